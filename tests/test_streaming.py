"""Windowed statistics over a stream of measurements."""

from corvane.streaming import events as X


def test_windowed_stats(spark, tmp_path):
    schema = "operation string, timestamp timestamp, duration double"
    rows = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 3.0), ("b", "2024-01-01 00:20:00", 5.0), ("a", "2024-01-01 03:00:00", 7.0)]
    df = spark.createDataFrame(rows, "operation string, timestamp string, duration double").selectExpr("operation", "cast(timestamp AS timestamp) AS timestamp", "duration")
    src = str(tmp_path / "in")
    df.write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    query = X.windowed_stats(stream).writeStream.format("memory").queryName("windowed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    found = {(str(r["start"]), r["operation"]): (r["count"], r["total_time"], r["avg_time"]) for r in spark.table("windowed").collect()}
    assert found == {("2024-01-01 00:00:00", "a"): (2, 4.0, 2.0), ("2024-01-01 00:00:00", "b"): (1, 5.0, 5.0)}
