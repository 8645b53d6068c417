"""Latency statistics that are kept up to date: measurements in sorted blocks, whose heads give counts, sums and ranks.

Each batch of measurements (an hour's, say) is written once: for each operation its durations in order, cut into blocks of ``BLOCK`` values, a row with the
block's smallest and largest value, number and sum. On reading, totals are sums over heads. A rank's value is bracketed by
heads alone: at most as many values are below ``v`` as the blocks that begin below it hold, and at least as many as those that end below it hold. Only
blocks that reach into a bracket are opened, for exact ranks; all other values are never read, whatever the number of batches.

Defined results: as ``latency.stats``; null durations aren't counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import latency as L
from corvane.storage import cut

#: Values of a block, and of a share of one operation's values that is sorted in one place.
BLOCK, SHARE = 512, 1 << 20


def blocks(metrics: DataFrame, batch: str) -> DataFrame:
    """``operation, batch, low, high, n, total, data``: the durations of a batch in sorted blocks. An operation with many is dealt into shares, each sorted by itself."""
    rows = metrics.filter("duration IS NOT NULL").select("operation", F.col("duration").cast("double").alias("duration"), F.monotonically_increasing_id().alias("__place"))
    shares = rows.groupBy(F.col("operation").alias("__o")).agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("__n"))  # one row for each operation
    dealt = rows.join(F.broadcast(shares), F.col("operation").eqNullSafe(F.col("__o"))).withColumn("__share", F.pmod(F.xxhash64("__place"), F.col("__n")))
    place = F.row_number().over(Window.partitionBy("operation", "__share").orderBy("duration")) - 1
    numbered = dealt.withColumn("__block", F.floor(place / BLOCK))
    made = numbered.groupBy("operation", "__share", "__block").agg(F.min("duration").alias("low"), F.max("duration").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("duration").alias("total"), F.sort_array(F.collect_list("duration")).alias("data"))  # BLOCK at most
    return made.select("operation", F.lit(batch).alias("batch"), "low", "high", "n", "total", "data")


def add(metrics: DataFrame, path: str, batch: str) -> None:
    """Adds a batch to the table at ``path``; one that is added again under its name takes the place of the former."""
    blocks(metrics, batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def opened(kept: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals of each operation; the bracket of each rank (``operation, name, rank, lo, hi``) by heads alone; and which blocks reach into one."""
    heads = kept.select("operation", "low", "high", "n", "total")
    totals = cut(heads.groupBy("operation").agg(F.sum("n").alias("count"), F.sum("total").alias("total_time"), F.min("low").alias("min_time"), F.max("high").alias("max_time")), "totals")
    ranks = totals.select("operation", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), of(F.col("count")).cast("long").alias("rank")) for name, of in L.RANKS.items()))).alias("r")).select(F.col("operation").alias("__o"), "r.*")

    def reached(edge: str) -> DataFrame:
        """The smallest edge at which the blocks up to it hold more values than the rank."""
        sums = heads.groupBy("operation", edge).agg(F.sum("n").alias("n"))
        upto = sums.withColumn("__upto", F.sum("n").over(Window.partitionBy("operation").orderBy(edge).rowsBetween(Window.unboundedPreceding, 0)))
        met = upto.join(F.broadcast(ranks), F.col("operation").eqNullSafe(F.col("__o")) & (F.col("__upto") > F.col("rank")))
        return met.groupBy(F.col("operation").alias("o"), "name", "rank").agg(F.min(edge).alias(edge))

    low, high = reached("low").withColumnRenamed("low", "lo"), reached("high").select(F.col("o").alias("__p"), F.col("name").alias("__name"), F.col("high").alias("hi"))
    brackets = cut(low.join(high, F.col("o").eqNullSafe(F.col("__p")) & (F.col("name") == F.col("__name"))).select("o", "name", "rank", "lo", "hi"), "brackets")
    return totals, brackets, kept.join(F.broadcast(brackets), F.col("operation").eqNullSafe(F.col("o")) & (F.col("high") >= F.col("lo")) & (F.col("low") <= F.col("hi")))


def stats(kept: DataFrame) -> DataFrame:
    """``latency.STATS`` of each operation from a table of blocks (``blocks``, read back)."""
    totals, brackets, reach = opened(kept)
    below = kept.select("operation", "high", "n").join(F.broadcast(brackets), F.col("operation").eqNullSafe(F.col("o")) & (F.col("high") < F.col("lo"))).groupBy("o", "name").agg(F.sum("n").alias("__below"))
    values = reach.select("o", "name", "rank", "lo", "hi", F.explode("data").alias("v")).filter("v <= hi")
    counted = values.groupBy("o", "name", "rank", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    first = below.select(F.col("o").alias("__p"), F.col("name").alias("__name"), "__below")
    order = Window.partitionBy("o", "name").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(F.broadcast(first), F.col("o").eqNullSafe(F.col("__p")) & (F.col("name") == F.col("__name")), "left").withColumn("__upto", F.sum("c").over(order) + F.coalesce("__below", F.lit(0)))
    exact = ranked.filter((F.col("__upto") > F.col("rank")) & F.col("v").isNotNull()).groupBy("o").pivot("name", list(L.RANKS)).agg(F.min("v"))
    out = totals.join(exact, F.col("operation").eqNullSafe(F.col("o")))
    derived = {"avg_time": F.col("total_time") / F.col("count"), "median_time": (F.col("median_lo") + F.col("median_hi")) / 2, "p95_time": F.col("p95"), "p99_time": F.col("p99")}
    return out.withColumns(derived).select(*L.STATS.split(", "))


def values_read(kept: DataFrame) -> DataFrame:
    """``n_all, n_read``: values of the table, and of the blocks that ``stats`` opens."""
    _, _, reach = opened(kept)
    once = reach.select("operation", "batch", "low", "high", "n", F.xxhash64("data").alias("h")).distinct()
    return kept.agg(F.sum("n").alias("n_all")).join(once.agg(F.sum("n").alias("n_read")))
