"""Each registered query with SQL is held against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([repr(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == sorted_rows(names, found.fetchall())


def test_without_sql():
    """What has no SQL: recursive splitting, held against the specification in ``test_chunking``, what indexes read (``test_indexes``), content-defined chunks (``test_delta``), and the operations of ``tests/llm``."""
    assert {n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("op") and n != "pipeline"} == {"split_large_parents", "child_chunks", "child_chunks_sql", "chunk_pipeline", "chunk_delta", "sparse_index_reads", "dense_index_reads"}


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"qid", "rank", "id", "score"}
