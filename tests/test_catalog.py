"""Every registered query with a DuckDB twin gives the same rows as it."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import learning
from quillspark.plans import catalog
from quillspark.streaming import requests

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([plain(v[i]) for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = catalog.queries()[name](spark, DATA)
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(x) for x in got.collect()]) == rows(want.columns, want.fetchall())


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    "given, kept",
    [("<think>a</think>b", "b"), ("<THINKING>a\nb</THINKING> c ", "c"), ("[reasoning]x[/reasoning]y", "y"), ("a<think>left open", "a"), ("plain", "plain"), (None, None), ("<think>all</think>", "")],
)
def test_strip_reasoning(spark, given, kept):
    assert one(spark, T.strip_reasoning(F.col("t").cast("string")), t=given) == kept


def test_greedy_packing(spark):
    def plainly(parts, budget, joint):
        out, now = [], None
        for p in parts:
            if now is not None and len(now) + len(p) + joint > budget:
                out.append(now)
                now = None
            now = p if now is None else now + "\n" * joint + p
        return out + ([now] if now is not None else [])

    for parts in ([], ["a" * 5] * 4, ["a" * 400, "b", "c" * 297, "d"], ["x" * 299, "y" * 300, "z" * 301]):
        got = spark.createDataFrame([(parts,)], "p array<string>").select(T.packed(F.col("p"), 300, 2)).first()[0]
        assert got == plainly(parts, 300, 2)


def test_answers(spark):
    match = lambda kind, a, b: one(spark, learning.answer_matches(F.col("k"), F.col("a"), F.col("b")), k=kind, a=a, b=b)
    assert match("single_choice", " a ", "A") and not match("short_answer", "x", "x")
    assert match("multi_choice", "b，A", '["a","b"]') and not match("multi_choice", "a", "a,b")


def test_stream_of_requests(spark, tmp_path):
    schema = "request_id string, ts timestamp"
    spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:10:00'), ('b', timestamp'2024-01-01 00:11:00') t(request_id, ts)").coalesce(1).write.json(f"{tmp_path}/in")
    stream = requests.once_each(spark.readStream.schema(schema).json(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(x["request_id"] for x in spark.table("once").collect()) == ["a", "b"]
