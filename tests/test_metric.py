"""Nearest vectors for many queries by metric partitions, against all pairs."""

import numpy as np
import pytest

from quillspark.operators import metric


def plain(vectors, queries, n):
    ok = [(k, np.array(v, dtype=float)) for k, v in vectors if k is not None and v and len(v) == 8 and None not in v]
    ok = [(k, v / np.linalg.norm(v)) for k, v in ok if np.isfinite(v).all() and v.any()]
    out = []
    for q, v in {q: v for q, v in queries if v and len(v) == 8}.items():
        u = np.array(v) / np.linalg.norm(v)
        out += [(q, k, s) for s, k in sorted(((-round(float(u @ x), 6), k) for k, x in ok))[:n] for s in [-s]]
    return sorted(out)


@pytest.mark.parametrize("spread, n, cut", [(0.05, 5, 40), (1.0, 5, 65_536), (0.05, 700, 65_536)])
def test_recall(spark, monkeypatch, spread, n, cut):
    """On clustered vectors most are never visited; without clusters, with slices, ties and odd rows the result is right as well."""
    monkeypatch.setattr(metric, "SLICE", cut)
    monkeypatch.setattr(metric, "QUERIES", 7)
    r = np.random.default_rng(3)
    centre = r.normal(size=(20, 8))
    vectors = [(i, list(map(float, centre[i % 20] + r.normal(size=8) * spread))) for i in range(600)]
    vectors += [(700, vectors[5][1]), (701, vectors[5][1]), (702, None), (703, []), (704, [0.0] * 8), (705, [1.0, None] + [0.0] * 6), (706, [float("inf")] * 8), (707, [1.0, 2.0]), (None, vectors[0][1]), (708, [-x for x in vectors[0][1]])]
    queries = [(k, v) for k, v in vectors[::50] if v] + [(5000, vectors[5][1]), (5001, [0.5] * 3), (5002, None)]
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found, work = metric.recall(df(vectors), df([*queries, queries[0]]), n)
    got = sorted(map(tuple, found.collect()))
    want = plain(vectors, queries, n)
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)
    rows = work.collect()
    compared, whole = sum(x["vectors"] * x["queries"] for x in rows), sum(x["vectors"] for x in rows) * (len(queries) - 2)
    if spread < 0.1 and n == 5:
        assert compared < 0.3 * whole
    assert compared <= whole


def test_no_queries_or_vectors(spark):
    some = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert metric.recall(some, some.where("false"), 3)[0].count() == 0
    assert metric.recall(some.where("false"), some, 3)[0].count() == 0
    assert [tuple(x) for x in metric.recall(some, some, 3)[0].collect()] == [(1, 1, 1.0)]
