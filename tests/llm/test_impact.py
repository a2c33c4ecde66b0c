import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import impact
from ferrule.llm.queries import OP9_SQL, QUERIES
from tools.oracle_check import digest


def brute(rows, k):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in dict((tuple([i, tuple(v)]), (i, v)) for i, v in whole if i % 20 == 0).values():
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in whole if c != q and len(a) == len(b))[:k]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, k, schema="vec_id long, embedding array<double>"):
    out = impact.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0, k)
    return sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    df, res = QUERIES["op9_topk"](spark, f"/root/testdata/{sf}"), con.sql(OP9_SQL)
    rows, want = [tuple(r) for r in df.collect()], res.fetchall()
    assert rows and digest(df.columns, rows)[0] == digest(res.columns, want)[0]


def test_blocks_ties_and_early_stops(spark, monkeypatch):
    monkeypatch.setattr(impact, "CANDIDATES", 70)
    monkeypatch.setattr(impact, "QUERIES", 9)
    rng = np.random.default_rng(4)
    x = np.where(rng.random((500, 12)) < 0.15, rng.normal(size=(500, 12)) * 20, rng.normal(size=(500, 12)) * 0.05)
    x[100:200] = x[7]  # one very common vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    for k in (1, 20, 600):
        assert found(spark, rows, k) == brute(rows, k)


def test_cases(spark):
    rows = [(0, [1.0, -0.5], "a", 1), (20, [float("nan"), 1.0], "a", 1), (40, None, "a", 1), (60, [None, 1.0], "a", 1), (80, [], "a", 1),
            (100, [1.0], "a", 1), (1, [0.01, -0.01], "a", 1), (2, [0.01, -0.01], "a", 1), (None, [9.0, 9.0], "a", 1),
            (0, [1.0, -0.5], "a", 1), (120, [0.0, 0.0], "a", 1), (3, [1e6, 1e6], "a", 1), (140, [1e10, -1e10], "a", 1)]
    assert found(spark, rows, 20, "vec_id long, embedding array<double>, RANK string, score int") == brute([r[:2] for r in rows], 20)
    assert found(spark, [], 20) == [] and found(spark, [(20, [1.0])], 20) == []


def test_segments_are_by_descending_impact_and_whole():
    x = np.random.default_rng(5).integers(-60, 60, (40, 9))
    parts = impact.segments(x)
    assert np.array_equal(sum(p for p, _ in parts), x)
    rest = x.copy()
    for p, bound in parts:
        rest = rest - p
        assert np.abs(rest).max() <= bound
