import math

import numpy as np
import pytest

from ferrule.llm import covertree
from ferrule.llm.queries import QUERIES

from ..conftest import SF_MID, SF_SMALL


def brute(rows, cosine):
    """Links and components; rows are (id, vector, label)."""
    n, links = len(rows), [0] * len(rows)
    ok = [r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) > 0
          and all(x is not None and math.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1]) for r in rows]
    up = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    x = [np.array(r[1], dtype=np.float64) if k else None for r, k in zip(rows, ok, strict=True)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                if float(x[i] @ x[j]) / math.sqrt(float(x[i] @ x[i]) * float(x[j] @ x[j])) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                    up[b] = a
    return sorted((r[0] is None, r[0] or 0, k, root(r[0]) if r[0] is not None else None) for r, k in zip(rows, links, strict=True))


def got(df):
    out = df.collect()
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out)
    return sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in out)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(QUERIES["op6_embeddings"](spark, sf)) == brute(rows, 0.98)


def clusters(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] * rng.uniform(0.2, 5, (n, 1)) + rng.normal(size=(n, dim)) * spread
    return [(i, [float(v) for v in row], int(rng.integers(0, 2))) for i, row in enumerate(x)]


@pytest.mark.parametrize("spread", [0.02, 0.2, 1.0])
def test_clusters_over_many_nodes_and_blocks(spark, monkeypatch, spread):
    monkeypatch.setattr(covertree, "NODE_ROWS", 40)
    monkeypatch.setattr(covertree, "BLOCK", 25)
    rows = clusters(3, 400, 5, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for cosine in (0.9, 0.98, 0.9999):
        assert got(covertree.near_vectors(df, cosine)) == brute(rows, cosine)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1),
            (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [1.0, None], 1), (10, [inf, 0.0], 1), (11, [1.0, 0.0, 0.0], 1),
            (12, [1.0, 0.0], 1), (13, [-0.0, 1.0], 1), (14, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (15, [1e-30, 0.0], 1),
            (16, [1e30, 0.0], 1)]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "vec_id long, embedding array<float>, label int, pivot string, H int")
    assert got(covertree.near_vectors(df)) == brute(rows, 0.98)
    assert covertree.near_vectors(df.limit(0)).collect() == []
    twins = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (3, None, None)]
    out = got(covertree.near_vectors(spark.createDataFrame(twins, "vec_id long, embedding array<double>, label int")))
    assert out == [(False, 1, 2, 1), (False, 1, 2, 1), (False, 2, 1, 1), (False, 2, 2, 1), (False, 3, 0, 1), (False, 3, 1, 1)]


def test_levels_halve_and_cover():
    x = np.random.default_rng(2).normal(size=(500, 4))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    todo = [(covertree.build(x, 0.01), None)]
    while todo:
        node, above = todo.pop()
        far = np.sqrt(np.maximum(2 - 2 * x[node.members] @ x[node.centre], 0))
        assert node.radius >= far.max() - 1e-9
        if node.children:
            assert node.children[0].centre == node.centre  # nested
            assert np.array_equal(np.sort(np.concatenate([c.members for c in node.children])), np.sort(node.members))
            assert max(c.radius for c in node.children) <= node.radius
        todo += [(c, node) for c in node.children]
