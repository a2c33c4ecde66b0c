import random

import numpy as np
from pyspark.sql import functions as F

from ferrule.llm import common


def brute(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up if root(x) != x}


def test_components(spark):
    r = random.Random(2)
    cases = [[], [(1, 1)], [(1, 2), (1, 3), (1, 2)], [(i, i + 1) for i in range(150)], [(150 - i, 151 - i) for i in range(60)],
             [(r.randrange(300), r.randrange(300)) for _ in range(220)], [(99, i) for i in range(50)] + [(-5, 99)]]
    for edges in cases:
        got = common.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
        assert {x.id: x.component for x in got} == brute(edges) and len(got) == len(brute(edges))


def test_running_total(spark):
    rows = [(i % 3, (i * 37) % 11, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, w long, i long")
    out = common.running_total(df, ["k"], F.col("w"), [F.col("i")], "t", 400).collect()
    for k in range(3):
        mine = sorted((x.t, x.w) for x in out if x.k == k)
        at = 0
        for t, w in sorted(mine, key=lambda p: (p[0], p[1])):
            assert t == at
            at += w
        assert at == sum(w for kk, w, _ in rows if kk == k)


def test_short_batches_only_lower(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for given, want in (("64m", 4 << 20), ("1m", 1 << 20), ("2097152b", 2 << 20), ("1g", 4 << 20)):
        spark.conf.set(key, given)
        common.short_batches(spark)
        got = spark.conf.get(key)
        assert got == given or int(got.rstrip("b")) == want
        assert want == 4 << 20 or got == given or int(got.rstrip("b")) <= want
    spark.conf.set(key, before)


def test_components_over_many_chunks(spark, monkeypatch):
    """Each task holds a few links only: several levels, and a hub whose links lie in all of them."""
    r = random.Random(6)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        path = list(range(400))
        r.shuffle(path)
        hub = [(200, 1000 + i) for i in range(300)] + [(1000 + i, 3000 + i) for i in range(0, 300, 3)] + [(-1, 200)]
        for edges in (list(zip(path, path[1:])), hub, [(r.randrange(500), r.randrange(500)) for _ in range(400)]):
            df = spark.createDataFrame(edges, "a long, b long").repartition(17)
            got = common.connected(df, "a", "b").collect()
            assert {x.id: x.component for x in got} == brute(edges) and len(got) == len(brute(edges))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_contraction_of_a_chunk():
    r = random.Random(7)
    for n in (1, 2, 30, 500):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(n)]
        ids, roots = common._contract(*np.array(edges).T)
        assert dict(zip(ids.tolist(), roots.tolist(), strict=True)) == brute(edges)
    path = [(i, i + 1) for i in range(5000)]
    r.shuffle(path)
    ids, roots = common._contract(*np.array(path).T)
    assert len(ids) == 5000 and not roots.any()
