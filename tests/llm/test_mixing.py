import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ferrule.llm import mixing
from ferrule.llm.queries import QUERIES

from ..conftest import SF_MID, SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), ratio=1.5):
    """Water filling, one round after the other. ``sizes``: words by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), ratio * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > 2 * sizes[s]}
        for s in full or free:
            out[s] = 2.0 * sizes[s] if full else w[s] * level
        if not full:
            return out
        left -= sum(out[s] for s in full)
        free -= full
    return out


def check(rows, docs):
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = targets(sizes), defaultdict(int)
    source = {d: s for d, _, s in docs}
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((d, len(WORD.findall(t or ""))) for d, t, _ in docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op1_mixing"](spark, sf).collect()
    check(rows, docs)
    again = QUERIES["op1_mixing"](spark, sf).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string, source string" + more)


def test_shards_get_their_quotas(spark):
    docs = [(i, "w " * (1 + i * 37 % 50), f"s{i % 4}") for i in range(1500)]
    df = frame(spark, docs)
    mixed = mixing.mix(df, block_words=16, shard_words=1500).collect()
    total = sum(len(r.text.split()) for r in mixed)
    assert abs(total - 1.5 * sum(len(t.split()) for _, t, _ in docs)) <= 2
    load = defaultdict(int)
    for r in mixed:
        load[r.shard] += len(r.text.split())
    n = max(load) + 1
    assert n == -(-total // 1500) or n == total // 1500 + 1
    # a block's documents start in it: a source's run may begin and end inside a document
    assert all(abs(v - total / n) <= 16 + 2 * 4 * 50 for v in load.values())
    order = [(r.shard, r.shuffle_key) for p in mixing.in_shards(mixing.mix(df, block_words=16, shard_words=1500))
             .rdd.glom().collect() for r in p]
    assert len(order) == len(mixed)


def test_cases(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, " \t", "b"), (4, "x\x0by z", None), (5, "w " * 70_000, "b"),
            (6, "é é", "Ä"), (7, "same text", "a"), (8, "same text", "a"), (None, "no id", "a")]
    out = mixing.plan_mix(frame(spark, [(*d, 1, "t") for d in docs], ", Size int, TARGET string")).select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"))
    rows = out.where("doc_id is not null").collect()
    sizes = {"a": 6, "b": 70_000, None: 3, "Ä": 1}
    want = targets(sizes)
    for r in rows:
        s = {d: s for d, _, s in docs}[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 2 * r.size
    assert sum(r.taken for r in out.collect()) == pytest.approx(sum(want.values()), abs=2)
    twice = frame(spark, [(1, "a b c", "s")] * 4)
    assert sum(r.words for r in mixing.plan_mix(twice).select(F.explode("draws.words").alias("words")).collect()) == 18
    assert mixing.plan_mix(frame(spark, [])).collect() == [] and mixing.mix(frame(spark, [])).collect() == []
    assert mixing.plan_mix(frame(spark, [(1, None, None)])).collect()[0].draws == []


def test_cut_keeps_the_text_up_to_a_word(spark):
    df = spark.createDataFrame([("  a\n\nb\tc  d ", 3)], "t string, n int")
    assert df.select(mixing.first_words(F.col("t"), F.col("n"))).first()[0] == "  a\n\nb\tc"


def test_hypergeometric_follows_its_law(spark):
    for n, total, good, draws in ((20_000, 50, 20, 10), (20_000, 1000, 3, 400), (2000, 10**7, 10**6, 10**4),
                                  (100, 10, 10, 4), (100, 10, 0, 4)):
        df = spark.range(n).select(mixing.hypergeometric(
            F.lit(total), F.lit(good), F.lit(draws), mixing._uniform(F.col("id"))).alias("x"))
        r = df.agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
        p = good / total
        var = draws * p * (1 - p) * (total - draws) / (total - 1)
        assert abs(r.m - draws * p) <= 5 * (var / n) ** 0.5 + 1e-9
        assert abs(r.v - var) <= 8 * var / n**0.5 + 1e-9
        assert r.lo >= max(0, draws + good - total) and r.hi <= min(good, draws)
