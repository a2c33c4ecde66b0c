import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import quality
from ferrule.llm.queries import QUERIES

from ..conftest import SF_MID

SF_TRAIN = "/root/testdata/sf0.1"


def test_query_on_held_out_rows(spark):
    rows = QUERIES["op4_quality"](spark, SF_TRAIN).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_TRAIN}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF_TRAIN}/documents.parquet")
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    right = np.mean([(s >= 0.5) == (y == 1) for s, y in held])
    kept = np.mean([s >= 0.5 for s in good])
    assert auc > 0.97 and right > 0.95 and kept > 0.98, (auc, right, kept)


def test_labels_held_out_teach_nothing_and_reruns_agree(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    one = quality.train(docs, labels.where(~held), max_rows=200)
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    two = quality.train(docs, flipped.where(~held), max_rows=200)
    for a, b in zip(one, two, strict=True):
        assert np.array_equal(a, b)


def test_linear_time_pairs_are_all_pairs():
    rng = np.random.default_rng(1)
    squares = rng.random((3, 20)).astype(np.float32)
    m = quality.Model(np.zeros((0, 9)), 0.3, rng.normal(size=20), rng.normal(size=(20, quality.RANK)))
    got = quality._logits(squares, m)[0]
    for row, z in zip(np.sqrt(squares), got, strict=True):
        pairs = sum(m.factors[i] @ m.factors[j] * row[i] * row[j] for i in range(20) for j in range(i))
        assert z == pytest.approx(0.3 + row @ m.weights + pairs, rel=1e-4)


def test_cases(spark):
    good = "a plain sentence with some words in it, number %d."
    docs = [(i, good % i if i % 2 else "BUY NOW!! " * (i % 30 + 3), i) for i in range(1, 400)]
    labels = [(i, i % 2, 0) for i in range(1, 400)] + [(None, 1, 0), (7, None, 0), (9, 5, 0), (3, 0, 0)]
    train = spark.createDataFrame(docs, "doc_id long, text string, n_chars int")
    model = quality.train(train, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), metadata=("n_chars",))
    long = (good % 1 + "\n") * 60_000
    rows = [(1, None, None, "x", 1.0), (2, "", 5, "x", 1.0), (None, "HOT!! HOT!!", 3, "x", 1.0), (4, long, 9, "x", 1.0),
            (5, good % 5, 2, "x", 1.0), (5, good % 5, 2, "x", 1.0), (6, "y" * 3_000_000, None, "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, source string, Score double")
    got = quality.score(df, model, metadata=("n_chars",))
    assert got.columns == ["doc_id", "text", "n_chars", "source", "score"]
    out = {(r.doc_id, r.text): r.score for r in got.collect()}
    assert len(got.collect()) == 7 and len(out) == 6 and all(0 <= s <= 1 for s in out.values())
    assert out[5, good % 5] > 0.9 > 0.1 > out[None, "HOT!! HOT!!"] and out[4, long] > 0.5
    assert quality.score(df.limit(0), model, metadata=("n_chars",)).collect() == []
    blank = quality.train(train, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(df, blank, keep=["doc_id"]).collect()} == {0.5}


def test_a_long_text_in_parts_has_the_same_features(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["some WORDS, and | marks!! " * 500, "", "short", "x y\n" * 3000])
    whole = list(quality._by_text(texts))
    from ferrule.llm import tokens

    monkeypatch.setattr(tokens.chunks, "__defaults__", (700, 512))
    cut = list(quality._by_text(texts))
    for got in (whole, cut):
        at = np.concatenate([g[0] for g in got])
        assert sorted(at.tolist()) in ([0, 1, 2, 3], [0, 2, 3])
    row = lambda got, i: next(np.concatenate([g[1], g[2]], axis=1)[np.flatnonzero(g[0] == i)[0]] for g in got if i in g[0])
    for i in (0, 2, 3):
        assert np.array_equal(row(whole, i), row(cut, i))
