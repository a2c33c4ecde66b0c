import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ferrule.llm import packing
from ferrule.llm.common import materialize

from ..conftest import SF_MID
from .test_mixing import WORD, targets
from .test_neardup import brute
from .test_packing import check as check_packing


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF_MID}/documents.parquet"), []
    for name, stage in cp.STAGES:
        after = materialize(stage(spark, docs, SF_MID), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(steps):
    assert [n for n, _, _ in steps] == ["quality", "near_duplicates", "mixing", "packing"]
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns


def test_quality_rejects_junk_and_keeps_the_rest(spark, steps):
    _, before, after = steps[0]
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q"))
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    of = [(r.q, r.doc_id in kept) for r in before.join(labels, "doc_id").select("doc_id", "q").collect()]
    good, bad = [k for q, k in of if q == 1], [k for q, k in of if q == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.25


def test_one_document_of_each_group_stays(steps):
    _, before, after = steps[1]
    docs = [(r.doc_id, r.text) for r in before.collect()]
    want = brute(docs, 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, c) in want.items() if d == c)
    texts = dict(docs)
    assert all(r.text == texts[r.doc_id] for r in after.collect())


def test_mix_meets_its_targets(steps):
    _, before, after = steps[2]
    count = lambda rows: {s: sum(len(WORD.findall(r.text or "")) for r in rows if r.source == s) for s in {r.source for r in rows}}
    sizes, taken = count(before.collect()), count(after.collect())
    for s, want in targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= 1
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_packing_holds_every_id(steps):
    _, before, after = steps[3]
    check_packing(after.collect(), [(r.doc_id, r.text) for r in before.collect()])


def test_result_holds_the_ids_of_cut_and_repeated_documents(steps):
    _, before, after = steps[3]
    rows = after.collect()
    assert rows and all(len(r.ids) == r.length for r in rows)
    ids = {tuple(r.input_ids[:r.n_tokens]) for r in packing.sequences(after).collect()}
    assert sum(map(len, ids)) <= sum(r.length for r in rows) and len(ids) > 1


def test_run_and_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None, 1.0, "x"), (2, "", "en", "a", 0, 1.0, "x"), (3, "a few words", "en", "a", 11, 1.0, "x"),
                                  (4, "a few words", "en", None, 11, 1.0, "x"), (None, "no id", "en", "b", 5, 1.0, "x")],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double, shard string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    for name, d, lab in (("odd", docs, labels), ("empty", docs.limit(0), labels.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        lab.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        kept = cp.mix_sources(spark, cp.drop_near_duplicates(spark, cp.keep_quality(spark, d, f"{tmp_path}/{name}"), ""), "")
        assert kept.dtypes == d.dtypes and {(r.score, r.shard) for r in kept.collect()} <= {(1.0, "x")}
        out = cp.run(spark, f"{tmp_path}/{name}")
        assert {"doc_id", "sequence_id", "offset"} <= set(out.columns)
        assert out.count() == 0 or name == "odd"


def test_rows_are_told_apart_without_ids(spark):
    text = [" ".join(f"{a}{i}" for i in range(40)) for a in "abcd"]
    rows = [(3, text[0]), (5, text[0]), (5, text[1]), (7, text[2]), (7, text[2]), (None, text[3]), (None, text[3]), (None, None), (9, text[3]), (None, "")]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, key string")
    out = cp.drop_near_duplicates(spark, docs, "")
    assert out.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(3, text[0]), (5, text[1]), (7, text[2]), (9, text[3]), (None, None), (None, "")], key=str)
