import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from ferrule.llm import lexical
from ferrule.llm.queries import OP11_SQL, QUERIES
from tools.oracle_check import digest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n, length = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out, by_item = [], {}
    for i, text in items:
        by_item.setdefault(i, set()).update(terms(text))
    for item, want in by_item.items():
        scored = []
        for i, c, size in bags:
            m = 10 + (90 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in want if t in c)
            scored += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=10, docs_schema="doc_id long, text string", items_schema="item_id long, text string"):
    out = lexical.search(spark.createDataFrame(docs, docs_schema), spark.createDataFrame(items, items_schema), k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    df, res = QUERIES["op11_lexical"](spark, f"/root/testdata/{sf}"), con.sql(OP11_SQL)
    rows, want = [tuple(r) for r in df.collect()], res.fetchall()
    assert rows and digest(df.columns, rows)[0] == digest(res.columns, want)[0]


def corpus(rnd, n):
    words = ["a", "B", "c9", "été", "ÉTÉ", "dé", "e" * 30, "zz", "q", "w"]
    return ["".join(rnd.choice([" ", ",", "\n", "_", "\x7f"]) + rnd.choice(words) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_blocks_copies_and_ties(spark, monkeypatch):
    rnd = random.Random(8)
    docs = [(i, t) for i, t in enumerate(corpus(rnd, 150))]
    docs += [(1000 - i, docs[3][1]) for i in range(200)] + [(7, docs[7][1]), (None, docs[7][1]), (None, "a zz"), (5000, None), (5001, "")]
    items = [(i, t) for i, t in enumerate(corpus(rnd, 12))] + [(3, "zz"), (None, "a b"), (50, None), (51, "!!"), (52, "nowhere")]
    want = {k: brute(docs, items, k) for k in (1, 10, 400)}
    assert found(spark, docs, items, 10) == want[10]
    for name, value in (("PAIRS", 20), ("CELLS", 30), ("EXPANDED", 40), ("PIECE", 16)):
        monkeypatch.setattr(lexical, name, value)
    for k in want:
        assert found(spark, docs, items, k) == want[k]


def test_equal_hashes_do_not_join_classes(spark, monkeypatch):
    rnd = random.Random(9)
    docs, items = list(enumerate(corpus(rnd, 120))), list(enumerate(corpus(rnd, 6)))
    real = lexical.F.xxhash64
    monkeypatch.setattr(lexical.F, "xxhash64", lambda *c: lexical.F.pmod(real(*c), lexical.F.lit(3)))
    assert found(spark, docs, items) == brute(docs, items, 10)


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [], []) == []
    docs = [(1, "a b", "x", 1), (2, "b", "x", 1)]
    assert found(spark, docs, [(9, "b a", "t")], 10, "doc_id long, text string, SCORE string, terms int", "item_id long, text string, rank string") == brute(
        [d[:2] for d in docs], [(9, "b a")], 10)


def test_a_text_is_counted_whole_in_pieces(monkeypatch):
    text = ("été " * 50 + "x" * 200 + " É,zz\n").encode() * 5
    whole = lexical.count_terms(text, {b"zz": 0, "été".encode(): 1})
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert lexical.count_terms(text, {b"zz": 0, "été".encode(): 1}) == whole
    assert whole == (len(terms(text.decode())), [0, 1], [5, 250])


def test_sums_beyond_doubles_are_exact():
    import pyarrow as pa

    weights, n = np.array([2**36, 2**35], dtype=np.int64), 2
    run = lexical._score(weights, (np.array([0, 2, 3]), np.array([0, 1, 0])), n, 3)
    batch = pa.RecordBatch.from_pydict({"key": [1, 2], "m": [10, 20], "terms": pa.array([[0, 1], [0]], pa.list_(pa.int32())),
                                        "tfs": pa.array([[3, 4], [5]], pa.list_(pa.int32())), "first": pa.array([5, None], pa.int64())})
    got = {(r["item"], r["key"]): r["score"] for b in run([batch]) for r in b.to_pylist()}
    part = lambda w, tf, m: w * ((10**9 * tf) // (1000 * tf + 8 * m))
    assert got == {(0, 1): part(2**36, 3, 10) + part(2**35, 4, 10), (1, 1): part(2**36, 3, 10), (0, 2): part(2**36, 5, 20), (1, 2): part(2**36, 5, 20)}
