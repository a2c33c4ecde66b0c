import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrule.llm import suffixtree, tokens
from ferrule.llm.queries import QUERIES

from ..conftest import SF_MID, SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = object()


def words(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), END]


def check(rows, docs, held):
    c = Counter(w for d, t in docs if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in docs:
        w = words(t)
        want[d, held(d), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID, "/root/testdata/sf0.1"])
def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op7_lm"](spark, sf).collect()
    check(rows, docs, lambda d: zlib.crc32(str(d).encode()) % 7 == 2)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_contexts_are_learned(spark):
    rng = np.random.default_rng(1)
    docs = []
    for i in range(300):  # what follows "a" depends on what stands before it
        w = []
        for _ in range(60):
            first = str(rng.choice(["x", "y"]))
            w += [first, "a", {"x": "p", "y": "q"}[first]]
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    m = suffixtree.learn(df)
    assert len(m.tree.pairs) >= 2 and (m.tree.one > 0).any()
    assert np.allclose((10.0 ** m.tree.table.astype(float)).sum(axis=1), 1, atol=1e-3)
    rows = suffixtree.score_texts(df, F.col("doc_id") % 5 == 0).collect()
    per_token = sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    assert per_token > math.log10(0.5) / 3 - 0.03  # one free choice in three words


def test_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n "), (4, "A a\x0bÀ à"), (None, "a"), (5, "new words here"), (5, "new words here"),
            (6, "w" * 9000 + " " + "a " * 200_000), (7, "a b")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, held_out string, K int")
    check(suffixtree.score_texts(df, F.col("doc_id") == 5).collect(), docs, lambda d: d == 5)
    nothing = suffixtree.score_texts(df, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in nothing)
    assert suffixtree.score_texts(df.limit(0), F.lit(False)).collect() == []


def test_shares_of_a_class_sum_to_one(spark):
    df = spark.createDataFrame([(i, " ".join(f"r{(i * k) % 977}t" for k in range(40))) for i in range(300)], "doc_id long, text string")
    m = suffixtree.learn(df)
    rare = [r.c for r in m.counts.collect() if r.c * suffixtree.ALPHABET < m.tokens]
    if rare:
        total = sum(c - m.discount for c in rare) + m.discount * len(rare)
        assert total == pytest.approx(sum(rare))


def test_parts_of_a_long_text_run_on(monkeypatch):
    text = pa.array(["one two three four " * 300, "", "x y", "tail  " * 50])
    known = suffixtree.Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 20, np.int64), 0, 0)

    def read():
        reader, out = suffixtree._Reader(known), []
        for chunk in tokens.chunks(text):
            key, _, _, symbol, one, two, of, _ = reader.read(chunk)
            out += [(int(chunk.texts[t]), int(s), int(a), int(b)) for s, a, b, t in zip(symbol, one, two, of, strict=True)]
        return out

    whole = read()
    monkeypatch.setattr(tokens.chunks, "__defaults__", (100, 512))
    assert [x for x in whole if x[0] != 1] == [x for x in read() if x[0] != 1]


def test_rare_sequences_are_kept_in_a_large_corpus(spark):
    """What an entry or a context needs is a count, not a share of the tokens."""
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 30_000, 3000))) for i in range(300)]
    docs += [(1000 + i, t) for i, t in enumerate(["uno dos tres cuatro", "duo dos tres cinco"] * 3)]
    asked = [(-1, "uno dos tres cuatro"), (-2, "uno dos tres cinco"), (-3, "duo dos tres cuatro"), (-4, "duo dos tres cinco")]
    rows = suffixtree.score_texts(spark.createDataFrame(docs + asked, "doc_id long, text string"), F.col("doc_id") < 0).where("held_out").collect()
    assert rows[0].train_tokens > 2 * suffixtree.ENTRIES  # a sequence seen three times has under 1 / ENTRIES of the tokens
    score = {r.doc_id: r.score for r in rows}
    assert score[-1] > score[-2] + 0.5 and score[-4] > score[-3] + 0.5  # three words back decide


def test_tables_against_plain_counts(spark, monkeypatch):
    texts = ["a b c d", "a b c d e", "x b c d", "b c", "", None, "a  b", "a b a b a b"] * 3
    docs = [(i, t) for i, t in enumerate(texts)] + [(-1, "a b c d e"), (-2, "x b e d new"), (-3, "")]
    learn, flat = suffixtree.learn, math.log10(0.01)

    def flat_base(rows):
        m = learn(rows)
        none = np.zeros(0, dtype=np.int64)
        return m._replace(tree=suffixtree.Tree(np.zeros_like(m.tree.one), none, none, np.full((1, m.known.end + 1), flat)))

    monkeypatch.setattr(suffixtree, "learn", flat_base)
    rows = suffixtree.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") < 0).collect()

    counts, after, one = Counter(), {}, Counter(w for t in texts for w in words(t))
    for t in texts:
        seq = [END, *words(t)]
        for d in range(1, suffixtree.DEPTH + 1):
            for i in range(d, len(seq)):
                after.setdefault(tuple(seq[i - d:i]), Counter())[seq[i]] += 1
    n = sum(one.values())

    def rest(h):
        return sum(suffixtree.DISCOUNT if c >= suffixtree.MIN_COUNT else c for c in after[h].values()) / sum(after[h].values())

    def entry(h, w):
        c = after[h][w]
        return (c - suffixtree.DISCOUNT) / sum(after[h].values()) if c >= suffixtree.MIN_COUNT else 0

    def p(h, w, base):
        """``w`` after ``h``; at last ``base``, or where that is None the word's share."""
        if not h:
            return one[w] / n if base is None else base
        shorter = p(h[1:], w, base)
        return entry(h, w) + rest(h) * shorter if stays(h) else shorter

    def stays(h):
        if max(after.get(h, {0: 0}).values()) < suffixtree.MIN_COUNT:
            return False
        return sum((q := entry(h, w) + rest(h) * (s := p(h[1:], w, None))) * math.log(q / s) for w in one) >= suffixtree.DIVERGENCE

    for r in rows:
        seq = [END, *words(dict(docs)[r.doc_id])]
        want = sum(math.log10(p(tuple(seq[max(0, i - suffixtree.DEPTH):i]), seq[i], 10 ** flat)) for i in range(1, len(seq)))
        assert r.score == pytest.approx(want, abs=1e-4), r


def pieces_of(monkeypatch, texts, size):
    """Rows of ``_pieces`` without Spark, texts read in small chunks and pieces of about ``size`` words."""
    monkeypatch.setattr(suffixtree, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(suffixtree, "PIECE", size)
    monkeypatch.setattr(tokens.chunks, "__defaults__", (100, 512))
    batch = pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string()), "held_out": [i % 3 == 1 for i in range(len(texts))]})
    return list(suffixtree._pieces(iter(batch.to_batches())))


TEXTS = ["one two three four " * 90, "", None, "x y", "w" * 300 + " tail  " * 50, " " * 250 + "late", "a " + " " * 300]


def test_pieces_hold_the_sequences_of_whole_texts(monkeypatch):
    def read(size):
        out = Counter()
        for row in pieces_of(monkeypatch, TEXTS, size):
            ids, piece = row.column("doc_id")[0].as_py(), suffixtree._Piece.load(row.column("piece")[0].as_py())
            keys, text, place, is_word, back, levels = piece.sequences()
            for d, (x, g) in enumerate(levels, start=1):
                out.update((ids[t], d, int(a), int(b)) for t, a, b, n in zip(text, x, g, place, strict=True) if n >= d)
            out.update((ids[t], 0, int(k), int(w)) for t, k, w in zip(text, keys[back[0]], is_word, strict=True))
        return out

    want = Counter()
    for i, t in enumerate(TEXTS):
        want[i] = len(words(t))
    whole = read(1 << 20)
    assert len(pieces_of(monkeypatch, TEXTS, 20)) > len(TEXTS)
    assert read(20) == whole
    assert Counter({i: sum(n for k, n in whole.items() if k[:2] == (i, 0)) for i in range(len(TEXTS))}) == want


def test_training_reads_no_held_out_text(monkeypatch):
    rows = pieces_of(monkeypatch, TEXTS, 20)
    ends = sum(len(p.size) - p.goes_on for p in suffixtree._training(iter(rows)))
    assert ends == sum(i % 3 != 1 for i in range(len(TEXTS)))


def test_sequences_that_occur_once_are_not_sent(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 400)) for _ in range(60)] + ["uno dos tres cuatro", "b", "uno dos tres cuatro"]
    rows, bits = pieces_of(monkeypatch, texts, 2000), 1 << 22
    maps, by_part = np.zeros((suffixtree.DEPTH, suffixtree.RANGES, bits // suffixtree.RANGES // 8), np.uint8), {}
    for r in suffixtree._taken_slots(bits)(iter(rows)):
        for part, block in zip(r.column("part").to_pylist(), r.column("block").to_pylist(), strict=True):
            by_part.setdefault(part, []).append(block)
    for part, blocks in by_part.items():
        found = suffixtree._taken_twice(bits)(pa.table({"part": [part] * len(blocks), "block": blocks}))
        maps[part // suffixtree.RANGES, part % suffixtree.RANGES] = suffixtree._load(found.column("block")[0].as_py())[0]
    value = SimpleNamespace(value=maps.tobytes())
    homes = suffixtree._Homes(4, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sent, seen = Counter(), [Counter() for _ in range(suffixtree.DEPTH)]
    for r in suffixtree._followers(value, homes)(iter(rows)):
        for block in r.column("block").to_pylist():
            arrays = suffixtree._load(block)[1:]
            for d in range(1, suffixtree.DEPTH + 1):
                sent[d] += len(arrays[0])
                arrays = arrays[d + 2:]
    for p in suffixtree._training(iter(rows)):
        _, _, place, _, _, levels = p.sequences()
        for d, (_, g) in enumerate(levels):
            seen[d].update(g[place > d].tolist())
    for d in range(1, suffixtree.DEPTH + 1):
        twice = sum(n > 1 for n in seen[d - 1].values())
        assert 0 < twice <= sent[d] < twice + 0.05 * len(seen[d - 1])


def test_sequences_are_sent_with_what_they_share(monkeypatch):
    """Blocks of several tasks' worth hold every count once, beside the entry one word shorter, and merge to plain counts."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 300)) for _ in range(40)]
    rows = pieces_of(monkeypatch, texts, 500)
    bits = SimpleNamespace(value=np.full((suffixtree.DEPTH, 1 << 13), 255, np.uint8).tobytes())
    often = np.sort(suffixtree._Piece.load(rows[0].column("piece")[0].as_py()).words)[:3]
    homes = suffixtree._Homes(6, often, np.array([2, 6, 3]))
    monkeypatch.setattr(suffixtree, "SEQUENCES", 3000)
    by_part = {}
    for r in suffixtree._followers(bits, homes)(iter(rows)):
        for part, block in zip(r.column("part").to_pylist(), r.column("block").to_pylist(), strict=True):
            by_part.setdefault(part, []).append(block)
            _, *values = suffixtree._load(block)
            assert [len(v) for v in values[4:5]] == [0] and [len(v) for v in values[8:10]] == [0, 0]  # words that the shorter entry has
    assert max(len(b) for b in by_part.values()) > 2
    got = [Counter() for _ in range(suffixtree.DEPTH)]
    for part, blocks in by_part.items():
        merged = suffixtree._merge(pa.table({"part": [part] * len(blocks), "block": blocks})).column("block")[0].as_py()
        for d, (before, _, key, count) in enumerate(suffixtree._merged_levels(merged)):
            mine = np.ones(len(key), bool) if d else homes.base(before) == part
            assert not set(got[d]) & set(key[mine].tolist())
            got[d].update(dict(zip(key[mine].tolist(), count[mine].tolist(), strict=True)))
    want = [Counter() for _ in range(suffixtree.DEPTH)]
    for p in suffixtree._training(iter(rows)):
        _, _, place, _, _, levels = p.sequences()
        for d, (_, g) in enumerate(levels):
            want[d].update(g[place > d].tolist())
    assert got == [Counter({k: c for k, c in w.items() if c > 1}) for w in want]


def test_a_sequence_counts_only_if_those_inside_do():
    g = np.arange(1, 7, dtype=np.uint64) * np.uint64(8)  # slots by depth
    levels, place = [(g, g)] * suffixtree.DEPTH, np.array([1, 2, 3, 4, 1, 2])
    bits = np.zeros((suffixtree.DEPTH, 16), np.uint8)
    bits[0, [1, 2, 4, 5, 6]] = 1  # all but the third
    bits[1:] = 1
    found = suffixtree._possible(bits, levels, place)
    assert [f.tolist() for f in found] == [[0, 1, 3, 4, 5], [1, 5], []]


def test_a_text_in_several_pieces_is_one_row(spark):
    docs = [(1, "a b c " * 450_000), (2, "a b d")]  # more words than a piece has
    rows = suffixtree.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), F.lit(False)).collect()
    long = next(r for r in rows if r.doc_id == 1)
    assert len(rows) == 2 and long.n_tokens == long.n_known == 1_350_001
    assert long.base_score == pytest.approx(1_350_000 * math.log10(450_002 / 1_350_011), rel=1e-3)
    assert -100 < long.score < 0  # each word follows from the one before


def test_index_finds_what_is_there():
    keys = np.unique(np.random.default_rng(7).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    index = suffixtree._Index(keys)
    assert np.array_equal(index.find(keys), np.arange(len(keys)))
    assert (index.find(keys + np.uint64(1)) == len(keys)).all() and (index.find(np.array([2**64 - 1], np.uint64)) == len(keys)).all()
    assert suffixtree._Index(keys[:0]).find(keys[:3]).tolist() == [0, 0, 0]
