import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm import packing
from ferrule.llm.queries import QUERIES, bpe_ranks

from ..conftest import SF_MID, SF_SMALL


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def one_by_one(counts, window):
    """Best fit decreasing, one piece at a time: how full the windows get (which of two equally full ones is no matter)."""
    open_ = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        fit = [w for w in open_ if window - sum(w) >= length]
        if fit:
            max(fit, key=sum).append(length)
        else:
            open_.append([length])
    return Counter(sum(w) for w in open_)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=15))
def test_plan_is_best_fit_decreasing(counts):
    plan, windows = packing.best_fit_decreasing(counts, 40), defaultdict(list)
    for length, n in counts.items():
        steps = sorted(p for p in plan if p[0] == length)
        for r in range(n):
            _, rank, base, each, first = [p for p in steps if p[1] <= r][-1]
            i = r - rank
            windows[base + i // each].append((first + i % each * length, length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 40
    assert sorted(windows) == list(range(len(windows)))
    assert Counter(sum(n for _, n in w) for w in windows.values()) == one_by_one(counts, 40)


def check(rows, docs, window=2048):
    """Pieces cover every document's ids once; windows are gapless. Returns tokens by sequence."""
    ids = reference_ids([t or "" for _, t in docs])
    want = Counter()
    for (d, _), i in zip(docs, ids, strict=True):
        for at in range(0, len(i), window):
            piece = np.array(i[at:at + window], "<u4")
            want[d, at, len(piece), zlib.crc32(piece.tobytes()), len(i)] += 1
    assert Counter((r.doc_id, r.start, r["length"], r.ids_crc32, r.doc_tokens) for r in rows) == want
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r["length"]))
    used = {}
    for s, pieces in windows.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        used[s] = at
    return used


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used = check(QUERIES["op3_packing"](spark, sf).collect(), docs)
    assert len(used) <= -(-sum(used.values()) // 2048) + 2


def test_cases(spark):
    long = " ".join(f"wörd{i % 977}, " for i in range(60_000)) + " " * 5000 + "x" * 30_000
    docs = [(1, None), (2, ""), (None, "a b"), (3, "<|endoftext|> it's\r\n\t 12  \x85 é"), (3, "same"), (3, "same"),
            (4, long), (5, "\0 \n")]
    df = spark.createDataFrame([(d, t, 3, "z") for d, t in docs], "doc_id long, text string, Length int, steps string")
    check(packing.pack(df, bpe_ranks()).collect(), docs)
    assert packing.pack(df.limit(0), bpe_ranks()).collect() == []
    assert packing.sequences(packing.pack(df.limit(0), bpe_ranks(), keep_ids=True)).collect() == []


def test_sequences_hold_the_ids(spark):
    docs = [(i, "word " * (i % 90)) for i in range(300)] + [(999, "many tokens, " * 900)]
    ids = dict(zip([d for d, _ in docs], reference_ids([t for _, t in docs]), strict=True))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pieces = packing.pack(df, bpe_ranks(), window=64, keep_ids=True)
    where = {(r.sequence_id, r.offset): r for r in pieces.collect()}
    rows = packing.sequences(pieces, window=64).collect()
    for r in rows:
        assert len(r.input_ids) == (r.n_tokens if r.n_tokens.bit_count() == 1 else 64)
    for (s, offset), p in where.items():
        row = next(r for r in rows if r.sequence_id == s)
        assert row.input_ids[offset:offset + p["length"]] == ids[p.doc_id][p.start:p.start + p["length"]]
    assert sum(r.n_tokens for r in rows) == sum(map(len, ids.values()))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1 \n\t'., é<|>")), max_size=300))
def test_parts_do_not_change_the_ids(text):
    enc = packing.encoder(bpe_ranks())
    cut = list(packing.parts(text, 7))
    assert "".join(cut) == text
    assert [i for p in cut for i in enc.encode_ordinary(p)] == reference_ids([text])[0][:-1]


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\r\n \u3000"])
def test_long_white_space_has_the_librarys_ids(space):
    for n in (9_999, 10_000, 10_001, 1_200_000):
        run = (space * n)[:n]
        texts = [run, "a" + run, run + "b", "a " + run + "b c" + run + "\n!", "x" + run + "\x1cq"]
        enc = packing.encoder(bpe_ranks())
        for text, want in zip(texts, reference_ids(texts), strict=True):
            got = np.concatenate([packing.token_ids(enc, part) for part in packing.parts(text)])
            assert np.array_equal(got, want[:-1])


def test_five_million_blanks_are_packed(spark):
    df = spark.createDataFrame([(1, " " * 5_000_000 + "end"), (2, "\n" * 1_500_000)], "doc_id long, text string")
    rows = packing.pack(df, bpe_ranks()).collect()
    for doc in (1, 2):
        mine = sorted((r.start, r.length) for r in rows if r.doc_id == doc)
        assert sum(n for _, n in mine) == next(r.doc_tokens for r in rows if r.doc_id == doc)
