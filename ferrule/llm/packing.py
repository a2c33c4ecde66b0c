"""Packing: best-fit decreasing over the whole corpus, from piece counts by length.

Every document is tokenized, gets an end id, and is cut into full windows; what remains of it
is shorter than a window. Best fit decreasing looks at lengths only, so it runs on the counts
of pieces by length (at most one number for each length up to the window): lengths from long
to short, each into the open window with the least room that still holds it. A segment tree
indexed by remaining room finds that window. Windows with the same history are handled at
once, so the work depends on the window's size, not on the corpus. The outcome says, for the
r-th piece of a length, its sequence and offset; pieces are numbered within their length
by ``running_total``. This is the packing that best fit decreasing gives one piece at a time.

Tokens: the ranks of a public byte-level BPE (the vocabulary file is a parameter); a
special token's string inside a text is ordinary text. Very long texts are tokenized in
parts, cut before a blank that follows a non-blank, where the vocabulary's own pattern
always cuts.

Cases: a null text is empty; an empty text is the end id alone; repeated rows are rows of
their own; null ids are kept. Equal lengths are numbered by document, start and checksum.
Other columns are ignored, whatever their names. No documents: no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_total, short_batches
from .tokens import releasing

WINDOW, END_ID, PART_CHARS, SHIFT = 2048, 1, 1_000_000, 1 << 15
#: More plan rows than this are joined without a broadcast (one row takes about 48 bytes).
PLAN_BROADCAST_ROWS = 100_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """The vocabulary as ranks; one ``base64-token rank`` pair a line."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``size``, cut only before a blank that follows a non-blank."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


#: Runs of white space (what the vocabulary's pattern calls so) that its regular expression would step back through.
SPACES = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_SPACE = re.compile(f"(?<!{SPACES}){SPACES}{{10000,}}+")


def token_ids(enc, text: str) -> np.ndarray:
    """The ids of ``text``; it ends where the whole text ends, or in a non-blank.

    The pattern takes a run of white space as one piece: whole at the text's end, else without its last character,
    which goes with what follows. Long runs are given as that piece, so that no regular expression runs over them."""
    out, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if at < run.start():
            out.append(enc.encode_to_numpy(text[at:run.start()]))
        out.append(np.array(enc._encode_single_piece(text[run.start():end]), np.uint32))
        at = end
    if at < len(text):
        out.append(enc.encode_to_numpy(text[at:]))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _tokenize(ranks_path: str, window: int, end_id: int, keep_ids: bool, short: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        rows: list[tuple] = []
        kept: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            arrays, fields = [pa.array(c, pa.int64()) for c in cols], list(names)
            if keep_ids:
                ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
                flat = np.concatenate(kept) if kept else np.zeros(0, np.uint32)
                held = (flat.astype(np.int32) - SHIFT).astype(np.int16) if short else flat.astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(held)))
                fields.append("ids")
            rows.clear()
            kept.clear()
            return pa.RecordBatch.from_arrays(arrays, fields)

        tokens = 0
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc, text in zip(ids_of, texts, strict=True):
                first, start, rest = len(rows), 0, np.zeros(0, np.uint32)
                body = text.as_py() or ""
                for part in parts(body):
                    rest = np.concatenate([rest, token_ids(enc, part)]) if len(part) else rest
                    while len(rest) >= window:
                        piece, rest = rest[:window], rest[window:]
                        rows.append((doc, start, window, zlib.crc32(piece.astype("<u4").tobytes()), 0))
                        start += window
                        if keep_ids:
                            kept.append(piece)
                rest = np.concatenate([rest, np.array([end_id], np.uint32)])
                rows.append((doc, start, len(rest), zlib.crc32(rest.astype("<u4").tobytes()), 0))
                if keep_ids:
                    kept.append(rest)
                total = start + len(rest)
                rows[first:] = [(*r[:4], total) for r in rows[first:]]
                tokens += total
                if tokens >= 1_000_000:
                    yield flush()
                    tokens = 0
        yield flush()

    return run


class RoomTree:
    """Segment tree over remaining room 0..size: which rooms have an open window."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, has: bool) -> None:
        at = self.leaves + room
        self.any[at] = has
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that has an open window."""
        at = self.leaves + least
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first sequence, pieces a sequence, offset of the first of them).

    Piece r of a length belongs to the row with the largest first rank up to r; with i = r -
    first rank its sequence is first sequence + i div pieces, its offset is the row's offset
    plus (i mod pieces) times the length.
    """
    tree, plan, made = RoomTree(window), [], 0
    open_: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, how many)

    def add(room: int, base: int, n: int) -> None:
        if room and n:
            open_.setdefault(room, []).append((base, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, base, n = window, made, -(-left // (window // length))
                made += n
            else:
                base, n = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, base, each, window - room))
                add(room - each * length, base, full)
                rank, left = rank + full * each, left - full * each
            some = left if full < n and left < each else 0
            if some:
                plan.append((length, rank, base + full, some, window - room))
                add(room - some * length, base + full, 1)
                rank, left = rank + some, 0
            add(room, base + full + bool(some), n - full - bool(some))
    return plan


def pack(docs: DataFrame, ranks_path: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id",
         text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    short_batches(spark)
    # ids below 2**16 are written and shuffled as two bytes each
    short = keep_ids and max(encoder(ranks_path).max_token_value, end_id) < 2 * SHIFT
    schema = PIECES + (f", ids array<{'smallint' if short else 'int'}>" if keep_ids else "")
    pieces = materialize(
        docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(releasing(_tokenize(ranks_path, window, end_id, keep_ids, short)), schema), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = best_fit_decreasing(counts, window)
    plan = spark.createDataFrame(rows, "plan_length long, rank long, base long, each long, first long")
    steps = plan.groupBy("plan_length").agg(F.array_sort(F.collect_list(F.struct("rank", "base", "each", "first"))).alias("steps"))
    if len(rows) <= PLAN_BROADCAST_ROWS:
        steps = F.broadcast(steps)
    ranked = running_total(pieces, ["length"], F.lit(1),
                           [F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")], "r", sum(counts.values()))
    at = ranked.join(steps, F.col("length") == F.col("plan_length")).withColumn(
        "s", F.element_at(F.filter("steps", lambda x: x["rank"] <= F.col("r")), -1))
    i = F.col("r") - F.col("s.rank")
    columns = [F.transform("ids", lambda x: x.cast("int") + SHIFT).alias("ids") if short and c == "ids" else F.col(c) for c in pieces.columns]
    return at.select(*columns, (F.col("s.base") + F.floor(i / F.col("s.each"))).alias("sequence_id"),
                     (F.col("s.first") + (i % F.col("s.each")) * F.col("length")).alias("offset"))


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """The packed sequences of ``pack(..., keep_ids=True)``: sequence_id, n_tokens, doc_ids, starts, input_ids.

    ``input_ids`` is padded to the window, except where the sequence's own length is a power of two.
    """
    one = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids"))).alias("p"),
        F.sum("length").alias("n_tokens"))
    bare = F.bit_count(F.col("n_tokens")) == 1
    ids = F.flatten(F.col("p.ids"))
    pad = F.array_repeat(F.lit(pad_id), F.when(bare, 0).otherwise(window - F.col("n_tokens")).cast("int"))
    return one.select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"),
                      F.concat(ids, pad).alias("input_ids"))
