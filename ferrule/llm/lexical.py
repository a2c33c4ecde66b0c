"""Ranked lexical search by bags: equal documents are scored once, then expanded.

A document's bag is its term counts, restricted to the items' terms, with the length norm ``m`` of its
whole text. Documents of one bag score alike for every item, so they form a class: bags are grouped by
a 64-bit hash together with the counts and ``m`` themselves, so that the hash deals them out and
equality confirms them. Each class is scored once for all items of a block; a task keeps ten classes
an item. Only the classes that are among an item's best are expanded, to their smallest ids.

The k best documents lie in the k best classes, by descending score, then smallest id: a class outside them
is preceded by k documents. Of one class at most k members are needed. So nothing grows with a class.

Items go through in blocks of at most ``PAIRS`` (item, term) pairs, or one item, so what a task holds of them (their
terms and weights) is bounded; a further block is a further pass over the documents. Counts and corpus
statistics cover whole texts of all documents, and a text is counted piece by piece.

Cases: null texts have no terms, and documents without any don't count; rows that repeat are
documents each; a null doc_id comes last among equal scores; rows of one item_id (or of the null one) are one item;
items without terms, and empty tables, give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, running_total, short_batches

#: What a term is made of (a fixed value): everything but ASCII's separators and signs.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

PAIRS, PIECE, CELLS, EXPANDED = 200_000, 1 << 20, 1 << 21, 1 << 22

#: Byte by byte: separators to blanks, A-Z to a-z. Bytes of other letters are above 127 and stay.
_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[bytes]:
    """``text``, translated, in pieces of about ``PIECE`` bytes that end where a term does."""
    at = 0
    while at < len(text):
        part = text[at:at + PIECE].translate(_BYTES)
        end = at + PIECE
        while end < len(text):  # the rest of the term that the cut went through
            more = text[end:end + 4096].translate(_BYTES)
            stop = more.find(b" ")
            part += more if stop < 0 else more[:stop]
            end += len(more) if stop < 0 else stop
            if stop >= 0:
                break
        yield part
        at = end


def count_terms(text: bytes, ids: dict[bytes, int]) -> tuple[int, list[int], list[int]]:
    """How many terms the text has, and the ids and counts of those in ``ids``, by ascending id."""
    n, counts = 0, Counter()
    for piece in pieces(text):
        words = piece.split()
        n += len(words)
        for word, c in Counter(words).items():
            if (i := ids.get(word)) is not None:
                counts[i] += c
    known = sorted(counts)
    return n, known, [counts[i] for i in known]


def _bags(terms: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {t.encode(): i for i, t in enumerate(terms)}
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            n, known, counts = [], [], []
            for text in texts:
                bag = count_terms(text.as_py() or b"", ids)
                n.append(bag[0]), known.append(bag[1]), counts.append(bag[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"])

    return run


class Best:
    """The k best classes of each item so far: by descending score, then smallest id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items)
        self.item = self.score = self.first = self.none = self.row = None

    def add(self, item, score, first, none, row) -> None:
        """Take in scored classes; ``row`` says where each is."""
        new = (item, score, first, none, row)
        if self.item is not None:
            new = tuple(np.concatenate(p) for p in zip((self.item, self.score, self.first, self.none, self.row), new, strict=True))
        by = np.lexsort((new[2], new[3], -new[1], new[0]))
        by = by[np.arange(len(by)) - np.searchsorted(new[0][by], new[0][by]) < self.k]
        self.item, self.score, self.first, self.none, self.row = (x[by] for x in new)
        # an item with k classes takes no further one below its k-th score
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) >= self.k)
        ends = np.searchsorted(self.item, full, side="right") - 1
        self.least[full] = self.score[ends]


def _score(weights: np.ndarray, holders: tuple[np.ndarray, np.ndarray], n_items: int, k: int):
    """Score classes for all items: each posting (class, term) adds to the items that hold the term."""
    starts, items = holders
    held = np.diff(starts)
    exact = float(np.bincount(items, weights=np.repeat(weights.astype(np.float64), held), minlength=n_items).max(initial=0)) * 1e6 < 2**53

    def contributions(terms, tfs, m):
        return weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))

    def sums(rows, terms, value, n_rows):
        """The score of every (class, item), classes in rows."""
        many = held[terms]
        at = np.repeat(starts[terms] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        cell = np.repeat(rows, many) * n_items + items[at]
        if exact:  # below 2**53 sums of doubles are whole and exact
            return np.bincount(cell, weights=np.repeat(value.astype(np.float64), many), minlength=n_rows * n_items).astype(np.int64)
        out = np.zeros(n_rows * n_items, dtype=np.int64)
        np.add.at(out, cell, np.repeat(value, many))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kept = Best(n_items, k), {}
        for number, batch in enumerate(batches):
            lists = batch.column("terms")
            ends = np.asarray(lists.offsets).astype(np.int64)
            terms = np.asarray(lists.values.slice(0)).astype(np.int64)
            tfs = np.asarray(batch.column("tfs").values).astype(np.int64)
            m = np.asarray(batch.column("m")).astype(np.int64)
            none = np.asarray(batch.column("first").is_null().to_numpy(zero_copy_only=False))
            first = batch.column("first").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            work = np.concatenate(([0], np.cumsum(held[terms])))[ends]
            at = 0
            while at < batch.num_rows:
                # as many classes as the score table and the postings' work allow, one at least
                to = min(at + max(1, CELLS // n_items), int(np.searchsorted(work, work[at] + EXPANDED, side="right")) - 1)
                to = min(max(to, at + 1), batch.num_rows)
                span = slice(ends[at], ends[to])
                rows = np.repeat(np.arange(to - at), np.diff(ends[at:to + 1]))
                score = sums(rows, terms[span], contributions(terms[span], tfs[span], m[at:to][rows]), to - at).reshape(to - at, n_items)
                cls, item = np.nonzero((score > 0) & (score >= best.least[None, :]))
                if len(cls):
                    best.add(item, score[cls, item], first[at + cls], none[at + cls], (number << 32) + at + cls)
                at = to
            if best.row is not None:
                here = np.unique(best.row[best.row >> 32 == number]) & 0xFFFFFFFF
                kept[number] = (here, batch.take(pa.array(here)))
                for old in set(kept) - set(np.unique(best.row >> 32).tolist()):
                    del kept[old]
        if best.row is None:
            return
        for number, (here, rows) in sorted(kept.items()):
            mine = best.row >> 32 == number
            picked = rows.take(pa.array(np.searchsorted(here, best.row[mine] & 0xFFFFFFFF)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.item[mine], pa.int32()), pa.array(best.score[mine], pa.int64()),
                 *[picked.column(c) for c in ("key", "m", "terms", "tfs", "first")]],
                names=["item", "score", "key", "m", "terms", "tfs", "first"])

    return run


def _blocks(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, int]:
    """(block, item_id, term) of all items, and the number of blocks; a block has about ``PAIRS`` rows, or one item."""
    terms = materialize(items.select(F.col(f"`{item_id}`").alias("item_id"), F.explode(F.regexp_extract_all(
        lower_ascii(F.col(f"`{text}`")), F.lit(TERM), F.lit(0))).alias("term")).distinct(), "lexical-terms")
    sizes = materialize(terms.groupBy("item_id").agg(F.count("*").alias("pairs")), "lexical-items")
    n = sizes.count()
    if not n:
        return terms, 0
    placed = materialize(running_total(sizes, [], F.col("pairs"), [F.col("item_id")], "before", n)
                         .withColumn("block", F.floor(F.col("before") / PAIRS)).select("item_id", "block"), "lexical-blocks")
    return (materialize(terms.join(placed, terms["item_id"].eqNullSafe(placed["item_id"])).select("block", terms["item_id"], "term"), "lexical-pairs"),
            placed.agg(F.max("block")).first()[0] + 1)


def _holders(pairs: DataFrame) -> tuple[list, list[str], tuple[np.ndarray, np.ndarray]]:
    """Of one block's pairs (bounded): the item ids, the terms, and for each term the items that hold it."""
    rows = pairs.toArrow()
    ids = pa.compute.unique(rows.column("item_id"))
    terms = pa.compute.unique(rows.column("term")).sort()
    item = pa.compute.index_in(rows.column("item_id"), ids).to_numpy()
    term = pa.compute.index_in(rows.column("term"), terms).to_numpy()
    order = np.argsort(term, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(terms))))).astype(np.int64)
    return ids.to_pylist(), terms.to_pylist(), (starts, item[order].astype(np.int64))


def _best_of_block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    ids, terms, holders = _holders(pairs)
    bags = docs.mapInArrow(_bags(terms), "doc_id long, n long, terms array<int>, tfs array<int>")
    bags = materialize(bags.where("n > 0"), "lexical-bags")
    n_docs, n_terms = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    big = "decimal(38,0)"
    norm = F.expr(f"CAST(10 + (CAST(90 * n AS {big}) * CAST({n_docs} AS decimal(18,0))) div CAST({n_terms} AS {big}) AS long)")
    bags = bags.where(F.size("terms") > 0).withColumn("m", norm).withColumn("key", F.xxhash64("terms", "tfs", "m"))
    same = ["key", "m", "terms", "tfs"]
    classes = materialize(bags.groupBy(*same).agg(F.min("doc_id").alias("first"), F.count("*").alias("members")), "lexical-classes")
    df = classes.select(F.explode("terms").alias("term"), "members").groupBy("term").agg(F.sum("members").alias("df"))
    weigh = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = np.zeros(len(terms), dtype=np.int64)
    for term, w in df.select("term", weigh).collect():  # one row a term of the block
        weights[term] = w
    scored = classes.select(*same, "first").mapInArrow(
        _score(weights, holders, len(ids), k), "item int, score long, key long, m long, terms array<int>, tfs array<int>, first long")
    place = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("first").asc_nulls_last(), *same)
    top = materialize(scored.withColumn("at", F.row_number().over(place)).where(F.col("at") <= k).drop("at", "first"), "lexical-top")
    # at most k keys of 8 bytes for each of the block's items: hashes find the members, the counts confirm them
    hashed = bags.join(F.broadcast(top.select("key").distinct()), "key", "left_semi")
    inside = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last()))
    members = hashed.select(*same, "doc_id").withColumn("nth", inside).where(F.col("nth") <= k)
    found = top.join(members, same).select("item", "score", "doc_id")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "item_id": pa.array(ids, pa.int64())}))
    best = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents that score highest above 0 for each item's terms."""
    spark = docs.sparkSession
    short_batches(spark)
    pairs, blocks = _blocks(items, item_id, item_text)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        out = out.unionByName(materialize(_best_of_block(rows, pairs.where(F.col("block") == b).drop("block"), k), "lexical-best"))
    return out
