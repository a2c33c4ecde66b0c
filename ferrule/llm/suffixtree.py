"""Language-model scores by a probabilistic suffix tree over words.

The tree has two parts. Its base, sent to all tasks, is over symbols; everything else is in Spark tables.

Tables: the contexts are the one to ``DEPTH`` words before (a text's beginning counts as one). Every next word seen at
least ``MIN_COUNT`` times after a context is an entry, whatever the corpus's size. A context stays if its discounted distribution diverges (Kullback-Leibler) from its longest shorter
suffix's by at least ``DIVERGENCE``. What a context's discounts leave over goes to the distribution of its
longest suffix that stays, at last to the base's.

Base: symbols are every word that makes up at least 1/``ALPHABET`` of the training tokens, one class of rarer words
for each last byte, and the end of a text (which also stands before its beginning). Contexts are the one
or two symbols before; a context is a node of the tree if it makes up at least 1/``CONTEXTS`` of
the tokens and its next-symbol distribution diverges (Kullback-Leibler) from that of its
shorter suffix by at least ``DIVERGENCE``. Each distribution is smoothed by an absolute discount
that goes to the shorter suffix's distribution. A token is scored in the longest suffix state that is in the tree;
a rare word's probability is its class's times its discounted share of the class, and an unseen word
gets what the discounts of its class left over. The base's limits are shares of the corpus, so it has a bounded size.

Texts are split into words once: ``_pieces`` writes the words of some texts as places in a list of the distinct ones,
and every later pass reads that. Counting deals a sequence by the word before its last one (for a frequent word, by the one
before that too), so a part has all shorter suffixes of its contexts and judges them by itself; a task sends one packed
value a part, not a row a sequence, and numpy merges the values of a part. A pass before it sends only slots of hashes,
about a byte a sequence, to find the slots that occur twice; sequences of other slots, or with such a sequence inside, occur once
and are not sent (a bitmap of 16 MB at most a level, which only skips work). Texts are scored by cells of ``CELL`` bytes or so: a cell
asks once for each of its distinct words and word sequences that the tables may hold, each part answers in the order of
the questions, and the answers meet the cell's texts. So a hot sequence costs an entry a cell, not one a token.

Words are told apart by 64-bit hashes. Cases: a null text is empty, and an empty one is its end alone; texts
without words likewise; null ids count as training rows unless the caller says otherwise; repeated rows are scored each;
without training rows the base score is 0 and the model knows nothing. Other columns are ignored, whatever their
names. No documents: no rows.
"""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fs
from .common import materialize, short_batches
from .neardup import BITMAP_BITS
from .tokens import chunks, mixed, release, releasing, words

ALPHABET, CONTEXTS, FREQUENT, ENTRIES, DIVERGENCE, DISCOUNT = 5_000, 1_000, 100_000, 400_000, 0.01, 0.5
DEPTH, MIN_COUNT = 3, 2
CELL = 8 << 20  # bytes of text
TURNS = 2  # in which parts are judged and asked: what is shuffled at once is that share of them
CELL_TURNS = 2  # in which the cells ask and are scored
PIECES = ["cell", "nr", "doc_id", "held", "piece"]
PIECE = 1 << 18  # words that are laid out at once (and those of a chunk more)
RANGES = 16  # in which the slots of a level are merged
END = 0x20  # stands for the end of a text and for its beginning; no word has this last byte
HELD = 1 << 20  # distinct keys that a task counts before it passes them on
SEQUENCES = 3 << 18  # places with a sequence of two words that a task holds before it passes them on
PART_TOKENS, LEAST_PARTS = 1 << 22, 16
ENTRY_BITS = 1 << 26  # at most, in a level's bitmap of the sequences that the tables may hold


class Words(NamedTuple):
    """The frequent words: sorted hashes, each one's count and symbol; where each hash prefix starts."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    first: np.ndarray
    run: int
    heavy: int  # symbols of single words; a class is heavy + last byte, the end is heavy + 256

    @property
    def end(self) -> int:
        return self.heavy + 256

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for a word that is not frequent."""
        at, out = self.first[(h >> np.uint64(44)).astype(np.int64)], np.full(len(h), -1, dtype=np.int64)
        for _ in range(self.run if len(self.hashes) else 0):
            near = np.minimum(at, len(self.hashes) - 1)
            out = np.where(self.hashes[near] == h, near, out)
            at = at + 1
        return out


class Tree(NamedTuple):
    """``one``: state by symbol (0: the root), ``pairs``: sorted symbol pairs that are states, ``states``
    theirs, ``table``: log10 probability by state and next symbol."""

    one: np.ndarray
    pairs: np.ndarray
    states: np.ndarray
    table: np.ndarray


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; ``np.unique`` without counts takes several times as long."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


class _Index:
    """Places of keys among sorted distinct ones, by the prefixes of hashes: a probe or two a key."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(1, len(keys).bit_length())
        self.shift, self.none = np.uint64(64 - bits), len(keys)
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        count = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.cumsum(count) - count

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, the number of all for one that is not among them."""
        out = np.full(len(keys), self.none, dtype=np.int64)
        at, left = self.first[(keys >> self.shift).astype(np.int64)], np.arange(len(keys))
        while len(left):
            here = self.keys[at]
            same = here == keys
            out[left[same]] = at[same]
            later = here < keys
            at, keys, left = at[later] + 1, keys[later], left[later]
        return np.minimum(out, self.none)


class _Counter:
    """Counts of 64-bit keys, merged now and then."""

    def __init__(self) -> None:
        self.keys, self.counts, self.n = [], [], 0

    def add(self, k: np.ndarray, c: np.ndarray) -> None:
        """Distinct keys and their counts."""
        self.keys.append(k)
        self.counts.append(c)
        self.n += len(k)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        k = np.concatenate(self.keys) if self.keys else np.zeros(0, np.uint64)
        c = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        by = np.argsort(k, kind="stable")
        k, c = k[by], c[by]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        k, c = k[new], np.add.reduceat(c, new) if len(k) else c
        self.keys, self.counts, self.n = [k], [c], len(k)
        return k, c


def _count(make):
    """An Arrow pass over pieces that counts the keys ``make`` yields for each: rows (k, c), aggregated within the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, keys = _Counter(), make()

        def rows(k, c):
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["k", "c"])

        for piece in _training(batches):
            counter.add(*keys(piece))
            if counter.n > HELD:
                k, c = counter.merge()
                if len(k) > HELD // 2:
                    yield rows(k, c)
                    counter = _Counter()
        yield rows(*counter.merge())

    return run


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays as one value, compressed byte by byte of their items."""
    head, body = [len(arrays)], []
    for x in arrays:
        if x.dtype != np.uint64 and x.dtype.kind in "iu":
            x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
        body.append(pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")
        head += [ord(x.dtype.char), len(x), len(body[-1])]
    return b"".join([np.array(head, "<i8").tobytes(), *body])


def _load(value: bytes, last: bool = False) -> list[np.ndarray]:
    """``last``: of the arrays only the last one."""
    n = int(np.frombuffer(value, "<i8", 1)[0])
    at, out = 8 + 24 * n, []
    for i, (char, size, length) in enumerate(np.frombuffer(value, "<i8", 3 * n, 8).reshape(n, 3).tolist(), start=1):
        if last and i < n:
            at += length
            continue
        kind = np.dtype(chr(char))
        raw = pa.decompress(value[at:at + length], decompressed_size=size * kind.itemsize, codec="zstd", asbytes=True) if size else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, size).T).reshape(-1).view(kind))
        at += length
    return out


class _Piece(NamedTuple):
    """Words of some texts; the first text may have begun, and the last one may go on, in another piece."""

    words: np.ndarray   # the distinct ones
    code: np.ndarray    # by word: its place there
    size: np.ndarray    # words by text
    before: np.ndarray  # up to DEPTH symbols before the first one
    runs_on: bool       # the first text began before
    goes_on: bool

    @classmethod
    def load(cls, value: bytes, keep: np.ndarray | None = None) -> _Piece:
        """``keep``: which texts."""
        known, code, size, before, flags = _load(value)
        code, size, runs_on, goes_on = code.astype(np.int64), size.astype(np.int64), bool(flags[0]), bool(flags[1])
        if keep is not None and not keep.all():
            code = code[np.repeat(keep, size)]
            runs_on, goes_on = runs_on and bool(keep[0]), goes_on and bool(keep[-1])
            before, size = before if keep[0] else np.array([END], np.uint64), size[keep]
        return cls(known, code, size, before, runs_on, goes_on)

    def lay(self):
        """By symbol: its text, its place there (from 1, or from that of ``before``), whether it is a word."""
        n = len(self.size)
        per = self.size + 1
        if self.goes_on:
            per[-1] -= 1
        text, ends = np.repeat(np.arange(n), per), np.cumsum(per)
        is_word = np.ones(len(text), dtype=bool)
        is_word[ends[:n - self.goes_on] - 1] = False
        place = np.arange(len(text)) - np.repeat(ends - per, per) + 1
        place[text == 0] += len(self.before) - 1
        return text, place, is_word

    def keys(self):
        """All keys; by symbol its text, place and whether it is a word; the places among the keys of itself, of the one before,
        up to that ``DEPTH`` before."""
        text, place, is_word = self.lay()
        keys = np.concatenate([self.words, np.array([END], np.uint64), self.before])
        end, m = len(self.words), len(self.before)
        line = np.full(DEPTH + len(text), end, dtype=np.int64)  # an end stands for the next text's beginning too
        line[DEPTH - m:DEPTH] = end + 1 + np.arange(m)
        line[DEPTH:][is_word] = self.code
        return keys, text, place, is_word, [line[DEPTH - d:len(line) - d] for d in range(DEPTH + 1)]

    def sequences(self):
        """As ``keys``, and by depth (key before, key) of the sequences. Those of a depth hold at places of at least the depth."""
        keys, text, place, is_word, back = self.keys()
        k, levels = keys[back[0]], []
        for d in range(DEPTH):
            if not d:
                x = keys[back[1]]
            else:
                first = keys[back[d + 1][:1]]
                for i in reversed(range(1, d + 1)):
                    first = _gram(first, keys[back[i][:1]])
                x = np.concatenate([first, levels[-1][1][:-1]])
            levels.append((x, _gram(x, k)))
        return keys, text, place, is_word, back, levels


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits the texts of rows (doc_id, text, held_out) into words: rows (cell, nr, doc_id, held, piece).

    A cell has successive texts of a task, of about ``CELL`` bytes; ``doc_id`` and ``held`` are by text of the piece."""
    cell = task = TaskContext.get().partitionId() << 32
    length = nr = 0
    for batch in batches:
        ids, held = batch.column("doc_id"), batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        keys, sizes, n, open_ = [], [], 0, False
        first, before, runs_on, last = 0, np.array([END], np.uint64), False, -1

        def row():
            code, distinct = pd.factorize(np.concatenate(keys))
            piece = _dump(distinct.astype(np.uint64), code, np.array(sizes, np.int64), before, np.array([runs_on, open_], np.uint8))
            mine = ids.slice(first, last + 1 - first)
            return pa.RecordBatch.from_arrays(
                [pa.array([cell], pa.int64()), pa.array([nr], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine),
                 pa.array([held[first:last + 1].tobytes()], pa.binary()), pa.array([piece], pa.binary())],
                PIECES)

        for chunk in chunks(batch.column("text").fill_null("")):
            w = words(chunk)
            keys.append(_keyed(chunk, w).astype(np.uint64))
            size = np.bincount(w.text, minlength=len(chunk.texts)).tolist()
            if open_ and sizes:
                sizes[-1] += size[0]
            else:
                sizes += size
            n, open_, last, length = n + len(keys[-1]), chunk.goes_on, int(chunk.texts[-1]), length + len(chunk.data)
            if n > PIECE:
                yield row()
                own = np.concatenate(keys)
                begun = before if len(sizes) == 1 else np.array([END], np.uint64)
                before = np.concatenate([begun, own[len(own) - sizes[-1]:]])[-DEPTH:] if open_ else np.array([END], np.uint64)
                first, runs_on, keys, sizes, n, nr = last + (not open_), open_, [], [], 0, nr + 1
                if not open_:
                    cell = task + length // CELL
        if sizes:
            yield row()
            nr += 1
        cell = task + length // CELL


def _split(docs: DataFrame, doc_id: str, text: str, held_out: Column) -> DataFrame:
    rows = docs.withColumn("__held", F.coalesce(held_out, F.lit(False))).select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col("__held").alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _kept(rows.mapInArrow(releasing(_pieces), f"cell long, nr long, doc_id array<{kind}>, held binary, piece binary"), "tree-pieces")


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[_Piece]:
    for batch in batches:
        for held, value in zip(batch.column("held"), batch.column("piece"), strict=True):
            keep = np.frombuffer(held.as_py(), bool) == 0
            if keep.any():
                yield _Piece.load(value.as_py(), keep)
                release()


def _word_keys():
    """Word hashes, the lowest byte replaced by the word's last byte: hash and class in one key."""
    def of(piece: _Piece):
        count = np.bincount(piece.code, minlength=len(piece.words))
        return piece.words[count > 0], count[count > 0]

    return of


def _keyed(chunk, w) -> np.ndarray:
    from .tokens import LOWERED

    return (w.hash & ~np.uint64(255)) | LOWERED[chunk.data[w.end - 1]].astype(np.uint64) if len(w.hash) else w.hash


class _Reader:
    """Symbols of texts with the two symbols before each; a text's parts in several chunks run on."""

    def __init__(self, known: Words) -> None:
        self.known, self.before = known, (known.end, known.end)

    def read(self, chunk):
        """(key, place in ``known``, text) by word; (symbol, one before, two before, text, is a word) by symbol."""
        w, known = words(chunk), self.known
        key, n = _keyed(chunk, w), len(chunk.texts)
        found = known.find(key)
        symbol = known.heavy + (key & np.uint64(255)).astype(np.int64)
        if len(known.symbols):
            symbol = np.where(found >= 0, known.symbols[found], symbol)
        closed = n - chunk.goes_on
        size = np.bincount(w.text, minlength=n)
        out = np.full(len(key) + closed, known.end, dtype=np.int64)
        place = np.arange(len(key)) + w.text
        out[place] = symbol
        is_word = np.zeros(len(out), dtype=bool)
        is_word[place] = True
        text = np.repeat(np.arange(n), size + (np.arange(n) < closed))
        starts = (np.cumsum(size) - size + np.arange(n))[1:]
        one = np.concatenate([[self.before[0]], out[:-1]]) if len(out) else out
        two = np.concatenate([[self.before[1]], one[:-1]]) if len(out) else out
        two[starts[starts < len(two)]] = known.end
        if not chunk.goes_on:
            self.before = (known.end, known.end)
        elif len(out):
            self.before = (int(out[-1]), int(one[-1]))
        return key, found, w.text, out, one, two, text, is_word


def _piece_symbols(known: Words, piece: _Piece, text: np.ndarray, place: np.ndarray, is_word: np.ndarray):
    """As ``_Reader.read``, of a piece: places in ``known`` of its distinct words; symbol, one before, two before by symbol."""
    def symbols(keys):
        found = known.find(keys)
        symbol = known.heavy + (keys & np.uint64(255)).astype(np.int64)
        return found, np.where(found >= 0, known.symbols[found], symbol) if len(known.symbols) else symbol

    found, symbol = symbols(piece.words)
    before = np.where(piece.before == END, known.end, symbols(piece.before)[1])
    line = np.full(len(text) + 2, known.end, dtype=np.int64)
    line[max(0, 2 - len(before)):2] = before[-2:]
    line[2:][is_word] = symbol[piece.code]
    two = np.where(place == 1, known.end, line[:-2])
    return found, line[2:], line[1:-1], two


def _gram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a sequence: the key of all but its last word, and that word's."""
    return mixed(before * np.uint64(0x9FB21C651E98DF25) + word)


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _possible(bits: np.ndarray, levels: list, place: np.ndarray) -> list[np.ndarray]:
    """By depth the places of sequences that may occur twice: a slot of their own says so, and those of the two sequences inside."""
    out, shorter = [], np.ones(len(place), dtype=bool)
    for d, (_, g) in enumerate(levels, start=1):
        inside = (place >= d) & shorter
        if d > 1:
            inside[1:] &= shorter[:-1]  # what stands before the piece is not known
        at = np.flatnonzero(inside)
        out.append(at[_maybe(bits[d - 1], g[at])])
        shorter = np.zeros(len(place), dtype=bool)
        shorter[out[-1]] = True
    return out


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of each key there, their counts; a key and its place are sorted as one number where they fit."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()) >> (64 - bits) == 0:
        packed = np.sort(keys << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64))
        by, keys = (packed & np.uint64((1 << bits) - 1)).astype(np.int64), packed >> np.uint64(bits)
    else:
        by = np.argsort(keys)
        keys = keys[by]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.empty(len(keys), dtype=np.int64)
    at[by] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return keys[first], at, np.diff(first, append=len(keys))


def _parted(of: np.ndarray, parts: int) -> list[np.ndarray]:
    """For each part that some keys belong to: (part, their places)."""
    by = np.argsort(of.astype(np.uint16) if parts <= 1 << 16 else of, kind="stable")
    cuts = np.searchsorted(of[by], np.arange(parts + 1))
    return [(p, by[a:b]) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _of_key(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys % np.uint64(parts)).astype(np.int64)


def _blocks(mine: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m[0] for m in mine], pa.int32()), pa.array([m[1] for m in mine], pa.binary())], ["part", "block"])


def _merged(keys: np.ndarray, counts: np.ndarray):
    """The place of one of each distinct key, in the order of keys, and their summed counts."""
    by = np.argsort(keys)
    new = np.flatnonzero(np.concatenate([[True], np.diff(keys[by]) != 0])) if len(keys) else np.zeros(0, np.int64)
    return by[new], np.add.reduceat(counts[by], new) if len(keys) else counts


def _taken_slots(bits: int):
    """An Arrow pass over pieces: rows (part, block), the slots of a level's sequences in a range, and whether twice in the task."""
    width = bits // RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[] for _ in range(DEPTH)], 0

        def rows():
            mine = []
            for level, some in enumerate(held):
                slot, count = np.unique(np.concatenate(some), return_counts=True)
                cuts = np.searchsorted(slot, np.arange(RANGES + 1) * width)
                for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b > a:
                        steps = np.diff(slot[a:b].astype(np.int64), prepend=r * width)
                        mine.append((level * RANGES + r, _dump(steps << 1 | (count[a:b] > 1))))
            return _blocks(mine)

        for piece in _training(batches):
            _, _, place, _, _, levels = piece.sequences()
            for d, (_, g) in enumerate(levels, start=1):
                held[d - 1].append((g[place >= d] & np.uint64(bits - 1)).astype(np.uint32))
            n += len(place)
            if n > 2 * SEQUENCES:
                yield rows()
                held, n = [[] for _ in range(DEPTH)], 0
                release()
        if n:
            yield rows()

    return run


def _taken_twice(bits: int):
    def run(table: pa.Table) -> pa.Table:
        seen = np.zeros(bits // RANGES, dtype=np.uint8)
        for block in table.column("block"):
            steps = _load(block.as_py())[0].astype(np.int64)
            slot = np.cumsum(steps >> 1)
            seen[slot] = np.minimum(seen[slot] + 1 + (steps & 1).astype(np.uint8), 2)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()),
                         "block": pa.array([_dump(np.packbits(seen > 1, bitorder="little"))], pa.binary())})

    return run


def _entry_slots(bits: int):
    """As ``_taken_slots``, an Arrow pass over merged parts, of the sequences there."""
    width = bits // RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("block"):
                mine = []
                for level, (_, _, g, _) in enumerate(_merged_levels(value.as_py())):
                    slot = _distinct((g & np.uint64(bits - 1)).astype(np.uint32))
                    cuts = np.searchsorted(slot, np.arange(RANGES + 1) * width)
                    for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if b > a:
                            mine.append((level * RANGES + r, _dump(np.diff(slot[a:b].astype(np.int64), prepend=r * width) << 1 | 1)))
                yield _blocks(mine)

    return run


def _bitmaps(rows: DataFrame, slots, n: int, most: int) -> Broadcast:
    """By level a bitmap of the slots that occur twice, as one value sent once for all later passes."""
    bits = 1 << 16
    while bits < min(8 * n, most):
        bits *= 2
    found = rows.mapInArrow(releasing(slots(bits)), "part int, block binary").groupBy("part").applyInArrow(
        _taken_twice(bits), "part int, block binary")
    out = np.zeros((DEPTH, RANGES, bits // RANGES // 8), dtype=np.uint8)
    with _cleaned(rows.sparkSession):
        blocks = found.collect()  # 2 MB a row at most
    for r in blocks:
        out[r.part // RANGES, r.part % RANGES] = _load(bytes(r.block))[0]
    return rows.sparkSession.sparkContext.broadcast(out.tobytes())


class _Homes(NamedTuple):
    """Parts of sequences, by the word before the last one; those of a frequent word lie in several successive parts."""

    parts: int
    often: np.ndarray   # sorted words
    shares: np.ndarray  # in how many parts

    def base(self, word: np.ndarray) -> np.ndarray:
        return _of_key(mixed(word ^ np.uint64(0x5851F42D4C957F2D)), self.parts)

    def spread(self, word: np.ndarray) -> np.ndarray:
        if not len(self.often):
            return np.ones(len(word), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.often, word), len(self.often) - 1)
        return np.where(self.often[at] == word, self.shares[at], 1)

    def of(self, word: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        own = (mixed(earlier + np.uint64(1)) % self.spread(word).astype(np.uint64)).astype(np.int64)
        return (self.base(word) + own) % self.parts


def _followers(bitmaps: Broadcast, homes: _Homes):
    """An Arrow pass over pieces that counts sequences of two words and more: rows (part, block), aggregated within the task.

    A block has the sorted words of its sequences, then by depth (1 to ``DEPTH``) as many values as the words and the count take: the
    places of the words before (depth 1) or of the entry one word shorter, as steps, nothing for the words that this entry has, the
    places of the next words (depth 1) or of the earliest words, the counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmaps.value, np.uint8).reshape(DEPTH, -1)
        held, lists, n, size = [[] for _ in range(DEPTH)], [], [0] * DEPTH, 0

        def rows():
            distinct, code, _ = _ranked(np.concatenate(lists))
            width = np.uint64(len(distinct).bit_length())
            low = (np.uint64(1) << width) - np.uint64(1)
            kinds, at = [], None  # by depth: parts, entries (there may be several parts for one), parents, words, counts
            for d, some in enumerate(held, start=1):
                first, last = (np.concatenate([h[i] for h in some]) for i in (0, 1))
                parent = code[first] if d == 1 else at[first]
                key, at, count = _ranked(parent.astype(np.uint64) << width | code[last].astype(np.uint64))
                parent, word = (key >> width).astype(np.int64), (key & low).astype(np.int64)
                which = np.arange(len(key))
                if d == 1:  # all parts of a frequent word have what follows it
                    before, times = parent, homes.spread(distinct[parent])
                    which = np.repeat(which, times)
                    part = (np.repeat(homes.base(distinct[parent]), times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)) % homes.parts
                else:
                    part = homes.of(distinct[before[parent]], distinct[word]) if d == 2 else part[parent]
                kinds.append((dict(_parted(part, homes.parts)), which, parent, word, count))
            none, place = np.zeros(0, np.int64), np.empty(max(len(distinct), *(len(k[4]) for k in kinds)), dtype=np.int64)
            for p in range(homes.parts):
                mine = [which[dealt.get(p, none)] for dealt, which, _, _, _ in kinds]
                if not len(mine[0]):
                    continue
                used, out, blank = np.zeros(len(distinct), dtype=bool), [], np.zeros(0, np.int64)
                for d, (some, (_, _, parent, word, _)) in enumerate(zip(mine, kinds, strict=True)):
                    used[word[some]] = True
                    if not d:
                        used[parent[some]] = True
                at_word = np.cumsum(used) - 1
                for d, (some, (_, _, parent, word, count)) in enumerate(zip(mine, kinds, strict=True)):
                    parents = place[parent[some]] if d else at_word[parent[some]]
                    out += [np.diff(parents, prepend=0), *[blank] * d, at_word[word[some]], count[some] - 1]
                    place[some] = np.arange(len(some))
                yield _blocks([(p, _dump(distinct[used], *out))])

        for piece in _training(batches):
            keys, _, place, _, back, levels = piece.sequences()
            row = np.empty(len(place), dtype=np.uint32)  # of the sequence one word shorter
            for d, at in enumerate(_possible(bits, levels, place), start=1):
                held[d - 1].append(((back[1][at] + size).astype(np.uint32) if d == 1 else row[at], (back[0 if d == 1 else d][at] + size).astype(np.uint32)))
                row[at] = np.arange(n[d - 1], n[d - 1] + len(at), dtype=np.uint32)
                n[d - 1] += len(at)
            lists.append(keys)
            size += len(keys)
            if n[0] > SEQUENCES:
                yield from rows()
                held, lists, n, size = [[] for _ in range(DEPTH)], [], [0] * DEPTH, 0
                release()
        if lists:
            yield from rows()

    return run


def _keys_of(fields: list[np.ndarray], words_: np.ndarray | None = None) -> np.ndarray:
    """Keys of sequences from their words (or the places of these in ``words_``), the last one first."""
    g = fields[-1] if words_ is None else words_[fields[-1]]
    for f in fields[-2::-1]:
        g = _gram(g, f if words_ is None else words_[f])
    return g


def _merge(table: pa.Table) -> pa.Table:
    """One part's sequences that occur ``MIN_COUNT`` times or more, as one value.

    Its words; places of the word before and the next word, and the count of depth 1 (in the order of keys); for each further depth
    its contexts, and by entry the place of its context, of the entry of its shorter suffix, and its count."""
    blocks = [_load(value.as_py()) for value in table.column("block")]
    distinct, code = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
    places = np.split(code.astype(np.uint32), np.cumsum([len(b.pop(0)) for b in blocks])[:-1])
    out, shorter, fields = [], None, [[]] * len(blocks)  # by block the places of the words, the last one first
    for depth in range(1, DEPTH + 1):
        counts = []
        for i, (block, own) in enumerate(zip(blocks, places, strict=True)):
            (steps, *_, last, count), block[:] = block[:depth + 2], block[depth + 2:]
            parent = np.cumsum(steps, dtype=np.int64)
            fields[i] = [own[last], own[parent]] if depth == 1 else [*(f[parent] for f in fields[i]), own[last]]
            counts.append(count)
        words_ = [np.concatenate(column) for column in zip(*fields, strict=True)]
        g = _keys_of(words_, distinct)
        at, total = _merged(g, np.concatenate(counts).astype(np.int64) + 1)
        some = total >= MIN_COUNT
        at, total = at[some], total[some]
        words_ = [w[at] for w in words_]
        if depth == 1:
            used = np.zeros(len(distinct), dtype=bool)
            used[words_[0]] = used[words_[1]] = True
            place = np.cumsum(used) - 1
            out += [distinct[used], place[words_[1]], place[words_[0]], total]
        else:
            x, code = np.unique(_keys_of(words_[1:], distinct), return_inverse=True)
            out += [x, code, np.searchsorted(shorter, _keys_of(words_[:-1], distinct)), total]
        shorter = g[at]
    return pa.table({"part": table.column("part").slice(0, 1).cast(pa.int32()), "block": pa.array([_dump(*out)], pa.binary())})


def _merged_levels(value: bytes):
    """Of a merged part, by depth of its entries: the words before the last one, the last ones, the keys, the counts."""
    distinct, before, last, count, *deeper = _load(value)
    before, last = distinct[before], distinct[last]
    yield before, last, _gram(before, last), count
    while deeper:
        (x, code, shorter, count), deeper = deeper[:4], deeper[4:]
        before, last = before[shorter], last[shorter]
        yield before, last, _gram(x[code], last), count


def _totals(homes: _Homes, turn: int):
    """An Arrow pass over merged parts: rows (part, block), the counts of sequences, for the parts of a turn that may have them as contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, value in zip(batch.column("part").to_pylist(), batch.column("block"), strict=True):
                entries = []
                for depth, (before, last, key, count) in zip(range(1, DEPTH), _merged_levels(value.as_py()), strict=False):
                    to = homes.of(last, before)
                    some = (last != np.uint64(END)) & (to % TURNS == turn)
                    if depth == 1:  # a frequent word's lie in several parts
                        some &= homes.base(before) == part
                    entries.append((key[some], count[some].astype(np.int64), to[some]))
                key, count, to = (np.concatenate(e) for e in zip(*entries, strict=True))
                by = np.argsort(key)
                key, count, to = key[by], count[by], to[by]
                yield _blocks([(p, _dump(key[at], count[at])) for p, at in _parted(to, homes.parts)])

    return run


def _asked_words(known: Words, parts: int):
    """An Arrow pass over merged parts: rows (part, home, block), the words that are not frequent, for the parts that count them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, value in zip(batch.column("part").to_pylist(), batch.column("block"), strict=True):
                k = _load(value.as_py())[0]
                k = k[(known.find(k) < 0) & (k != np.uint64(END))]
                blocks = _blocks([(p, _dump(k[at])) for p, at in _parted(_of_key(k, parts), parts)])
                yield pa.RecordBatch.from_arrays([blocks.column(0), pa.array(np.full(len(blocks), home, np.int32)), blocks.column(1)], ["part", "home", "block"])

    return run


def _word_counts(asked: pa.Table, words_: pa.Table) -> pa.Table:
    """The counts (right) of the words that are asked for (left) in a part of the words: rows (part, block) by home."""
    k, c = _load(words_.column("block")[0].as_py())[-2:] if words_.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    blocks = []
    for value in asked.column("block"):
        keys = _load(value.as_py())[0]
        blocks.append(_dump(keys, c[np.searchsorted(k, keys)]))
    return pa.table({"part": asked.column("home").cast(pa.int32()), "block": pa.array(blocks, pa.binary())})


def _judged(known: Words, n: int, texts: int, homes: _Homes):
    """The contexts and entries of a part (left) that stay, by the counts of its words and of its contexts (right): rows (part, block) by key."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return told([])
        distinct, wx, w, c, *deeper = _load(left.column("block")[0].as_py())
        at = known.find(distinct)
        counts = np.where(at >= 0, known.counts[at], 0) if len(known.counts) else np.zeros(len(distinct), np.int64)
        sums = [_load(b.as_py()) for b in right.column("block")]
        keys, sums = (np.concatenate([np.zeros(0, t), *(v[i] for v in sums)]) for i, t in enumerate((np.uint64, np.int64)))
        by = np.argsort(keys)
        keys, sums = keys[by], sums[by]
        rare = (at < 0) & (distinct != np.uint64(END))
        counts[rare] = sums[np.searchsorted(keys, distinct[rare])]
        counts[distinct == END] = texts
        word = distinct[w]
        entries, contexts = [], []
        for depth in range(1, DEPTH + 1):
            if depth == 1:
                x, total, sp, sa = distinct, counts, (counts / n)[w], np.zeros(len(w))
            else:
                (x, wx, s, c), deeper = deeper[:4], deeper[4:]
                word, sp, sa, total = word[s], p[s], a[s], sums[np.searchsorted(keys, x)]
            q = (c - DISCOUNT) / np.maximum(total, 1)[wx]
            rest = 1 - np.bincount(wx, weights=q, minlength=len(x))
            p = q + rest[wx] * sp
            # all words that are no entries have the suffix's probability times ``rest``
            d = np.bincount(wx, weights=p * np.log(p / sp), minlength=len(x))
            d = d + np.maximum(1 - np.bincount(wx, weights=p, minlength=len(x)), 0.0) * np.log(np.maximum(rest, 1e-300))
            stays = (d >= DIVERGENCE) & (np.bincount(wx, minlength=len(x)) > 0)
            mine = stays[wx]
            p, a = np.where(mine, p, sp), np.where(mine, q + rest[wx] * sa, sa)
            if depth == 1:  # a frequent word's lie in several parts
                first = homes.base(x) == left.column("part")[0].as_py()
                mine, stays = mine & first[wx], stays & first
            g = _gram(x[wx[mine]], word[mine])
            entries.append((g, a[mine]))
            contexts.append((x[stays], rest[stays]))
        return told([(*(np.concatenate(v) for v in zip(*pairs, strict=True)),) for pairs in (entries, contexts)])

    def told(pairs) -> pa.Table:
        mine = _told(*pairs, homes.parts) if pairs else []
        return pa.Table.from_batches([_blocks(mine)])

    return run


def _told(entries, contexts, parts: int, words_=None) -> list:
    """(part, block) of what is known of some keys: entries (key, a), contexts (key, rest), words (key, count)."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    dealt = []
    for k, v in (entries or none, contexts or none, words_ or none):
        by = np.argsort(k)
        k, v = k[by], v[by].astype(np.float32) if v.dtype.kind == "f" else v[by]
        dealt.append({p: (k[at], v[at]) for p, at in _parted(_of_key(k, parts), parts)})
    return [(p, _dump(*(x for d in dealt for x in d.get(p, none)))) for p in range(parts) if any(p in d for d in dealt)]


def _split_words(parts: int):
    """An Arrow pass over pieces that counts words: rows (part, block), aggregated within the task."""
    count = _count(_word_keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in count(batches):
            yield _blocks(_told(None, None, parts, (rows.column("k").to_numpy().view(np.uint64), rows.column("c").to_numpy())))

    return run


def _merge_words(table: pa.Table) -> pa.Table:
    found = [_load(b.as_py()) for b in table.column("block")]
    k, c = (np.concatenate([f[i] for f in found]) for i in (-2, -1))
    at, c = _merged(k, c.astype(np.int64))
    return pa.table({"part": table.column("part").slice(0, 1).cast(pa.int32()), "block": pa.array([_dump(*found[0][:4], k[at], c)], pa.binary())})


def _rows_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column("block"):
            k, c = _load(value.as_py())[-2:]
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["k", "c"])


@contextlib.contextmanager
def _cleaned(spark: SparkSession):
    """Spark drops the shuffle files of a job here when the job ends; nothing else reads them."""
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, without the shuffle files of the job when the table is written."""
    with _cleaned(df.sparkSession):
        return materialize(df, name)


def _forget(spark: SparkSession, *written: DataFrame) -> None:
    """Delete tables of this run that nothing later reads, and let Spark's cleaner drop the shuffle files that nothing
    refers to any more (it acts when the driver's JVM collects garbage, by itself only every half hour)."""
    for folder in {f.rsplit("/", 1)[0] for df in written for f in df.inputFiles()}:
        fs.delete_folder(spark, folder)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _parts(tokens: int) -> int:
    """In how many parts the sequences of so many tokens are counted and looked up, one in a task's memory at a time."""
    return -(-max(LEAST_PARTS, -(-tokens // PART_TOKENS)) // TURNS) * TURNS


def _tables(pieces: DataFrame, words_: DataFrame, parts: int, known: Words, n: int, texts: int) -> tuple[DataFrame, Broadcast]:
    """All contexts and entries that stay, as rows (part, block), see ``_told``; by level a bitmap of what may be an entry.

    As a context, a sequence leaves ``rest`` of its mass to its suffix; as a context with its next word, it has the
    probability ``a`` without the base's part."""
    spark = pieces.sparkSession
    repeated = _bitmaps(pieces.select("held", "piece"), _taken_slots, n, BITMAP_BITS)
    _forget(spark)
    many = known.counts * parts > n
    shares = np.minimum(-(-known.counts[many] * parts // max(n, 1)), parts)
    homes = _Homes(parts, known.hashes[many], shares)
    merged = _kept(pieces.select("held", "piece").mapInArrow(releasing(_followers(repeated, homes)), "part int, block binary").groupBy(
        "part").applyInArrow(_merge, "part int, block binary"), "tree-sequences")
    repeated.destroy()
    _forget(spark)
    bitmaps = _bitmaps(merged, _entry_slots, n, ENTRY_BITS)
    tables = []
    for turn in range(TURNS):
        some = merged.where(F.col("part") % TURNS == turn)
        asked = some.mapInArrow(releasing(_asked_words(known, parts)), "part int, home int, block binary")
        counts = asked.groupBy("part").cogroup(words_.groupBy("part")).applyInArrow(_word_counts, "part int, block binary")
        sums = merged.mapInArrow(releasing(_totals(homes, turn)), "part int, block binary").unionByName(counts)
        tables.append(_kept(some.groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(
            _judged(known, max(n, 1), texts, homes), "part int, block binary"), "tree-tables"))
        del some, asked, counts, sums
        _forget(spark)
    _forget(spark, merged)
    return reduce(DataFrame.unionByName, tables), bitmaps


def _next_symbols(known: Words, keep: np.ndarray, pairs: np.ndarray):
    """Keys context x alphabet + next symbol: contexts are places in ``keep`` (single symbols), or in ``pairs``."""
    size = known.end + 1

    def make():
        at = np.full(size, -1, dtype=np.int64)
        at[keep] = np.arange(len(keep))

        def of(piece: _Piece):
            _, symbol, one, two = _piece_symbols(known, piece, *piece.lay())
            if len(pairs):
                key = two * size + one
                context = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                context = np.where(pairs[context] == key, context, -1)
            else:
                context = at[one]
            some = context >= 0
            return np.unique((context[some] * size + symbol[some]).astype(np.uint64), return_counts=True)

        return of

    return make


class Model(NamedTuple):
    known: Words
    tree: Tree
    counts: DataFrame  # (k, c) of every training word
    words: DataFrame   # the same as rows (part, block), see ``_told``
    parts: int
    tokens: int
    distinct: int
    texts: int
    discount: float
    class_tokens: np.ndarray
    class_words: np.ndarray
    tables: DataFrame  # see ``_tables``
    repeated: Broadcast


def _distribution(parent: np.ndarray, symbols: np.ndarray, counts: np.ndarray, total: int) -> np.ndarray:
    """Discounted counts, the rest of the mass by the parent's distribution over the other symbols."""
    p = (counts - DISCOUNT) / total
    rest = 1 - parent[symbols].sum()
    out = parent * ((1 - p.sum()) / rest if rest > 0 else 0.0)
    out[symbols] = p
    return np.maximum(out, 1e-300)


def _grow(table: list, parents: list[np.ndarray], rows: list, totals: np.ndarray) -> list[int]:
    """For each context its new state, or -1 where its distribution doesn't diverge from its parent's."""
    states = []
    for context, total in enumerate(totals):
        symbols, counts = rows[context]
        if not len(symbols) or total <= 0:
            states.append(-1)
            continue
        p = _distribution(parents[context], symbols, counts, int(total))
        if float((p * np.log(p / parents[context])).sum()) < DIVERGENCE:
            states.append(-1)
            continue
        states.append(len(table))
        table.append(p)
    return states


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many training texts end in each piece."""
    for batch in batches:
        n = []
        for held, value in zip(batch.column("held"), batch.column("piece"), strict=True):
            trains, goes_on = np.frombuffer(held.as_py(), bool) == 0, bool(_load(value.as_py(), last=True)[0][1])
            n.append(int(trains.sum()) - int(goes_on and trains[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])


def learn(docs: DataFrame, text: str = "text") -> Model:
    """Count words and next symbols over all of ``docs`` (or over the training texts of what ``_split`` made) and grow the tree."""
    short_batches(docs.sparkSession)
    pieces = docs if docs.columns == PIECES else _split(docs.withColumn("__id", F.lit(0)), "__id", text, F.lit(False))
    rows = pieces.select("held", "piece")
    parts = _parts(pieces.count() * PIECE)
    counted = _kept(rows.mapInArrow(releasing(_split_words(parts)), "part int, block binary").groupBy("part").applyInArrow(
        _merge_words, "part int, block binary"), "tree-words")
    counts = counted.mapInArrow(releasing(_rows_of_words), "k long, c long")
    texts = int(rows.mapInArrow(_texts, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total.n) + texts, int(total.v) + (texts > 0)
    often = counts.where(F.col("c") * FREQUENT >= n).toArrow().sort_by("k")  # FREQUENT rows at most
    keys, freq = np.asarray(often["k"]).astype(np.int64).view(np.uint64), np.asarray(often["c"]).astype(np.int64)
    by = np.argsort(keys)
    keys, freq = keys[by], freq[by]
    single = freq * ALPHABET >= n
    heavy = int(single.sum())
    symbols = heavy + (keys & np.uint64(255)).astype(np.int64)
    symbols[single] = np.arange(heavy)
    first = np.searchsorted(keys, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))
    run = int(np.bincount((keys >> np.uint64(44)).astype(np.int64)).max(initial=0)) if len(keys) else 0
    known = Words(keys, freq, symbols, first, run, heavy)

    # rarer words, by class (last byte)
    rare = counts.where(F.col("c") * ALPHABET < n).groupBy(F.col("k").bitwiseAND(255).cast("int").alias("b")).agg(
        F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
    class_tokens, class_words, n1, n2 = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64), 0, 0
    for r in rare.collect():  # 256 rows at most
        class_tokens[r.b], class_words[r.b], n1, n2 = r.c, r.v, n1 + r.n1, n2 + r.n2
    discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5

    size = known.end + 1
    unigram = np.concatenate([freq[single], class_tokens, [texts]]).astype(np.int64)
    root = (unigram + 0.5) / (unigram.sum() + 0.5 * size)
    table, one = [root], np.zeros(size, dtype=np.int64)
    keep = np.flatnonzero((unigram * CONTEXTS >= n) & (unigram > 0))

    def followers(pairs: np.ndarray, n_contexts: int) -> list:
        """(symbols, counts) by context, of the entries that make up at least 1 / ENTRIES of the tokens."""
        make = _next_symbols(known, keep, pairs)
        found = rows.mapInArrow(releasing(_count(make)), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).where(
            F.col("c") * ENTRIES >= n).toArrow()
        k, c = np.asarray(found["k"]).astype(np.int64), np.asarray(found["c"]).astype(np.int64)
        by = np.argsort(k)
        k, c = k[by], c[by]
        cut = np.searchsorted(k // size, np.arange(n_contexts + 1))
        return [(k[a:b] % size, c[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    none = np.zeros(0, dtype=np.int64)
    pairs, states = none, none
    if len(keep):
        after = followers(none, len(keep))
        one[keep] = [max(s, 0) for s in _grow(table, [root] * len(keep), after, unigram[keep])]
        found = sorted((int(keep[i]) * size + int(s), int(c)) for i, (nexts, cs) in enumerate(after)
                       for s, c in zip(nexts, cs, strict=True) if s != known.end and c * CONTEXTS >= n)
        if found:
            pairs, pair_counts = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
            parents = [table[one[p % size]] for p in pairs]
            states = np.array(_grow(table, parents, followers(pairs, len(pairs)), pair_counts), dtype=np.int64)
            pairs, states = pairs[states >= 0], states[states >= 0]
    tree = Tree(one, pairs, states, np.log10(np.array(table)).astype(np.float32))
    return Model(known, tree, counts, counted, parts, n, v, texts, discount, class_tokens, class_words,
                 *_tables(pieces, counted, parts, known, n, texts))


def _questions(piece: _Piece, bits: list[np.ndarray]):
    """The keys that a piece asks for: the end, its words, those of what stands before it, by depth those of sequences that may be an
    entry; by depth the places of these."""
    _, _, place, _, _, levels = piece.sequences()
    keys, places = [np.array([END], np.uint64), piece.words, *(k for k, _ in _earlier(piece))], []
    for (_, g), at in zip(levels, _possible(bits, levels, place), strict=True):
        places.append(at)
        keys.append(g[at])
    return np.concatenate(keys), places


def _earlier(piece: _Piece) -> list:
    """Of the 1 to ``DEPTH`` symbols before a piece: (key, whether there are so many)."""
    m = len(piece.before)
    return [(_keys_of([piece.before[m - 1 - i:m - i] for i in range(min(d, m))]), d <= m) for d in range(1, DEPTH + 1)]


def _asks(bitmaps: Broadcast, parts: int, turn: int):
    """What a cell's pieces ask the parts of a turn: rows (part, cell, keys), the distinct keys of a part, sorted, as one value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, now, held = np.frombuffer(bitmaps.value, np.uint8).reshape(DEPTH, -1), None, []

        def rows():
            g = _distinct(np.concatenate(held))
            mine = [(p, _dump(g[at])) for p, at in _parted(_of_key(g, parts), parts)]
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in mine], pa.int32()), pa.array([now] * len(mine), pa.int64()),
                                               pa.array([m[1] for m in mine], pa.binary())], ["part", "cell", "keys"])

        for batch in batches:
            for cell, value in zip(batch.column("cell").to_pylist(), batch.column("piece"), strict=True):
                if now is not None and cell != now:
                    yield rows()
                    held = []
                now = cell
                keys = _questions(_Piece.load(value.as_py()), bits)[0]
                held.append(_distinct(keys[keys % np.uint64(TURNS) == turn]))  # the number of parts is a multiple of that of turns
                release()
                if sum(len(h) for h in held) > 4 * HELD:
                    held = [_distinct(np.concatenate(held))]
        if now is not None:
            yield rows()

    return run


def _answer(asked: pa.Table, told: pa.Table) -> pa.Table:
    """Answers to the cells' keys of one part, in the order of each cell's keys: what is known of a key, and the values."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    found = [_load(b.as_py()) for b in told.column("block")]
    tables = []
    for i in (0, 2, 4):
        k, v = (np.concatenate([none[j], *(f[i + j] for f in found)]) for j in (0, 1)) if i < 4 else (
            np.concatenate([np.zeros(0, t), *(f[i + j] for f in found)]) for j, t in ((0, np.uint64), (1, np.int64)))
        by = np.argsort(k)
        tables.append((_Index(k[by]), v[by]))
    blocks = []
    for value in asked.column("keys"):
        keys, out = _load(value.as_py())[0], []
        kind = np.zeros(len(keys), dtype=np.uint8)
        for i, (index, v) in enumerate(tables):
            at = index.find(keys)
            hit = at < len(v)
            kind |= hit.astype(np.uint8) << i
            out.append(v[at[hit]])
        blocks.append(_dump(kind, *out))
    return pa.table({"cell": asked.column("cell").cast(pa.int64()), "part": asked.column("part").cast(pa.int32()), "block": pa.array(blocks, pa.binary())})


def _answers(table: pa.Table, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, rest, c) of a cell's keys, and a last row for keys that have no answer: -1, 1 and 0."""
    n = len(keys) + 1
    a, rest, c = np.full(n, -1.0, np.float32), np.ones(n, np.float32), np.zeros(n, np.int64)
    places = dict(_parted(_of_key(keys, parts), parts))
    for part, value in zip(table.column("part").to_pylist(), table.column("block"), strict=True):
        kind, *values = _load(value.as_py())
        if len(kind):
            for i, (into, v) in enumerate(zip((a, rest, c), values, strict=True)):
                into[places[part][(kind >> i & 1).astype(bool)]] = v
    return a, rest, c


def _score(model_parts, bitmaps: Broadcast, parts: int):
    """Scores the texts (left) of a cell by its answers (right)."""
    known, tree, class_tokens, class_words, discount, n_texts = model_parts

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.log10((known.counts - discount) / class_tokens[(known.hashes & np.uint64(255)).astype(np.int64)])
            unseen = np.log10(np.where(class_words > 0, discount * class_words / class_tokens, 1))
        share[known.symbols < known.heavy] = 0.0
        log_count = np.log10(known.counts + 1.0)
        order = np.argsort(left.column("nr").to_numpy()).tolist()
        load = lambda row: _Piece.load(left.column("piece")[row].as_py())
        bits = np.frombuffer(bitmaps.value, np.uint8).reshape(DEPTH, -1)
        questions, asked = {}, np.zeros(0, np.uint64)
        for row in order:
            keys, places = _questions(load(row), bits)
            questions[row] = keys, [at.astype(np.uint32) for at in places]
            asked = _distinct(np.concatenate([asked, _distinct(keys)]))
            release()
        a, rest, count = _answers(right, asked, parts)
        release()

        where = _Index(asked).find
        ids, held, columns = [], [], [[] for _ in range(4)]
        for row in order:
            piece = load(row)
            n, size = len(piece.size), piece.size
            _, text, place, is_word, back = piece.keys()
            keys, places = questions.pop(row)
            asks = np.split(where(keys), np.cumsum([1, len(piece.words), *[1] * DEPTH, *(len(at) for at in places)])[:-1])
            begin, own, earlier, entries = int(asks[0][0]), asks[1], asks[2:2 + DEPTH], asks[2 + DEPTH:]
            found, symbol, one, two = _piece_symbols(known, piece, text, place, is_word)
            state = tree.one[one]
            if len(tree.pairs):
                pair = two * (known.end + 1) + one
                near = np.minimum(np.searchsorted(tree.pairs, pair), len(tree.pairs) - 1)
                state = np.where(tree.pairs[near] == pair, tree.states[near], state)
            # by distinct word
            counted, hit = count[own], found >= 0
            last = (piece.words & np.uint64(255)).astype(np.int64)
            part, logs = np.zeros(len(own)), np.log10(counted + 1.0)
            if len(known.hashes):
                part[hit], logs[hit] = share[found[hit]], log_count[found[hit]]
            with np.errstate(divide="ignore", invalid="ignore"):
                part[~hit] = np.where(counted > 0, np.log10(counted - discount) - np.log10(class_tokens[last]), unseen[last])[~hit]
            of = text[is_word]
            closed = np.arange(n) < n - piece.goes_on
            n_known = np.bincount(of, weights=(hit | (counted > 0))[piece.code], minlength=n).astype(np.int64) + closed * int(n_texts > 0)
            base = np.bincount(of, weights=logs[piece.code], minlength=n) + closed * np.log10(n_texts + 1.0)
            p = tree.table[state, symbol].astype(np.float64)
            p[is_word] += part[piece.code]
            # the tables' part, from the shortest context to the longest
            upper, left_over = np.zeros(len(text)), np.ones(len(text))
            ends = np.concatenate([own, [begin]])[back[0]]
            for d, (at, here, before, (_, whole)) in enumerate(zip(places, entries, earlier, _earlier(piece), strict=True), start=1):
                context = np.concatenate([before if whole else [len(asked)], ends[:-1]])
                r = np.where(place >= d, rest[context], 1.0)
                ends = np.full(len(text), len(asked))
                ends[at] = here
                mine = a[ends]
                upper = np.where(mine >= 0, mine, r * upper)
                left_over *= r
            p = np.log10(np.minimum(upper + left_over * 10.0 ** p, 1.0), where=upper > 0, out=p + np.log10(left_over))
            score = np.bincount(text, weights=p, minlength=n)
            own_texts = slice(int(piece.runs_on), n)
            for column, value in zip(columns, (size + closed, n_known, base, score), strict=True):
                if piece.runs_on:  # the rest of the text that the piece before ended with
                    column[-1][-1] += value[0]
                if n > piece.runs_on:
                    column.append(value[own_texts])
            release()
            ids.append(left.column("doc_id")[row].values.slice(int(piece.runs_on)))
            held.append(np.frombuffer(left.column("held")[row].as_py(), bool)[own_texts])
        return pa.Table.from_arrays(
            [pa.concat_arrays(ids), pa.array(np.concatenate(held)), *(pa.array(np.concatenate(c)) for c in columns)],
            ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    return run


def _answered(pieces: DataFrame, told: DataFrame, bitmaps: Broadcast, parts: int, turn: int) -> DataFrame:
    asked = pieces.select("cell", "piece").mapInArrow(releasing(_asks(bitmaps, parts, turn)), "part int, cell long, keys binary")
    told = told.where(F.col("part") % TURNS == turn)
    answers = _kept(asked.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_answer, "cell long, part int, block binary"), "tree-answers")
    del asked, told
    _forget(pieces.sparkSession)
    return answers


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for every row.

    The model learns from the rows where ``held_out`` is not true.
    """
    spark = docs.sparkSession
    short_batches(spark)
    pieces = _split(docs, doc_id, text, held_out)
    m = learn(pieces)
    model = (m.known, m.tree, np.maximum(m.class_tokens, 1), m.class_words, m.discount, m.texts)
    kind = pieces.schema["doc_id"].dataType.elementType.simpleString()
    n_tokens, log_tokens = m.tokens, float(np.log10(m.tokens + m.distinct + 1))
    told, scored = m.tables.unionByName(m.words), []
    for turn in range(CELL_TURNS):
        some = pieces.where(F.pmod(F.xxhash64("cell"), F.lit(CELL_TURNS)) == turn)
        answers = [_answered(some, told, m.repeated, m.parts, t) for t in range(TURNS)]
        scored.append(_kept(some.groupBy("cell").cogroup(reduce(DataFrame.unionByName, answers).groupBy("cell")).applyInArrow(
            _score(model, m.repeated, m.parts), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"), "tree-scores"))
        _forget(spark, *answers)
    _forget(spark, told, pieces)
    m.repeated.destroy()
    return reduce(DataFrame.unionByName, scored).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * log_tokens).alias("base_score"), "score")
