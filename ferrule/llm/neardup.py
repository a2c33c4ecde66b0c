"""Near-duplicate documents by word shingles: SetSketch bands, likelihood, then full sets.

1. Each whole text becomes its set of distinct shingles and that set's sketch. Texts with one set are
   one class, known by its smallest id; only classes go on, so copies cost one row each.
2. Bands of 4 registers are bucket keys. In each bucket every member is paired with the smallest
   id (the pivot): as many pairs as rows, never all pairs.
3. Pairs whose sizes, or whose jointly estimated similarity, rule a link out are dropped (an
   estimate 6 standard deviations below the threshold), the others are confirmed on the full sets.
4. Components of those links. In a bucket whose members other than the pivot still lie in several components, each
   member outside the largest is confirmed against all members of other components, in blocks.
   After that every pair of a bucket is either tested or already connected.

Sets of shingles are made only for classes that share a bucket with another: a bitmap of
bounded size, built by an aggregate, lets the second reading of the texts skip the rest.
At similarity 0.8 a pair shares none of the 32 buckets once in 10^7.

Cases: a null text, or one without words, has no shingles and no links; with fewer words than a shingle the
whole sequence is the one shingle; rows with one id count as one document; rows with a
null id take no part and are kept. Other columns are ignored, whatever their names. No documents: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, materialize, short_batches
from .sketch import REGISTERS, jaccard, registers
from .tokens import chunks, mixed, releasing, words

BAND = 4  # registers of 16 bits: a bucket key is 64 bits
SALT_ROWS, BLOCK = 100, 256
#: The candidates' bitmap: about 16 bits a candidate, 16 MB at most; a fuller one lets more texts through.
BITMAP_BITS = 1 << 27
_P = np.uint64(0x9FB21C651E98DF25)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of n successive word hashes (of all of them where there are fewer), sorted."""
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = out * _P + h[i:len(h) - k + 1 + i]
    return np.unique(mixed(out))


def _word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(place, word hashes) of each text that has bytes."""
    at, parts = None, []
    for chunk in chunks(column):
        w = words(chunk)
        cuts = np.searchsorted(w.text, np.arange(len(chunk.texts) + 1))
        for i, place in enumerate(chunk.texts):
            if place != at:
                if at is not None:
                    yield at, np.concatenate(parts)
                at, parts = place, []
            parts.append(w.hash[cuts[i]:cuts[i + 1]])
    if at is not None:
        yield at, np.concatenate(parts)


def _sketches(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, places, total = batch.column(0), [], [], 0

            def flush():
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                marks = registers(flat, np.repeat(np.arange(len(sets)), sizes), len(sets))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (REGISTERS // BAND)),
                                                pa.array(marks.view(np.int64).ravel()))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(places, pa.int64())), pa.array(sizes), pa.array(keys, pa.binary()), rows],
                    ["doc_id", "n_shingles", "set_key", "sketch"])

            for place, h in _word_hashes(batch.column(1).fill_null("")):
                sets.append(shingles(h, n_words))
                places.append(place)
                total += len(sets[-1])
                if len(sets) >= 2048 or total >= 1 << 20:
                    yield flush()
                    sets, places, total = [], [], 0
            yield flush()

    return run


def _sets(n_words: int, bitmap: bytes):
    bits = np.frombuffer(bitmap, dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            slot = _slots(ids, len(bits) * 8)
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            found, rows, total = [], [], 0
            for place, h in _word_hashes(batch.column(1).fill_null("")):
                found.append(place)
                rows.append(shingles(h, n_words).tobytes())
                total += len(rows[-1])
                if total >= 1 << 23:
                    yield _id_sets(batch, found, rows)
                    found, rows, total = [], [], 0
            yield _id_sets(batch, found, rows)

    return run


def _id_sets(batch: pa.RecordBatch, found: list, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found, pa.int64())), pa.array(rows, pa.binary())],
                                      ["id", "set"])


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def id_bitmap(ids: DataFrame, col: str) -> bytes:
    """A bitmap in which the slot of every id is set: at most BITMAP_BITS, whatever the number of ids."""
    n = ids.count()
    bits = 1 << 16
    while bits < min(16 * n, BITMAP_BITS):
        bits *= 2

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _slots(batch.column(0).to_numpy(zero_copy_only=False), bits)
            yield pa.RecordBatch.from_arrays([pa.array(s >> 6), pa.array(np.uint64(1) << (s & 63).astype(np.uint64)).view(pa.int64())],
                                             ["at", "bit"])

    words_ = ids.select(col).mapInArrow(slots, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("w")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words_["at"].to_numpy()] = words_["w"].to_numpy()
    return out.tobytes()


def maybe_in(bitmap: bytes):
    """A filter on ids: false only for ids that the bitmap was not made from."""
    table = np.frombuffer(bitmap, dtype=np.uint8)

    @F.pandas_udf("boolean")
    def test(ids: pd.Series) -> pd.Series:
        none = ids.isna().to_numpy()
        slot = _slots(ids.fillna(0).to_numpy(), len(table) * 8)
        return pd.Series((table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool) & ~none)

    return test


def one_of_each(docs: DataFrame, judged: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that ``judged`` (``near_duplicates``' rows) does not keep.

    Rows that the bitmap of dropped ids rules out stay where they are; only the others are joined.
    """
    judged = materialize(judged.select("doc_id", "kept"), "near-judged")
    gone = judged.where("not kept").select("doc_id").distinct()
    test, mine = maybe_in(id_bitmap(gone, "doc_id")), F.col(f"`{doc_id}`")
    marked = docs.withColumn("__maybe", F.coalesce(test(mine.cast("long")), F.lit(False)))
    out = marked.where("not __maybe").unionByName(
        marked.where("__maybe").join(gone.withColumnRenamed("doc_id", "__gone"), mine.cast("long") == F.col("__gone"), "left_anti"))
    return out.drop("__maybe")


def _estimate(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (np.asarray(batch.column(c).flatten()).astype(np.int64).view(np.uint16).reshape(n, REGISTERS)
                    for c in ("sx", "sp"))
            est = jaccard(a, b, batch.column("nx").to_numpy().astype(float), batch.column("np").to_numpy().astype(float))
            keep = batch.filter(pa.array(est >= least))
            yield pa.RecordBatch.from_arrays([keep.column("p"), keep.column("x")], ["p", "x"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |a & b| >= percent |a | b| for sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    """Rows sorted by (p, salt, x): the pivot's set comes first (x null), then its members'."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots = None, []
        for batch in batches:
            out = []
            p, salt, x, sets = (batch.column(i) for i in range(4))
            for i, (pi, si, xi) in enumerate(zip(p.to_pylist(), salt.to_pylist(), x.to_pylist(), strict=True)):
                mine = np.frombuffer(sets[i].as_buffer(), dtype=np.uint64)
                if (pi, si) != key:
                    key, pivots = (pi, si), []
                if xi is None:
                    pivots.append(mine.copy())
                elif any(_linked(mine, q, percent) for q in pivots):
                    out.append((pi, xi))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())],
                                             ["p", "x"])

    return run


def _cross(percent: int):
    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        """Members outside the largest component (few) against all of other components; one link for each pair of components."""
        sets = [np.frombuffer(s, dtype=np.uint64) for s in pdf["set"]]
        ids, comp, few = pdf["id"].to_numpy(), pdf["component"].to_numpy(), pdf["few"].to_numpy()
        out, done = [], set()
        for i in np.flatnonzero(few):
            for j in range(len(ids)):
                pair = (min(comp[i], comp[j]), max(comp[i], comp[j]))
                if comp[i] != comp[j] and pair not in done and _linked(sets[i], sets[j], percent):
                    done.add(pair)
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["p", "x"], dtype="int64")

    return unit


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (component_id = doc_id)."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marks = materialize(rows.withColumn("text", F.coalesce(F.col("text"), F.lit(" "))).withColumn(
        "text", F.when(F.col("text") == "", " ").otherwise(F.col("text"))).mapInArrow(
        releasing(_sketches(n_words)), "doc_id long, n_shingles long, set_key binary, sketch array<long>"), "near-sketches")
    classes = materialize(marks.where("n_shingles > 0 and doc_id is not null").groupBy("set_key", "n_shingles").agg(
        F.min(F.struct("doc_id", "sketch")).alias("m")).select(
        "set_key", F.col("m.doc_id").alias("id"), F.col("n_shingles").alias("n"), F.col("m.sketch").alias("sketch")), "near-classes")

    bands = classes.select("id", "n", F.posexplode("sketch")).select(
        F.xxhash64("pos", "col").alias("key"), "id", "n")
    # written, so that the join below deals both sides anew and can split the rows of one hot bucket
    tops = materialize(bands.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("c")).where("c > 1"), "near-tops")
    shared = materialize(bands.join(tops.select("key", "p", "c"), "key").select(
        "key", "id", "n", F.col("p.id").alias("p"), F.col("p.n").alias("np"), "c"), "near-buckets")
    pairs = (shared.where(f"id <> p and 100 * least(n, np) >= {percent} * greatest(n, np)")
             .select(F.col("id").alias("x"), "p", F.col("n").alias("nx"), "np").distinct())
    one = classes.select("id", "n", "sketch")
    least = percent / 100 - 6 * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
    likely = materialize(
        pairs.join(one.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx")), ["x", "nx"])
        .join(one.select(F.col("id").alias("p"), F.col("n").alias("np"), F.col("sketch").alias("sp")), ["p", "np"])
        .select("p", "x", "nx", "np", "sx", "sp").mapInArrow(releasing(_estimate(float(least))), "p long, x long").distinct(), "near-pairs")

    asked = shared.where("c > 2").select("id").unionByName(likely.select(F.col("p").alias("id"))).unionByName(
        likely.select(F.col("x").alias("id"))).distinct()
    asked = materialize(asked, "near-asked")
    sets = materialize(rows.where("doc_id is not null and text <> ''").mapInArrow(
        releasing(_sets(n_words, id_bitmap(asked, "id"))), "id long, set binary").join(asked, "id", "left_semi")
        .where("length(set) > 0"), "near-sets")

    many = likely.groupBy("p").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    members = likely.join(many, "p").select("p", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"), "x")
    heads = members.select("p", "salt").distinct().join(sets.select(F.col("id").alias("p"), "set"), "p").select(
        "p", "salt", F.lit(None).cast("long").alias("x"), "set")
    both = members.join(sets.select(F.col("id").alias("x"), "set"), "x").select("p", "salt", "x", "set").unionByName(heads)
    links = materialize(both.repartition("p", "salt").sortWithinPartitions("p", "salt", F.col("x").asc_nulls_first())
                        .mapInArrow(releasing(_confirm(percent)), "p long, x long"), "near-links")
    # rows with one id are one document: it links the classes of its texts
    again = marks.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    ties = marks.select("doc_id", "set_key").join(again, "doc_id").join(classes.select("set_key", "id"), "set_key").select(
        F.col("doc_id").alias("p"), F.col("id").alias("x")).where("p <> x").distinct()
    comp = connected(links.unionByName(ties), "p", "x", "near-components")
    comp = _rest(shared, sets, comp, percent)

    known = classes.select("set_key", F.col("id").alias("cid")).join(comp, F.col("cid") == F.col("id"), "left").select(
        "set_key", F.coalesce("component", "cid").alias("component"))
    final = marks.select("doc_id", "n_shingles", "set_key").join(known, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return final.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _rest(shared: DataFrame, sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Step 4: links between components that meet in a bucket, other than through its pivot."""
    at = shared.where("c > 2 and id <> p").join(comp, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component"))
    open_ = materialize(at.groupBy("key").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("c"),
        F.bit_xor(F.xxhash64("id")).alias("mark")).where("a <> b"), "near-open")
    if open_.isEmpty():
        return comp
    # buckets with the same members are one
    open_ = open_.groupBy("mark", "c").agg(F.min("key").alias("key")).select("key")
    rows = materialize(at.join(open_, "key"), "near-open-rows")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("k"))
    largest = materialize(sizes.groupBy("key").agg(
        F.max(F.struct("k", "component"))["component"].alias("largest"), F.sum("k").alias("total"),
        (F.sum("k") - F.max("k")).alias("few")), "near-largest")  # written, so that a hot bucket's rows can be split below
    rows = rows.join(largest, "key").withColumn("is_few", F.col("component") != F.col("largest"))
    n_few, n_all = F.ceil(F.col("few") / BLOCK).cast("int"), F.ceil(F.col("total") / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("id", "key"), n).cast("int")
    # a unit is a block of the few and a block of all
    units = rows.where("is_few").select("key", "id", "component", F.lit(True).alias("few"), block(n_few).alias("f"),
                                        F.explode(F.sequence(F.lit(0), n_all - 1)).alias("a")).unionByName(
        rows.select("key", "id", "component", F.lit(False).alias("few"),
                    F.explode(F.sequence(F.lit(0), n_few - 1)).alias("f"), block(n_all).alias("a")))
    more = materialize(units.join(sets, "id").groupBy("key", "f", "a").applyInPandas(_cross(percent), "p long, x long"), "near-more")
    if more.isEmpty():
        return comp
    joined = more.join(comp.select(F.col("id").alias("p"), F.col("component").alias("cp")), "p", "left").join(
        comp.select(F.col("id").alias("x"), F.col("component").alias("cx")), "x", "left")
    joined = joined.select(F.coalesce("cp", "p").alias("p"), F.coalesce("cx", "x").alias("x"))
    wider = connected(joined, "p", "x", "near-wider").select(F.col("id").alias("component"), F.col("component").alias("wider"))
    nodes = comp.unionByName(joined.select(F.col("p").alias("id"), F.col("p").alias("component"))).unionByName(
        joined.select(F.col("x").alias("id"), F.col("x").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
    return materialize(nodes.join(wider, "component", "left").select("id", F.coalesce("wider", "component").alias("component"))
                       .where("id <> component"), "near-final")
