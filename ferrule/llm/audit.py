"""Filter interaction audit: what each filter removes in every order, by incremental retraction streaming.

All files go through one Structured Streaming query as available-now micro-batches. A document's mask holds
the filters that it fails by itself (A to D). The filter of repeated texts (E) depends on the whole table:
its state is keyed by the text (128 bits of its SHA-256) and holds the smallest id seen and who has it. When a smaller id arrives, the
masks that its former holders were counted with are retracted and counted again with E. Counters a part, mask and
label are the sums of what the batches emitted, written once a batch; they are right after every batch for
the files seen so far, in whatever order these come.

A hot text is combined before it is shuffled: a task sends one row a (text, part, labels) with the smallest
id, not one a document. State rows hold the texts of one bucket of digests each, about ``TEXTS`` a batch, as a state row
costs as much to reach as some hundred texts; the texts in it are looked up by digest. A table goes through in at most
``BATCHES`` batches unless told otherwise, so what a state row holds is bounded by both. State lies in
RocksDB with changelogs in the query's checkpoint, so a lost executor loses nothing.

From the counters, 32 masks a part, every order and step is arithmetic: a document is kept after a step if its
mask has none of the filters so far, and its remover is the first of its mask's filters in the order, each of them in
the same number of orders.

Cases: a null text is empty; a null source is the part with the empty name; a null doc_id is neither smaller than another nor
ever repeats one; rows that repeat with one id don't repeat one another; a document with several labels counts
as good (or toxic) if one says so; unlabelled ones are neither; extra columns are ignored, whatever their names; empty tables
give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ferrule.session import scratch_dir

from .common import materialize, short_batches

#: What the filters say (fixed values).
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, JUNK = 200, 50, 2, b"#$%&*|"
REPEATED = 1 << FILTERS.index("E")

FILES, BATCHES, TEXTS, PIECE, COMBINE = 16, 16, 256, 1 << 20, 1 << 16
_SPACE, _UPPER, _CONTINUES = b" \t\n\v\f\r", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(128, 192))

JUDGED = "doc_id long, part string, digest binary, mask int, n long, spread long"
COMBINED = "bucket long, digest binary, mask int, part string, flags int, has_id boolean, first long, n_first long, n long"
DELTA = "part string, mask int, flags int, change long"
STATE = "texts string"


def own_mask(text: bytes) -> int:
    """The filters A to D that a text fails, as bits; a long text's words are gathered piece by piece."""
    words, distinct, at = 0, set(), 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in _SPACE:  # to the end of the word
            end += 1
        some = text[at:end].split()
        words += len(some)
        distinct.update(some)
        at = end
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUES))
    return ((words < LEAST_WORDS) | (100 * len(distinct) < LEAST_DISTINCT * words) << 1 | (100 * upper > MOST_UPPER * points) << 2
            | (len(text.translate(None, JUNK)) < len(text)) << 3)


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, of at least ``COMBINE`` rows but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= COMBINE:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to digests and masks; rows equal in all of the output become one with their number."""

    def narrow() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, digest = [], []
            for value in batch.column("text").cast(pa.binary()):
                text = value.as_py() or b""
                mask.append(own_mask(text))
                digest.append(hashlib.sha256(text).digest()[:16])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part").cast(pa.string()), pa.array(digest, pa.binary()),
                                              pa.array(mask, pa.int32())], names=["doc_id", "part", "digest", "mask"])

    for rows in _gathered(narrow()):
        keys = ["doc_id", "part", "digest", "mask"]
        same = rows.append_column("n", pa.array(np.ones(rows.num_rows, dtype=np.int64))).group_by(keys).aggregate([("n", "sum")])
        same = same.select([*keys, "n_sum"]).rename_columns([*keys, "n"])
        yield from same.append_column("spread", pa.array(np.arange(same.num_rows))).to_batches()


def _combine(buckets: int):
    """One row for each (text, part, labels) of a task: its smallest id, how many rows have that, and how many rows there are."""
    keys = ["digest", "mask", "part", "flags", "has_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches):
            rows = rows.append_column("has_id", pc.is_valid(rows.column("doc_id")))
            rows = rows.append_column("first", pc.fill_null(rows.column("doc_id"), 0)).select([*keys, "first", "n"])
            ids = rows.group_by([*keys, "first"]).aggregate([("n", "sum")]).sort_by("first")
            out = ids.group_by(keys, use_threads=False).aggregate([("first", "first"), ("n_sum", "first"), ("n_sum", "sum")])
            bucket = [int.from_bytes(d[:8], "big") % buckets for d in out.column("digest").to_pylist()]
            out = out.select([*keys, "first_first", "n_sum_first", "n_sum_sum"]).rename_columns([*keys, "first", "n_first", "n"])
            yield from out.add_column(0, "bucket", pa.array(bucket, pa.int64())).to_batches()

    return run


def _changes(changes: dict[tuple, int]) -> pd.DataFrame:
    part, mask, flags, change = zip(*((*k, n) for k, n in changes.items() if n), strict=True) if any(changes.values()) else ((),) * 4
    return pd.DataFrame({"part": pd.Series(part, dtype=object), "mask": np.array(mask, dtype=np.int32),
                         "flags": np.array(flags, dtype=np.int32), "change": np.array(change, dtype=np.int64)})


def _retract(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Count a bucket's new rows by their text's state, and a text's holders again if a smaller id has come."""
    texts = {d: (first, {(part, flags): n for part, flags, n in held}) for d, first, held in json.loads(state.get[0])} if state.exists else {}
    changes: dict[tuple, int] = defaultdict(int)
    for frame in frames:
        columns = (frame[c].tolist() for c in ("digest", "mask", "part", "flags", "has_id", "first", "n_first", "n"))
        for digest, mask, part, flags, has_id, doc_id, n_first, n in zip(*columns, strict=True):
            who = (part, flags)
            if not has_id:
                changes[part, mask, flags] += n
                continue
            digest = bytes(digest).hex()
            first, holders = texts.get(digest, (None, {}))
            if n > n_first:
                changes[part, mask | REPEATED, flags] += n - n_first
            if first is None or doc_id < first:
                for (held_part, held_flags), c in holders.items():
                    changes[held_part, mask, held_flags] -= c
                    changes[held_part, mask | REPEATED, held_flags] += c
                texts[digest] = (doc_id, {who: n_first})
                changes[part, mask, flags] += n_first
            elif doc_id == first:
                holders[who] = holders.get(who, 0) + n_first
                changes[part, mask, flags] += n_first
            else:
                changes[part, mask | REPEATED, flags] += n_first
        if len(changes) > COMBINE:
            yield _changes(changes)
            changes.clear()
    if texts:
        state.update((json.dumps([[d, first, [[*who, n] for who, n in held.items()]] for d, (first, held) in texts.items()]),))
    yield _changes(changes)


#: The stateful query's own settings: state on disk, bounded memory, changes logged to the checkpoint, no room set aside
#: for logs (4 MB a state partition).
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def label_flags(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, flags: 1 if a label says good, 2 if one says toxic; documents with neither are left out."""
    good, toxic = (F.max(F.when(F.col(f"`{c}`") == 1, 1).otherwise(0)) for c in ("quality", "toxic"))
    return (labels.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").cast("long").alias("labelled"))
            .agg((good + 2 * toxic).alias("flags")).where("flags > 0"))


def count_masks(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int | None = None, doc_id: str = "doc_id",
                text: str = "text", source: str = "source") -> DataFrame:
    """part, mask, flags, n: how many documents of the Parquet files at ``path`` fail exactly the filters of a mask."""
    short_batches(spark)
    flags = materialize(label_flags(labels), "audit-flags")
    out, checkpoint = scratch_dir(spark, "audit-counters"), scratch_dir(spark, "audit-stream")
    spark.createDataFrame([], DELTA).write.parquet(f"{out}/batch=-1")
    table, path = spark.read.parquet(path), path.rstrip("/")
    n_files = max(1, len(table.inputFiles()))
    files_per_batch = files_per_batch or max(FILES, -(-n_files // BATCHES))
    batches = -(-n_files // files_per_batch)
    buckets = max(1, table.count() // (TEXTS * batches))      # the files' footers say how many rows there are
    files = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the path may name a folder or a single file
    rows = (spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch).parquet(files)
            .select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                    F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("text")))
    judged = rows.mapInArrow(_judge, JUDGED)
    # ids that are null meet no label: their place in the task spreads them
    known = F.col("doc_id").isNotNull()
    labelled = judged.join(flags, (F.coalesce("doc_id", "spread") == F.col("labelled")) & known, "left").select(
        *(c for c in judged.columns if c != "spread"), F.coalesce("flags", F.lit(0)).alias("flags"))
    changes = labelled.mapInArrow(_combine(buckets), COMBINED).groupBy("bucket").applyInPandasWithState(
        _retract, DELTA, STATE, "update", "NoTimeout")

    def count(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("part", "mask", "flags").agg(F.sum("change").alias("change"))
        summed.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is run again replaces what it wrote

    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = (changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).foreachBatch(count).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stream.awaitTermination()
    counted = spark.read.schema(DELTA).parquet(out)
    return counted.groupBy("part", "mask", "flags").agg(F.sum("change").alias("n")).where("n <> 0")


def interactions(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and what the step's filter does there, from the documents by mask and labels."""
    by_mask = counted.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *(F.sum(F.when(F.col("flags").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias(name)
                                 for name, bit in (("good", 1), ("toxic", 2))))
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(FILTERS)))
    bit_of = "shiftleft(1, ascii(substr(filter_order, {}, 1)) - ascii('A'))".format
    steps = (parts.select("part", "masks", F.explode(orders).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
             .withColumn("bit", F.expr(bit_of("step")))
             .withColumn("before", F.expr(f"aggregate(sequence(1, step), 0, (a, i) -> a + IF(i < step, {bit_of('i')}, 0))")))

    def total(where: str, what: str = "m.n") -> Column:
        return F.expr(f"aggregate(masks, 0L, (a, m) -> a + IF({where}, {what}, 0L))")

    removed = "m.mask & before = 0 AND m.mask & bit <> 0"
    n_orders = 120  # each of a mask's filters comes first in equally many
    return steps.select(
        "part", "filter_order", "step", total("m.mask & (before | bit) = 0").alias("kept"), total(removed).alias("removed"),
        total("m.mask & before <> 0 AND m.mask & bit <> 0").alias("redundant"), total("m.mask = bit").alias("unique_fails"),
        total(removed, "m.good").alias("good_lost"), total(removed, "m.toxic").alias("toxic_lost"),
        total("m.mask & bit <> 0", f"m.n * ({n_orders} div bit_count(m.mask))").alias("shapley"))


def audit_files(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """The audit of all documents in the Parquet files at ``path``: one row per part, order of the filters and step."""
    return interactions(count_masks(spark, path, labels, files_per_batch))
