"""Helpers that several operators of this package share.

``materialize`` cuts lineage with a table written in the shared folder,
``running_total`` numbers or sums rows of a group in a fixed order without
ever bringing the group to one task, and ``connected`` labels components.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.session import scratch_dir

#: What the tokens of every operator here are separated by (a fixed value).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would change other letters too)."""
    return F.translate(c, UPPER, LOWER)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the folder ``spark.checkpoint.dir`` names, and read it back.

    Later jobs start from the files, so a lost executor costs no earlier stage,
    and the planner knows the table's real size.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_BATCH_BYTES = 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to 4 MB, if they are larger.

    Python passes here read texts, and a batch stands in memory on both sides of the pipe (the
    default is 64 MB, in buffers that grow by doubling). The setting stays: plans run later."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)\s*([bkmgt]?)b?", spark.conf.get(key, "64m").lower())
    size = int(now[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[now[2]] if now and int(now[1]) > 0 else 1 << 62
    if size > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add output columns; an input column whose name clashes (in any case) gives way."""
    mine = {c.lower() for c in cols}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in mine],
                     *[v.alias(k) for k, v in cols.items()])


def let(value: Column, body) -> Column:
    """``body`` of ``value`` with the value worked out once (an SQL ``let``)."""
    return F.transform(F.array(value), body)[0]


def _cell(order: list[Column], n_rows: int) -> Column:
    return F.pmod(F.xxhash64(*order), F.lit(max(1, math.isqrt(max(0, n_rows))))).cast("int")


def cell_bases(df: DataFrame, keys: list[str], weight: Column, order: list[Column], n_rows: int) -> DataFrame:
    """For ``place``: rows (keys, __cell, __sum, __base), __base what the cells before it in ``keys`` sum to."""
    sums = (df.withColumn("__w", weight).withColumn("__cell", _cell(order, n_rows))
            .groupBy(*keys, "__cell").agg(F.sum("__w").alias("__sum")))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0)))


def place(df: DataFrame, bases: DataFrame, keys: list[str], weight: Column, order: list[Column], out: str,
          n_rows: int) -> DataFrame:
    """Join ``bases`` to their rows and add ``out``, the running total up to each row."""
    inside = Window.partitionBy(*keys, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("__w", weight).withColumn("__cell", _cell(order, n_rows))
            .join(bases.drop("__sum"), [*keys, "__cell"])
            .withColumn(out, F.col("__base") + F.coalesce(F.sum("__w").over(inside), F.lit(0)))
            .drop("__w", "__cell", "__base"))


def running_total(df: DataFrame, keys: list[str], weight: Column, order: list[Column], out: str,
                  n_rows: int) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows before this one within its ``keys`` (not null).

    ``order`` fixes the order up to a hash: rows are dealt to about sqrt(n_rows)
    cells by the hash of the ``order`` columns, cells follow one another, and inside
    a cell rows are sorted by ``order``. One window runs over the rows of a (keys, cell),
    one over the cells of ``keys``; neither ever holds more than about sqrt(n_rows) rows of
    one group, however hot its key. Rows equal in all of ``order`` must be interchangeable.
    ``df`` is read twice: pass a written table.
    """
    return place(df, cell_bases(df, keys, weight, order, n_rows), keys, weight, order, out, n_rows)


#: Links that a task holds at once while it contracts them (16 bytes each).
CHUNK_LINKS = 1 << 18


def _contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some links, each id that isn't the smallest of its component among them, and that smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = at[:len(a)], at[len(a):], np.arange(len(ids))
    while True:
        ru, rv = root[u], root[v]
        if np.array_equal(ru, rv):
            break
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while not np.array_equal(up := root[root], root):
            root = up
    inner = root != np.arange(len(ids))
    return ids[inner], ids[root[inner]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        ids, roots = _contract(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], names=["id", "root"])

    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_LINKS):
            part = batch.slice(at, CHUNK_LINKS)
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
            if sum(len(h[0]) for h in held) >= CHUNK_LINKS:
                yield out()
    if held:
        yield out()


def connected(edges: DataFrame, a: str, b: str, name: str = "components", max_levels: int = 60) -> DataFrame:
    """Components of an undirected graph given as links: rows (id, component), component the smallest id.

    Contraction, level by level: each task reduces its links, in chunks of bounded size, to one from each id to the
    smallest one that it reaches there. Ids for which chunks differ, and roots that another chunk has below a smaller
    one, make the links of the next level, over roots only. An id has at most one row a chunk, so the links of a hub
    never meet; a star is settled in one level. Every table is written to the shared folder. Ids without a link to
    another id are not returned. No id's neighbours are ever gathered in a list.
    """
    links = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), name)
    levels: list[DataFrame] = []
    for _ in range(max_levels):
        found = materialize(links.mapInArrow(_contracted, "id long, root long"), name)
        labels = materialize(found.groupBy("id").agg(F.min("root").alias("root"), F.max("root").alias("other")), name)
        levels.append(labels.select("id", "root"))
        torn = found.join(labels.where("root <> other").select("id", F.col("root").alias("v")), "id").where("root <> v").select(
            F.col("root").alias("u"), "v")
        above = found.select(F.col("root").alias("u")).distinct().join(labels.select(F.col("id").alias("u"), F.col("root").alias("v")), "u")
        links = materialize(torn.unionByName(above).distinct(), name)
        if links.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_levels} levels")
    comp = levels.pop().select("id", F.col("root").alias("component"))
    for labels in reversed(levels):
        up = comp.select(F.col("id").alias("root"), F.col("component").alias("top"))
        mine = labels.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("component"))
        comp = materialize(mine.unionByName(comp.join(labels.select("id"), "id", "left_anti")), name)
    return comp
