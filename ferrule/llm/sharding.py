"""Sharding by Karmarkar-Karp differencing: groups of equal texts to shards of near-equal bytes.

Documents of one text form an indivisible group, summed before anything else, so a text
with very many copies is one row. Groups are dealt by hash to cells of about ``cell_rows``;
in each cell the differencing method starts with one partial partition per group (all its
bytes in one bin), and again and again takes the two with the largest spread and joins
them in opposite order, largest bin to smallest. A cell ends as one partial partition; the
cells' partitions are then joined by the same rule, ``fan`` at a time, level by level, until
one is left. No task or driver ever holds more than a cell.

Law ``bytes``: sizes near equal, as far as groups that may not be split allow. Size: UTF-8
bytes of the text plus 1; a null text counts as the empty one. Rows with null or repeated
ids are rows like any other; of equal texts all copies share a shard; ties are broken by
digest. Slots count the rows of a shard from 0 in a fixed order. Other columns are ignored,
whatever their names. No documents: no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_total

CELL_ROWS, FAN = 1024, 1024


def difference(items: np.ndarray) -> np.ndarray:
    """Join partial partitions (one row of k bin sizes each); returns the final bin of each (row, bin).

    The heap holds partial partitions by spread, the largest first, ties by age.
    """
    n, k = items.shape
    order = np.argsort(-items, axis=1, kind="stable")
    sums = [list(map(int, items[i, order[i]])) for i in range(n)]
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    joins = []
    for _ in range(n - 1):
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = [x + y for x, y in zip(sums[a], reversed(sums[b]), strict=True)]
        rank = sorted(range(k), key=both.__getitem__, reverse=True)
        sums[a] = sums[b] = None
        sums.append([both[j] for j in rank])
        joins.append((a, b, rank))
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], n + len(joins) - 1))
    labels: list = [None] * (n + len(joins))
    labels[-1] = list(range(k))
    for at in range(len(joins) - 1, -1, -1):
        a, b, rank = joins[at]
        mine, la, lb = labels[n + at], [0] * k, [0] * k
        for p, j in enumerate(rank):
            la[j], lb[k - 1 - j] = mine[p], mine[p]
        labels[a], labels[b], labels[n + at] = la, lb, None
    out = np.empty((n, k), dtype=np.int64)
    np.put_along_axis(out, order, np.array(labels[:n], dtype=np.int64).reshape(n, k), axis=1)
    return out


def _first_level(k: int):
    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("digest").reset_index(drop=True)
        items = np.zeros((len(pdf), k), dtype=np.int64)
        items[:, 0] = pdf["bytes"]
        return pdf.assign(bin=difference(items)[:, 0])[["digest", "cell", "bin", "bytes"]]

    return cell


def _next_level(k: int):
    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="cell", columns="bin", values="bytes", aggfunc="sum", fill_value=0)
        wide = wide.reindex(columns=range(k), fill_value=0).sort_index()
        to = difference(wide.to_numpy().astype(np.int64))
        return pd.DataFrame({"parent": pdf["parent"].iloc[0], "cell": np.repeat(wide.index.to_numpy(), k),
                             "bin": np.tile(np.arange(k), len(wide)), "up": to.ravel(),
                             "bytes": wide.to_numpy().ravel()})

    return cells


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, doc_id: str = "doc_id", text: str = "text",
                   cell_rows: int = CELL_ROWS, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, digest, shard, slot."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = materialize(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("digest")), "shard-rows")
    n_rows = rows.count()
    cells = max(1, math.ceil(n_rows / cell_rows))
    groups = (rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
              .withColumn("cell", F.pmod(F.xxhash64("digest"), F.lit(cells)).cast("long")))
    placed = materialize(groups.groupBy("cell").applyInPandas(
        _first_level(n_shards), "digest binary, cell long, bin long, bytes long"), "shard-cells")
    level = placed.groupBy("cell", "bin").agg(F.sum("bytes").alias("bytes"))
    bins = level.select("cell", "bin").withColumn("top", F.col("cell")).withColumn("shard", F.col("bin"))
    while cells > 1:
        ups = materialize(level.withColumn("parent", F.floor(F.col("cell") / fan)).groupBy("parent").applyInPandas(
            _next_level(n_shards), "parent long, cell long, bin long, up long, bytes long"), "shard-level")
        bins = (bins.join(ups.select(F.col("cell").alias("top"), F.col("bin").alias("shard"), "parent", "up"),
                          ["top", "shard"])
                .select("cell", "bin", F.col("parent").alias("top"), F.col("up").alias("shard")))
        level = ups.groupBy(F.col("parent").alias("cell"), F.col("up").alias("bin")).agg(F.sum("bytes").alias("bytes"))
        cells = math.ceil(cells / fan)
    where = placed.join(bins.select("cell", "bin", "shard"), ["cell", "bin"]).select("digest", "shard")
    out = materialize(rows.join(where, "digest").withColumn("shard", F.col("shard").cast("int")), "shard-out")
    return running_total(out, ["shard"], F.lit(1), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", n_rows)
