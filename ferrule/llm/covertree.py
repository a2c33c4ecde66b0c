"""Embedding near-duplicates: a threshold join by dual traversal of cover trees.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so a cosine threshold is a distance, and the
triangle inequality prunes. The tree's top level is spread over the cluster: at most
``PIVOTS`` sampled vectors are its centres (that bounded sample is all that comes to the driver), every
vector belongs to its nearest one, and a centre's covering radius is the largest distance in
it. Two centres' vectors meet only if the centres are no further apart than both radii and
the threshold together, and only within one label. Centres with more than ``BLOCK`` vectors
are cut into blocks, so a task holds two blocks at most, whatever the label or cluster.

In a task each block gets its lower levels: nested centres with radii halving from level to
level. Pairs of nodes are then followed down from the roots; a pair is dropped when its centres are further
apart than both covering radii and the threshold, all of it links when even its
furthest vectors must, and what is left at the leaves is compared exactly, in double precision.
A task returns counts and one anchor per vector, never its pairs.

Equal vectors of a label are one vector with a multiplicity, so copies cost one row.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
link with nothing; vectors of different length don't compare; rows with a null id take no part,
with component null and kept; rows with one id share their component. Other
columns are ignored, whatever their names. No vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import connected, materialize
from .tokens import releasing

PIVOTS, NODE_ROWS, BLOCK, LEAF = 512, 8192, 2048, 16
SLACK = 1e-7  # more than rounding can take from a bound


class Node:
    """A centre, the vectors it covers, how far the furthest is, and its children (one level down)."""

    __slots__ = ("centre", "children", "members", "radius")

    def __init__(self, centre: int, members: np.ndarray, radius: float) -> None:
        self.centre, self.members, self.radius, self.children = centre, members, radius, []


def _far(x: np.ndarray, i: int, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x[rows] @ x[i]), 0))


def build(x: np.ndarray, stop: float) -> Node:
    """The cover tree of unit vectors ``x``, down to radius ``stop`` or LEAF vectors."""
    rows = np.arange(len(x))
    root = Node(0, rows, float(_far(x, 0, rows).max()))
    todo = [(root, 1.0)]
    while todo:
        node, r = todo.pop()
        if len(node.members) <= LEAF or node.radius <= stop:
            continue
        while r >= node.radius:
            r /= 2
        left, centre = node.members, node.centre
        while len(left):  # the parent's centre first: levels are nested
            d = _far(x, centre, left)
            near = d <= r
            node.children.append(Node(centre, left[near], float(d[near].max(initial=0.0))))
            left = left[~near]
            centre = int(left[0]) if len(left) else -1
        todo += [(c, r / 2) for c in node.children]
    return root


def dual(x: np.ndarray, y: np.ndarray, a: Node, b: Node, reach: float, whole, leaf) -> None:
    """Follow pairs of nodes of the trees over x and y; calls whole(A, B) or leaf(A, B) for what may link."""
    d = float(np.sqrt(max(2 - 2 * float(x[a.centre] @ y[b.centre]), 0)))
    todo = [(a, b)] if d <= a.radius + b.radius + reach + SLACK else []
    while todo:
        p, q = todo.pop()
        if not p.children and not q.children:
            leaf(p, q)
            continue
        ps, qs = p.children or [p], q.children or [q]
        left, right = np.array([n.centre for n in ps]), np.array([n.centre for n in qs])
        ra, rb = np.array([n.radius for n in ps]), np.array([n.radius for n in qs])
        for at in range(0, len(ps), 512):
            gap = np.sqrt(np.maximum(2 - 2 * (x[left[at:at + 512]] @ y[right].T), 0))
            both = ra[at:at + 512, None] + rb[None, :]
            for i, j in zip(*np.nonzero(gap <= both + reach + SLACK), strict=True):
                if gap[i, j] + both[i, j] <= reach - SLACK:
                    whole(ps[at + i], qs[j])
                else:
                    todo.append((ps[at + i], qs[j]))


class Links:
    """What a task keeps of its links: a count by vector and in-task components."""

    def __init__(self, n: int, weight: np.ndarray) -> None:
        self.count, self.root, self.weight = np.zeros(n, dtype=np.int64), np.arange(n), weight

    def _join(self, rows: np.ndarray) -> None:
        roots = np.unique(self.root[rows])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots[1:])] = roots[0]

    def add(self, rows: np.ndarray, cols: np.ndarray, hit: np.ndarray, both_ways: bool) -> None:
        """``hit[i, j]``: rows[i] links with cols[j]. ``both_ways``: the mirrored pair comes on its own."""
        self.count[rows] += hit @ self.weight[cols]
        if not both_ways:
            self.count[cols] += hit.T @ self.weight[rows]
        for i in np.flatnonzero(hit.any(axis=1)):
            self._join(np.append(cols[hit[i]], rows[i]))


def compare(raw: np.ndarray, n_left: int, weight: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts and roots over all rows of ``raw``: the first n_left against the others, or all among themselves if there are no others."""
    # by a power of two, which changes no digit: the cosine is that of the numbers as they are
    raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])
    norm = np.sqrt((raw * raw).sum(axis=1))
    unit = raw / norm[:, None]
    reach, links, self_join = float(np.sqrt(2 - 2 * cosine)), Links(len(raw), weight), n_left == len(raw)
    off = 0 if self_join else n_left
    x, y = unit[:n_left], unit[off:]

    def leaf(p: Node, q: Node) -> None:
        rows, cols = p.members, q.members + off
        for at in range(0, len(rows), 1024):
            r = rows[at:at + 1024]
            hit = (raw[r] @ raw[cols].T) / (norm[r][:, None] * norm[cols][None, :]) >= cosine
            links.add(r, cols, hit & (r[:, None] != cols[None, :]), self_join)

    def whole(p: Node, q: Node) -> None:
        rows, cols = p.members, q.members + off
        for at in range(0, len(rows), 1024):
            r = rows[at:at + 1024]
            links.add(r, cols, r[:, None] != cols[None, :], self_join)

    if len(x) and len(y):
        a = build(x, reach / 4)
        dual(x, y, a, a if self_join else build(y, reach / 4), reach, whole, leaf)
    return links.count, links.root


def _unit(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "id", "h"], kind="stable").reset_index(drop=True)
        raw = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        count, root = compare(raw, int((pdf["side"] == 0).sum()), pdf["copies"].to_numpy().astype(np.int64), cosine)
        ids = pdf["id"].to_numpy()
        anchor = pd.Series(ids).groupby(root).transform("min").to_numpy()
        some = count > 0
        return pd.DataFrame({"id": ids[some], "h": pdf["h"].to_numpy()[some], "links": count[some], "anchor": anchor[some]})

    return run


def _nearest(pivots: dict[int, np.ndarray]):
    """Adds to each vector its nearest pivot (of its length) and the distance; pivot -1 where there is none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pivot, far = np.full(n, -1, dtype=np.int32), np.zeros(n)
            vec = batch.column("vec")
            sizes = np.diff(np.asarray(vec.offsets)) if n else np.zeros(0)
            flat, starts = np.asarray(vec.flatten(), dtype=np.float64), np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                if int(size) in pivots:
                    rows = np.flatnonzero(sizes == size)
                    x = flat[starts[rows][:, None] + np.arange(int(size))]
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    d = np.sqrt(np.maximum(2 - 2 * (x @ pivots[int(size)].T), 0))
                    pivot[rows], far[rows] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(far)],
                                             [*batch.schema.names, "pivot", "far"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", vec: str = "embedding",
                 label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (vec_id = component_id)."""
    v = F.col("vec")
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vec}`").alias("vec"), F.col(f"`{label}`").alias("label"))
    rows = rows.withColumn("ok", F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall(v, number) & F.exists(v, lambda x: x != 0), F.lit(False)))
    classes = materialize(rows.where("ok").groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
                          .withColumn("h", F.xxhash64("label", "vec")).withColumn("dim", F.size("vec")), "tree-classes")
    n = classes.count()
    picked = classes.orderBy("h").limit(min(PIVOTS, max(1, n // NODE_ROWS))).select("vec").collect()
    pivots: dict[int, np.ndarray] = {}
    for r in picked:
        x = np.array(r.vec, dtype=np.float64)
        x = x / np.abs(x).max()
        pivots[len(x)] = np.vstack([*pivots.get(len(x), []), x / np.sqrt((x * x).sum())])
    placed = materialize(classes.mapInArrow(releasing(_nearest(pivots)), StructType([*classes.schema, StructField("pivot", IntegerType()), StructField("far", DoubleType())])),
                         "tree-placed")
    key = ["label", "dim", "pivot"]
    nodes = placed.groupBy(*key).agg(F.max("far").alias("radius"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    apart = [(d, i, j, float(np.sqrt(max(2 - 2 * float(p[i] @ p[j]), 0)))) for d, p in pivots.items()
             for i in range(len(p)) for j in range(i, len(p))] + [(-1, -1, -1, 0.0)]
    apart = F.broadcast(vectors.sparkSession.createDataFrame(apart, "d int, p int, q int, gap double"))  # PIVOTS^2 / 2 rows at most
    a = nodes.select("label", "dim", F.col("pivot").alias("p"), F.col("radius").alias("rp"), F.col("blocks").alias("bp"))
    b = nodes.select("label", "dim", F.col("pivot").alias("q"), F.col("radius").alias("rq"), F.col("blocks").alias("bq"))
    reach = float(np.sqrt(2 - 2 * cosine))
    meet = (a.join(b, ["label", "dim"]).where("p <= q")
            .join(apart.withColumnsRenamed({"p": "i", "q": "j"}),
                  (F.col("p") == F.col("i")) & (F.col("q") == F.col("j")) & (F.col("dim") == F.col("d")), "left")
            .where(F.coalesce(F.col("gap"), F.lit(0.0)) <= F.col("rp") + F.col("rq") + reach + SLACK))
    units = (meet.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("bp") - 1)))
             .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("bq") - 1))).where("p < q or x <= y"))
    sides = F.when((F.col("p") == F.col("q")) & (F.col("x") == F.col("y")),
                   F.array(F.struct(F.lit(0).alias("side"), F.col("p").alias("pivot"), F.col("x").alias("block")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("p").alias("pivot"), F.col("x").alias("block")),
                F.struct(F.lit(1).alias("side"), F.col("q").alias("pivot"), F.col("y").alias("block"))))
    parts = units.select("label", "dim", "p", "x", "q", "y", F.explode(sides).alias("s")).select(
        "label", "dim", "p", "x", "q", "y", "s.side", "s.pivot", "s.block")
    blocked = placed.join(nodes.select(*key, "blocks"), key).withColumn(
        "block", F.pmod(F.col("h"), F.col("blocks")).cast("int"))
    work = blocked.join(parts, [*key, "block"]).select("label", "dim", "p", "x", "q", "y", "side", "id", "h", "copies", "vec")
    found = materialize(work.groupBy("label", "dim", "p", "x", "q", "y").applyInPandas(
        _unit(cosine), "id long, h long, links long, anchor long"), "tree-links")

    # each row's class, worked out once: the vectors themselves are not needed any more
    ids = materialize(rows.where("ok").select("id", "label", "vec").join(
        classes.select("label", "vec", F.col("id").alias("cid"), "h", "copies"), ["label", "vec"]).select("id", "cid", "h", "copies"),
        "tree-ids")
    again = ids.groupBy("id").agg(F.count("*").alias("c")).where("c > 1")
    ties = ids.join(again, "id").select(F.col("id").alias("u"), F.col("cid").alias("v"))  # rows with one id
    comp = connected(found.select(F.col("id").alias("u"), F.col("anchor").alias("v")).unionByName(ties), "u", "v", "tree-components")
    counts = found.groupBy(F.col("id").alias("cid"), "h").agg(F.sum("links").alias("links"))
    out = (ids.join(counts, ["cid", "h"], "left").join(comp.withColumnRenamed("id", "cid"), "cid", "left")
           .select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "cid").alias("component")))
    # a row that links with nothing may share its id with one that does
    of_id = out.groupBy("id").agg(F.min("component").alias("component"))
    lone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n")).join(of_id, "id", "left")
    out = out.unionByName(lone.select("id", "n", "component"))
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
