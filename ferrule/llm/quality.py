"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairs summed in linear
time as half the square of the sum minus the sum of squares, for each of ``RANK`` factors.
Features x: the shares of a text's words that fall in each of ``BUCKETS`` hash buckets (their
square roots, so that the squares sum to 1); statistics of its form, each as the quantile bin it
falls in; metadata columns likewise, with a bin of their own for missing values.

The model is fitted on at most ``max_rows`` labelled rows, half of them from each class where
there are enough, taken in order of a hash of the id and weighted back to the classes' true
shares. Only that bounded sample comes to the driver. Scoring reads every whole text, a chunk
at a time.

Cases: null and empty texts have no words and are scored by their statistics; of several rows
with one id in the sample one counts; null ids, null labels and labels other than 0 and 1 teach
nothing; without any labels every score is 0.5. Repeated rows get one score. Other columns are ignored,
whatever their names. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import short_batches
from .tokens import chunks, release, releasing, words

BUCKETS, RANK, BINS, MAX_ROWS, SEED = 4096, 8, 10, 8000, 11
_KINDS = np.zeros((256, 6), dtype=bool)  # capital, letter, digit, sentence mark, other mark, line end
_KINDS[65:91, 0] = True
_KINDS[65:91, 1] = _KINDS[97:123, 1] = _KINDS[128:, 1] = True
_KINDS[48:58, 2] = True
_KINDS[[ord(c) for c in ".,;:?'-"], 3] = True
_KINDS[33:127, 4] = ~(_KINDS[33:127, 1] | _KINDS[33:127, 2] | _KINDS[33:127, 3])
_KINDS[10, 5] = True
STATS = ("words", "capitals", "digits", "sentence_marks", "other_marks", "line_ends", "word_length", "bare_marks",
         "marked_words", "repeats", "distinct", "most")


class Model(NamedTuple):
    """``edges``: bin edges by statistic; ``weights``: w0, w; ``factors``: v (features x RANK)."""

    edges: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def _sums(chunk) -> tuple[np.ndarray, np.ndarray]:
    """By text of the chunk: sums that the statistics are made from, and words by bucket."""
    n, w = len(chunk.texts), words(chunk)
    sums = np.zeros((n, 11))
    bounds = np.concatenate([[0], chunk.ends])
    for k in range(6):
        run = np.concatenate([[0], np.cumsum(_KINDS[:, k][chunk.data], dtype=np.int64)])
        sums[:, k] = run[bounds[1:]] - run[bounds[:-1]]
    counts = np.bincount(w.text * BUCKETS + (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=n * BUCKETS)
    if len(w.begin):
        mark = _KINDS[:, 3] | _KINDS[:, 4]
        last, one = mark[chunk.data[w.end - 1]], mark[chunk.data[w.begin]]
        again = np.zeros(len(w.hash), dtype=bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
        for k, x in ((6, np.ones(len(w.hash))), (7, w.end - w.begin), (8, last & one & (w.end - w.begin < 3)),
                     (9, last & ~one), (10, again)):
            sums[:, k] = np.bincount(w.text, weights=x, minlength=n)
    return sums, counts.reshape(n, BUCKETS)


def _by_text(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the column, sums, words by bucket), a text that comes in several chunks put together."""
    held = None
    for chunk in chunks(column):
        texts, (sums, counts) = chunk.texts, _sums(chunk)
        if held is not None:
            if held[0][0] == texts[0]:
                sums[0] += held[1][0]
                counts[0] += held[2][0]
            else:
                yield held
        yield texts[:-1], sums[:-1], counts[:-1]
        held = texts[-1:], sums[-1:], counts[-1:]
    if held is not None:
        yield held


def _stats(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """STATS by text, from its sums."""
    capital, letter, digit, sentence, other, lines, n, length, bare, marked, again = sums.T
    some = np.maximum(n, 1)
    marks = np.maximum(letter + digit + sentence + other, 1)
    return np.stack([
        np.log1p(n), capital / np.maximum(letter, 1), digit / marks, sentence / marks, other / marks, lines / some,
        length / some, bare / some, marked / some, again / some,
        (counts > 0).sum(axis=1) / np.maximum(np.minimum(n, BUCKETS), 1), counts.max(axis=1) / some], axis=1)


def _features(stats: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Dense features: squares of the word shares first, then one-hot bins (the last bin for missing values)."""
    n, k = stats.shape
    x = np.zeros((n, BUCKETS + k * (BINS + 1)), dtype=np.float32)
    np.divide(counts, np.maximum(counts.sum(axis=1, keepdims=True), 1), out=x[:, :BUCKETS], casting="same_kind")
    for j in range(k):
        at = np.where(np.isnan(stats[:, j]), BINS, np.searchsorted(edges[j], stats[:, j], side="right"))
        x[np.arange(n), BUCKETS + j * (BINS + 1) + at] = 1
    return x


def _logits(squares: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linear-time form. ``squares``: the squared features, none of them negative."""
    x = np.sqrt(squares)
    inner = x @ m.factors
    pairs = 0.5 * ((inner * inner).sum(axis=1) - squares @ (m.factors * m.factors).sum(axis=1))
    return m.bias + x @ m.weights + pairs, x, inner


def fit(stats: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray,
        epochs: int = 25, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = SEED) -> Model:
    """Adam on the weighted log loss; ``counts`` are (buckets, counts) of each row."""
    k = stats.shape[1]
    edges = np.sort(np.nanquantile(np.where(np.isnan(stats).all(axis=0), 0.0, stats),
                                   np.arange(1, BINS) / BINS, axis=0).T, axis=1) if len(y) else np.zeros((k, BINS - 1))
    rng, size = np.random.default_rng(seed), BUCKETS + k * (BINS + 1)
    p = [np.zeros(1), np.zeros(size), rng.normal(0, 0.02, (size, RANK))]
    if not len(y):
        return Model(edges, 0.0, p[1].astype(np.float32), p[2].astype(np.float32) * 0)
    mean, var, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at:at + batch]
            dense = np.zeros((len(rows), BUCKETS))
            for i, r in enumerate(rows):
                dense[i, counts[r][0]] = counts[r][1]
            squares = _features(stats[rows], dense, edges)
            z, x, inner = _logits(squares, Model(edges, float(p[0][0]), p[1], p[2]))
            g = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            grads = [np.array([g.sum()]), x.T @ g + decay * p[1],
                     x.T @ (g[:, None] * inner) - (squares.T @ g)[:, None] * p[2] + decay * p[2]]
            t += 1
            for a, d, u, v in zip(p, grads, mean, var, strict=True):
                u += 0.1 * (d - u)
                v += 0.01 * (d * d - v)
                a -= rate * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(edges, float(p[0][0]), p[1].astype(np.float32), p[2].astype(np.float32))


def _with_meta(docs: DataFrame, metadata: tuple[str, ...]) -> DataFrame:
    return docs.withColumns({f"__m{i}": F.log1p(F.greatest(F.col(f"`{c}`").cast("double"), F.lit(0.0)))
                             for i, c in enumerate(metadata)}) if metadata else docs


def _meta(batch: pa.RecordBatch, n: int) -> np.ndarray:
    cols = [batch.column(f"__m{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(n)]
    return np.stack(cols, axis=1) if cols else np.zeros((batch.num_rows, 0))


def _extract(n_meta: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = _meta(batch, n_meta)
            for at, sums, counts in _by_text(batch.column("text").fill_null("")):
                stats = np.concatenate([_stats(sums, counts), meta[at]], axis=1)
                used = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at)), batch.column("label").take(pa.array(at)),
                     pa.array(list(stats), pa.list_(pa.float64())), pa.array(used, pa.list_(pa.int32())),
                     pa.array([c[u] for c, u in zip(counts, used, strict=True)], pa.list_(pa.int32()))],
                    ["doc_id", "label", "stats", "buckets", "counts"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, doc_id: str = "doc_id",
          text: str = "text", metadata: tuple[str, ...] = ()) -> Model:
    """Fit on at most ``max_rows`` of ``labels``' rows (doc_id and a 0/1 label); see the module's notes."""
    short_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)")
    share = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    half = max_rows // 2
    want = {c: min(share.get(c, 0), max(half, max_rows - share.get(1 - c, 0))) for c in (0, 1)}
    picked = [(r.doc_id, r.label) for c in (0, 1) if want[c] for r in
              known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(want[c]).collect()]
    sample = docs.sparkSession.createDataFrame(sorted(set(picked)), "id long, label int")
    rows = _with_meta(docs, metadata).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                                             *[f"__m{i}" for i in range(len(metadata))])
    found = (rows.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).drop("id"))  # at most max_rows short rows
    found = found.mapInArrow(releasing(_extract(len(metadata))), "doc_id long, label int, stats array<double>, "
                                                      "buckets array<int>, counts array<int>")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct("stats", "buckets", "counts")).alias("x"))
    rows = one.select("doc_id", "label", "x.*").toArrow().combine_chunks()
    order = np.lexsort((rows["label"].to_numpy(), rows["doc_id"].to_numpy()))
    y = rows["label"].to_numpy().astype(float)[order]
    have = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([share[int(c)] / have[int(c)] for c in y])
    stats = np.array(rows["stats"].to_pylist(), dtype=float).reshape(len(y), len(STATS) + len(metadata))[order]
    counts = [(rows["buckets"][i].values.to_numpy(), rows["counts"][i].values.to_numpy()) for i in order.tolist()]
    model = fit(stats, counts, y, weight / weight.mean() if len(y) else weight)
    del rows, counts
    release()
    return model


def _score(model: Model, n_meta: int, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta, out = _meta(batch, n_meta), np.zeros(batch.num_rows)
            for at, sums, counts in _by_text(batch.column(text).fill_null("")):
                if len(at):
                    stats = np.concatenate([_stats(sums, counts), meta[at]], axis=1)
                    z = _logits(_features(stats, counts, model.edges), model)[0].astype(float)
                    out[at] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out)], [*keep, "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", metadata: tuple[str, ...] = (),
          keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) with ``score``, for every row."""
    short_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "score"]
    rows = _with_meta(docs, metadata)
    schema = StructType([rows.schema[c] for c in keep] + [StructField("score", DoubleType(), False)])
    return rows.mapInArrow(releasing(_score(model, len(metadata), text, keep)), schema)
