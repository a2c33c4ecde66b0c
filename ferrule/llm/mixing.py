"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

Targets: a source asks for ``ratio`` x all words x its weight's share, but for no more than
``epochs`` times its own words; what is cut off goes to the others by weight (water filling).

Draw: each source's documents stand in a random order fixed by a seeded hash, and the words
of that stream are counted off in blocks. The mix takes the first blocks of the stream up to
the target, the stream starting over for a second epoch; the document at the target's end is
cut there, so a source gives its target to the word. The taken blocks go to output shards
of equal size: a tree halves the range of shards, and at each node the left half's count of
blocks of every source is drawn from the multivariate hypergeometric law of that node's
blocks, one source after the other. The leaves hold exact quotas; each shard takes its
quota of the next blocks of each source's (already permuted) stream, so draws are disjoint.
A document goes to the shard of the block it starts in. ``shuffle_key`` gives a shard's local order.

Only DataFrame functions are used. Running sums go through ``cell_bases`` and ``place``, so a source
with a third of all rows is never one task's work; the tree works on one row per node.

Cases: a null or blank text has no words: its target share is none and it is never drawn; a null
source is a source of its own, last in order; repeated rows are rows like any other;
equal ids are ordered by their text's hash. Columns named like an output column give way.
No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, cell_bases, let, materialize, place, with_columns

WEIGHTS, RATIO, EPOCHS = (5, 2, 1), 1.5, 2
BLOCK_WORDS, SHARD_WORDS, SEED = 2048, 1 << 22, 17
CHUNK = 64  # blocks to a join key


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, ratio: float = RATIO, epochs: int = EPOCHS) -> DataFrame:
    """From (source, words): rank, source, source_size, target. One row per source."""
    src = sizes.groupBy("source").agg(F.sum("words").alias("source_size"))
    src = src.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("at", F.col("cap") / F.col("w"))
    whole, lower = Window.partitionBy(), Window.orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(whole) * ratio
    # the level to which the uncapped are filled if all with a smaller cap / weight are capped
    src = src.withColumn("level", (budget - F.coalesce(F.sum("cap").over(lower), F.lit(0.0)))
                         / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(lower), F.lit(0.0))))
    level = F.min_by(F.when(F.col("at") >= F.col("level"), F.col("level")),
                     F.when(F.col("at") >= F.col("level"), F.struct("at", "rank"))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(F.col("w") * level, F.col("cap")))
    return src.select("rank", "source", "source_size", target.alias("target"))


def _uniform(*cols) -> Column:
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """A hypergeometric draw by inversion of ``u``: how many of ``draws`` out of ``total`` are among ``good``.

    Probabilities relative to the mode's follow from one another by ratios, outwards from the
    mode for 10 standard deviations and 30 steps; past that nothing is left at double precision.
    """
    known = F.struct(total.cast("double").alias("all_"), good.cast("double").alias("good_"), draws.cast("double").alias("draws_"))

    def with_mode(v):
        N, K, n = v["all_"], v["good_"], v["draws_"]
        low, high = F.greatest(F.lit(0.0), n + K - N), F.least(n, K)
        share = K / F.greatest(N, F.lit(1.0))
        reach = F.ceil(F.sqrt(F.greatest(F.lit(0.0), n * share * (1 - share))) * 10 + 30).cast("double")
        mode = F.least(high, F.greatest(low, F.floor((n + 1) * (K + 1) / (N + 2)).cast("double")))
        return let(mode, lambda m: F.struct(
            N.alias("all_"), K.alias("good_"), n.alias("draws_"), m.alias("mode"),
            F.least(reach, high - m).cast("int").alias("up"), F.least(reach, m - low).cast("int").alias("down")))

    def walk(v, sign: int, stop: Column) -> Column:
        """The relative probabilities beyond the mode: their sum, and the first value at which it reaches ``stop``."""
        N, K, n = v["all_"], v["good_"], v["draws_"]

        def step(s, j):
            x = v["mode"] + j * sign
            ratio = ((K - x + 1) * (n - x + 1) / (x * (N - K - n + x)) if sign > 0
                     else (x + 1) * (N - K - n + x + 1) / ((K - x) * (n - x)))
            p = s["p"] * ratio
            return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"),
                            F.when((s["x"] < 0) & (s["sum"] + p >= stop), x).otherwise(s["x"]).alias("x"))

        steps = v["up"] if sign > 0 else v["down"]
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("x"))
        return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.expr("cast(array() as array<int>)")),
                           start, step)

    def pick(v):
        never = F.lit(float("inf"))
        sums = F.struct(walk(v, 1, never)["sum"].alias("up"), walk(v, -1, never)["sum"].alias("down"))
        return let(sums, lambda z: let(u * (z["up"] + z["down"] + 1) - 1, lambda aim: F.when(aim <= 0, v["mode"])
                   .when(aim <= z["up"], walk(v, 1, aim)["x"]).otherwise(walk(v, -1, aim - z["up"])["x"])))

    return let(let(known, with_mode), lambda v: let(pick(v), lambda x: F.when(x < 0, v["mode"]).otherwise(x))).cast("long")


def shard_quotas(targets: DataFrame, n_shards: int, block_words: int, seed: int) -> DataFrame:
    """The tree: rows (rank, shard, first, last) for the blocks ``first`` to ``last`` - 1 of a source's stream."""
    blocks = targets.select("rank", F.ceil(F.floor(F.col("target") + 0.5) / block_words).cast("long").alias("q"))
    root = blocks.agg(F.array_sort(F.collect_list(F.struct("rank", "q"))).alias("have")).select(
        F.lit(0).cast("long").alias("lo"), F.lit(n_shards).cast("long").alias("hi"),
        F.transform("have", lambda x: x["rank"]).alias("ranks"), F.transform("have", lambda x: x["q"]).alias("have"))
    root = root.withColumn("all", F.aggregate("have", F.lit(0).cast("long"), lambda a, x: a + x))
    nodes, width, leaf = root, n_shards, 1
    while width > 1:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        room = F.floor(mid * F.col("all") / n_shards) - F.floor(F.col("lo") * F.col("all") / n_shards)
        start = F.struct(F.aggregate("have", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
                         room.cast("long").alias("draws"), F.expr("cast(array() as array<bigint>)").alias("out"))

        def draw(s, good):
            u = _uniform(F.lit(seed), F.col("lo"), F.col("hi"), F.size(s["out"]))
            got = F.when(good >= s["total"], s["draws"]).otherwise(hypergeometric(s["total"], good, s["draws"], u))
            return let(got, lambda g: F.struct((s["total"] - good).alias("total"), (s["draws"] - g).alias("draws"),
                                               F.concat(s["out"], F.array(g)).alias("out")))

        left = F.aggregate("have", start, draw)["out"]
        halves = nodes.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, left)).withColumn("mid", mid)
        one = F.struct("lo", "hi", "have")
        two = (F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("have")),
               F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("have", "left", lambda a, b: a - b).alias("have")))
        nodes = (halves.withColumn("n", F.explode(F.when(F.col("left").isNull(), F.array(one)).otherwise(F.array(*two))))
                 .select("n.lo", "n.hi", "ranks", "n.have", "all"))
        width, leaf = -(-width // 2), leaf * 2
        if leaf % 256 == 0 or width == 1:  # written, as a plan that goes on growing costs more than the rows
            nodes = materialize(nodes.repartition("lo") if leaf > 256 else nodes, "mix-tree")
    leaves = (nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("ranks", "have")).alias("z"))
              .select("shard", F.col("z.ranks").alias("rank"), F.col("z.have").alias("n")).where("n > 0"))
    last = F.sum("n").over(Window.partitionBy("rank").orderBy("shard"))
    return leaves.withColumn("last", last).select("rank", "shard", (F.col("last") - F.col("n")).alias("first"), "last")


def plan_mix(docs: DataFrame, weights: tuple = WEIGHTS, ratio: float = RATIO, epochs: int = EPOCHS,
             block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED,
             doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and draws, an array of (epoch, shard, words, shuffle_key).

    ``words`` is the document's size, or less for the one document that a source's target cuts;
    a document that the mix leaves out has no draws.
    """
    d, t, s = F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.col(f"`{source}`")
    keyed = docs.withColumns({  # a source's key: itself, and never null
        "__size": n_words(t), "__h": F.xxhash64(d, t, F.lit(seed)),
        "__s": F.concat(F.when(s.isNull(), "0").otherwise("1"), F.coalesce(s, F.lit("")))})
    narrow = materialize(keyed.select("__s", s.alias("source"), "__size", "__h"), "mix-sizes")
    n_rows = narrow.count()
    targets = materialize(source_targets(narrow.select("source", F.col("__size").alias("words")), weights, ratio, epochs),
                          "mix-targets")
    words = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]  # one number
    quotas = shard_quotas(targets, max(1, -(-int(words) // shard_words)), block_words, seed)

    # for each cell of the stream, the shards that its blocks fall in, for all epochs
    bases = cell_bases(narrow, ["__s"], F.col("__size"), [F.col("__h")], n_rows)
    known = targets.select("rank", "source_size", "target", F.floor(F.col("target") + 0.5).alias("__take"),
                           F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"),
                                    F.coalesce("source", F.lit(""))).alias("__s"))
    bases = bases.join(known, "__s")
    epoch_list = F.array(*[F.lit(e).cast("long") for e in range(epochs)])
    spans = (bases.withColumn("e", F.explode(epoch_list))
             .withColumn("lo", F.col("e") * F.col("source_size") + F.col("__base"))
             .withColumn("hi", F.least(F.col("lo") + F.col("__sum"), F.col("__take"))).where("hi > lo")
             .select("__s", "__cell", "rank", F.floor(F.col("lo") / block_words).alias("lo"),
                     F.floor((F.col("hi") - 1) / block_words).alias("hi")))
    spans = spans.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("lo") / CHUNK), F.floor(F.col("hi") / CHUNK))))
    owners = quotas.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / CHUNK),
                                                             F.floor((F.col("last") - 1) / CHUNK))))
    shards = (spans.join(owners, ["rank", "chunk"]).where("first <= hi and last > lo")
              .groupBy("__s", "__cell").agg(F.array_sort(F.collect_set(F.struct("first", "shard"))).alias("__shards")))
    bases = bases.drop("rank").withColumnsRenamed({"source_size": "__source_size", "target": "__target"}).join(
        shards, ["__s", "__cell"], "left")

    at = place(keyed, bases, ["__s"], F.col("__size"), [F.col("__h")], "__start", n_rows)
    draws = []
    for e in range(epochs):
        start = F.col("__start") + e * F.col("__source_size")
        block = F.floor(start / block_words)
        shard = F.try_element_at(F.filter("__shards", lambda b: b["first"] <= block), F.lit(-1))["shard"]
        draws.append(F.struct(F.lit(e).alias("epoch"), shard.alias("shard"),
                              F.least(F.col("__size"), F.col("__take") - start).alias("words"),
                              F.xxhash64("__h", F.lit(e), F.lit(seed)).alias("shuffle_key")))
    out = with_columns(at, {"size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"),
                            "draws": F.filter(F.array(*draws), lambda x: x["words"] > 0)})
    return out.drop("__s", "__h", "__size", "__source_size", "__target", "__take", "__shards", "__start")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it stands."""
    pieces = F.regexp_extract_all(text, F.lit(f"{SPACE_CLASS}*{WORD_CLASS}+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mix itself: a row of ``docs`` for each draw, with epoch, shard and shuffle_key; cut texts are cut."""
    drawn = plan_mix(docs, text=text, **how).withColumn("__d", F.explode("draws"))
    cut = F.when(F.col("__d.words") < F.col("size"), first_words(F.col(f"`{text}`"), F.col("__d.words")))
    drawn = drawn.withColumn(text, cut.otherwise(F.col(f"`{text}`")))
    return with_columns(drawn, {"epoch": F.col("__d.epoch"), "shard": F.col("__d.shard"),
                                "shuffle_key": F.col("__d.shuffle_key")}).drop("__d", "draws", "size", "source_size", "target")


def in_shards(mixed: DataFrame) -> DataFrame:
    """``mix``'s rows, each shard's together and in their local order."""
    return mixed.repartition("shard").sortWithinPartitions("shard", "shuffle_key")
