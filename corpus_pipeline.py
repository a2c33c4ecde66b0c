"""The corpus pipeline: documents through four operators, each stage written as Parquet and read again.

quality (rejects go) -> near-duplicates (one document of each group stays) -> mixing sources to
target weights (documents leave, or come twice; a source's last one may be cut) -> packing (pieces in sequences).
All stages but the last return the columns of the documents they get. Learned, drawn and cut
results have no SQL form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import mixing, neardup, packing, quality
from ferrule.llm.common import materialize, table
from ferrule.llm.queries import bpe_ranks


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator's output has, and the new name of each column."""
    names = {c: f"__in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores 0.5 or more."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",))
    rows, name = _apart(docs)
    scored = quality.score(rows, model, text=name["text"], metadata=(name["n_chars"],))
    return scored.where("score >= 0.5").drop("score").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shares at least 80 % of its five-word shingles, link by link: that of the smallest id.

    Rows are told apart by a key of their own, so ids may be repeated or null (a null one comes last)."""
    rows, name = _apart(docs)
    rows = materialize(rows.withColumn("key", F.monotonically_increasing_id()), "near-rows")
    judged = materialize(neardup.near_duplicates(rows, doc_id="key", text=name["text"]).select("doc_id", "component_id"), "near-rows-judged")
    ids = rows.select("key", F.struct(F.col(name["doc_id"]).isNull().alias("none"), F.col(name["doc_id"]).alias("id"), "key").alias("rank"))
    first = judged.join(ids, F.col("doc_id") == F.col("key")).groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.key")
    gone = judged.join(first, F.col("doc_id") == F.col("key"), "left_anti").select("doc_id", F.lit(False).alias("kept"))
    return neardup.one_of_each(rows, gone, doc_id="key").select(*name.values()).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix draws, once for each draw, with the text that it takes and that text's length."""
    rows, name = _apart(docs)
    mixed = mixing.mix(rows, doc_id=name["doc_id"], text=name["text"], source=name["source"])
    n_chars = F.length(name["text"]).cast(docs.schema["n_chars"].dataType)
    return mixed.withColumn(name["n_chars"], n_chars).select(*name.values()).toDF(*docs.columns)


def pack_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, sequence and offset; ``packing.sequences`` puts them together."""
    return packing.pack(docs, bpe_ranks(), keep_ids=True)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources),
          ("packing", pack_pieces)]

#: The stages learn, draw and cut; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
