"""XML record sets (A10-A12, B9, S11, S12) on Spark's built-in XML source.

Reading: ``rowTag`` rows, every value kept as text; a row's attributes, text
and nested elements are flattened to one record - the driver only walks the
inferred *schema* to build one ``coalesce`` per output key (first occurrence
wins), the rows stay in executors.
Writing: ``<records><record><var var_name="c">v</var>...</record></records>``
with NULL and empty cells left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTR = "_"            # attribute prefix of the XML source
VALUE = "_VALUE"      # text of an element that also has attributes


def read_records(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """A10: rows of ``row_tag`` elements, all values as text."""
    return (spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", "false")
            .option("attributePrefix", ATTR).option("valueTag", VALUE).load(path))


def _walk(col: Column, dtype: T.DataType, tag: str, out: dict[str, list[Column]]) -> None:
    if isinstance(dtype, T.ArrayType):           # repeated element: the first one wins
        _walk(F.element_at(col, 1), dtype.elementType, tag, out)
        return
    if not isinstance(dtype, T.StructType):
        out.setdefault(tag, []).append(col.cast("string"))
        return
    attrs = [f for f in dtype.fields if f.name.startswith(ATTR) and f.name != VALUE]
    for f in attrs:
        out.setdefault(f.name[len(ATTR):], []).append(col[f.name].cast("string"))
    if VALUE in dtype.fieldNames():
        out.setdefault(tag, []).append(col[VALUE].cast("string"))
    for f in dtype.fields:
        if not f.name.startswith(ATTR):
            _walk(col[f.name], f.dataType, f.name, out)


def flatten(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A11+S11: one flat record per row; first value of a key wins; text trimmed.

    ``keep`` columns are passed through untouched (e.g. a position)."""
    keep = keep or []
    fields = [f for f in records.schema.fields if f.name not in keep]
    out: dict[str, list[Column]] = {}
    for f in fields:
        if f.name.startswith(ATTR) and f.name != VALUE:
            out.setdefault(f.name[len(ATTR):], []).append(F.col(f"`{f.name}`").cast("string"))
    for f in fields:
        if not f.name.startswith(ATTR):
            _walk(F.col(f"`{f.name}`"), f.dataType, f.name, out)
    return records.select(*keep, *[F.trim(F.coalesce(*cols)).alias(k) for k, cols in out.items()])


def merge_first(flat: DataFrame, order: str) -> DataFrame:
    """Many matches merged into one record, first (by ``order``) non-NULL value wins.

    ``min_by`` is a partial aggregate: the merge never gathers the rows of a key."""
    keys = [c for c in flat.columns if c != order]
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").alias("value")) for k in keys]))
    long = flat.select(F.col(order).alias("_pos"), entries.alias("e")).select("_pos", "e.key", "e.value")
    return long.where(F.col("value").isNotNull()).groupBy("key").agg(F.min_by("value", "_pos").alias("value"))


def to_var_records(df: DataFrame) -> DataFrame:
    """One ``var`` element per non-empty cell, named by ``var_name``."""
    cells = F.array(*[F.struct(F.lit(c).alias(f"{ATTR}var_name"), F.col(f"`{c}`").cast("string").alias(VALUE))
                      for c in df.columns])
    return df.select(F.filter(cells, lambda x: x[VALUE].isNotNull() & (x[VALUE] != "")).alias("var"))


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """B9 sink (values are escaped by the writer)."""
    (to_var_records(df).write.format("xml").option("rootTag", "records").option("rowTag", "record")
     .option("attributePrefix", ATTR).option("valueTag", VALUE).mode(mode).save(path))


def read_var_records(spark: SparkSession, path: str) -> DataFrame:
    """Read B9 output back as (file, record position, var_name, value)."""
    schema = T.StructType([T.StructField("var", T.ArrayType(T.StructType([
        T.StructField(f"{ATTR}var_name", T.StringType()), T.StructField(VALUE, T.StringType())])))])
    recs = (spark.read.format("xml").option("rowTag", "record").option("attributePrefix", ATTR)
            .option("valueTag", VALUE).schema(schema).load(path))
    return recs.select(F.col("_metadata.file_name").alias("file_name"),
                       F.monotonically_increasing_id().alias("record_id"),
                       F.posexplode("var").alias("pos", "v")) \
        .select("file_name", "record_id", "pos", F.col(f"v.{ATTR}var_name").alias("var_name"),
                F.col(f"v.{VALUE}").alias("value"))
