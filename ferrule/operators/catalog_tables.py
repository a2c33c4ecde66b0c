"""Tables that Spark's own catalog knows: create, insert by name, update by partition.

``CREATE TABLE … USING parquet PARTITIONED BY … CLUSTERED BY`` with column defaults; inserts are ``INSERT INTO … BY
NAME``, so unlisted columns take their DEFAULT, or NULL.  An update rewrites the partitions that
hold a changed row, or get one, by dynamic partition overwrite.  The table is bucketed by its key: reading it
gives the key's hash partitioning, so the key joins shuffle the batch and never the target, and the rows are
written as they lie.

Writes are Spark's: each insert statement is one job commit.  An update may be repeated: a run that was cut off between
the overwrite and the removal of emptied partitions leaves moved rows twice, and the next one, which gives both the
same values, writes one of them.

An empty text in the partition column is stored as NULL, as Spark's file tables do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import spark_type
from .catalog import ColumnSpec, TableSpec
from .skipping import touched


def quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def column_ddl(column: ColumnSpec) -> str:
    kind = spark_type(column.data_type, column.precision, column.scale)
    return f"{quoted(column.name)} {kind}" + (f" DEFAULT {column.default}" if column.default is not None else "")


def create(spark: SparkSession, name: str, spec: TableSpec, partition_by: str | None = None, buckets: int = 8,
           location: str | None = None) -> None:
    """Create ``name`` with the columns of ``spec``, bucketed by its primary key (if any) and partitioned by one column."""
    ddl = [f"CREATE TABLE {quoted(name)} ({', '.join(column_ddl(c) for c in spec.columns)}) USING parquet"]
    if partition_by:
        ddl.append(f"PARTITIONED BY ({quoted(partition_by)})")
    if spec.primary_key:
        keys = ", ".join(quoted(k) for k in spec.primary_key)
        ddl.append(f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS")
    if location:
        ddl.append("LOCATION '" + location.replace("'", "\\'") + "'")
    spark.sql(" ".join(ddl))


def _bucketing(spark: SparkSession, name: str) -> tuple[int, list[str]]:
    """The table's number of buckets and their columns, from the catalog."""
    facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)}").collect()}
    columns = [c.strip().strip("`") for c in facts.get("Bucket Columns", "[]").strip("[]").split(",") if c.strip()]
    return int(facts.get("Num Buckets", 0) or 0), columns


def partition_column(spark: SparkSession, name: str) -> str | None:
    return next((c.name for c in spark.catalog.listColumns(name) if c.isPartition), None)


def _dealt(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    """Rows dealt as the table's buckets are, so that a task writes one file a partition."""
    buckets, columns = _bucketing(spark, name)
    return rows.repartition(buckets, *[F.col(f"`{c}`") for c in columns]) if buckets and set(columns) <= set(rows.columns) else rows


def insert(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Append ``rows`` by column name; columns that they don't have take the table's DEFAULT, or NULL."""
    spark.sql(f"INSERT INTO {quoted(name)} BY NAME SELECT * FROM {{rows}}", rows=_dealt(spark, name, rows))


def _is_any(column: Column, values: list) -> Column:
    """``column`` is one of ``values``, NULL included; plain comparisons, so that partitions are pruned."""
    given = [v for v in values if v is not None]
    tests = ([column.isin(given)] if given else []) + ([column.isNull()] if len(given) < len(values) else [])
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _values(df: DataFrame, column: str) -> list:
    """The distinct partition values (metadata: one each)."""
    return [r[0] for r in df.select(F.col(f"`{column}`")).distinct().collect()]


def with_changes(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``target`` with the columns of ``changes`` (one row per key) in the rows that it names, NULL included."""
    new = changes.select(F.col(f"`{key}`"), F.lit(True).alias("_hit"), *[F.col(f"`{c}`").alias(f"_new_{c}") for c in changes.columns if c != key])
    given = {c for c in changes.columns if c != key}
    return target.join(new, key, "left").select(*[
        (F.when(F.col("_hit"), F.col(f"`_new_{c}`")).otherwise(F.col(f"`{c}`")) if c in given else F.col(f"`{c}`"))
        .cast(target.schema[c].dataType).alias(c) for c in target.columns])


def update(spark: SparkSession, name: str, changes: DataFrame, key: str, primary_key: tuple[str, ...] = ()) -> None:
    """Set the columns of ``changes`` in the rows of ``name`` with its ``key``; keys that the table doesn't have do nothing.

    ``changes`` is read several times: pass a written or persisted table.  ``key`` may be one column of a wider
    ``primary_key``.  Only partition values come to the driver."""
    target, part = spark.table(name), partition_column(spark, name)
    if part is None:
        raise ValueError(f"{name} is not partitioned: an update would rewrite it whole")
    moves = part in changes.columns
    hits = touched(target.select(*dict.fromkeys([key, part])), changes.select(F.col(f"`{key}`")), key)
    pairs = (hits.join(changes.select(F.col(f"`{key}`"), F.col(f"`{part}`").alias("_to")), key) if moves
             else hits.withColumn("_to", F.col(f"`{part}`"))).select(F.col(f"`{part}`").alias("_from"), "_to").distinct().collect()
    if not pairs:
        return
    old = list(dict.fromkeys(r["_from"] for r in pairs))
    rows = target.where(_is_any(F.col(f"`{part}`"), list(dict.fromkeys([*old, *(r["_to"] for r in pairs)]))))
    final = with_changes(rows, changes, key)
    emptied = []
    if moves:
        # after a run that was cut off, a moved row lies in both partitions, and is now the same in both
        final = final.dropDuplicates(list(primary_key or (key,)))
        held = set(_values(with_changes(rows.select(*dict.fromkeys([key, part])), changes.select(F.col(f"`{key}`"), F.col(f"`{part}`")), key), part))
        emptied = [v for v in old if v not in held]
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        columns = ", ".join(quoted(c) for c in target.columns)
        spark.sql(f"INSERT OVERWRITE {quoted(name)} SELECT {columns} FROM {{rows}}", rows=final)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    for value in emptied:
        literal = "null" if value is None else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
        spark.sql(f"ALTER TABLE {quoted(name)} DROP IF EXISTS PARTITION ({quoted(part)} = {literal})")
    spark.catalog.refreshTable(name)
