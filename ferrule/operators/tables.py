"""Copy-on-write Parquet tables for update and insert.

Plain Parquet has no UPDATE or MERGE, so a change writes new files and then
publishes a manifest that lists the folders of each partition.  A commit is
one new file ``_commits/vNNNNNN`` (created, never overwritten), so readers
see the old or the new version and two writers can't both publish one.
Inserts add folders; only an update replaces a partition's folders, and only
those that held a changed row - a row that moves is added to its new one.

Partition folders are named by a digest of the value, and the column itself
stays in the files: NULLs and texts like ``007`` come back as they were.
A commit may carry a token; ``applied`` tells whether it was published, so a
retried run does not apply twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import fs
from . import apply as A

PART = "_part"                       # name of the physical partition folders
ENTRIES = "part string, path string"


def part_key(column: Column | str | None) -> Column:
    """The partition folder of a row: a digest of its partition value (one for NULL, one if unpartitioned)."""
    if column is None:
        return F.lit("all")
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit("v"), F.md5(c.cast("string"))))


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _base(self, table: str) -> str:
        return f"{self.root}/{table}"

    # --- versions -------------------------------------------------------------------------
    def version(self, table: str) -> int:
        """The latest published version; 0 where there is none.  A failing read is an error, not a 0."""
        names = [n for n in fs.children(self.spark, f"{self._base(table)}/_commits") if n.startswith("v")]
        return max((int(n[1:]) for n in names), default=0)

    def _commit(self, table: str, version: int) -> dict:
        return json.loads(fs.read_text(self.spark, f"{self._base(table)}/_commits/v{version:06d}"))

    def _latest(self, table: str) -> dict:
        v = self.version(table)
        if not v:
            raise ValueError(f"no table {table} in {self.root}")
        return self._commit(table, v)

    def applied(self, table: str, token: str) -> bool:
        """Whether a commit with this token was published (looked for from the latest back)."""
        return any(self._commit(table, v)["token"] == token for v in range(self.version(table), 0, -1))

    def manifest(self, table: str) -> DataFrame:
        """One row per folder: part, path.  Its size follows the number of partitions and appends."""
        return self.spark.read.schema(ENTRIES).parquet(self._latest(table)["manifest"])

    def partition_column(self, table: str) -> str | None:
        return self._latest(table)["part_col"]

    def schema(self, table: str) -> StructType:
        return StructType.fromJson(self._latest(table)["schema"])

    # --- read ------------------------------------------------------------------------------
    def read(self, table: str, parts: list[str] | None = None) -> DataFrame:
        """The table, or only the partitions whose keys are in ``parts``; later versions don't change it."""
        latest = self._latest(table)
        schema = StructType.fromJson(latest["schema"])
        entries = self.spark.read.schema(ENTRIES).parquet(latest["manifest"])
        if parts is not None:
            entries = entries.where(F.col("part").isin(parts))
        paths = [e["path"] for e in entries.collect()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # --- write -----------------------------------------------------------------------------
    def create(self, table: str, df: DataFrame, partition_by: str | None = None) -> int:
        return self._publish(table, df, partition_by, df.schema, None, None)

    def commit(self, table: str, rows: DataFrame, replaced: list[str], token: str | None = None) -> int:
        """Publish ``rows`` in place of the partitions ``replaced`` (none: they are added)."""
        latest = self._latest(table)
        kept = self.spark.read.schema(ENTRIES).parquet(latest["manifest"])
        if replaced:
            kept = kept.where(~F.col("part").isin(replaced))
        return self._publish(table, rows, latest["part_col"], StructType.fromJson(latest["schema"]), kept, token)

    def _publish(self, table: str, df: DataFrame, part_col: str | None, schema: StructType,
                 kept: DataFrame | None, token: str | None) -> int:
        base, unique = self._base(table), uuid.uuid4().hex[:12]
        version = self.version(table) + 1
        data, manifest = f"{base}/data/v{version:06d}-{unique}", f"{base}/_manifests/v{version:06d}-{unique}"
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        rows.withColumn(PART, part_key(part_col)).write.partitionBy(PART).parquet(data)
        folders = [n for n in fs.children(self.spark, data) if n.startswith(f"{PART}=")]      # names as written
        new = self.spark.createDataFrame([(n.split("=", 1)[1], f"{data}/{n}") for n in folders], ENTRIES)
        (new if kept is None else kept.unionByName(new)).coalesce(1).write.parquet(manifest)
        fs.create_text(self.spark, f"{base}/_commits/v{version:06d}", json.dumps(
            {"schema": json.loads(schema.json()), "part_col": part_col, "manifest": manifest, "token": token}))
        return version

    def update(self, table: str, batch: DataFrame, key: str) -> int:
        """Rewrite only the partitions that hold a row the batch changes."""
        part = part_key(self.partition_column(table))
        hit = self.read(table).withColumn(PART, part).select(key, PART).join(batch.select(key).distinct(), key, "left_semi")
        touched = [r[0] for r in hit.select(PART).distinct().collect()]          # at most the number of partitions
        if not touched:
            return self.version(table)
        return self.commit(table, A.apply_update(self.read(table, touched), batch, key), touched)

    def insert(self, table: str, rows: DataFrame, token: str | None = None) -> int:
        """Append; nothing that is there is read or rewritten."""
        return self.commit(table, A.insert_columns(rows, self.schema(table)), [], token)
