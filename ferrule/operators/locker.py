"""Data locker: before images by day.

Layout: Parquet partitioned by ``day`` (yyyyMMdd) and ``target_table``;
one row per preserved table row with lineage and the row as
``map<string,string>``.  Reading one day prunes to its partitions;
retention deletes whole day partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fs
from ..functions import scalars as S
from ..functions.types import DEFAULT_SHELF_LIFE_DAYS
from ..session import ensure_checkpoint_dir
from .apply import sequence_keys
from .quarantine import row_map

LOCKER_SCHEMA = ("day string, target_table string, item_id string, file string, authors string, mode string, "
                 "append_time timestamp_ntz, row_no bigint, row map<string,string>")
ITEM_COLUMNS = ["day", "target_table", "item_id", "file", "authors", "mode", "append_time"]


def locker_rows(image: DataFrame, *, target_table: str, item_id: str, file: str, authors: str | None,
                mode: str, as_of: str, row_no: Column | None = None, payload: list[str] | None = None
                ) -> DataFrame:
    """Rows of one preserved item (an update's before image or an insert's rows)."""
    payload = payload or [c for c in image.columns if c != "row_no"]
    ts = F.lit(as_of).cast("timestamp_ntz")
    return image.select(
        S.day_key(ts).alias("day"), F.lit(target_table).alias("target_table"), F.lit(item_id).alias("item_id"),
        S.base_name(F.lit(file)).alias("file"), F.lit(authors).cast("string").alias("authors"),
        F.lit(mode).alias("mode"), ts.alias("append_time"),
        (row_no if row_no is not None else F.lit(None)).cast("bigint").alias("row_no"),
        row_map(payload).alias("row"))


def item_id(run_id: str) -> Column:
    """An item is one tab of one file in one run."""
    return F.concat(F.lit(f"{run_id}:"), F.col("path"), F.lit("#"), F.col("tab"))


def locker_rows_by_tab(image: DataFrame, *, target_table: str, run_id: str, mode: str, as_of: str,
                      row: Column) -> DataFrame:
    """B7 for many tabs at once: ``image`` carries ``path``, ``tab``, ``authors``, ``row_no``."""
    ts = F.lit(as_of).cast("timestamp_ntz")
    return image.select(
        S.day_key(ts).alias("day"), F.lit(target_table).alias("target_table"), F.lit(run_id).alias("run_id"),
        item_id(run_id).alias("item_id"), S.base_name("path").alias("file"),
        F.col("authors").cast("string").alias("authors"), F.lit(mode).alias("mode"), ts.alias("append_time"),
        F.col("row_no").cast("bigint").alias("row_no"), row.alias("row"))


def append(rows: DataFrame, path: str) -> None:
    """B7 sink: under ``day=/target_table=/run_id=``; a repeated run writes its own folders again."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "target_table", "run_id").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A written locker; day, table and run come from the folders, as text."""
    return spark.read.schema("item_id string, file string, authors string, mode string, append_time timestamp_ntz, "
                             "row_no bigint, row map<string,string>, day string, target_table string, run_id string").parquet(path)


def days(locker: DataFrame) -> DataFrame:
    """The days present in the locker."""
    return locker.select("day").distinct()


def items_of_day(locker: DataFrame, day: str) -> DataFrame:
    """The day's items numbered in append order; sheet name ``mode_n``.

    Items are dealt out by range and numbered by the counts of the ranges before theirs: a day of very many
    tabs is no single task's work."""
    ensure_checkpoint_dir(locker.sparkSession)
    items = locker.where(F.col("day") == day).select(*ITEM_COLUMNS).distinct()
    numbered = sequence_keys(items, "item_no", 0, ["append_time", "item_id", "target_table", "mode"])
    return numbered.withColumn("sheet", F.concat_ws("_", "mode", F.col("item_no").cast("string")))


def export_day(locker: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the day with their sheet, TAB_Details of the day)."""
    items = items_of_day(locker, day)
    rows = (locker.where(F.col("day") == day)
            .join(items.select("day", "target_table", "item_id", "mode", "sheet", "item_no"),
                  ["day", "target_table", "item_id", "mode"]))
    details = items.select(F.col("file").alias("orig_file_name"), F.col("authors").alias("file_authors"),
                           F.col("sheet").alias("tab_name"), F.col("target_table").alias("sql_table"),
                           "append_time", "item_no")
    return rows, details


def with_shelf_life(locker: DataFrame, settings: DataFrame | None) -> DataFrame:
    """Each item's retention days from settings, default 14."""
    if settings is None:
        return locker.withColumn("shelf_life_days", F.lit(DEFAULT_SHELF_LIFE_DAYS))
    s = settings.select("target_table", F.col("shelf_life_days").alias("_life"))
    return (locker.join(s, "target_table", "left")
            .withColumn("shelf_life_days", F.coalesce("_life", F.lit(DEFAULT_SHELF_LIFE_DAYS))).drop("_life"))


def cutoff_day(as_of: str, life: Column) -> Column:
    return S.day_key(F.date_sub(F.to_date(F.lit(as_of)), life))


def purge(locker: DataFrame, settings: DataFrame | None, as_of: str) -> DataFrame:
    """Keep items whose day is not before ``as_of - shelf life`` (strictly older go)."""
    lived = with_shelf_life(locker, settings)
    return lived.where(F.col("day") >= cutoff_day(as_of, F.col("shelf_life_days"))).drop("shelf_life_days")


def write_export(rows: DataFrame, details: DataFrame, path: str) -> None:
    """B8 sink: one folder per sheet (``sheet=Update_1``...) plus ``TAB_Details``."""
    rows.write.mode("overwrite").partitionBy("sheet").parquet(f"{path}/items")
    details.write.mode("overwrite").parquet(f"{path}/TAB_Details")


def written_partitions(spark: SparkSession, path: str) -> DataFrame:
    """(day, target_table, folder) of a written locker, from the folder names (unescaped as Spark escapes them)."""
    root, out = path.rstrip("/"), []
    for d in fs.children(spark, root):
        if d.startswith("day="):
            out += [(fs.unescape(d[4:], spark), fs.unescape(t[13:], spark), f"{root}/{d}/{t}")
                    for t in fs.children(spark, f"{root}/{d}") if t.startswith("target_table=")]
    return spark.createDataFrame(out, "day string, target_table string, folder string")


def expired_partitions(partitions: DataFrame, settings: DataFrame | None, as_of: str) -> DataFrame:
    """E4 on a written locker: the partitions older than their table's shelf life."""
    lived = with_shelf_life(partitions, settings)
    return lived.where(F.col("day") < cutoff_day(as_of, F.col("shelf_life_days"))).drop("shelf_life_days")


def purge_written(spark: SparkSession, path: str, settings: DataFrame | None, as_of: str) -> list[str]:
    """Delete the expired partition folders of a written locker; returns them.

    Whole-folder deletes; an emptied day goes with its last table.  The folder list is
    metadata: one entry per day and table."""
    gone = [r["folder"] for r in expired_partitions(written_partitions(spark, path), settings, as_of).collect()]
    for folder in gone:
        fs.delete_folder(spark, folder)
        day = folder.rsplit("/", 1)[0]
        if not fs.children(spark, day):
            fs.delete_folder(spark, day)
    return gone
