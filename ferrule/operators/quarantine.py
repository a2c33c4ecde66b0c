"""Rejected rows, error summaries and run counts.

Tabs of different tables have different columns, so the quarantine keeps
the row as ``map<string,string>`` next to fixed lineage columns; one dataset
holds every tab of every run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .rules import qcol

LINEAGE = ("file", "authors", "tab", "target_table", "mode", "file_seq", "tab_seq", "row_no")
NULL_MARK = "\\N"


def row_map(payload: list[str], names: list[str] | None = None) -> Column:
    """Payload columns as ``map<string,string>`` (values as text), under ``names`` if given."""
    if not payload:
        return F.create_map().cast("map<string,string>")
    return F.map_from_arrays(F.array(*[F.lit(c) for c in names or payload]),
                             F.array(*[qcol(c).cast("string") for c in payload]))


def map_text(m: Column | str) -> Column:
    """Sorted ``key=value;...`` text of a map (NULL values as ``\\N``), for comparisons."""
    m = F.col(m) if isinstance(m, str) else m
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="),
                                                             F.coalesce(e["value"], F.lit(NULL_MARK)))), ";")


def map_text_sql(columns: list[str], prefix: str = "") -> str:
    """DuckDB twin of :func:`map_text` over named columns."""
    parts = [f"'{c}=' || coalesce(CAST({prefix}\"{c}\" AS VARCHAR), '{NULL_MARK}')" for c in sorted(columns)]
    return "concat_ws(';', " + ", ".join(parts) + ")" if parts else "''"


def to_quarantine(annotated: DataFrame, payload: list[str], run_id: str) -> DataFrame:
    """B5 rows: rejected rows only, lineage + row map + the failing rule."""
    return (annotated.where(F.col("rule_id").isNotNull())
            .select(F.lit(run_id).alias("run_id"), "file", "authors", "tab", "target_table", "row_no",
                    row_map(payload).alias("row"), "rule_column", "rule_id", "rule_message"))


def error_desc(column: Column, n: Column, message: Column) -> Column:
    """One summary line per (tab, column, rule) with its count (F1)."""
    return F.when(column.isNull(), F.concat(message, F.lit(" ("), n.cast("string"), F.lit(" rows)"))) \
        .otherwise(F.concat(F.lit("Column "), column, F.lit(" has "), n.cast("string"),
                            F.lit(" items: "), message))


def error_desc_sql(column: str, n: str, message: str) -> str:
    return (f"CASE WHEN {column} IS NULL THEN {message} || ' (' || CAST({n} AS VARCHAR) || ' rows)' "
            f"ELSE 'Column ' || {column} || ' has ' || CAST({n} AS VARCHAR) || ' items: ' || {message} END")


def error_details(quarantine: DataFrame) -> DataFrame:
    """Orig_File_Name, File_Authors, Tab_Name, SQL Table, Error Desc.

    A partial+final hash aggregate: a hot (tab, rule) group is combined map-side."""
    g = (quarantine.groupBy("file", "authors", "tab", "target_table", "rule_column", "rule_id", "rule_message")
         .agg(F.count(F.lit(1)).alias("n")))
    return g.select(S.base_name("file").alias("orig_file_name"), F.col("authors").alias("file_authors"),
                    F.col("tab").alias("tab_name"), F.col("target_table").alias("sql_table"),
                    error_desc(F.col("rule_column"), F.col("n"), F.col("rule_message")).alias("error_desc"))


def union_all_by_name(frames: list[DataFrame]) -> DataFrame:
    """union of frames with different columns; missing columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    """union, then drop duplicate rows."""
    return union_all_by_name(frames).dropDuplicates()


def run_counts(annotated: DataFrame, run_id: str) -> DataFrame:
    """Per tab (missing tab -> ``default``) rows, accepted, rejected, files; one log line each."""
    tab_key = F.coalesce(F.col("tab"), F.lit("default"))
    g = (annotated.groupBy(tab_key.alias("tab_key"), "target_table", "mode")
         .agg(F.count(F.lit(1)).alias("n_rows"),
              F.count(F.when(F.col("rule_id").isNull(), 1)).alias("n_accepted"),
              F.count(F.col("rule_id")).alias("n_rejected"),
              F.countDistinct("file").alias("n_files")))
    msg = F.concat(F.lit("Validated "), F.col("mode"), F.lit(" tab "), F.col("tab_key"), F.lit(" for "),
                   F.col("target_table"), F.lit(": "), F.col("n_accepted").cast("string"), F.lit(" accepted, "),
                   F.col("n_rejected").cast("string"), F.lit(" rejected"))
    return g.select(F.lit(run_id).alias("run_id"), "tab_key", "target_table", "mode", "n_rows", "n_accepted",
                    "n_rejected", "n_files",
                    F.when(F.col("n_rejected") > 0, F.lit("warning")).otherwise(F.lit("info")).alias("level"),
                    msg.alias("message"))
