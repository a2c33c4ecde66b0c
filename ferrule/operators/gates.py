"""Tab gates C1-C11 over many tabs at once, as joins against the catalog.

Input: one row per tab ``(tab, target_table, header array<string>, n_rows)``.
Output: the first gate each tab fails (NULL = passes) and, for an update that
passes, its key column.  Column names resolve case-insensitively (C7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .catalog import Catalog, by_shuffle


def _one_row_per_table(catalog: Catalog) -> DataFrame:
    """The catalog as (_schema, _table, _exists, _cols, _keys): lower-case column and key names as arrays."""
    name = [F.col("table_schema").alias("_schema"), F.col("table_name").alias("_table")]
    cols = catalog.columns.groupBy(*name).agg(F.collect_set(F.lower("column_name")).alias("_cols"))
    keys = catalog.primary_keys().groupBy(*name).agg(F.collect_set(F.lower("column_name")).alias("_keys"))
    both = ["_schema", "_table"]
    return (catalog.tables.select(*name).distinct().withColumn("_exists", F.lit(True))
            .join(by_shuffle(cols), both, "left").join(by_shuffle(keys), both, "left"))


def tab_gates(envelopes: DataFrame, catalog: Catalog) -> DataFrame:
    """One join per tab; a tab is judged by its own row, so tabs of one name in different files don't meet."""
    e = (envelopes
         .withColumn("mode", S.mode_of_tab("tab"))
         .withColumn("_valid_name", S.is_schema_table("target_table"))
         .withColumn("_schema", F.when(F.col("_valid_name"), F.split("target_table", "[.]")[0]))
         .withColumn("_table", F.when(F.col("_valid_name"), F.split("target_table", "[.]")[1])))
    none = F.expr("cast(array() as array<string>)")
    g = (e.join(by_shuffle(_one_row_per_table(catalog)), ["_schema", "_table"], "left")
         .withColumn("_cols", F.coalesce("_cols", none)).withColumn("_keys", F.coalesce("_keys", none))
         .withColumn("_header", F.coalesce("header", none)))
    known, own_key = (lambda h: F.array_contains("_cols", F.lower(h))), (lambda h: F.array_contains("_keys", F.lower(h)))
    keys = F.filter("_header", own_key)
    update, insert = F.col("mode") == "update", F.col("mode") == "insert"
    gate = (F.when(F.col("mode").isNull(), "C1")
            .when(~F.col("_valid_name"), "C2")
            .when(F.col("_exists").isNull(), "C3")
            .when(F.coalesce("n_rows", F.lit(0)) == 0, "C4")
            .when(F.size("_cols") == 0, "C5")
            .when(~F.forall("_header", known), "C6")
            .when(insert & (F.size(keys) > 0), "C8")
            .when(update & (F.size(keys) > 1), "C9")
            .when(update & (F.size("_keys") == 0), "C10")
            .when(update & (F.size(keys) == 0), "C11"))
    where = ["path"] if "path" in envelopes.columns else []
    return (g.withColumn("gate_id", gate)
            .select(*where, "tab", "target_table", "mode", F.col("n_rows").cast("bigint").alias("n_rows"), "gate_id",
                    F.when(F.col("gate_id").isNull() & update, F.try_element_at(keys, F.lit(1))).alias("key_column")))


def resolve_header(envelopes: DataFrame, catalog: Catalog) -> DataFrame:
    """Each header cell with its catalog column (NULL when unknown)."""
    e = envelopes.where(S.is_schema_table("target_table")).select(
        "tab", "target_table", F.split("target_table", "[.]")[0].alias("_schema"),
        F.split("target_table", "[.]")[1].alias("_table"), F.posexplode("header").alias("position", "header_name"))
    cols = catalog.columns.select(F.col("table_schema").alias("_schema"), F.col("table_name").alias("_table"),
                                  F.lower("column_name").alias("_lc"), "column_name", "data_type", "is_nullable",
                                  "char_max_len", "numeric_precision", "numeric_scale")
    return (e.withColumn("_lc", F.lower("header_name")).join(by_shuffle(cols), ["_schema", "_table", "_lc"], "left")
            .select("tab", "target_table", F.col("position").cast("bigint").alias("position"), "header_name",
                    "column_name", "data_type", "is_nullable", "char_max_len", "numeric_precision", "numeric_scale"))
