"""Per-table settings: lookup (A14) and checked upsert (E5).

``table_settings(target_table, auto_edit, shelf_life_days, updated_at)``.
A table without an entry uses the defaults (auto edit on, 14 days); an
accepted request equal to the defaults removes the entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import DEFAULT_AUTO_EDIT, DEFAULT_SHELF_LIFE_DAYS

SETTINGS_SCHEMA = "target_table string, auto_edit boolean, shelf_life_days int, updated_at timestamp_ntz"


def upsert(requests: DataFrame, catalog_tables: DataFrame, existing: DataFrame | None = None,
           order: list[str] | None = None) -> DataFrame:
    """E5: last valid write per table wins; invalid requests change nothing.

    A request is valid when its table is non-empty, exists in the catalog and
    its shelf life is > 0.  ``max_by`` over (updated_at, tie-breakers) is a
    partial aggregate, so a table with most of the requests never gathers
    them in one task."""
    order = order or ["updated_at"]
    names = catalog_tables.select(F.concat_ws(".", "table_schema", "table_name").alias("target_table"))
    valid = requests.where(F.col("target_table").isNotNull() & (F.length("target_table") > 0)
                           & (F.col("shelf_life_days") > 0))
    cols = ["target_table", "auto_edit", "shelf_life_days", "updated_at"]
    pool = valid.select(*cols, *[c for c in order if c not in cols])
    if existing is not None:
        pool = pool.unionByName(existing.select(*cols), allowMissingColumns=True)
    rank = F.struct(*[F.col(c) for c in order])
    latest = (pool.groupBy("target_table")
              .agg(F.max_by(F.struct("auto_edit", "shelf_life_days", "updated_at"), rank).alias("_w"))
              .select("target_table", "_w.auto_edit", "_w.shelf_life_days", "_w.updated_at"))
    # existence is per table, so it is checked on the aggregate (one row per table),
    # after the map-side partial aggregate has collapsed hot tables
    latest = latest.join(names, "target_table", "left_semi")
    is_default = (F.col("auto_edit") == F.lit(DEFAULT_AUTO_EDIT)) & \
                 (F.col("shelf_life_days") == F.lit(DEFAULT_SHELF_LIFE_DAYS))
    return latest.where(~is_default)


def lookup(targets: DataFrame, settings: DataFrame) -> DataFrame:
    """Settings of each target table with defaults filled in."""
    s = settings.select("target_table", F.col("auto_edit").alias("_ae"), F.col("shelf_life_days").alias("_sl"))
    return (targets.join(s, "target_table", "left")
            .withColumn("auto_edit", F.coalesce("_ae", F.lit(DEFAULT_AUTO_EDIT)))
            .withColumn("shelf_life_days", F.coalesce("_sl", F.lit(DEFAULT_SHELF_LIFE_DAYS)))
            .drop("_ae", "_sl"))
