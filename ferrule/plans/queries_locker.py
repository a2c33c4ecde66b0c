"""Registered queries: locker, retention, settings, quarantine unions, run counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apply as A
from ..operators import locker as L
from ..operators import quarantine as Q
from ..operators import rules as R
from ..operators import settings as ST
from . import fixtures as X
from .queries import (CHANGED, KEY, accepted_sql, annotated, annotated_sql, inserted_with_keys, orders_accepted,
                      orders_ctes, resolved_update, _insert_ctes)
from .registry import register

DECLARED_TABLES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in X.TARGET_SOURCE) + \
    ") AS t(target_table)"


# --- E5/A14: settings ------------------------------------------------------------------------

def settings(spark: SparkSession, sf: str) -> DataFrame:
    return ST.upsert(X.settings_requests(spark, sf), X.declared_catalog(spark, sf).tables,
                     order=["updated_at", "event_id"])


def _settings_sql() -> str:
    return f"""
SELECT target_table, w.auto_edit AS auto_edit, w.shelf_life_days AS shelf_life_days, w.updated_at AS updated_at
FROM (SELECT target_table, arg_max({{'auto_edit': auto_edit, 'shelf_life_days': shelf_life_days,
             'updated_at': updated_at}}, (updated_at, event_id)) AS w
      FROM ({X.SETTINGS_REQUESTS_SQL}) r
      WHERE target_table IS NOT NULL AND length(target_table) > 0 AND shelf_life_days > 0
        AND target_table IN ({DECLARED_TABLES_SQL})
      GROUP BY target_table)
WHERE NOT (w.auto_edit = TRUE AND w.shelf_life_days = 14)"""


@register("settings_upsert", _settings_sql)
def settings_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return settings(spark, sf)


# --- A14: settings lookup with defaults ---------------------------------------------------------

@register("settings_lookup", lambda: f"""WITH st AS ({_settings_sql()})
SELECT t.target_table, coalesce(st.auto_edit, TRUE) AS auto_edit, coalesce(st.shelf_life_days, 14) AS shelf_life_days
FROM (SELECT DISTINCT target_table FROM ({X.LOCKER_SQL})) t LEFT JOIN st USING (target_table)""")
def settings_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A14 for every table the locker holds: its settings, defaults where it has none."""
    targets = X.locker(spark, sf).select("target_table").distinct()
    return ST.lookup(targets, settings(spark, sf)).select("target_table", "auto_edit", "shelf_life_days")


# --- B7: locker append -------------------------------------------------------------------------

def _locker_append_sql() -> str:
    before = ", ".join(f"tgt.{c}" for c in [KEY] + CHANGED)
    img_text = Q.map_text_sql([KEY] + CHANGED, "b.")
    cust_cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    ins_text = Q.map_text_sql(cust_cols, "i.")
    day = X.AS_OF[:10].replace("-", "")
    return f"""WITH {orders_ctes()}, {_insert_ctes()},
b AS (SELECT {before}, res.row_no FROM tgt JOIN res USING (o_orderkey))
SELECT '{day}' AS day, 'pub.orders' AS target_table, '{X.RUN_ID}:update_orders' AS item_id,
  'changes_0001.csv' AS file, '{X.BATCH_AUTHORS}' AS authors, 'Update' AS mode,
  TIMESTAMP '{X.AS_OF}' AS append_time, b.row_no AS row_no, {img_text} AS row_text FROM b
UNION ALL
SELECT '{day}', 'pub.customer', '{X.RUN_ID}:insert_customer', 'changes_0001.csv', '{X.BATCH_AUTHORS}', 'Insert',
  TIMESTAMP '{X.AS_OF}', i.row_no, {ins_text} FROM ins i"""


def appended(spark: SparkSession, sf: str) -> DataFrame:
    res = resolved_update(orders_accepted(spark, sf))
    image = A.before_image(res, X.target_orders(spark, sf), KEY, CHANGED, carry=["row_no"])
    upd = L.locker_rows(image, target_table="pub.orders", item_id=f"{X.RUN_ID}:update_orders", file=X.BATCH_FILE,
                        authors=X.BATCH_AUTHORS, mode="Update", as_of=X.AS_OF, row_no=F.col("row_no"),
                        payload=[KEY] + CHANGED)
    ins = inserted_with_keys(spark, sf)
    new = L.locker_rows(ins, target_table="pub.customer", item_id=f"{X.RUN_ID}:insert_customer", file=X.BATCH_FILE,
                        authors=X.BATCH_AUTHORS, mode="Insert", as_of=X.AS_OF, row_no=F.col("row_no"),
                        payload=["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return upd.unionByName(new)


@register("locker_append", _locker_append_sql)
def locker_append(spark: SparkSession, sf: str) -> DataFrame:
    return appended(spark, sf).withColumn("row_text", Q.map_text("row")).drop("row")


# --- A13/B8/C15: locker read and export ----------------------------------------------------------

LOCKER_TEXT = Q.map_text_sql(list(X.LOCKER_PAYLOAD))


@register("locker_days", f"SELECT DISTINCT day FROM ({X.LOCKER_SQL})")
def locker_days(spark: SparkSession, sf: str) -> DataFrame:
    return L.days(X.locker(spark, sf))


def _items_sql() -> str:
    return f"""lk AS ({X.LOCKER_SQL}),
items AS (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY append_time, item_id) AS BIGINT) AS item_no
          FROM (SELECT DISTINCT day, target_table, item_id, file, authors, mode, append_time
                FROM lk WHERE day = '{X.EXPORT_DAY}'))"""


@register("locker_export", f"""WITH {_items_sql()}
SELECT lk.day, lk.item_id, lk.target_table, lk.file, lk.authors, lk.mode, lk.append_time, lk.row_no,
  {Q.map_text_sql(list(X.LOCKER_PAYLOAD), 'lk.')} AS row_text, items.mode || '_' || CAST(items.item_no AS VARCHAR) AS sheet,
  items.item_no FROM lk JOIN items USING (day, item_id)""")
def locker_export(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = L.export_day(X.locker(spark, sf), X.EXPORT_DAY)
    return rows.withColumn("row_text", Q.map_text("row")).drop("row")


@register("locker_details", f"""WITH {_items_sql()}
SELECT file AS orig_file_name, authors AS file_authors, mode || '_' || CAST(item_no AS VARCHAR) AS tab_name,
  target_table AS sql_table, append_time, item_no FROM items""")
def locker_details(spark: SparkSession, sf: str) -> DataFrame:
    _, details = L.export_day(X.locker(spark, sf), X.EXPORT_DAY)
    return details


# --- D6/E4: retention -------------------------------------------------------------------------------

def _retention_sql() -> str:
    as_of_day = X.AS_OF[:10]
    return f"""WITH lk AS ({X.LOCKER_SQL}), st AS ({_settings_sql()})
SELECT lk.day, lk.target_table, lk.item_id, lk.row_no, coalesce(st.shelf_life_days, 14) AS shelf_life_days
FROM lk LEFT JOIN st USING (target_table)
WHERE lk.day >= strftime(DATE '{as_of_day}' - coalesce(st.shelf_life_days, 14), '%Y%m%d')"""


@register("retention_purge", _retention_sql)
def retention_purge(spark: SparkSession, sf: str) -> DataFrame:
    lived = L.with_shelf_life(X.locker(spark, sf), settings(spark, sf))
    kept = lived.where(F.col("day") >= L.cutoff_day(X.AS_OF, F.col("shelf_life_days")))
    return kept.select("day", "target_table", "item_id", "row_no", "shelf_life_days")


# --- F4/F5/B6/F2/F3 -------------------------------------------------------------------------------

def _rejected_wide(spark: SparkSession, sf: str) -> list[DataFrame]:
    orders = annotated(X.update_orders(spark, sf), X.PUB_ORDERS, X.UPDATE_ORDERS_ENV)
    cust = annotated(X.insert_customer(spark, sf), X.customer_spec(spark, sf), X.INSERT_CUSTOMER_ENV)
    dups = annotated(X.update_dups(spark, sf), X.PUB_ORDERS, X.UPDATE_DUPS_ENV)
    return [d.where(F.col("rule_id").isNotNull()) for d in (orders, cust, dups)]


def _annotated_ctes() -> str:
    return (f"vo AS ({annotated_sql(X.UPDATE_ORDERS_SQL, X.PUB_ORDERS, X.UPDATE_ORDERS_ENV)}),\n"
            f"vc AS ({annotated_sql(X.INSERT_CUSTOMER_SQL, X.PUB_CUSTOMER, X.INSERT_CUSTOMER_ENV)}),\n"
            f"vd AS ({annotated_sql(X.UPDATE_DUPS_SQL, X.PUB_ORDERS, X.UPDATE_DUPS_ENV)})")


@register("quarantine_union", f"""WITH {_annotated_ctes()}
SELECT * FROM vo WHERE rule_id IS NOT NULL UNION ALL BY NAME
SELECT * FROM vc WHERE rule_id IS NOT NULL UNION ALL BY NAME
SELECT * FROM vd WHERE rule_id IS NOT NULL""")
def quarantine_union(spark: SparkSession, sf: str) -> DataFrame:
    return Q.union_all_by_name(_rejected_wide(spark, sf))


def _union_distinct_sql() -> str:
    return f"""WITH {orders_ctes()},
vd AS ({annotated_sql(X.UPDATE_DUPS_SQL, X.PUB_ORDERS, X.UPDATE_DUPS_ENV)}),
dacc AS ({accepted_sql('vd', X.PUB_ORDERS, X.UPDATE_DUPS_ENV)})
SELECT DISTINCT * FROM (
  SELECT {', '.join('tgt.' + c for c in [KEY] + CHANGED)} FROM tgt SEMI JOIN res USING (o_orderkey)
  UNION ALL BY NAME
  SELECT tgt.o_orderkey, tgt.o_orderstatus FROM tgt SEMI JOIN dacc USING (o_orderkey))"""


@register("union_distinct", _union_distinct_sql)
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """F5 over two before images that overlap (a key changed by both tabs appears once)."""
    target = X.target_orders(spark, sf)
    img1 = A.before_image(resolved_update(orders_accepted(spark, sf)), target, KEY, CHANGED)
    from .queries import accepted_typed

    dacc = accepted_typed(X.update_dups(spark, sf), X.PUB_ORDERS, X.UPDATE_DUPS_ENV)
    img2 = A.before_image(dacc.select(KEY), target, KEY, ["o_orderstatus"])
    return Q.union_distinct([img1, img2])


def _quarantine_all(spark: SparkSession, sf: str) -> DataFrame:
    """Quarantine rows of the run: rule rejects of three tabs, plus missing keys (D2) marked
    in the same pass as the update tab's validation."""
    cols = ["file", "authors", "tab", "target_table", "row_no", "rule_column", "rule_id", "rule_message"]
    orders = R.validate(X.update_orders(spark, sf), X.PUB_ORDERS, X.UPDATE_ORDERS_ENV, keep_prep=True)
    key_value = A.typed_value(X.PUB_ORDERS.column(KEY), KEY, frozenset(orders.columns))
    orders = A.mark_missing_keys(orders, key_value, X.target_orders(spark, sf), KEY)
    cust = annotated(X.insert_customer(spark, sf), X.customer_spec(spark, sf), X.INSERT_CUSTOMER_ENV)
    dups = annotated(X.update_dups(spark, sf), X.PUB_ORDERS, X.UPDATE_DUPS_ENV)
    frames = [d.where(F.col("rule_id").isNotNull()).select(*cols) for d in (orders, cust, dups)]
    return Q.union_all_by_name(frames)


def _error_details_sql() -> str:
    cols = "file, authors, tab, target_table, row_no, rule_column, rule_id, rule_message"
    return f"""WITH {orders_ctes()}, {_annotated_ctes()},
qa AS (SELECT {cols} FROM vo WHERE rule_id IS NOT NULL UNION ALL SELECT {cols} FROM vc WHERE rule_id IS NOT NULL
       UNION ALL SELECT {cols} FROM vd WHERE rule_id IS NOT NULL
       UNION ALL SELECT '{X.BATCH_FILE}', '{X.BATCH_AUTHORS}', acc.tab, 'pub.orders', acc.row_no, '{KEY}', 'D2',
                        '{R.RULE_TEXT['D2']}' FROM acc ANTI JOIN tgt USING (o_orderkey)),
g AS (SELECT file, authors, tab, target_table, rule_column, rule_id, rule_message, count(*) AS n FROM qa
      GROUP BY ALL)
SELECT regexp_extract(file, '([^/\\\\]*)$', 1) AS orig_file_name, authors AS file_authors, tab AS tab_name,
  target_table AS sql_table, {Q.error_desc_sql('rule_column', 'n', 'rule_message')} AS error_desc FROM g"""


@register("error_details", _error_details_sql)
def error_details(spark: SparkSession, sf: str) -> DataFrame:
    return Q.error_details(_quarantine_all(spark, sf))


def _run_counts_sql() -> str:
    cols = "file, tab, target_table, mode, rule_id"
    return f"""WITH {_annotated_ctes()},
a AS (SELECT {cols} FROM vo UNION ALL SELECT {cols} FROM vc UNION ALL SELECT {cols} FROM vd),
g AS (SELECT coalesce(tab, 'default') AS tab_key, target_table, mode, count(*) AS n_rows,
             count(CASE WHEN rule_id IS NULL THEN 1 END) AS n_accepted, count(rule_id) AS n_rejected,
             count(DISTINCT file) AS n_files FROM a GROUP BY ALL)
SELECT '{X.RUN_ID}' AS run_id, tab_key, target_table, mode, n_rows, n_accepted, n_rejected, n_files,
  CASE WHEN n_rejected > 0 THEN 'warning' ELSE 'info' END AS level,
  'Validated ' || mode || ' tab ' || tab_key || ' for ' || target_table || ': ' || CAST(n_accepted AS VARCHAR)
  || ' accepted, ' || CAST(n_rejected AS VARCHAR) || ' rejected' AS message FROM g"""


@register("run_counts", _run_counts_sql)
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    frames = [annotated(X.update_orders(spark, sf), X.PUB_ORDERS, X.UPDATE_ORDERS_ENV),
              annotated(X.insert_customer(spark, sf), X.customer_spec(spark, sf), X.INSERT_CUSTOMER_ENV),
              annotated(X.update_dups(spark, sf), X.PUB_ORDERS, X.UPDATE_DUPS_ENV)]
    cols = ["file", "tab", "target_table", "mode", "rule_id"]
    return Q.run_counts(Q.union_all_by_name([f.select(*cols) for f in frames]), X.RUN_ID)
