"""Registered queries over the test tables: validation, apply, quarantine.

Each query is a whole-table Spark plan; its oracle is DuckDB SQL over the
same parquet views that rebuilds the same fixture in CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apply as A
from ..operators import quarantine as Q
from ..operators import rules as R
from ..operators.catalog import TableSpec
from . import fixtures as X
from .registry import register

KEY = "o_orderkey"
LINEAGE = list(Q.LINEAGE)


# --- shared plan pieces (Spark) ----------------------------------------------------------

def annotated(batch: DataFrame, spec: TableSpec, env: R.Envelope) -> DataFrame:
    return R.validate(batch, spec, env)


def accepted_typed(batch: DataFrame, spec: TableSpec, env: R.Envelope) -> DataFrame:
    v = R.validate(batch, spec, env, keep_prep=True).where(F.col("rule_id").isNull())
    return A.typed(v, spec, env.header, keep=("tab", "file_seq", "tab_seq", "row_no"))


def orders_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return accepted_typed(X.update_orders(spark, sf), X.PUB_ORDERS, X.UPDATE_ORDERS_ENV)


def customer_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return accepted_typed(X.insert_customer(spark, sf), X.customer_spec(spark, sf), X.INSERT_CUSTOMER_ENV)


def resolved_update(acc: DataFrame) -> DataFrame:
    return A.resolve_duplicates(acc.drop("tab", "file_seq", "tab_seq"), KEY)


# --- shared plan pieces (DuckDB twins) ------------------------------------------------------

def _chain(spec: TableSpec, env: R.Envelope) -> dict[str, str]:
    gate, key = R.envelope_gate(env, spec, True)
    return R.chain_sql(R.build_rules(spec, env, gate, key))


def annotated_sql(batch_sql: str, spec: TableSpec, env: R.Envelope) -> str:
    ch = _chain(spec, env)
    return (f"SELECT *, {ch['rule_id']} AS rule_id, {ch['rule_column']} AS rule_column, "
            f"{ch['rule_message']} AS rule_message FROM ({batch_sql})")


def accepted_sql(annotated_cte: str, spec: TableSpec, env: R.Envelope) -> str:
    typed = A.typed_sql(spec, env.header, keep=("tab", "file_seq", "tab_seq", "row_no"))
    return f"SELECT {typed} FROM {annotated_cte} WHERE rule_id IS NULL"


def orders_ctes() -> str:
    return (f"tgt AS ({X.TARGET_ORDERS_SQL}),\n"
            f"va AS ({annotated_sql(X.UPDATE_ORDERS_SQL, X.PUB_ORDERS, X.UPDATE_ORDERS_ENV)}),\n"
            f"acc AS ({accepted_sql('va', X.PUB_ORDERS, X.UPDATE_ORDERS_ENV)}),\n"
            f"res AS (SELECT * EXCLUDE (tab, file_seq, tab_seq) FROM acc "
            f"QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY row_no DESC) = 1)")


RULE_KEY = ("CASE WHEN rule_id IS NULL THEN 'accepted' WHEN rule_column IS NULL THEN rule_id "
            "ELSE rule_column || ':' || rule_id END")


def rule_key() -> F.Column:
    return (F.when(F.col("rule_id").isNull(), F.lit("accepted"))
            .when(F.col("rule_column").isNull(), F.col("rule_id"))
            .otherwise(F.concat_ws(":", "rule_column", "rule_id")))


# --- V1-V15, V14, F1 ------------------------------------------------------------------------

#: The flagship's counts by hand: which planted value each row meets first, in header order (FIXTURES.md §3).
REJECT_COUNTS_SQL = """SELECT rule_key, count(*) AS n_rows FROM (SELECT CASE
  WHEN k % 97 <> 0 AND k % 101 = 0 THEN 'o_orderkey:V5'
  WHEN k % 53 = 0 THEN 'o_custkey:V12' WHEN k % 13 = 0 THEN 'o_custkey:V2' WHEN k % 59 = 0 THEN 'o_custkey:V4'
  WHEN k % 61 = 0 THEN 'o_custkey:V5' WHEN k % 67 = 0 THEN 'o_orderstatus:V1'
  WHEN k % 71 = 0 THEN 'o_totalprice:V8' WHEN k % 73 = 0 THEN 'o_totalprice:V9' WHEN k % 79 = 0 THEN 'o_totalprice:V10'
  WHEN k % 83 = 0 THEN 'o_totalprice:V11' WHEN k % 31 = 0 THEN 'o_totalprice:V15'
  WHEN k % 37 = 0 THEN 'o_orderdate:V7' WHEN k % 29 = 0 THEN 'o_orderpriority:V1'
  WHEN k % 260 < 2 THEN 'o_flags:V4' WHEN k % 260 > 257 THEN 'o_flags:V5'
  WHEN k % 107 = 0 THEN 'o_token:V6' WHEN k % 8010 = 0 THEN 'o_token:V4' WHEN k % 8010 > 8000 THEN 'o_token:V5'
  WHEN k % 109 = 0 THEN 'o_deposit:V9' WHEN k % 113 = 0 THEN 'o_deposit:V10' WHEN k % 127 = 0 THEN 'o_deposit:V8'
  WHEN k % 97 = 0 THEN 'o_orderkey:V13' ELSE 'accepted' END AS rule_key FROM (SELECT o_orderkey AS k FROM orders)) GROUP BY rule_key"""


@register("validate_reject_counts", REJECT_COUNTS_SQL)
def validate_reject_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = annotated(X.update_orders(spark, sf), X.PUB_ORDERS, X.UPDATE_ORDERS_ENV)
    return v.groupBy(rule_key().alias("rule_key")).agg(F.count(F.lit(1)).alias("n_rows"))


ORDERS_PAYLOAD = list(X.UPDATE_ORDERS_HEADER)


def _rejected_rows_sql() -> str:
    return (f"WITH va AS ({annotated_sql(X.UPDATE_ORDERS_SQL, X.PUB_ORDERS, X.UPDATE_ORDERS_ENV)})\n"
            f"SELECT '{X.RUN_ID}' AS run_id, file, authors, tab, target_table, row_no, "
            f"{Q.map_text_sql(ORDERS_PAYLOAD)} AS row_text, rule_column, rule_id, rule_message "
            f"FROM va WHERE rule_id IS NOT NULL")


@register("validate_rejected_rows", _rejected_rows_sql)
def validate_rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    v = annotated(X.update_orders(spark, sf), X.PUB_ORDERS, X.UPDATE_ORDERS_ENV)
    q = Q.to_quarantine(v, ORDERS_PAYLOAD, X.RUN_ID)
    return q.withColumn("row_text", Q.map_text("row")).drop("row")


def _accepted_rows_sql() -> str:
    return f"WITH {orders_ctes()}\nSELECT * FROM acc"


@register("validate_accepted_rows", _accepted_rows_sql)
def validate_accepted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return orders_accepted(spark, sf)


# --- D1/D2: key existence -------------------------------------------------------------------

def _missing_keys_sql() -> str:
    return (f"WITH {orders_ctes()}\nSELECT acc.tab, acc.row_no, acc.o_orderkey, 'D2' AS rule_id, "
            f"'{R.RULE_TEXT['D2']}' AS rule_message FROM acc ANTI JOIN tgt USING (o_orderkey)")


@register("missing_keys", _missing_keys_sql)
def missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    acc = orders_accepted(spark, sf)
    miss = A.missing_keys(acc, X.target_orders(spark, sf), KEY)
    return miss.select("tab", "row_no", KEY, F.lit("D2").alias("rule_id"),
                       F.lit(R.RULE_TEXT["D2"]).alias("rule_message"))


def _existing_keys_sql() -> str:
    return f"WITH {orders_ctes()}\nSELECT acc.* FROM acc SEMI JOIN tgt USING (o_orderkey)"


@register("existing_keys", _existing_keys_sql)
def existing_keys(spark: SparkSession, sf: str) -> DataFrame:
    acc = orders_accepted(spark, sf)
    return A.existing_keys(acc, X.target_orders(spark, sf), KEY).select(*acc.columns)


# --- D3: before image ---------------------------------------------------------------------------

CHANGED = [c for c in X.UPDATE_ORDERS_HEADER if c != KEY]


def _before_image_sql() -> str:
    cols = ", ".join(f"tgt.{c}" for c in [KEY] + CHANGED)
    return f"WITH {orders_ctes()}\nSELECT {cols} FROM tgt SEMI JOIN res USING (o_orderkey)"


@register("before_image", _before_image_sql)
def before_image(spark: SparkSession, sf: str) -> DataFrame:
    res = resolved_update(orders_accepted(spark, sf))
    return A.before_image(res, X.target_orders(spark, sf), KEY, CHANGED)


# --- D4/E2/C12/C13: update ---------------------------------------------------------------------

TARGET_ORDER_COLS = [c.name for c in X.PUB_ORDERS.columns]


def _update_sql(stamp: bool, res_cte: str = "res") -> str:
    sets = []
    for c in TARGET_ORDER_COLS:
        if c == KEY:
            sets.append("t.o_orderkey")
        elif c in CHANGED:
            sets.append(f"CASE WHEN r.o_orderkey IS NOT NULL THEN r.{c} ELSE t.{c} END AS {c}")
        elif c == "edit_dt" and stamp:
            sets.append(f"CASE WHEN r.o_orderkey IS NOT NULL THEN TIMESTAMP '{X.AS_OF}' ELSE t.edit_dt END AS edit_dt")
        else:
            sets.append(f"t.{c}")
    return f"SELECT {', '.join(sets)} FROM tgt t LEFT JOIN {res_cte} r ON t.o_orderkey = r.o_orderkey"


@register("update_apply", lambda: f"WITH {orders_ctes()}\n{_update_sql(True)}")
def update_apply(spark: SparkSession, sf: str) -> DataFrame:
    res = resolved_update(orders_accepted(spark, sf)).drop("row_no")
    stamped = A.edit_stamp(res, X.PUB_ORDERS, auto_edit=True, as_of=X.AS_OF)
    return A.apply_update(X.target_orders(spark, sf), stamped, KEY)


EDIT_ENV = R.Envelope("update_orders", "pub.orders", X.UPDATE_ORDERS_HEADER + ("edit_dt",))
EDIT_VALUE = "2001-01-01 10:00:00"


def _edit_stamp_off_sql() -> str:
    batch = f"SELECT *, '{EDIT_VALUE}' AS edit_dt FROM ({X.UPDATE_ORDERS_SQL})"
    return (f"WITH tgt AS ({X.TARGET_ORDERS_SQL}),\n"
            f"va AS ({annotated_sql(batch, X.PUB_ORDERS, EDIT_ENV)}),\n"
            f"acc AS ({accepted_sql('va', X.PUB_ORDERS, EDIT_ENV)}),\n"
            f"res AS (SELECT * EXCLUDE (tab, file_seq, tab_seq, edit_dt) FROM acc "
            f"QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY row_no DESC) = 1)\n"
            f"{_update_sql(False)}")


@register("edit_stamp_off", _edit_stamp_off_sql)
def edit_stamp_off(spark: SparkSession, sf: str) -> DataFrame:
    """C14: with auto edit off the batch's own edit column is dropped, not applied."""
    batch = X.update_orders(spark, sf).withColumn("edit_dt", F.lit(EDIT_VALUE))
    acc = accepted_typed(batch, X.PUB_ORDERS, EDIT_ENV)
    res = A.resolve_duplicates(acc.drop("tab", "file_seq", "tab_seq"), KEY).drop("row_no")
    off = A.edit_stamp(res, X.PUB_ORDERS, auto_edit=False, as_of=X.AS_OF)
    return A.apply_update(X.target_orders(spark, sf), off, KEY)


# --- duplicate keys inside an update (§7.4 item 4) -------------------------------------------

def _dups_sql() -> str:
    return (f"WITH va AS ({annotated_sql(X.UPDATE_DUPS_SQL, X.PUB_ORDERS, X.UPDATE_DUPS_ENV)}),\n"
            f"acc AS ({accepted_sql('va', X.PUB_ORDERS, X.UPDATE_DUPS_ENV)})\n"
            f"SELECT o_orderkey, o_orderstatus, row_no FROM acc "
            f"QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY row_no DESC) = 1")


@register("duplicate_key_resolution", _dups_sql)
def duplicate_key_resolution(spark: SparkSession, sf: str) -> DataFrame:
    acc = accepted_typed(X.update_dups(spark, sf), X.PUB_ORDERS, X.UPDATE_DUPS_ENV)
    return A.resolve_duplicates(acc.select(KEY, "o_orderstatus", "row_no"), KEY)


# --- E1/B2: insert ---------------------------------------------------------------------------------

CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _insert_ctes() -> str:
    return (f"ia AS ({annotated_sql(X.INSERT_CUSTOMER_SQL, X.PUB_CUSTOMER, X.INSERT_CUSTOMER_ENV)}),\n"
            f"iacc AS ({accepted_sql('ia', X.PUB_CUSTOMER, X.INSERT_CUSTOMER_ENV)}),\n"
            f"ins AS (SELECT CAST((SELECT max(c_custkey) FROM customer) + row_number() OVER "
            f"(ORDER BY file_seq, tab_seq, row_no) AS BIGINT) AS c_custkey, c_name, c_nationkey, c_acctbal, "
            f"c_mktsegment, row_no FROM iacc)")


def inserted_with_keys(spark: SparkSession, sf: str) -> DataFrame:
    target = X.table(spark, sf, "customer")
    acc = customer_accepted(spark, sf)
    base = target.agg(F.max("c_custkey")).first()[0] or 0   # one scalar, not rows
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return A.sequence_keys(acc, "c_custkey", int(base), ["file_seq", "tab_seq", "row_no"])


@register("insert_sequence_keys", lambda: f"WITH {_insert_ctes()}\nSELECT * FROM ins")
def insert_sequence_keys(spark: SparkSession, sf: str) -> DataFrame:
    return inserted_with_keys(spark, sf).select(*CUSTOMER_COLS, "row_no")


@register("insert_apply", lambda: (f"WITH {_insert_ctes()}\nSELECT {', '.join(CUSTOMER_COLS)} FROM customer "
                                   f"UNION ALL SELECT {', '.join(CUSTOMER_COLS)} FROM ins"))
def insert_apply(spark: SparkSession, sf: str) -> DataFrame:
    return A.apply_insert(X.table(spark, sf, "customer"), inserted_with_keys(spark, sf))
