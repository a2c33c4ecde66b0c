"""Registered queries over batches of many tables, validated in one plan, and over tables of Spark's own catalog.
Their DuckDB SQL is written by hand and shares nothing with the rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apply as A
from ..operators import catalog_tables as CT
from ..operators import rules as R
from ..operators.catalog import ColumnSpec, TableSpec
from ..operators.gates import tab_gates
from ..operators.rule_table import validate_tables
from ..operators.skipping import touched
from ..session import scratch_dir
from . import fixtures as X
from .queries import accepted_typed, inserted_with_keys, rule_key
from .registry import register

#: Headers of a customer's order tab, by the customer's number; the third has a column that no table has, the fourth no key.
ORDER_HEADERS = (("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), ("o_orderpriority", "O_ORDERKEY", "o_flags", "o_deposit"),
                 ("o_orderkey", "o_token", "zzz", "o_orderstatus"), ("o_orderstatus", "o_totalprice"))
EVENT_HEADERS = (("ts", "user_id", "event_type", "value"), ("VALUE", "event_type"), ("event_id", "ts", "nope", "value"))
LINE_HEADERS = (("l_orderkey", "l_quantity"), ("l_partkey", "l_quantity", "l_returnflag", "l_shipdate"))


def _by(number: Column, values: list[Column]) -> Column:
    out = values[-1]
    for i, v in enumerate(values[:-1]):
        out = F.when(number == i, v).otherwise(out)
    return out


def _text(c: Column) -> Column:
    return c.cast("string")


def _tab(df: DataFrame, prefix: str, owner: Column, suffix: str, headers: tuple, shape: Column, cells: dict[str, Column], row_no: Column) -> DataFrame:
    """Rows of one tab per owner, each with its header and a map of its cells."""
    names = [F.array(*[F.lit(h) for h in header]) for header in headers]
    values = [F.array(*[cells[h.lower()] for h in header]) for header in headers]
    return df.select(F.concat(F.lit("inbox/many_"), _text(owner % 4), F.lit(".csv")).alias("path"),
                     F.concat(F.lit(prefix), _text(owner)).alias("tab"), F.concat(F.lit("c"), _text(owner), F.lit(suffix)).alias("target_table"),
                     _by(shape, names).alias("header"), row_no.cast("bigint").alias("row_no"),
                     _by(shape, [F.map_from_arrays(n, v) for n, v in zip(names, values)]).alias("row"))


def many_tables(spark: SparkSession, sf: str) -> DataFrame:
    """One update of orders a customer, one insert of lines a supplier, one insert of events a user; each into its own schema."""
    o, e, li = (X.table(spark, sf, t) for t in ("orders", "events", "lineitem"))
    k, n, p = F.col("o_orderkey"), F.col("event_id"), F.col("l_partkey")
    orders = {
        "o_orderkey": F.when(k % 97 == 0, None).when(k % 101 == 0, "1e30").otherwise(_text(k)),
        "o_custkey": F.when(k % 53 == 0, None).when(k % 13 == 0, "abc").when(k % 61 == 0, "3000000000").otherwise(_text(F.col("o_custkey"))),
        "o_totalprice": F.when(k % 31 == 0, "10.999").when(k % 83 == 0, "12345678901.5").when(k % 71 == 0, "1e9")
        .otherwise(_text(F.col("o_totalprice").cast("decimal(18,2)"))),
        "o_orderdate": F.when(k % 37 == 0, "2024-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        "o_orderpriority": F.when(k % 29 == 0, "WAY-TOO-LONG-PRIORITY").otherwise(F.col("o_orderpriority")),
        "o_flags": _text(k % 260 - 2),
        "o_deposit": F.when(k % 109 == 0, "-214748.3649").when(k % 113 == 0, "214748.3648").when(k % 127 == 0, "n.b.").otherwise("10.50"),
        "o_token": F.when(k % 107 == 0, "0007000").otherwise(_text(k % 8010)),
        "zzz": F.lit("?"), "o_orderstatus": F.when(k % 67 == 0, "PF").otherwise(F.col("o_orderstatus"))}
    events = {
        "event_id": _text(n), "nope": F.lit(None).cast("string"), "event_type": F.col("event_type"),
        "ts": F.when(n % 29 == 0, "tomorrow").when(n % 3 == 0, None).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        "user_id": F.when(n % 31 == 0, "9" * 20).otherwise(_text(F.col("user_id"))),
        "value": F.when(n % 19 == 0, "abc").when(n % 23 == 0, " -Inf ").otherwise("1.5e300")}
    lines = {
        "l_orderkey": _text(F.col("l_orderkey")), "l_partkey": F.when(p % 17 == 0, "12.5").otherwise(F.concat(F.lit(" +"), _text(p))),
        "l_quantity": F.when(p % 41 == 0, "1,5").otherwise(_text(F.col("l_quantity"))), "l_returnflag": F.col("l_returnflag"),
        "l_shipdate": F.when(p % 43 == 0, "31/12/1999").otherwise(F.date_format("l_shipdate", "M/d/yyyy"))}
    u, w, s = F.col("o_custkey"), F.col("user_id"), F.col("l_suppkey")
    return (_tab(o, "Update_orders_", u, ".orders", ORDER_HEADERS, u % 4, orders, k + 3)
            .unionByName(_tab(e, "Insert_events_", w, ".events", EVENT_HEADERS, w % 3, events, n + 3))
            .unionByName(_tab(li, "Insert_lines_", s, ".lineitem", LINE_HEADERS, F.when(s % 5 == 0, 0).otherwise(1), lines,
                              F.col("l_orderkey") * 8 + F.col("l_linenumber"))))


#: The first planted value that a row's checks meet, in header order.  A tab with an unknown column has no update key, so a NULL there is V12.
MANY_TABLES_SQL = """
WITH price AS (SELECT *, o_orderkey AS k, CASE WHEN o_orderkey % 31 = 0 THEN 'o_totalprice:V15' WHEN o_orderkey % 83 = 0 THEN 'o_totalprice:V11'
    WHEN o_orderkey % 71 = 0 THEN 'o_totalprice:V15b' END AS bad_price, o_orderkey % 97 <> 0 AND o_orderkey % 101 = 0 AS big_key FROM orders),
judged AS (
  SELECT 'Update_orders_' || o_custkey AS tab, 'c' || o_custkey || '.orders' AS target_table, CASE
    WHEN o_custkey % 11 = 0 THEN 'C5'
    WHEN o_custkey % 4 = 0 THEN CASE WHEN big_key THEN 'o_orderkey:V5' WHEN k % 53 = 0 THEN 'o_custkey:V12' WHEN k % 13 = 0 THEN 'o_custkey:V2'
      WHEN k % 61 = 0 THEN 'o_custkey:V5' WHEN bad_price IS NOT NULL THEN bad_price WHEN k % 37 = 0 THEN 'o_orderdate:V7'
      WHEN k % 97 = 0 THEN 'o_orderkey:V13' ELSE 'accepted' END
    WHEN o_custkey % 4 = 1 THEN CASE WHEN k % 29 = 0 THEN 'o_orderpriority:V1' WHEN big_key THEN 'O_ORDERKEY:V5' WHEN k % 260 < 2 THEN 'o_flags:V4'
      WHEN k % 260 > 257 THEN 'o_flags:V5' WHEN k % 109 = 0 THEN 'o_deposit:V9' WHEN k % 113 = 0 THEN 'o_deposit:V10'
      WHEN k % 127 = 0 THEN 'o_deposit:V8' WHEN k % 97 = 0 THEN 'O_ORDERKEY:V13' ELSE 'accepted' END
    WHEN o_custkey % 4 = 2 THEN CASE WHEN k % 97 = 0 THEN 'o_orderkey:V12' WHEN big_key THEN 'o_orderkey:V5' WHEN k % 107 = 0 THEN 'o_token:V6' WHEN k % 8010 = 0 THEN 'o_token:V4'
      WHEN k % 8010 > 8000 THEN 'o_token:V5' ELSE 'zzz:C6' END
    ELSE CASE WHEN k % 67 = 0 THEN 'o_orderstatus:V1' WHEN bad_price IS NOT NULL THEN bad_price ELSE 'C11' END END AS rule_key FROM price
  UNION ALL
  SELECT 'Insert_events_' || user_id, 'c' || user_id || '.events', CASE
    WHEN user_id NOT IN (SELECT c_custkey FROM customer) THEN 'C3'
    WHEN user_id % 3 = 0 THEN CASE WHEN event_id % 29 = 0 THEN 'ts:V7' WHEN event_id % 31 = 0 THEN 'user_id:V5' WHEN event_id % 19 = 0 THEN 'value:V8'
      ELSE 'accepted' END
    WHEN user_id % 3 = 1 THEN CASE WHEN event_id % 19 = 0 THEN 'VALUE:V8' ELSE 'accepted' END
    ELSE CASE WHEN event_id % 29 = 0 THEN 'ts:V7' ELSE 'nope:C6' END END FROM events
  UNION ALL
  SELECT 'Insert_lines_' || l_suppkey, 'c' || l_suppkey || '.lineitem', CASE
    WHEN l_suppkey NOT IN (SELECT c_custkey FROM customer) THEN 'C3'
    WHEN l_suppkey % 5 = 0 THEN CASE WHEN l_partkey % 41 = 0 THEN 'l_quantity:V8' ELSE 'C8' END
    WHEN l_partkey % 17 = 0 THEN 'l_partkey:V3b' WHEN l_partkey % 41 = 0 THEN 'l_quantity:V8'
    WHEN l_partkey % 43 = 0 THEN 'l_shipdate:V7' ELSE 'accepted' END FROM lineitem)
SELECT target_table, tab, rule_key, count(*) AS n_rows FROM judged GROUP BY ALL
"""


@register("validate_all_tables", MANY_TABLES_SQL)
def validate_all_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tabs of many tables, each with its own header, in one plan."""
    catalog = X.tenant_catalog(spark, sf)
    batch = many_tables(spark, sf)
    # texts as group keys: an aggregate that holds texts would sort all rows
    named = batch.groupBy("path", "tab", "target_table", "header").agg(F.count("*").alias("n_rows"))
    tabs = named.groupBy("path", "tab").agg(F.min("target_table").alias("target_table"), F.min("header").alias("header"), F.sum("n_rows").alias("n_rows"))
    gates = tab_gates(tabs, catalog).select("path", "tab", "mode", "gate_id", "key_column")
    judged = validate_tables(batch.drop("header").join(gates, ["path", "tab"]), tabs, catalog)
    return judged.groupBy("target_table", "tab", rule_key().alias("rule_key")).agg(F.count("*").alias("n_rows"))


# --- tables of Spark's own catalog ----------------------------------------------------------------

def _table(spark: SparkSession, spec: TableSpec, rows: DataFrame, partition_by: str) -> str:
    """A new table of the session's catalog, in the shared folder, with ``rows``."""
    name = f"ferrule_{spec.table.split('.')[1]}_{uuid.uuid4().hex[:12]}"
    CT.create(spark, name, spec, partition_by, location=scratch_dir(spark, name))
    CT.insert(spark, name, rows)
    return name


def _lineage(row_no: Column) -> list[Column]:
    return [F.lit("tab").alias("tab"), F.lit(1).alias("file_seq"), F.lit(1).alias("tab_seq"), row_no.cast("bigint").alias("row_no")]


@register("update_catalog_table", """SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey,
  CASE WHEN hit THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN hit AND o_orderpriority = '5-LOW' THEN '007' WHEN hit AND o_orderkey % 10 = 1 THEN NULL WHEN hit THEN '1-URGENT' ELSE o_orderpriority END
    AS o_orderpriority, CASE WHEN hit THEN TIMESTAMP '1998-01-01' END AS edit_dt
FROM (SELECT *, o_orderkey % 9 <> 0 AND o_orderkey % 10 < 2 OR o_orderpriority = '5-LOW' AS hit FROM orders)""")
def update_catalog_table(spark: SparkSession, sf: str) -> DataFrame:
    """E2 on a partitioned, bucketed table: rows move to other partitions, one partition is emptied, keys are missing,
    rows are rejected; the update is applied twice."""
    o, k = X.table(spark, sf, "orders"), F.col("o_orderkey")
    name = _table(spark, X.PUB_ORDERS, X.target_orders(spark, sf), "o_orderpriority")
    low = F.col("o_orderpriority") == "5-LOW"
    moved = F.when(low, "007").when(k % 9 == 0, "WAY-TOO-LONG-PRIORITY").when(k % 10 == 1, None).otherwise("1-URGENT")
    header = ("o_orderkey", "o_orderstatus", "o_orderpriority")
    named = o.where(low | (k % 10 < 2)).select(*_lineage(k), k.cast("string").alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), moved.alias("o_orderpriority"))
    unknown = o.where(k % 10 == 3).select(*_lineage(k), (k + 10**9).cast("string").alias("o_orderkey"), F.lit("X").alias("o_orderstatus"),
                                          F.lit("nowhere").alias("o_orderpriority"))
    accepted = accepted_typed(named.unionByName(unknown), X.PUB_ORDERS, R.Envelope("update_moves", "pub.orders", header))
    changes = A.edit_stamp(A.resolve_duplicates(accepted.drop("tab", "file_seq", "tab_seq"), "o_orderkey").drop("row_no"), X.PUB_ORDERS, True, X.AS_OF)
    path = scratch_dir(spark, "changes")
    changes.write.parquet(path)
    for _ in range(2):
        CT.update(spark, name, spark.read.parquet(path), "o_orderkey")
    return spark.table(name).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "edit_dt")


@register("insert_catalog_table", """WITH top AS (SELECT max(c_custkey) AS top FROM customer),
good AS (SELECT row_number() OVER (ORDER BY c_custkey) AS n, * FROM customer WHERE c_custkey % 70 <> 0)
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT top + n, 'New ' || c_name, c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE), c_mktsegment FROM good, top""")
def insert_catalog_table(spark: SparkSession, sf: str) -> DataFrame:
    """E1 by column name, with generated keys, into a partitioned, bucketed table."""
    name = _table(spark, X.PUB_CUSTOMER, X.table(spark, sf, "customer"), "c_mktsegment")
    CT.insert(spark, name, inserted_with_keys(spark, sf).select("c_mktsegment", "c_acctbal", "c_custkey", "c_nationkey", "c_name"))
    return spark.table(name).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


#: pub.customer with columns that a default fills in, one of them never NULL.
CUSTOMER_DEFAULTS = TableSpec("pub.customer_defaults", (*X.PUB_CUSTOMER.columns,
                              ColumnSpec("c_status", "varchar", False, 10, ordinal=6, default="'new'"),
                              ColumnSpec("c_limit", "decimal", True, None, 10, 2, 7, default="100.50"),
                              ColumnSpec("c_since", "date", True, ordinal=8, default="DATE'1998-01-01'"),
                              ColumnSpec("c_note", "varchar", True, 20, ordinal=9)), ("c_custkey",))


@register("insert_defaults", """WITH top AS (SELECT max(c_custkey) AS top FROM customer),
good AS (SELECT row_number() OVER (ORDER BY c_custkey) AS n, * FROM customer WHERE c_custkey % 6 <> 0)
SELECT c_custkey, c_name, c_nationkey, c_mktsegment, 'old' AS c_status, 1.25::DECIMAL(10,2) AS c_limit, DATE '1990-05-05' AS c_since, 'kept' AS c_note FROM customer
UNION ALL SELECT top + n, c_name, NULL, c_mktsegment, 'new', CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 7.00 END, DATE '1998-01-01', NULL FROM good, top""")
def insert_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """A generated key, an unlisted column with a default (one of them NOT NULL, which C17 lets pass), one without, and a
    listed NULL that stays NULL although the column has a default."""
    c, k = X.table(spark, sf, "customer"), F.col("c_custkey")
    old = c.select("*", F.lit("old").alias("c_status"), F.lit("1.25").cast("decimal(10,2)").alias("c_limit"),
                   F.lit("1990-05-05").cast("date").alias("c_since"), F.lit("kept").alias("c_note"))
    name = _table(spark, CUSTOMER_DEFAULTS, old, "c_mktsegment")
    batch = c.select(*_lineage(k), "c_name", "c_mktsegment", F.when(k % 6 == 0, "x").when(k % 2 == 0, None).otherwise("7").alias("c_limit"))
    header = ("c_name", "c_mktsegment", "c_limit")
    rules = R.build_rules(CUSTOMER_DEFAULTS, R.Envelope("insert_new", "pub.customer_defaults", header), None, None, require_not_null=True)
    accepted = R.apply_chain(batch, rules, keep_prep=True).where("rule_id is null")
    typed = A.typed(accepted, CUSTOMER_DEFAULTS, header, keep=("file_seq", "tab_seq", "row_no"))
    top = spark.table(name).agg(F.max("c_custkey")).first()[0] or 0      # one scalar
    CT.insert(spark, name, A.sequence_keys(typed, "c_custkey", int(top), ["file_seq", "tab_seq", "row_no"]).drop("file_seq", "tab_seq", "row_no"))
    return spark.table(name).drop("c_acctbal")


# --- text keys as the source database compares them ------------------------------------------------

COLLATION = "UTF8_LCASE_RTRIM"       # case and closing blanks don't count


@register("collated_keys", """WITH batch AS (
  SELECT c_custkey AS row_no, CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN lower(c_name) || '   ' WHEN 2 THEN c_name ELSE ' ' || c_name END AS k,
    'S' || c_custkey % 7 AS seg FROM customer WHERE c_custkey % 3 > 0
  UNION ALL SELECT c_custkey + 1000000000, upper(c_name) || ' ', 'LATE' FROM customer WHERE c_custkey % 6 = 1),
keyed AS (SELECT *, rtrim(k, ' ') COLLATE NOCASE AS ck FROM batch),
target AS (SELECT *, rtrim(c_name, ' ') COLLATE NOCASE AS ck FROM customer),
last AS (SELECT ck, arg_max(seg, row_no) AS seg FROM keyed GROUP BY ck)
SELECT 'row' AS section, c_custkey AS id, c_name AS k, coalesce(seg, c_mktsegment) AS value FROM target LEFT JOIN last ON target.ck = last.ck
UNION ALL SELECT 'missing', row_no, k, seg FROM keyed WHERE NOT EXISTS (SELECT 1 FROM target WHERE target.ck = keyed.ck)
UNION ALL SELECT 'before', c_custkey, c_name, c_mktsegment FROM target WHERE EXISTS (SELECT 1 FROM last WHERE target.ck = last.ck)""")
def collated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """D1-D4 by a text key that differs in case and closing blanks: found and duplicate keys, before images, the update; a
    leading blank is another key."""
    c, k = X.table(spark, sf, "customer"), F.col("c_custkey")
    spelled = (F.when(k % 4 == 0, F.upper("c_name")).when(k % 4 == 1, F.concat(F.lower("c_name"), F.lit("   "))).when(k % 4 == 2, F.col("c_name"))
               .otherwise(F.concat(F.lit(" "), F.col("c_name"))))
    batch = c.where(k % 3 > 0).select(spelled.alias("c_name"), F.concat(F.lit("S"), k % 7).alias("c_mktsegment"), k.alias("row_no")).unionByName(
        c.where(k % 6 == 1).select(F.concat(F.upper("c_name"), F.lit(" ")).alias("c_name"), F.lit("LATE").alias("c_mktsegment"), (k + 10**9).alias("row_no")))
    missing = A.missing_keys(batch, c, "c_name", COLLATION)
    one = A.resolve_duplicates(A.existing_keys(batch, c, "c_name", COLLATION), "c_name", collation=COLLATION).drop("row_no")
    old = A.before_image(one, c, "c_name", ["c_custkey", "c_mktsegment"], collation=COLLATION)
    new = A.apply_update(c, one, "c_name", COLLATION)
    return (new.select(F.lit("row").alias("section"), k.alias("id"), F.col("c_name").alias("k"), F.col("c_mktsegment").alias("value"))
            .unionByName(missing.select(F.lit("missing").alias("section"), F.col("row_no").alias("id"), F.col("c_name").alias("k"), F.col("c_mktsegment").alias("value")))
            .unionByName(old.select(F.lit("before").alias("section"), k.alias("id"), F.col("c_name").alias("k"), F.col("c_mktsegment").alias("value"))))


# --- a large target read by what a batch names -----------------------------------------------------

@register("touched_rows", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderkey % 1000 < 20 AND o_orderkey % 7 <> 0 OR o_orderkey IN (SELECT o_orderkey * 3 FROM orders WHERE o_orderkey % 50 = 0)""")
def touched_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The target's rows that a batch names, by ranges pushed to the scan, a bit array and an exact join."""
    o, k = X.table(spark, sf, "orders"), F.col("o_orderkey")
    named = o.where((k % 1000 < 20) & (k % 7 != 0)).select(k.alias("k")).unionByName(o.where(k % 50 == 0).select((k * 3).alias("k")))
    keys = named.unionByName(named).unionByName(o.where(k % 10 == 0).select(F.lit(None).cast("bigint").alias("k")))
    return touched(o.select("o_orderkey", "o_orderstatus", "o_totalprice"), keys.withColumnRenamed("k", "o_orderkey"), "o_orderkey")
