"""Change batches, catalog, settings and locker built from the test tables.

Every fixture is derived from the driver's tables by Spark, so its size grows
with them; each has a DuckDB twin (a SQL text usable as a CTE body) so the
oracle queries rebuild exactly the same input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import Catalog, ColumnSpec, TableSpec, catalog_from_specs, spec_from_schema
from ..operators.rules import Envelope

AS_OF = "1998-01-01 00:00:00"          # fixed run time, never read from the clock
RUN_ID = "run-0001"
BATCH_FILE = "inbox/changes_0001.csv"
BATCH_AUTHORS = "data team"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- declared catalog (FIXTURES.md §2) --------------------------------------------

PUB_ORDERS = TableSpec(
    table="pub.orders",
    columns=(
        ColumnSpec("o_orderkey", "bigint", False, None, 19, 0, 1),
        ColumnSpec("o_custkey", "int", False, None, 10, 0, 2),
        ColumnSpec("o_orderstatus", "char", True, 1, None, None, 3),
        ColumnSpec("o_totalprice", "decimal", True, None, 10, 2, 4),
        ColumnSpec("o_orderdate", "datetime2", True, None, None, None, 5),
        ColumnSpec("o_orderpriority", "varchar", True, 15, None, None, 6),
        ColumnSpec("o_flags", "tinyint", True, None, 3, 0, 7),
        ColumnSpec("o_token", "varbinary", True, 4, None, None, 8),
        ColumnSpec("o_deposit", "smallmoney", True, None, 10, 4, 9),
        ColumnSpec("edit_dt", "datetime2", True, None, None, None, 10),
    ),
    primary_key=("o_orderkey",),
)

# Physical table behind each declared target (source tables of the test data).
TARGET_SOURCE = {"pub.orders": "orders", "pub.customer": "customer", "pub.part": "part",
                 "pub.lineitem": "lineitem", "pub.events": "events"}

_DERIVED_KEYS = {"pub.customer": ("c_custkey",), "pub.part": ("p_partkey",),
                 "pub.lineitem": ("l_orderkey", "l_linenumber"), "pub.events": ()}


def declared_specs(spark: SparkSession, sf_dir: str) -> list[TableSpec]:
    specs = [PUB_ORDERS]
    for name, keys in _DERIVED_KEYS.items():
        specs.append(spec_from_schema(name, table(spark, sf_dir, TARGET_SOURCE[name]).schema, keys))
    return specs


def declared_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return catalog_from_specs(spark, declared_specs(spark, sf_dir))


# --- dirty update batch over orders (FIXTURES.md §3) ---------------------------------

UPDATE_ORDERS_HEADER = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                        "o_orderpriority", "o_flags", "o_token", "o_deposit")
UPDATE_ORDERS_ENV = Envelope("update_orders", "pub.orders", UPDATE_ORDERS_HEADER)
BIG_NEG = "-1" + "0" * 39
BIG_POS = "1" + "0" * 39


def _lineage(tab: str, target: str, mode: str, row_no: Column, tab_seq: int = 1) -> list[Column]:
    return [F.lit(BATCH_FILE).alias("file"), F.lit(BATCH_AUTHORS).alias("authors"), F.lit(tab).alias("tab"),
            F.lit(target).alias("target_table"), F.lit(mode).alias("mode"), F.lit(1).alias("file_seq"),
            F.lit(tab_seq).alias("tab_seq"), row_no.cast("bigint").alias("row_no")]


def _lineage_sql(tab: str, target: str, mode: str, row_no: str, tab_seq: int = 1) -> str:
    return (f"'{BATCH_FILE}' AS file, '{BATCH_AUTHORS}' AS authors, '{tab}' AS tab, '{target}' AS target_table, "
            f"'{mode}' AS mode, 1 AS file_seq, {tab_seq} AS tab_seq, CAST({row_no} AS BIGINT) AS row_no")


def update_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")

    def every(n: int) -> Column:
        return k % n == 0

    txt = lambda c: c.cast("string")
    return o.select(
        *_lineage("update_orders", "pub.orders", "update", k + 3),
        F.when(every(97), None).when(every(101), "1e30").when(every(103), txt(k + 1000000))
        .otherwise(txt(k)).alias("o_orderkey"),
        F.when(every(53), None).when(every(13), "abc").when(every(59), "-3000000000")
        .when(every(61), "3000000000").otherwise(txt(F.col("o_custkey"))).alias("o_custkey"),
        F.when(every(67), "PF").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(every(71), "12,5").when(every(73), BIG_NEG).when(every(79), BIG_POS)
        .when(every(83), "12345678901.5").when(every(31), "10.999").when(every(89), None)
        .otherwise(txt(F.col("o_totalprice").cast("decimal(18,2)"))).alias("o_totalprice"),
        F.when(every(37), "2024-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("o_orderdate"),
        F.when(every(29), "WAY-TOO-LONG-PRIORITY").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        txt(k % 260 - 2).alias("o_flags"),
        F.when(every(107), "0007000").otherwise(txt(k % 8010)).alias("o_token"),
        F.when(every(109), "-214748.3649").when(every(113), "214748.3648").when(every(127), "n.b.")
        .otherwise("10.50").alias("o_deposit"),
    )


UPDATE_ORDERS_SQL = f"""
SELECT {_lineage_sql('update_orders', 'pub.orders', 'update', 'o_orderkey + 3')},
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN '1e30'
       WHEN o_orderkey % 103 = 0 THEN CAST(o_orderkey + 1000000 AS VARCHAR)
       ELSE CAST(o_orderkey AS VARCHAR) END AS o_orderkey,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'abc'
       WHEN o_orderkey % 59 = 0 THEN '-3000000000' WHEN o_orderkey % 61 = 0 THEN '3000000000'
       ELSE CAST(o_custkey AS VARCHAR) END AS o_custkey,
  CASE WHEN o_orderkey % 67 = 0 THEN 'PF' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 71 = 0 THEN '12,5' WHEN o_orderkey % 73 = 0 THEN '{BIG_NEG}'
       WHEN o_orderkey % 79 = 0 THEN '{BIG_POS}' WHEN o_orderkey % 83 = 0 THEN '12345678901.5'
       WHEN o_orderkey % 31 = 0 THEN '10.999' WHEN o_orderkey % 89 = 0 THEN NULL
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS o_totalprice,
  CASE WHEN o_orderkey % 37 = 0 THEN '2024-13-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate,
  CASE WHEN o_orderkey % 29 = 0 THEN 'WAY-TOO-LONG-PRIORITY' ELSE o_orderpriority END AS o_orderpriority,
  CAST(o_orderkey % 260 - 2 AS VARCHAR) AS o_flags,
  CASE WHEN o_orderkey % 107 = 0 THEN '0007000' ELSE CAST(o_orderkey % 8010 AS VARCHAR) END AS o_token,
  CASE WHEN o_orderkey % 109 = 0 THEN '-214748.3649' WHEN o_orderkey % 113 = 0 THEN '214748.3648'
       WHEN o_orderkey % 127 = 0 THEN 'n.b.' ELSE '10.50' END AS o_deposit
FROM orders
"""


# --- typed targets ------------------------------------------------------------------

def target_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pub.orders as a typed table: orders plus the declared extra columns."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("o_orderkey"), F.col("o_custkey").cast("int").alias("o_custkey"), "o_orderstatus",
        F.col("o_totalprice").cast("decimal(10,2)").alias("o_totalprice"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderpriority",
        (k % 200).cast("smallint").alias("o_flags"), (k % 8000 + 1).cast("int").alias("o_token"),
        F.lit("10.0000").cast("decimal(10,4)").alias("o_deposit"),
        F.lit(None).cast("timestamp_ntz").alias("edit_dt"))


TARGET_ORDERS_SQL = """
SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
  CAST(o_totalprice AS DECIMAL(10,2)) AS o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate,
  o_orderpriority, CAST(o_orderkey % 200 AS SMALLINT) AS o_flags, CAST(o_orderkey % 8000 + 1 AS INTEGER) AS o_token,
  CAST('10.0000' AS DECIMAL(10,4)) AS o_deposit, CAST(NULL AS TIMESTAMP) AS edit_dt
FROM orders
"""


# --- update with duplicate keys (FIXTURES.md §4) --------------------------------------

UPDATE_DUPS_HEADER = ("o_orderkey", "o_orderstatus")
UPDATE_DUPS_ENV = Envelope("update_dups", "pub.orders", UPDATE_DUPS_HEADER)


def update_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    key = F.when(k % 1000 == 0, k + 1000000).otherwise(k).cast("string")

    def rows(where: Column, status: str, row_no: Column) -> DataFrame:
        return o.where(where).select(
            *_lineage("update_dups", "pub.orders", "update", row_no, tab_seq=2),
            key.alias("o_orderkey"),
            F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit(status)).alias("o_orderstatus"))

    # every order changes once; every 50th gets a second, later row (a duplicate key)
    return rows(F.lit(True), "A", k + 3).unionByName(rows(k % 50 == 0, "B", k + 100000003))


UPDATE_DUPS_SQL = f"""
SELECT {_lineage_sql('update_dups', 'pub.orders', 'update', 'o_orderkey + 3', 2)},
  CAST(CASE WHEN o_orderkey % 1000 = 0 THEN o_orderkey + 1000000 ELSE o_orderkey END AS VARCHAR) AS o_orderkey,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'A' END AS o_orderstatus
FROM orders
UNION ALL
SELECT {_lineage_sql('update_dups', 'pub.orders', 'update', 'o_orderkey + 100000003', 2)},
  CAST(CASE WHEN o_orderkey % 1000 = 0 THEN o_orderkey + 1000000 ELSE o_orderkey END AS VARCHAR) AS o_orderkey,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'B' END AS o_orderstatus
FROM orders WHERE o_orderkey % 50 = 0
"""


# --- insert without keys (FIXTURES.md §4) ------------------------------------------------

INSERT_CUSTOMER_HEADER = ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
INSERT_CUSTOMER_ENV = Envelope("insert_customer", "pub.customer", INSERT_CUSTOMER_HEADER)


def insert_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        *_lineage("insert_customer", "pub.customer", "insert", k + 3, tab_seq=3),
        F.concat(F.lit("New "), F.col("c_name")).alias("c_name"),
        F.when(k % 70 == 0, F.lit("x")).otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey"),
        F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("c_acctbal"),
        F.col("c_mktsegment").alias("c_mktsegment"))


INSERT_CUSTOMER_SQL = f"""
SELECT {_lineage_sql('insert_customer', 'pub.customer', 'insert', 'c_custkey + 3', 3)},
  'New ' || c_name AS c_name,
  CASE WHEN c_custkey % 70 = 0 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
  CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS c_acctbal, c_mktsegment
FROM customer
"""


def customer_spec(spark: SparkSession, sf_dir: str) -> TableSpec:
    return spec_from_schema("pub.customer", table(spark, sf_dir, "customer").schema, ("c_custkey",))


# DuckDB-side spec of pub.customer (same mapping as spec_from_schema over the parquet schema).
PUB_CUSTOMER = TableSpec(
    table="pub.customer",
    columns=(
        ColumnSpec("c_custkey", "bigint", False, None, 19, 0, 1),
        ColumnSpec("c_name", "nvarchar", True, -1, None, None, 2),
        ColumnSpec("c_nationkey", "int", True, None, 10, 0, 3),
        ColumnSpec("c_acctbal", "float", True, None, 53, None, 4),
        ColumnSpec("c_mktsegment", "nvarchar", True, -1, None, None, 5),
    ),
    primary_key=("c_custkey",),
)


# --- locker (FIXTURES.md §5) ------------------------------------------------------------
# One preserved row per order: day = order date, item = priority; the priority's
# digit picks the item's table, mode, author and append hour.

LOCKER_TABLES = ("pub.orders", "pub.part", "pub.events", "pub.customer", "pub.lineitem")
LOCKER_PAYLOAD = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
EXPORT_DAY = "19971220"


def locker(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    tables = F.array(*[F.lit(t) for t in LOCKER_TABLES])
    payload = {"o_orderkey": F.col("o_orderkey").cast("string"), "o_custkey": F.col("o_custkey").cast("string"),
               "o_orderstatus": F.col("o_orderstatus"),
               "o_totalprice": F.col("o_totalprice").cast("decimal(18,2)").cast("string")}
    return o.select(
        day.alias("day"), F.element_at(tables, p).alias("target_table"), F.col("o_orderpriority").alias("item_id"),
        F.concat(F.lit("changes_"), day, F.lit(".xlsx")).alias("file"),
        F.concat(F.lit("team "), p.cast("string")).alias("authors"),
        F.when(p <= 3, F.lit("Update")).otherwise(F.lit("Insert")).alias("mode"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), p)).alias("append_time"),
        F.col("o_orderkey").alias("row_no"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in payload]), F.array(*payload.values())).alias("row"))


LOCKER_SQL = """
SELECT strftime(o_orderdate, '%Y%m%d') AS day,
  ['pub.orders', 'pub.part', 'pub.events', 'pub.customer', 'pub.lineitem'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS target_table,
  o_orderpriority AS item_id, 'changes_' || strftime(o_orderdate, '%Y%m%d') || '.xlsx' AS file,
  'team ' || substr(o_orderpriority, 1, 1) AS authors,
  CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 3 THEN 'Update' ELSE 'Insert' END AS mode,
  CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS append_time,
  o_orderkey AS row_no,
  CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice
FROM orders
"""


# --- settings change requests -----------------------------------------------------------
# Each event is a request: its user picks the table (the sixth choice does not
# exist), its id the shelf life (some <= 0, invalid) and the auto-edit flag.

SETTINGS_TABLES = ("pub.orders", "pub.part", "pub.events", "pub.customer", "pub.lineitem", "pub.nope")


def settings_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    tables = F.array(*[F.lit(t) for t in SETTINGS_TABLES])
    return e.select(
        F.element_at(tables, (F.col("user_id") % 6 + 1).cast("int")).alias("target_table"),
        (F.col("event_id") % 3 != 0).alias("auto_edit"),
        ((F.col("event_id") % 45) - 5).cast("int").alias("shelf_life_days"),
        F.col("ts").cast("timestamp_ntz").alias("updated_at"), "event_id")


SETTINGS_REQUESTS_SQL = """
SELECT ['pub.orders', 'pub.part', 'pub.events', 'pub.customer', 'pub.lineitem', 'pub.nope'][CAST(user_id % 6 + 1 AS INTEGER)] AS target_table,
  (event_id % 3 <> 0) AS auto_edit, CAST(event_id % 45 - 5 AS INTEGER) AS shelf_life_days,
  CAST(ts AS TIMESTAMP) AS updated_at, event_id
FROM events
"""


# --- tenant catalog: one schema per customer (grows with the data) ------------------------
# Each customer ``k`` owns schema ``c<k>`` with tables orders (PK o_orderkey),
# lineitem (two-column PK), events (a UNIQUE constraint only, no PK) and, for
# every 7th customer, a system table.  Every 11th customer's orders table has
# no catalog columns.

CATALOG_DB = "warehouse"
TENANT_TABLES = ("orders", "lineitem", "events", "MSysObjects")
# (table_name, column_name, ordinal, is_nullable, data_type, char_max_len, numeric_precision, numeric_scale)
TENANT_COLUMNS = tuple(
    [("orders", c.name, c.ordinal, "YES" if c.nullable else "NO", c.data_type, c.char_max_len, c.precision, c.scale)
     for c in PUB_ORDERS.columns]
    + [("lineitem", n, i + 1, nl, t, ln, p, s) for i, (n, nl, t, ln, p, s) in enumerate([
        ("l_orderkey", "NO", "bigint", None, 19, 0), ("l_partkey", "YES", "bigint", None, 19, 0),
        ("l_suppkey", "YES", "bigint", None, 19, 0), ("l_linenumber", "NO", "int", None, 10, 0),
        ("l_quantity", "YES", "float", None, 53, None), ("l_extendedprice", "YES", "float", None, 53, None),
        ("l_discount", "YES", "float", None, 53, None), ("l_tax", "YES", "float", None, 53, None),
        ("l_returnflag", "YES", "nvarchar", -1, None, None), ("l_linestatus", "YES", "nvarchar", -1, None, None),
        ("l_shipdate", "YES", "datetime2", None, None, None)])]
    + [("events", n, i + 1, "YES", t, ln, p, s) for i, (n, t, ln, p, s) in enumerate([
        ("event_id", "bigint", None, 19, 0), ("ts", "datetime2", None, None, None),
        ("user_id", "bigint", None, 19, 0), ("event_type", "nvarchar", -1, None, None),
        ("value", "float", None, 53, None), ("props", "nvarchar", -1, None, None)])]
    + [("MSysObjects", "id", 1, "NO", "int", None, 10, 0), ("MSysObjects", "name", 2, "YES", "varchar", 64, None, None)])
# (table_name, constraint_name, constraint_type, column_name)
TENANT_KEYS = (("orders", "pk_orders", "PRIMARY KEY", "o_orderkey"),
               ("lineitem", "pk_lineitem", "PRIMARY KEY", "l_orderkey"),
               ("lineitem", "pk_lineitem", "PRIMARY KEY", "l_linenumber"),
               ("events", "uq_events", "UNIQUE", "event_id"))


def _lit(v):
    return F.lit(v)


def _sqlv(v) -> str:
    if v is None:
        return "NULL"
    return f"'{v}'" if isinstance(v, str) else str(v)


def tenant_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    schema = F.concat(F.lit("c"), k.cast("string")).alias("table_schema")
    keep_table = (F.col("table_name") != "MSysObjects") | (k % 7 == 0)
    tables = (c.select(k, schema, F.explode(F.array(*[F.lit(t) for t in TENANT_TABLES])).alias("table_name"))
              .where(keep_table).select("table_schema", "table_name"))
    tmpl = F.array(*[F.struct(_lit(t).alias("table_name"), _lit(n).alias("column_name"), _lit(o).alias("ordinal"),
                              _lit(nl).alias("is_nullable"), _lit(dt).alias("data_type"),
                              _lit(ln).cast("int").alias("char_max_len"), _lit(p).cast("int").alias("numeric_precision"),
                              _lit(s).cast("int").alias("numeric_scale"))
                     for t, n, o, nl, dt, ln, p, s in TENANT_COLUMNS])
    columns = (c.select(k, schema, F.explode(tmpl).alias("t")).select(k, "table_schema", "t.*")
               .where(keep_table & ((F.col("table_name") != "orders") | (k % 11 != 0))).drop("c_custkey"))
    ktmpl = F.array(*[F.struct(_lit(t).alias("table_name"), _lit(cn).alias("constraint_name"),
                               _lit(ct).alias("constraint_type"), _lit(col).alias("column_name"))
                      for t, cn, ct, col in TENANT_KEYS])
    kc = c.select(F.lit(CATALOG_DB).alias("catalog"), F.concat(F.lit("c"), k.cast("string")).alias("schema"),
                  F.explode(ktmpl).alias("t")).select("catalog", "schema", "t.*")
    constraints = kc.select("catalog", "schema", "table_name", "constraint_name", "constraint_type").distinct()
    key_columns = kc.select("catalog", "schema", "table_name", "constraint_name", "column_name")
    return Catalog(tables, columns, constraints, key_columns)


def tenant_catalog_sql() -> dict[str, str]:
    cols = ", ".join("{" + ", ".join([f"'table_name': '{t}'", f"'column_name': '{n}'", f"'ordinal': {o}",
                                      f"'is_nullable': '{nl}'", f"'data_type': '{dt}'",
                                      f"'char_max_len': CAST({_sqlv(ln)} AS INTEGER)",
                                      f"'numeric_precision': CAST({_sqlv(p)} AS INTEGER)",
                                      f"'numeric_scale': CAST({_sqlv(s)} AS INTEGER)"]) + "}"
                     for t, n, o, nl, dt, ln, p, s in TENANT_COLUMNS)
    keys = ", ".join("{" + f"'table_name': '{t}', 'constraint_name': '{cn}', 'constraint_type': '{ct}', "
                     f"'column_name': '{col}'" + "}" for t, cn, ct, col in TENANT_KEYS)
    tabs = ", ".join(f"'{t}'" for t in TENANT_TABLES)
    return {
        "tables": f"""SELECT table_schema, table_name FROM (SELECT c_custkey, 'c' || CAST(c_custkey AS VARCHAR) AS table_schema,
                   unnest([{tabs}]) AS table_name FROM customer)
                   WHERE table_name <> 'MSysObjects' OR c_custkey % 7 = 0""",
        "columns": f"""SELECT table_schema, table_name, column_name, ordinal, is_nullable, data_type, char_max_len,
                   numeric_precision, numeric_scale FROM (SELECT c_custkey, 'c' || CAST(c_custkey AS VARCHAR) AS table_schema,
                   unnest([{cols}], recursive := true) FROM customer)
                   WHERE (table_name <> 'MSysObjects' OR c_custkey % 7 = 0) AND (table_name <> 'orders' OR c_custkey % 11 <> 0)""",
        "keys": f"""SELECT '{CATALOG_DB}' AS catalog, 'c' || CAST(c_custkey AS VARCHAR) AS schema,
                   unnest([{keys}], recursive := true) FROM customer""",
    }


# --- gate envelopes: one tab per customer, twelve shapes (FIXTURES.md §4 tab list) ----------
# (tab prefix, table suffix or full name, header, rows forced to zero)
GATE_SCENARIOS = (
    ("Update_a_", ".orders", ("O_OrderKey", "o_orderstatus"), False),
    ("Insert_b_", ".events", ("ts", "user_id", "event_type"), False),
    ("notes_", ".orders", ("o_orderkey", "o_orderstatus"), False),
    ("Update_insert_c_", ".orders", ("o_orderkey", "o_totalprice"), False),
    ("Update_d_", "orders", ("o_orderkey", "o_orderstatus"), False),
    ("Update_e_", ".nope", ("o_orderkey", "o_orderstatus"), False),
    ("Insert_f_", ".orders", ("o_orderkey", "o_orderstatus"), False),
    ("Update_g_", ".lineitem", ("l_orderkey", "l_linenumber", "l_quantity"), False),
    ("Update_h_", ".events", ("event_id", "value"), False),
    ("Update_i_", ".orders", ("o_orderstatus",), False),
    ("Update_j_", ".orders", ("o_orderkey", "o_orderstatus"), True),
    ("Update_k_", ".orders", ("o_orderkey", "zzz"), False),
)


def gate_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("_n"))
    k = F.col("c_custkey")
    s = k % len(GATE_SCENARIOS)
    ks = k.cast("string")
    tab = target = header = zero = None
    for i, (prefix, tbl, hdr, z) in enumerate(GATE_SCENARIOS):
        cond = s == i
        t_val = F.concat(F.lit("c"), ks, F.lit(tbl)) if tbl.startswith(".") else F.lit(tbl)
        parts = [(tab, F.concat(F.lit(prefix), ks)), (target, t_val),
                 (header, F.array(*[F.lit(h) for h in hdr])), (zero, F.lit(z))]
        tab, target, header, zero = [F.when(cond, v) if prev is None else prev.when(cond, v) for prev, v in parts]
    return (c.join(counts, c.c_custkey == counts.o_custkey, "left")
            .select(tab.alias("tab"), target.alias("target_table"), header.alias("header"),
                    F.when(zero, F.lit(0)).otherwise(F.coalesce("_n", F.lit(0))).cast("bigint").alias("n_rows")))


def gate_envelopes_sql() -> str:
    n = len(GATE_SCENARIOS)

    def case(fn) -> str:
        return "CASE " + " ".join(f"WHEN c_custkey % {n} = {i} THEN {fn(sc)}"
                                  for i, sc in enumerate(GATE_SCENARIOS)) + " END"

    tab = case(lambda sc: f"'{sc[0]}' || CAST(c_custkey AS VARCHAR)")
    target = case(lambda sc: f"'c' || CAST(c_custkey AS VARCHAR) || '{sc[1]}'" if sc[1].startswith(".")
                  else f"'{sc[1]}'")
    header = case(lambda sc: "[" + ", ".join(f"'{h}'" for h in sc[2]) + "]")
    zero = case(lambda sc: "TRUE" if sc[3] else "FALSE")
    return f"""SELECT {tab} AS tab, {target} AS target_table, {header} AS header,
  CAST(CASE WHEN {zero} THEN 0 ELSE coalesce(n._n, 0) END AS BIGINT) AS n_rows
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS _n FROM orders GROUP BY o_custkey) n ON c_custkey = n.o_custkey"""


# --- parsed sheet cells: one tab per customer, its orders as rows --------------------------
# Row 1 holds the table, row 2 the header (some with repeated or blank names),
# rows 3.. the orders; every 5th status cell is a NULL token or a look-alike,
# every 17th row is short one cell, every 23rd has one beyond the header; every 29th
# customer's tab has no first row.

TOKEN_SAMPLE = ("",  "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "n.a.", "NIL", " NA", "none")
SHEET_HEADERS = (("o_orderkey", "o_orderstatus", "o_orderstatus", "o_totalprice"),
                 ("o_orderkey", "", "o_orderstatus", "o_totalprice"),
                 ("o_orderkey", "o_orderstatus", "o_orderstatus", "o_orderstatus"),
                 ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"))


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    nh = len(SHEET_HEADERS)

    def where(key: Column) -> list[Column]:
        return [F.concat(F.lit("inbox/sheets_"), (key % nh).cast("string"), F.lit(".xlsx")).alias("path"),
                F.concat(F.lit("Update_orders_"), key.cast("string")).alias("tab")]

    k = F.col("c_custkey")
    hdr = None
    for i, h in enumerate(SHEET_HEADERS):
        v = F.array(*[F.lit(x) for x in h])
        hdr = F.when(k % nh == i, v) if hdr is None else hdr.when(k % nh == i, v)
    first = c.where(k % 29 != 0).select(*where(k), F.lit(1).cast("bigint").alias("row_no"),
                                        F.array(F.lit("pub.orders")).alias("cells"))
    second = c.select(*where(k), F.lit(2).cast("bigint").alias("row_no"), hdr.alias("cells"))
    ok = F.col("o_orderkey")
    tokens = F.array(*[F.lit(t) for t in TOKEN_SAMPLE])
    status = F.when(ok % 5 == 0, F.element_at(tokens, ((ok / 5).cast("bigint") % len(TOKEN_SAMPLE) + 1).cast("int"))) \
        .otherwise(F.col("o_orderstatus"))
    full = F.array(ok.cast("string"), status, F.col("o_orderpriority"),
                   F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    data = o.select(*where(F.col("o_custkey")), (ok + 3).alias("row_no"),
                    F.when(ok % 17 == 0, F.slice(full, 1, 3)).when(ok % 23 == 0, F.concat(full, F.array(F.lit("EXTRA"))))
                    .otherwise(full).alias("cells"))
    return first.unionByName(second).unionByName(data)


def sheet_cells_sql() -> str:
    nh = len(SHEET_HEADERS)
    hdr = "CASE " + " ".join(f"WHEN c_custkey % {nh} = {i} THEN [" + ", ".join(f"'{x}'" for x in h) + "]"
                             for i, h in enumerate(SHEET_HEADERS)) + " END"
    toks = "[" + ", ".join(f"'{t}'" for t in TOKEN_SAMPLE) + "]"
    return f"""
SELECT 'inbox/sheets_' || CAST(c_custkey % {nh} AS VARCHAR) || '.xlsx' AS path, 'Update_orders_' || CAST(c_custkey AS VARCHAR) AS tab,
  CAST(1 AS BIGINT) AS row_no, ['pub.orders'] AS cells FROM customer WHERE c_custkey % 29 <> 0
UNION ALL
SELECT 'inbox/sheets_' || CAST(c_custkey % {nh} AS VARCHAR) || '.xlsx', 'Update_orders_' || CAST(c_custkey AS VARCHAR),
  CAST(2 AS BIGINT), {hdr} FROM customer
UNION ALL
SELECT 'inbox/sheets_' || CAST(o_custkey % {nh} AS VARCHAR) || '.xlsx', 'Update_orders_' || CAST(o_custkey AS VARCHAR),
  CAST(o_orderkey + 3 AS BIGINT),
  CASE WHEN o_orderkey % 17 = 0 THEN list_slice(f, 1, 3) WHEN o_orderkey % 23 = 0 THEN list_append(f, 'EXTRA') ELSE f END
FROM (SELECT *, [CAST(o_orderkey AS VARCHAR),
         CASE WHEN o_orderkey % 5 = 0 THEN {toks}[CAST((o_orderkey // 5) % {len(TOKEN_SAMPLE)} + 1 AS INTEGER)]
              ELSE o_orderstatus END,
         o_orderpriority, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)] AS f FROM orders)
"""
