"""Registered queries that go through files or a database: inbox, stream, quarantine, XML, JDBC.

Inputs are written by Spark from the test tables into a fresh folder under
the session's checkpoint folder (``spark.checkpoint.dir``), then read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quarantine as Q
from ..operators import rules as R
from ..operators.tables import TableStore
from ..session import scratch_dir
from ..sources import envelope as EV
from ..sources import jdbc as J
from ..sources import xmlio as XM
from ..sources.workbook import read_inbox
from . import fixtures as X
from .pipeline import RunConfig, run
from .queries import ORDERS_PAYLOAD, _rejected_rows_sql, annotated
from .registry import register


def write_csv_tabs(batch: DataFrame, header: list[str], path: str) -> None:
    """One CSV file per tab, in parts under ``tab=<name>.csv/``: A1 = table, row 2 = header, then data."""
    batch = batch.withColumn("tab", F.concat("tab", F.lit(".csv")))
    tabs = batch.select("tab", "target_table").distinct()
    first = tabs.select("tab", F.lit(1).cast("bigint").alias("row_no"), F.col("target_table").alias("value"))
    second = tabs.select("tab", F.lit(2).cast("bigint").alias("row_no"), F.lit(",".join(header)).alias("value"))
    data = batch.select("tab", (F.col("row_no") + 2).alias("row_no"),
                        F.to_csv(F.struct(*[F.col(h) for h in header])).alias("value"))
    (first.unionByName(second).unionByName(data).repartitionByRange("tab", "row_no").sortWithinPartitions("tab", "row_no")
     .drop("row_no").write.mode("append").partitionBy("tab").text(path))


def _inbox(spark: SparkSession, sf: str) -> str:
    path = scratch_dir(spark, "inbox")
    write_csv_tabs(X.update_orders(spark, sf), list(X.UPDATE_ORDERS_HEADER), path)
    write_csv_tabs(X.insert_customer(spark, sf), list(X.INSERT_CUSTOMER_HEADER), path)
    write_csv_tabs(X.update_dups(spark, sf), list(X.UPDATE_DUPS_HEADER), path)
    return path


def _inbox_sql() -> str:
    """The same rows as DuckDB builds them from the fixtures: line numbers are the rank in the tab + 2."""
    parts = []
    for batch_sql, header in ((X.UPDATE_ORDERS_SQL, X.UPDATE_ORDERS_HEADER),
                              (X.INSERT_CUSTOMER_SQL, X.INSERT_CUSTOMER_HEADER),
                              (X.UPDATE_DUPS_SQL, X.UPDATE_DUPS_HEADER)):
        parts.append(f"SELECT tab, target_table, row_number() OVER (PARTITION BY tab ORDER BY row_no) + 2 AS row_no, "
                     f"{Q.map_text_sql(list(header))} AS row_text FROM ({batch_sql})")
    return " UNION ALL ".join(parts)


@register("inbox_workbook", _inbox_sql)
def inbox_workbook(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox files -> parsed cells -> envelope -> data rows."""
    parsed = read_inbox(spark, _inbox(spark, sf))
    rows = EV.split_rows(parsed)
    return rows.select("tab", "target_table", "row_no", Q.map_text("row").alias("row_text"))


def _seeded_store(spark: SparkSession, sf: str) -> TableStore:
    store = TableStore(spark, scratch_dir(spark, "tables"))
    store.create("pub.orders", X.target_orders(spark, sf), partition_by="o_orderpriority")
    store.create("pub.customer", X.table(spark, sf, "customer"), partition_by="c_mktsegment")
    return store


def _run_config(spark: SparkSession, run_id: str) -> RunConfig:
    base = scratch_dir(spark, "run")
    return RunConfig(run_id=run_id, as_of=X.AS_OF, locker_path=f"{base}/locker", quarantine_path=f"{base}/quarantine",
                     errors_path=f"{base}/errors", events_path=f"{base}/events")


def _stream_sql() -> str:
    """Quarantine of the stream's change run: rule rejects of each tab, then D2 for accepted
    update rows whose key the target lacks (their row as typed text, with the edit stamp)."""
    from .queries import accepted_sql, annotated_sql

    parts = []
    for name, batch_sql, spec, env in (("a", X.UPDATE_ORDERS_SQL, X.PUB_ORDERS, X.UPDATE_ORDERS_ENV),
                                       ("b", X.INSERT_CUSTOMER_SQL, X.PUB_CUSTOMER, X.INSERT_CUSTOMER_ENV),
                                       ("c", X.UPDATE_DUPS_SQL, X.PUB_ORDERS, X.UPDATE_DUPS_ENV)):
        numbered = f"SELECT * REPLACE (row_number() OVER (PARTITION BY tab ORDER BY row_no) + 2 AS row_no) FROM ({batch_sql})"
        v = f"v{name} AS ({annotated_sql(numbered, spec, env)})"
        parts.append((name, v, spec, env))
    ctes = ",\n".join(v for _, v, _, _ in parts)
    ctes += f",\ntgt AS ({X.TARGET_ORDERS_SQL})"
    selects = [f"SELECT tab, target_table, row_no, {Q.map_text_sql(list(env.header))} AS row_text, rule_column, "
               f"rule_id, rule_message FROM v{name} WHERE rule_id IS NOT NULL" for name, _, _, env in parts]
    for name, _, spec, env in parts:
        if R.tab_mode(env.tab) != "update":
            continue
        cols = list(env.header) + ["edit_dt"]
        acc = accepted_sql(f"v{name}", spec, env)
        stamped = f"SELECT * REPLACE (TIMESTAMP '{X.AS_OF}' AS edit_dt) FROM (SELECT *, NULL AS edit_dt FROM ({acc}))"
        selects.append(f"SELECT tab, '{env.table}' AS target_table, row_no, {Q.map_text_sql(cols, 'd.')} AS row_text, "
                       f"'o_orderkey' AS rule_column, 'D2' AS rule_id, '{R.RULE_TEXT['D2']}' AS rule_message "
                       f"FROM ({stamped}) d ANTI JOIN tgt USING (o_orderkey)")
    return f"WITH {ctes}\n" + "\nUNION ALL\n".join(selects)


@register("inbox_stream", _stream_sql)
def inbox_stream(spark: SparkSession, sf: str) -> DataFrame:
    """G1 end to end: file stream -> foreachBatch change run -> quarantine of the run."""
    from ..streaming.inbox import run_stream

    inbox = _inbox(spark, sf)
    store = _seeded_store(spark, sf)
    catalog = X.declared_catalog(spark, sf)
    cfg = _run_config(spark, "stream")
    runs = []

    def handle(parsed: DataFrame, batch_id: int) -> None:
        c = RunConfig(**{**cfg.__dict__, "run_id": f"stream-{batch_id}"})
        runs.append(c.run_id)
        run(spark, parsed, catalog, store, c)

    run_stream(spark, inbox, scratch_dir(spark, "stream-ckpt"), handle)
    q = spark.read.parquet(cfg.quarantine_path).where(F.col("run_id").isin(runs))
    return q.select("tab", "target_table", "row_no", Q.map_text("row").alias("row_text"), "rule_column", "rule_id",
                    "rule_message")


@register("quarantine_write", lambda: f"SELECT * EXCLUDE (file, authors, target_table) FROM ({_rejected_rows_sql()})")
def quarantine_write(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected rows written by (run_id, tab) partitions and read back."""
    path = scratch_dir(spark, "quarantine")
    v = annotated(X.update_orders(spark, sf), X.PUB_ORDERS, X.UPDATE_ORDERS_ENV)
    (Q.to_quarantine(v, ORDERS_PAYLOAD, X.RUN_ID).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "tab").parquet(path))
    back = spark.read.parquet(path)
    return back.select("run_id", "tab", "row_no", Q.map_text("row").alias("row_text"), "rule_column", "rule_id",
                       "rule_message")


# --- XML ---------------------------------------------------------------------------------------

XML_ORDER_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _orders_text(spark: SparkSession, sf: str) -> DataFrame:
    o = X.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"),
                    F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus",
                    F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_totalprice"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")


def _orders_text_sql() -> str:
    return ("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, "
            "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice, "
            "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders")


def _unpivot_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS var_name, {c} AS value FROM ({_orders_text_sql()}) "
                              f"WHERE {c} IS NOT NULL AND {c} <> ''" for c in XML_ORDER_COLS)


@register("xml_round_trip", _unpivot_sql)
def xml_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """B9 + A10: orders written as <record><var var_name=..>, read back as (var_name, value)."""
    path = scratch_dir(spark, "xml-records")
    XM.write_records(_orders_text(spark, sf), path)
    return XM.read_var_records(spark, path).select("var_name", "value")


def _write_items(spark: SparkSession, sf: str) -> str:
    o = _orders_text(spark, sf)
    items = o.select(F.col("o_orderkey").alias("_id"), F.col("o_orderstatus").alias("_kind"),
                     F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")).alias("name"),
                     F.struct(F.col("o_custkey").alias("_k"), F.col("o_totalprice").alias("_VALUE")).alias("sub"),
                     F.col("o_orderkey").cast("bigint").alias("_key"))
    path = scratch_dir(spark, "xml-items")
    (items.repartitionByRange("_key").sortWithinPartitions("_key").drop("_key")
     .write.format("xml").option("rootTag", "items").option("rowTag", "item").save(path))
    return path


FLAT_SQL = ("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS kind, o_orderpriority AS name, "
            "CAST(o_custkey AS VARCHAR) AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS sub FROM orders")


@register("xml_flatten", FLAT_SQL)
def xml_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """A10+A11+S11: nested item elements flattened to (id, kind, name, k, sub), text trimmed."""
    recs = XM.read_records(spark, _write_items(spark, sf), "item")
    return XM.flatten(recs)


@register("xml_merge_first", f"""WITH f AS ({FLAT_SQL} ORDER BY o_orderkey LIMIT 1)
SELECT 'id' AS key, id AS value FROM f UNION ALL SELECT 'kind', kind FROM f UNION ALL SELECT 'name', name FROM f
UNION ALL SELECT 'k', k FROM f UNION ALL SELECT 'sub', sub FROM f""")
def xml_merge_first(spark: SparkSession, sf: str) -> DataFrame:
    """Every matching item merged into one record; the first in document order wins."""
    recs = XM.read_records(spark, _write_items(spark, sf), "item")
    pos = F.struct(F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i"))
    flat = XM.flatten(recs.withColumn("_pos", pos), keep=["_pos"])
    return XM.merge_first(flat, "_pos")


# --- JDBC ----------------------------------------------------------------------------------------

@register("jdbc_round_trip", """SELECT c_mktsegment, count(*) AS n_rows,
  sum(CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT)) AS acctbal_cents
FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer) GROUP BY c_mktsegment""")
def jdbc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A5, B1-B4 on an in-process Derby database (no port; visible to this JVM only)."""
    import uuid

    name = f"ferrule_{uuid.uuid4().hex[:8]}"
    url = J.derby_url(name)
    cust = X.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    types = "c_name VARCHAR(64), c_mktsegment VARCHAR(32)"
    J.create_table(cust, url, "APP.CUSTOMER", J.DERBY_DRIVER, types)                       # B3
    J.stage(cust, url, "APP.UT_TMP", J.DERBY_DRIVER, types)                                  # B1
    J.register_catalog(spark, name, url, J.DERBY_DRIVER)
    J.execute(spark, f"INSERT INTO {name}.APP.CUSTOMER SELECT * FROM {name}.APP.UT_TMP")     # B4
    J.execute(spark, f"DROP TABLE {name}.APP.UT_TMP")
    J.append_numbered(cust, url, "APP.UPLOADS", ["c_custkey"], J.DERBY_DRIVER)               # B2
    assert J.user_tables(spark, name, "APP").where(F.lower("tableName") == "uploads").count() == 1  # A9
    # Spark creates the columns as quoted lower-case names
    # the table holds every customer twice (created, then the staged copy inserted)
    return J.query(spark, url, 'SELECT "c_mktsegment", COUNT(*) AS "n_rows", '
                              'SUM(CAST(FLOOR("c_acctbal" * 100 + 0.5) AS BIGINT)) AS "acctbal_cents" '
                              'FROM APP.CUSTOMER GROUP BY "c_mktsegment"', J.DERBY_DRIVER)  # A5
