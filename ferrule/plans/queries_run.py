"""Registered queries over whole change runs.  Their DuckDB SQL is written by hand, from what the
run is meant to do, and shares nothing with the plan's rules, gates or chaining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import locker as L
from ..operators import quarantine as Q
from ..operators import rules as R
from ..operators.catalog import ColumnSpec, TableSpec
from ..operators.tables import TableStore
from ..session import scratch_dir
from . import fixtures as X
from .pipeline import RunConfig, read_quarantine, run, run_batch
from .registry import register

PARSED = ["path", "tab", "tab_seq", "row_no", "cells", "authors", "file_seq"]


def _tab(path: str, file_seq: int, tab: str, tab_seq: int, table: str | None, header: list[str],
         rows: DataFrame | None, cells: list[Column], key: str) -> DataFrame:
    """A tab's cells: the table's name, the header, and a row per row of ``rows`` (numbered key + 10)."""
    spark = SparkSession.getActiveSession()
    head = [(1, [table])] if table else []
    top = spark.createDataFrame([*head, (2, header)], "row_no bigint, cells array<string>")
    if rows is not None:
        top = top.unionByName(rows.select((F.col(key) + 10).cast("bigint").alias("row_no"),
                                          F.array(*[c.cast("string") for c in cells]).alias("cells")))
    lineage = {"path": F.lit(path), "tab": F.lit(tab), "tab_seq": F.lit(tab_seq), "file_seq": F.lit(file_seq).cast("bigint"),
               "authors": F.lit(None).cast("string")}
    return top.withColumns(lineage).select(*PARSED)


def _store(spark: SparkSession, **tables: tuple[DataFrame, str | None]) -> TableStore:
    store = TableStore(spark, scratch_dir(spark, "tables"))
    for name, (df, part) in tables.items():
        store.create(f"pub.{name}", df, partition_by=part)
    return store


def _config(spark: SparkSession, run_id: str) -> RunConfig:
    base = scratch_dir(spark, "run")
    return RunConfig(run_id=run_id, as_of=X.AS_OF, locker_path=f"{base}/locker", quarantine_path=f"{base}/quarantine",
                     errors_path=f"{base}/errors", events_path=f"{base}/events")


def _line(section: str, item: Column, value: Column) -> list[Column]:
    return [F.lit(section).alias("section"), item.alias("item"), value.alias("value")]


def _bar(*cols: Column | str) -> Column:
    return F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-")) for c in cols])


# --- several files with tabs of equal names ------------------------------------------------------

MULTI_FILE_SQL = """
WITH m AS (SELECT max(c_custkey) AS top FROM customer),
ca AS (SELECT top + row_number() OVER (ORDER BY c_custkey) AS k, c_custkey + 10 AS row_no, 'new a ' || c_custkey AS nm, c_nationkey AS nation
       FROM customer, m WHERE c_custkey % 7 = 0),
cb AS (SELECT top + (SELECT count(*) FROM ca) + row_number() OVER (ORDER BY c_custkey) AS k, c_custkey + 10 AS row_no,
              'new b ' || c_custkey AS nm FROM customer, m WHERE c_custkey % 11 = 0),
n AS (SELECT (SELECT count(*) FROM ca) AS ca, (SELECT count(*) FROM cb) AS cb,
             (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 1) AS oa, (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 2) AS om,
             (SELECT count(*) FROM orders WHERE o_orderkey % 15 = 1) AS ob, (SELECT count(*) FROM orders WHERE o_orderkey % 20 = 3) AS oc,
             (SELECT count(*) FROM orders WHERE o_orderkey % 40 = 4) AS od, (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 5) AS of_,
             (SELECT count(*) FROM orders WHERE o_orderkey % 200 = 6) AS og)
SELECT 'orders' AS section, CAST(o_orderkey AS VARCHAR) AS item,
  CASE WHEN o_orderkey % 15 = 1 THEN 'Y' WHEN o_orderkey % 10 = 1 THEN 'X' ELSE o_orderstatus END || '|' ||
  CASE WHEN o_orderkey % 15 = 1 THEN '9-NEW' ELSE o_orderpriority END || '|' ||
  CASE WHEN o_orderkey % 15 = 1 OR o_orderkey % 10 = 1 THEN '1998-01-01 00:00:00' ELSE '-' END AS value FROM orders
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name || '|' || c_nationkey || '|' || c_mktsegment FROM customer
UNION ALL SELECT 'customer', CAST(k AS VARCHAR), CASE WHEN k = top + 1 THEN 'renamed' ELSE nm END || '|' || nation || '|-' FROM ca, m
UNION ALL SELECT 'customer', CAST(k AS VARCHAR), nm || '|-|RAIL' FROM cb
UNION ALL SELECT 'quarantine', 'a.csv|Update_orders|' || (o_orderkey + 10), 'D2|o_orderkey' FROM orders WHERE o_orderkey % 50 = 2
UNION ALL SELECT 'quarantine', 'a.csv|Update_customer|10', 'D2|c_custkey' FROM m
UNION ALL SELECT 'quarantine', 'b.csv|Update_customer|11', 'D2|c_custkey' FROM m
UNION ALL SELECT 'quarantine', 'c.csv|Update_orders|' || (o_orderkey + 10), 'C6|nope' FROM orders WHERE o_orderkey % 20 = 3
UNION ALL SELECT 'quarantine', 'd.csv|Update_orders|' || (o_orderkey + 10), 'C11|-' FROM orders WHERE o_orderkey % 40 = 4
UNION ALL SELECT 'quarantine', 'e.csv|Update_orders|-', 'C4|-'
UNION ALL SELECT 'quarantine', 'f.csv|Update_orders|' || (o_orderkey + 10), 'C2|-' FROM orders WHERE o_orderkey % 100 = 5
UNION ALL SELECT 'quarantine', 'g.csv|Update_orders|' || (o_orderkey + 10), 'C6|Unnamed: 2' FROM orders WHERE o_orderkey % 200 = 6
UNION ALL SELECT 'locker', 'Update|multi:inbox/a.csv#Update_orders|' || (o_orderkey + 10),
  'edit_dt=\\N;o_orderkey=' || o_orderkey || ';o_orderstatus=' || o_orderstatus FROM orders WHERE o_orderkey % 10 = 1
UNION ALL SELECT 'locker', 'Update|multi:inbox/b.csv#Update_orders|' || (o_orderkey + 10),
  'edit_dt=' || CASE WHEN o_orderkey % 10 = 1 THEN '1998-01-01 00:00:00' ELSE '\\N' END || ';o_orderkey=' || o_orderkey ||
  ';o_orderpriority=' || o_orderpriority || ';o_orderstatus=' || CASE WHEN o_orderkey % 10 = 1 THEN 'X' ELSE o_orderstatus END
  FROM orders WHERE o_orderkey % 15 = 1
UNION ALL SELECT 'locker', 'Insert|multi:inbox/a.csv#Insert_customer|' || row_no, 'c_custkey=' || k || ';c_name=' || nm || ';c_nationkey=' || nation FROM ca
UNION ALL SELECT 'locker', 'Insert|multi:inbox/b.csv#Insert_customer|' || row_no, 'c_custkey=' || k || ';c_mktsegment=RAIL;c_name=' || nm FROM cb
UNION ALL SELECT 'locker', 'Update|multi:inbox/b.csv#Update_customer|10', 'c_custkey=' || k || ';c_name=' || nm FROM ca, m WHERE k = top + 1
UNION ALL SELECT 'event', 'update tab Update_orders of a.csv for pub.orders: ' || oa || ' applied, ' || om || ' rejected', CASE WHEN om > 0 THEN 'warning' ELSE 'info' END FROM n
UNION ALL SELECT 'event', 'update tab Update_customer of a.csv for pub.customer: 0 applied, 1 rejected', 'warning'
UNION ALL SELECT 'event', 'insert tab Insert_customer of a.csv for pub.customer: ' || ca || ' applied, 0 rejected', 'info' FROM n
UNION ALL SELECT 'event', 'update tab Update_orders of b.csv for pub.orders: ' || ob || ' applied, 0 rejected', 'info' FROM n
UNION ALL SELECT 'event', 'insert tab Insert_customer of b.csv for pub.customer: ' || cb || ' applied, 0 rejected', 'info' FROM n
UNION ALL SELECT 'event', 'update tab Update_customer of b.csv for pub.customer: 1 applied, 1 rejected', 'warning'
UNION ALL SELECT 'event', 'update tab Update_orders of c.csv for pub.orders: 0 applied, ' || oc || ' rejected (C6)', CASE WHEN oc > 0 THEN 'warning' ELSE 'info' END FROM n
UNION ALL SELECT 'event', 'update tab Update_orders of d.csv for pub.orders: 0 applied, ' || od || ' rejected (C11)', CASE WHEN od > 0 THEN 'warning' ELSE 'info' END FROM n
UNION ALL SELECT 'event', 'update tab Update_orders of e.csv for pub.orders: 0 applied, 0 rejected (C4)', 'warning'
UNION ALL SELECT 'event', 'update tab Update_orders of f.csv for no table: 0 applied, ' || of_ || ' rejected (C2)', 'warning' FROM n
UNION ALL SELECT 'event', 'update tab Update_orders of g.csv for pub.orders: 0 applied, ' || og || ' rejected (C6)', 'warning' FROM n
"""


def _multi_file_cells(spark: SparkSession, sf: str) -> DataFrame:
    o, c = X.table(spark, sf, "orders"), X.table(spark, sf, "customer")
    k, ck = F.col("o_orderkey"), F.col("c_custkey")
    top = c.agg(F.max("c_custkey").alias("top"))
    o_tab, c_tab = "pub.orders", "pub.customer"
    rows_a = o.where(k % 10 == 1).select("o_orderkey", k.alias("v")).unionByName(o.where(k % 50 == 2).select("o_orderkey", (-k).alias("v")))
    ghosts = top.select(F.lit(0).alias("r"), (F.col("top") + 2).alias("v"))                # inserted only by a later tab
    later = top.select(F.explode(F.array(F.struct(F.lit(0).alias("r"), (F.col("top") + 1).alias("v")),
                                         F.struct(F.lit(1).alias("r"), (F.col("top") + 10**9).alias("v")))).alias("s")).select("s.*")
    tabs = [
        _tab("inbox/a.csv", 1, "Update_orders", 1, o_tab, ["o_orderkey", "o_orderstatus"], rows_a, [F.col("v"), F.lit("X")], "o_orderkey"),
        _tab("inbox/a.csv", 1, "Update_customer", 2, c_tab, ["c_custkey", "c_name"], ghosts, [F.col("v"), F.lit("early")], "r"),
        _tab("inbox/a.csv", 1, "Insert_customer", 3, c_tab, ["c_name", "c_nationkey"], c.where(ck % 7 == 0),
             [F.concat(F.lit("new a "), ck.cast("string")), F.col("c_nationkey")], "c_custkey"),
        _tab("inbox/b.csv", 2, "Update_orders", 1, o_tab, ["o_orderkey", "o_orderpriority", "o_orderstatus"], o.where(k % 15 == 1),
             [k, F.lit("9-NEW"), F.lit("Y")], "o_orderkey"),
        _tab("inbox/b.csv", 2, "Insert_customer", 2, c_tab, ["c_name", "c_mktsegment"], c.where(ck % 11 == 0),
             [F.concat(F.lit("new b "), ck.cast("string")), F.lit("RAIL")], "c_custkey"),
        _tab("inbox/b.csv", 2, "Update_customer", 3, c_tab, ["c_custkey", "c_name"], later, [F.col("v"), F.lit("renamed")], "r"),
        _tab("inbox/c.csv", 3, "Update_orders", 1, o_tab, ["o_orderkey", "nope"], o.where(k % 20 == 3), [k, F.lit("z")], "o_orderkey"),
        _tab("inbox/d.csv", 4, "Update_orders", 1, o_tab, ["o_orderstatus"], o.where(k % 40 == 4), [F.lit("Z")], "o_orderkey"),
        _tab("inbox/e.csv", 5, "Update_orders", 1, o_tab, ["o_orderkey", "o_orderstatus"], None, [], "o_orderkey"),
        _tab("inbox/f.csv", 6, "Update_orders", 1, None, ["o_orderkey", "o_orderstatus"], o.where(k % 100 == 5), [k, F.lit("Z")], "o_orderkey"),
        _tab("inbox/g.csv", 7, "Update_orders", 1, o_tab, ["o_orderkey", "o_orderstatus"], o.where(k % 200 == 6),
             [k, F.lit("Z"), F.lit("beyond")], "o_orderkey"),
    ]
    out = tabs[0]
    for t in tabs[1:]:
        out = out.unionByName(t)
    return out


@register("change_run_multi_file", MULTI_FILE_SQL)
def change_run_multi_file(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose tabs share names, updates and inserts in turn, bad headers, a key changed by two files, a row
    inserted and then changed; and the run repeated on the same tables, which changes nothing."""
    store = _store(spark, orders=(X.target_orders(spark, sf), "o_orderpriority"), customer=(X.table(spark, sf, "customer"), "c_mktsegment"))
    cells, catalog, cfg = _multi_file_cells(spark, sf), X.declared_catalog(spark, sf), _config(spark, "multi")
    for _ in range(2):
        events = run(spark, cells, catalog, store, cfg)
    q, lk = read_quarantine(spark, cfg), L.read(spark, cfg.locker_path)
    parts = [
        store.read("pub.orders").select(*_line("orders", F.col("o_orderkey").cast("string"), _bar("o_orderstatus", "o_orderpriority", "edit_dt"))),
        store.read("pub.customer").select(*_line("customer", F.col("c_custkey").cast("string"), _bar("c_name", "c_nationkey", "c_mktsegment"))),
        q.select(*_line("quarantine", _bar(F.regexp_extract("file", "[^/]*$", 0), "tab", "row_no"), _bar("rule_id", "rule_column"))),
        lk.select(*_line("locker", _bar("mode", "item_id", "row_no"), Q.map_text("row"))),
        events.select(*_line("event", F.col("message"), F.col("level")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- an update that moves rows between partitions ------------------------------------------------

@register("update_moves_partition", """SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN '007' WHEN o_orderkey % 9 = 2 THEN '1-URGENT'
       WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def update_moves_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Rows leave partitions, found new ones, join old ones; NULL and number-like values are partitions too."""
    k = F.col("o_orderkey")
    target = X.target_orders(spark, sf).withColumn("o_orderpriority", F.when(k % 13 != 0, F.col("o_orderpriority")))
    store = _store(spark, orders=(target, "o_orderpriority"))
    moved = F.when(k % 9 == 1, "007").when(k % 9 == 2, "1-URGENT")
    batch = X.table(spark, sf, "orders").where(k % 9 < 3).select(
        F.lit("moves.parquet").alias("path"), F.lit("Update_moves").alias("tab"), F.lit(1).cast("bigint").alias("file_seq"),
        F.lit(1).alias("tab_seq"), F.lit(None).cast("string").alias("authors"), F.lit("pub.orders").alias("target_table"),
        (k + 2).alias("row_no"), k.cast("string").alias("o_orderkey"), moved.alias("o_orderpriority"))
    run_batch(spark, batch, X.declared_catalog(spark, sf), store, _config(spark, "moves"))
    return store.read("pub.orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")


# --- an update by one column of a wider key ------------------------------------------------------

_LINES = "SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber"


@register("update_partial_key", f"""SELECT 'line' AS section, l_orderkey || '|' || l_linenumber AS item,
  CAST(CAST(CASE WHEN l_orderkey % 7 = 1 THEN 99 ELSE q END AS BIGINT) AS VARCHAR) AS value FROM ({_LINES})
UNION ALL SELECT 'locker', CAST(l_orderkey AS VARCHAR), CAST(CAST(q AS BIGINT) AS VARCHAR) FROM ({_LINES}) WHERE l_orderkey % 7 = 1
UNION ALL SELECT 'quarantine', '-1', 'D2' FROM (SELECT 1)""")
def update_partial_key(spark: SparkSession, sf: str) -> DataFrame:
    """Lines are keyed by order and number; a tab that names the order changes each of its lines, once."""
    li = X.table(spark, sf, "lineitem")
    row = F.struct("l_quantity", *[c for c in li.columns if c not in ("l_orderkey", "l_linenumber", "l_quantity")])
    lines = li.groupBy("l_orderkey", "l_linenumber").agg(F.max(row).alias("r")).select("l_orderkey", "l_linenumber", "r.*").select(li.columns)
    store = _store(spark, lineitem=(lines, "l_returnflag"))
    keys = li.where(F.col("l_orderkey") % 7 == 1).select("l_orderkey").distinct().unionByName(
        spark.range(1).select(F.lit(-1).cast("bigint").alias("l_orderkey")))
    batch = keys.select(
        F.lit("lines.parquet").alias("path"), F.lit("Update_lines").alias("tab"), F.lit(1).cast("bigint").alias("file_seq"),
        F.lit(1).alias("tab_seq"), F.lit(None).cast("string").alias("authors"), F.lit("pub.lineitem").alias("target_table"),
        (F.col("l_orderkey") + 10).alias("row_no"), F.col("l_orderkey").cast("string").alias("l_orderkey"), F.lit("99").alias("l_quantity"))
    cfg = _config(spark, "lines")
    run_batch(spark, batch, X.declared_catalog(spark, sf), store, cfg)
    whole = lambda c: F.col(c).cast("double").cast("bigint").cast("string")
    lk = L.read(spark, cfg.locker_path).select(F.col("row")["l_orderkey"].alias("k"), F.col("row")["l_quantity"].alias("q"))
    return (store.read("pub.lineitem").select(*_line("line", _bar("l_orderkey", "l_linenumber"), whole("l_quantity")))
            .unionByName(lk.select(*_line("locker", F.col("k"), whole("q"))))
            .unionByName(read_quarantine(spark, cfg).select(*_line("quarantine", F.col("row")["l_orderkey"], F.col("rule_id")))))


# --- a written locker: day partitions, export, retention -----------------------------------------

_SPACED = "pub.order details"


@register("locker_written", """WITH lk AS (
  SELECT o_orderkey, strftime(DATE '1997-12-10' + CAST(o_orderkey % 25 AS INTEGER), '%Y%m%d') AS day,
         CASE WHEN o_orderkey % 2 = 0 THEN 'pub.orders' ELSE 'pub.order details' END AS target_table FROM orders),
kept AS (SELECT * FROM lk WHERE day >= strftime(DATE '1998-01-01' - CASE WHEN target_table = 'pub.orders' THEN 14 ELSE 5 END, '%Y%m%d'))
SELECT 'kept' AS section, day || '|' || target_table AS item, CAST(count(*) AS VARCHAR) AS value FROM kept GROUP BY ALL
UNION ALL SELECT 'export', 'Update_' || CASE WHEN target_table = 'pub.order details' THEN 1 ELSE 2 END, 'o_orderkey=' || o_orderkey
  FROM kept WHERE day = '19971230'""")
def locker_written(spark: SparkSession, sf: str) -> DataFrame:
    """B7, B8, A13, C15, E4 on disk: appended by day and table (one name with a blank), expired folders deleted,
    one day read by its partition and exported as sheets."""
    path, k = scratch_dir(spark, "locker"), F.col("o_orderkey")
    day = F.date_add(F.lit("1997-12-10").cast("date"), (k % 25).cast("int"))
    spaced = k % 2 == 1
    rows = X.table(spark, sf, "orders").select(
        F.date_format(day, "yyyyMMdd").alias("day"), F.when(spaced, _SPACED).otherwise("pub.orders").alias("target_table"),
        F.lit("r").alias("run_id"), F.concat(F.when(spaced, "a").otherwise("b"), F.date_format(day, "dd")).alias("item_id"),
        F.lit("f.csv").alias("file"), F.lit(None).cast("string").alias("authors"), F.lit("Update").alias("mode"),
        F.date_trunc("day", day).cast("timestamp_ntz").alias("append_time"), k.alias("row_no"), Q.row_map(["o_orderkey"]).alias("row"))
    L.append(rows, path)
    L.append(rows, path)                          # the same run again writes the same folders
    settings = spark.createDataFrame([(_SPACED, 5)], "target_table string, shelf_life_days int")
    L.purge_written(spark, path, settings, X.AS_OF)
    kept = L.read(spark, path)
    out = f"{path}-export"
    L.write_export(*L.export_day(kept, "19971230"), out)
    sheets = spark.read.parquet(f"{out}/items")
    return (kept.groupBy("day", "target_table").agg(F.count(F.lit(1)).alias("n"))
            .select(*_line("kept", _bar("day", "target_table"), F.col("n").cast("string")))
            .unionByName(sheets.select(*_line("export", F.col("sheet"), Q.map_text("row")))))


# --- date layouts, whatever the session's time zone -----------------------------------------------

@register("date_layouts", """WITH d AS (SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS iso,
  date_part('month', o_orderdate) || '/' || date_part('day', o_orderdate) || '/' || date_part('year', o_orderdate) AS us FROM orders)
SELECT o_orderkey, CASE o_orderkey % 8
  WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00.000') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00.000')
  WHEN 2 THEN iso || ' 02:30:00.000' WHEN 3 THEN iso || ' 10:11:00.000' WHEN 4 THEN iso || ' 10:11:12.123'
  WHEN 5 THEN iso || ' 10:11:00.000' END AS parsed FROM d""")
def date_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Dashes, slashes with one-digit months, ``T``, minutes, milliseconds; a zone with summer time leaves them as they are."""
    from ..functions import scalars as S

    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    fmt = lambda f: F.date_format(d.cast("timestamp_ntz"), f)
    text = (F.when(k == 0, fmt("yyyy-MM-dd")).when(k == 1, fmt("M/d/yyyy")).when(k == 2, fmt("yyyy-MM-dd'T'02:30:00"))
            .when(k == 3, fmt("yyyy-MM-dd 10:11")).when(k == 4, fmt("yyyy-MM-dd 10:11:12.123")).when(k == 5, fmt("M/d/yyyy 10:11"))
            .when(k == 6, fmt("d.M.yyyy")).otherwise("1998-02-30"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = X.table(spark, sf, "orders").select("o_orderkey", S.parse_datetime(text).alias("ts"))
        path = scratch_dir(spark, "dates")
        rows.write.parquet(path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    return spark.read.parquet(path).select("o_orderkey", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("parsed"))


# --- the types that the order batch does not have -------------------------------------------------

_TYPES = TableSpec("pub.types", tuple(ColumnSpec(n, t, True, None, p, s, i) for i, (n, t, p, s) in enumerate([
    ("s", "smallint", 5, 0), ("b", "bit", 1, 0), ("m", "money", 19, 4), ("t", "time", None, None),
    ("d", "decimal", 10, 2), ("r", "real", 24, None)], start=1)))


@register("type_rules", """SELECT o_orderkey AS row_no, CASE
  WHEN o_orderkey % 12 = 0 THEN 's:V5' WHEN o_orderkey % 12 = 3 THEN 's:V4' WHEN o_orderkey % 12 = 6 THEN 's:V3b'
  WHEN o_orderkey % 5 = 0 THEN 'b:V5' WHEN o_orderkey % 7 = 0 THEN 'm:V10' WHEN o_orderkey % 11 = 0 THEN 'm:V9'
  WHEN o_orderkey % 13 = 0 THEN 't:V7' WHEN o_orderkey % 17 = 0 THEN 'd:V15b'
  WHEN o_orderkey % 23 = 0 AND o_orderkey % 19 <> 0 THEN 'd:V15' WHEN o_orderkey % 31 = 0 AND o_orderkey % 29 <> 0 THEN 'r:V8'
  ELSE 'accepted' END AS rule_key FROM orders""")
def type_rules(spark: SparkSession, sf: str) -> DataFrame:
    """V3b, V4, V5, V7-V10, V15, V15b on smallint, bit, money, time, decimal and real cells."""
    k = F.col("o_orderkey")
    cells = {
        "s": F.when(k % 12 == 0, "40000").when(k % 12 == 3, "-40000").when(k % 12 == 6, "1.5").when(k % 12 == 9, "7.000").otherwise("12"),
        "b": F.when(k % 5 == 0, "2").otherwise((k % 2).cast("string")),
        "m": F.when(k % 7 == 0, "922337203685477.5808").when(k % 11 == 0, "-922337203685477.5809").otherwise("1.25"),
        "t": F.when(k % 13 == 0, "24:00").otherwise("9:05:01.5"),
        "d": F.when(k % 17 == 0, "1e9").when(k % 19 == 0, "4.560").when(k % 23 == 0, "4.561").otherwise("3"),
        "r": F.when(k % 29 == 0, "nan").when(k % 31 == 0, "x").otherwise("1e3")}
    batch = X.table(spark, sf, "orders").select(k.alias("row_no"), *[v.alias(c) for c, v in cells.items()])
    rules = R.build_rules(_TYPES, R.Envelope("insert_types", "pub.types", tuple(cells)), None, None)
    v = R.apply_chain(batch, rules)
    return v.select("row_no", F.when(F.col("rule_id").isNull(), "accepted").otherwise(F.concat_ws(":", "rule_column", "rule_id")).alias("rule_key"))
