"""Rules as data give what the compiled chains give, whatever the number of tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ferrule.operators import quarantine as Q
from ferrule.operators import rules as R
from ferrule.operators.catalog import ColumnSpec as C
from ferrule.operators.catalog import TableSpec, catalog_from_specs
from ferrule.operators.gates import tab_gates
from ferrule.operators.rule_table import validate_tables
from ferrule.plans import fixtures as X
from ferrule.plans.queries_tables import MANY_TABLES_SQL, many_tables, validate_all_tables
from tools.oracle_check import digest

from .conftest import SF_SMALL
from .test_rules import CASES

TABS = "path string, tab string, target_table string, header array<string>, n_rows bigint"
OUT = ["tab", "row_no", "rule_id", "rule_column", "rule_message"]


def as_tab(batch, env):
    """A wide batch as rows with maps."""
    return batch.select(F.lit("p").alias("path"), F.lit(env.tab).alias("tab"), "row_no", Q.row_map(list(env.header)).alias("row"))


def by_table(spark, batches, specs):
    """Rows of all ``(batch, env)`` validated in one plan."""
    catalog = catalog_from_specs(spark, specs)
    rows = None
    for batch, env in batches:
        rows = as_tab(batch, env) if rows is None else rows.unionByName(as_tab(batch, env))
    tabs = spark.createDataFrame([("p", e.tab, e.table, list(e.header), 1) for _, e in batches], TABS)
    gates = tab_gates(tabs, catalog).select("path", "tab", "mode", "gate_id", "key_column")
    return sorted((tuple(r) for r in validate_tables(rows.join(gates, ["path", "tab"]), tabs, catalog).select(OUT).collect()), key=str)


def by_chain(batches, specs):
    out = []
    for batch, env in batches:
        spec = next((s for s in specs if s.table == env.table), None)
        judged = R.validate(batch, spec, env, table_exists=spec is not None)
        out += [tuple(r) for r in judged.select(F.lit(env.tab).alias("tab"), *OUT[1:]).collect()]
    return sorted(out, key=str)


def test_fixtures_as_the_chains_judge_them(spark):
    orders = X.update_orders(spark, SF_SMALL).withColumn("edit_dt", F.lit("2001-01-01 10:00:00"))
    specs = [X.PUB_ORDERS, X.customer_spec(spark, SF_SMALL)]
    batches = [(orders, X.UPDATE_ORDERS_ENV), (X.update_dups(spark, SF_SMALL), X.UPDATE_DUPS_ENV),
               (X.insert_customer(spark, SF_SMALL), X.INSERT_CUSTOMER_ENV)]
    batches += [(orders, R.Envelope(tab, table, header)) for tab, table, header in (
        ("update_edit", "pub.orders", X.UPDATE_ORDERS_HEADER + ("edit_dt",)), ("insert_key", "pub.orders", X.UPDATE_ORDERS_HEADER),
        ("update_none", "pub.orders", ("o_orderstatus", "o_flags")), ("update_gone", "pub.nope", ("o_orderkey",)), ("x", "pub.orders", ("o_orderkey",)),
        ("update_name", "orders", ("o_orderkey",)), ("update_back", "pub.orders", tuple(reversed(X.UPDATE_ORDERS_HEADER))))]
    got = by_table(spark, batches, specs)
    assert got == by_chain(batches, specs) and len({r[2] for r in got}) > 15


def test_every_case_of_the_rule_tests_in_one_plan(spark):
    rnd = random.Random(2)
    odd = ["\x01 5", "5\x01", "+5", " + 5", "5.", ".5", "--5", "5e", "5e2", "5e-3", "94999999999999e-13", "9.5e0", "12 3", "٣", "1" * 30, "-0", "00000000", "\t7\n",
           "1e400", "nan", " -INF", "1999-02-29", "2000-02-29", "1/2/2000 10:11", "99:99", "", " ", "1_0", "0.000000000001", "9" * 38, "9" * 39, "é" * 6]
    kinds = list(dict.fromkeys(case[0] for case in CASES)) + [C("c", "numeric", True, None, 38, 38), C("c", "decimal", True, None, 38, 0), C("c", "decimal"),
                                                              C("c", "decimal", True, None, 10), C("c", "unknown", False), C("c", "binary", True, 2)]
    batches, specs = [], []
    for i, kind in enumerate(kinds):
        values = [v for s, v, _ in CASES if s == kind] + odd + ["".join(rnd.choice("0123456789.eE+- ") for _ in range(rnd.randint(1, 7))) for _ in range(40)]
        batch = spark.createDataFrame(list(enumerate(values)), "row_no long, c string")
        specs.append(TableSpec(f"s.t{i}", (C("c", kind.data_type, kind.nullable, kind.char_max_len, kind.precision, kind.scale, 1),)))
        batches.append((batch.coalesce(1), R.Envelope(f"insert_{i}", f"s.t{i}", ("c",))))
    assert by_table(spark, batches, specs) == by_chain(batches, specs)


def test_odd_headers_nulls_and_empty_tables(spark):
    spec = TableSpec("s.t", (C("k", "bigint", False), C("Name", "varchar", False, 3), C("n", "int", False)), ("k",))
    rows = spark.createDataFrame([(1, None, None, None), (2, "x", "abcd", "q"), (3, "7", None, "1"), (4, "7", "ab", "1")], "row_no long, K string, name string, N string")
    batches = [(rows, R.Envelope("update_a", "s.t", ("K", "name", "N"))), (rows, R.Envelope("update_b", "s.t", ("N", "name", "K"))),
               (rows, R.Envelope("insert_c", "s.t", ("name",))), (rows.limit(0), R.Envelope("insert_d", "s.t", ("name", "N")))]
    assert by_table(spark, batches, [spec]) == by_chain(batches, [spec])
    catalog = catalog_from_specs(spark, [spec])
    none = spark.createDataFrame([], "path string, tab string, mode string, gate_id string, key_column string, row_no long, row map<string,string>")
    assert validate_tables(none, spark.createDataFrame([], TABS), catalog).collect() == []


def test_a_row_map_in_another_order_is_looked_up(spark):
    catalog = catalog_from_specs(spark, [TableSpec("s.t", (C("a", "int"), C("b", "varchar", True, 1)))])
    rows = spark.createDataFrame([("p", "insert_t", "insert", None, None, {"b": "xy", "a": "1"}), ("p", "insert_t", "insert", None, None, {"b": "x"})],
                                 "path string, tab string, mode string, gate_id string, key_column string, row map<string,string>")
    tabs = spark.createDataFrame([("p", "insert_t", "s.t", ["a", "b"], 2)], TABS)
    assert sorted((str(r.rule_id), str(r.rule_column)) for r in validate_tables(rows, tabs, catalog).collect()) == [("None", "None"), ("V1", "b")]


@pytest.mark.parametrize("sf", [SF_SMALL, "/root/testdata/sf0.01"])
def test_many_tables_match_sql(spark, sf):
    con = duckdb.connect()
    for t in ("orders", "events", "lineitem", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, res = validate_all_tables(spark, sf), con.sql(MANY_TABLES_SQL)
    rows, want = [tuple(r) for r in df.collect()], res.fetchall()
    assert len(rows) > 100 and digest(df.columns, rows)[0] == digest(res.columns, want)[0]


def test_the_plan_does_not_grow_with_the_tables(spark):
    """The same joins and scans, whatever the tables; no cell is shuffled."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = (validate_all_tables(spark, sf)._jdf.queryExecution().executedPlan().toString() for sf in (SF_SMALL, "/root/testdata/sf0.01"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all(few.count(node) == many.count(node) for node in ("Exchange", "SortMergeJoin", "FileScan", "Generate"))
    assert "explode(map_entries" not in few and many_tables(spark, SF_SMALL).select("target_table").distinct().count() > 100


def test_no_catalog_is_broadcast(spark, tmp_path):
    """A catalog unfolded from a small file may be huge: no look-up broadcasts it, whatever Spark takes its size for."""
    from ferrule.operators import gates as G
    from ferrule.plans import fixtures as X

    spark.range(50).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    catalog = X.tenant_catalog(spark, str(tmp_path))
    tabs = spark.createDataFrame([("Update_1", "c1.orders", ["o_orderkey", "zzz"], 3)],
                                 "tab string, target_table string, header array<string>, n_rows bigint")
    for df, n in ((G.resolve_header(tabs, catalog), 2), (G.tab_gates(tabs, catalog), 1), (catalog.primary_keys(), 150)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and df.count() == n
