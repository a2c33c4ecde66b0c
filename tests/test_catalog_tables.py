"""Tables of Spark's catalog: inserts by name, defaults, updates by partition, plans of the key joins."""

import uuid

import pytest

from ferrule.operators import catalog_tables as CT
from ferrule.operators import rules as R
from ferrule.operators.catalog import ColumnSpec as C
from ferrule.operators.catalog import TableSpec, catalog_from_specs

SPEC = TableSpec("x.t", (C("k", "bigint"), C("p", "varchar"), C("a", "int", default="5"), C("d", "date", default="DATE'1998-01-01'"), C("n", "varchar")), ("k",))


@pytest.fixture
def table(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex[:10]}"
    CT.create(spark, name, SPEC, "p", 4, f"{tmp_path}/t")
    CT.insert(spark, name, spark.createDataFrame([(i, ["x", "y", None, "007"][i % 4], i) for i in range(40)], "k long, p string, a int"))
    yield name
    spark.sql(f"DROP TABLE {name}")


def rows(spark, name):
    return {r.k: (r.p, r.a, str(r.d), r.n) for r in spark.table(name).collect()}


def test_inserts_take_defaults_by_name(spark, table):
    CT.insert(spark, table, spark.createDataFrame([("z", 100, None), (None, 101, "n")], "p string, k long, n string"))
    CT.insert(spark, table, spark.createDataFrame([(102, None, None)], "k long, a int, p string"))
    got = rows(spark, table)
    assert len(got) == 43 and got[100] == ("z", 5, "1998-01-01", None) and got[101] == (None, 5, "1998-01-01", "n")
    assert got[102] == (None, None, "1998-01-01", None) and got[3] == ("007", 3, "1998-01-01", None)


def test_update_moves_rows_and_may_be_repeated(spark, table):
    want = rows(spark, table)
    changes = [(0, "w", "q"), (1, None, "q"), (3, "007", None), (999, "w", "z"), *((i, "w", "q") for i in range(5, 40, 4))]
    for k, p, n in changes:
        if k in want:
            want[k] = (p, *want[k][1:3], n)
    df = spark.createDataFrame(changes, "k long, p string, n string")
    for _ in range(2):
        CT.update(spark, table, df, "k")
        assert rows(spark, table) == want and spark.table(table).count() == 40
    parts = {r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    assert parts == {"p=x", "p=w", "p=007", "p=__HIVE_DEFAULT_PARTITION__"}          # y is emptied


def test_a_cut_off_update_ends_right(spark, table, monkeypatch):
    """The overwrite is done, the emptied partition still there: moved rows lie twice until the update runs again."""
    df = spark.createDataFrame([(i, "w") for i in range(1, 40, 4)], "k long, p string")
    real = type(spark).sql

    def cut(self, text, *args, **kwargs):
        if text.startswith("ALTER TABLE"):
            raise RuntimeError("cut off")
        return real(self, text, *args, **kwargs)

    monkeypatch.setattr(type(spark), "sql", cut)
    with pytest.raises(RuntimeError):
        CT.update(spark, table, df, "k")
    monkeypatch.undo()
    spark.catalog.refreshTable(table)
    assert spark.table(table).count() == 50
    CT.update(spark, table, df, "k")
    assert spark.table(table).count() == 40 and spark.table(table).where("p = 'y'").count() == 0


def test_only_touched_partitions_are_rewritten(spark, table):
    def files():
        return {r[0] for r in spark.table(table).selectExpr("input_file_name()").distinct().collect()}

    before = files()
    CT.update(spark, table, spark.createDataFrame([(4, 77)], "k long, a int"), "k")
    after = files()
    assert {f for f in before - after} == {f for f in before if "/p=x/" in f}
    CT.update(spark, table, spark.createDataFrame([], "k long, a int"), "k")
    CT.update(spark, table, spark.createDataFrame([(-1, 1), (None, 2)], "k long, a int"), "k")
    assert files() == after and rows(spark, table)[4][1] == 77


def test_the_key_join_does_not_shuffle_the_target(spark, table):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changes = spark.createDataFrame([(0, "w")], "k long, p string")
        plan = CT.with_changes(spark.table(table), changes, "k").dropDuplicates(["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert plan.index("FileScan") < plan.index("Exchange")        # the one exchange is the batch's, below the second input


def test_partial_keys_and_partition_values_with_quotes(spark, tmp_path):
    spec = TableSpec("x.l", (C("k", "bigint"), C("n", "int"), C("p", "varchar"), C("v", "varchar")), ("k", "n"))
    name = f"l_{uuid.uuid4().hex[:10]}"
    CT.create(spark, name, spec, "p", 2, f"{tmp_path}/l")
    CT.insert(spark, name, spark.createDataFrame([(k, n, "it's" if k else "b", "old") for k in range(3) for n in range(3)], "k long, n int, p string, v string"))
    CT.update(spark, name, spark.createDataFrame([(1, "new", "b"), (2, "new", 'q"x')], "k long, v string, p string"), "k", ("k", "n"))
    got = sorted((r.k, r.n, r.p, r.v) for r in spark.table(name).collect())
    assert got == [(k, n, ["b", "b", 'q"x'][k], ["old", "new", "new"][k]) for k in range(3) for n in range(3)]
    spark.sql(f"DROP TABLE {name}")


def test_defaults_in_the_catalog_and_c17(spark):
    spec = TableSpec("s.t", (C("k", "bigint", False), C("a", "int", False, default="1"), C("b", "varchar", True, 3, collation="UTF8_LCASE_RTRIM")), ("k",))
    back = catalog_from_specs(spark, [spec]).spec("s.t")
    assert [(c.default, c.collation) for c in back.columns] == [(None, None), ("1", None), (None, "UTF8_LCASE_RTRIM")]
    assert R.missing_required(back, ("b",)) == []
