"""Unit table per rule V1-V15: accept / reject / NULL / boundaries."""

import pytest

from ferrule.operators import rules as R
from ferrule.operators.catalog import ColumnSpec, TableSpec

C = ColumnSpec
CASES = [
    # (spec, value, expected first rule)
    (C("c", "varchar", True, 5), "abcde", None),
    (C("c", "varchar", True, 5), "abcdef", "V1"),
    (C("c", "varchar", True, 5), None, None),
    (C("c", "nvarchar", True, -1), "x" * 500, None),
    (C("c", "int"), "12", None),
    (C("c", "int"), " 12 ", None),
    (C("c", "int"), "abc", "V2"),
    (C("c", "int"), "1_000", "V2"),
    (C("c", "int"), "0x10", "V2"),
    (C("c", "int"), "inf", "V2"),
    (C("c", "int"), "1.5", "V3b"),
    (C("c", "int"), "1e3", None),
    (C("c", "int"), "2147483647", None),
    (C("c", "int"), "2147483648", "V5"),
    (C("c", "int"), "-2147483648", None),
    (C("c", "int"), "-2147483649", "V4"),
    (C("c", "int"), None, None),
    (C("c", "tinyint"), "0", None),
    (C("c", "tinyint"), "-1", "V4"),
    (C("c", "tinyint"), "255", None),
    (C("c", "tinyint"), "256", "V5"),
    (C("c", "bit"), "1", None),
    (C("c", "bit"), "2", "V5"),
    (C("c", "smallint"), "-32769", "V4"),
    (C("c", "bigint"), "9223372036854775807", None),
    (C("c", "bigint"), "9223372036854775808", "V5"),
    (C("c", "bigint"), "1e30", "V5"),
    (C("c", "bigint"), "-1e30", "V4"),
    (C("c", "varbinary", True, 4), "1", None),
    (C("c", "varbinary", True, 4), "0", "V4"),
    (C("c", "varbinary", True, 4), "8001", "V5"),
    (C("c", "varbinary", True, 4), "00012", "V6"),
    (C("c", "datetime2"), "2024-01-02", None),
    (C("c", "datetime2"), "2024-01-02 10:11:12", None),
    (C("c", "datetime2"), "01/02/2024", None),
    (C("c", "datetime2"), "20240102", None),
    (C("c", "datetime2"), "2024-13-01", "V7"),
    (C("c", "datetime2"), "1009064", "V7"),
    (C("c", "datetime2"), "yesterday", "V7"),
    (C("c", "datetime2"), None, None),
    (C("c", "time"), "12:30", None),
    (C("c", "time"), "25:00", "V7"),
    (C("c", "decimal", True, None, 5, 2), "123.45", None),
    (C("c", "decimal", True, None, 5, 2), "abc", "V8"),
    (C("c", "decimal", True, None, 5, 2), "nan", "V8"),
    (C("c", "decimal", True, None, 5, 2), "-1" + "0" * 39, "V9"),
    (C("c", "decimal", True, None, 5, 2), "1" + "0" * 39, "V10"),
    (C("c", "decimal", True, None, 5, 2), "123456", "V11"),
    (C("c", "decimal", True, None, 5, 2), "1.234", "V15"),
    (C("c", "decimal", True, None, 5, 2), "1234.5", "V15b"),
    (C("c", "money", True, None, 19, 4), "922337203685477.5807", None),
    (C("c", "money", True, None, 19, 4), "922337203685477.5808", "V10"),
    (C("c", "money", True, None, 19, 4), "-922337203685477.5809", "V9"),
    (C("c", "smallmoney", True, None, 10, 4), "214748.3647", None),
    (C("c", "smallmoney", True, None, 10, 4), "214748.3648", "V10"),
    (C("c", "float", True, None, 53), "nan", None),
    (C("c", "float", True, None, 53), "-Infinity", None),
    (C("c", "float", True, None, 53), "1e308", None),
    (C("c", "float", True, None, 53), "abc", "V8"),
    (C("c", "int", False), None, "V12"),
    (C("c", "int", False), "1", None),
    (C("c", "geography"), "anything", None),
]


def _first_rule(spark, spec, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    rules = R.column_rules(spec, "c")
    out = R.apply_chain(df, rules).orderBy("i").select("rule_id").collect()
    return [r[0] for r in out]


def test_rule_table(spark):
    got = {}
    by_spec = {}
    for n, (spec, value, _) in enumerate(CASES):
        by_spec.setdefault(spec, []).append((n, value))
    for spec, items in by_spec.items():
        rules = _first_rule(spark, spec, [v for _, v in items])
        got.update({n: r for (n, _), r in zip(items, rules)})
    bad = [(CASES[n][0].data_type, CASES[n][1], CASES[n][2], got[n]) for n in range(len(CASES))
           if got[n] != CASES[n][2]]
    assert not bad, bad


def test_rule_sql_twin_agrees(duck):
    """The DuckDB twin of every rule gives the same first rule."""
    import duckdb

    by_spec = {}
    for n, (spec, value, expected) in enumerate(CASES):
        by_spec.setdefault(spec, []).append((value, expected))
    con = duckdb.connect()
    for spec, items in by_spec.items():
        ch = R.chain_sql(R.column_rules(spec, "c"))
        vals = ", ".join("(" + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") + ")" for v, _ in items)
        got = [r[0] for r in con.sql(f"SELECT {ch['rule_id']} FROM (VALUES {vals}) t(c)").fetchall()]
        assert got == [e for _, e in items], (spec.data_type, got)


def test_first_failure_wins_in_header_order(spark):
    spec = TableSpec("s.t", (C("a", "int", True), C("b", "varchar", True, 2), C("k", "bigint", False)), ("k",))
    env = R.Envelope("update_t", "s.t", ("b", "a", "k"))
    df = spark.createDataFrame([("xyz", "abc", "1"), ("ok", "abc", None), ("ok", "1", None), ("ok", "1", "2")],
                               "b string, a string, k string")
    got = [(r.rule_column, r.rule_id) for r in R.validate(df, spec, env).collect()]
    assert got == [("b", "V1"), ("a", "V2"), ("k", "V13"), (None, None)]


@pytest.mark.parametrize("tab,table,header,expected", [
    ("Update_a", "s.t", ("k", "a"), (None, "k")),
    ("notes", "s.t", ("k",), ("C1", None)),
    ("Update_insert_x", "s.t", ("k",), (None, "k")),
    ("update_d", "t", ("k",), ("C2", None)),
    ("Insert_f", "s.t", ("k", "a"), ("C8", None)),
    ("Update_i", "s.t", ("a",), ("C11", None)),
])
def test_envelope_gates(tab, table, header, expected):
    spec = TableSpec("s.t", (C("k", "bigint", False), C("a", "int")), ("k",))
    assert R.envelope_gate(R.Envelope(tab, table, header), spec, table == "s.t") == expected


def test_unknown_column_rejects_remaining_rows(spark):
    spec = TableSpec("s.t", (C("a", "int"),), ())
    env = R.Envelope("insert_t", "s.t", ("a", "zzz"))
    df = spark.createDataFrame([("x", "1"), ("1", "1")], "a string, zzz string")
    got = [(r.rule_column, r.rule_id) for r in R.validate(df, spec, env).collect()]
    assert got == [("a", "V2"), ("zzz", "C6")]


def test_c17_missing_not_null_column_on_insert(spark):
    spec = TableSpec("s.t", (C("k", "bigint", False), C("a", "int", False), C("b", "int")), ("k",))
    env = R.Envelope("insert_t", "s.t", ("b",))
    df = spark.createDataFrame([("1",)], "b string")
    assert R.validate(df, spec, env).first().rule_id is None          # off by default
    rules = R.build_rules(spec, env, None, None, require_not_null=True)
    assert R.apply_chain(df, rules).first().rule_id == "C17"
