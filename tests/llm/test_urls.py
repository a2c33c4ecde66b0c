import duckdb
import pytest

from ferrule.llm import urls
from ferrule.llm.queries import OP10_SQL, QUERIES, URL_RULES
from tools.oracle_check import digest

RULES = "host string, path string, verdict string"


def judged(spark, rows, rules=URL_RULES, schema="page_id long, url string"):
    out = urls.judge_urls(spark.createDataFrame(rows, schema), spark.createDataFrame(rules, RULES))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}


def test_cases(spark):
    long = "http://a.com/" + "x/" * 50_000
    dots = "http://" + "a." * 30_000 + "net/es/"
    got = judged(spark, [
        (1, None), (2, ""), (3, "no scheme.com/en/"), (4, "http://WWW.Example.com/en/x?y#z"),
        (5, "http://blog.example.com/en/1"), (6, "http://com/"), (7, "http://com"), (8, "http://xcom/en/"),
        (9, "https://a.net/es/?q=/fr/"), (10, "https://a.net/esx/"), (11, long), (12, dots),
        (13, "x://?http://example.com/en/"), (14, "http://example.com./en/"), (15, "http:///en/")])
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[5] == ("blog.example.com", "/en/1", "example.com/en/", "block")
    assert got[6][2:] == ("com/", "allow") and got[7] == ("com", "", None, "allow")
    assert got[8][2:] == (None, "allow") and got[9][2:] == ("net/es/", "block") and got[10][2] is None
    assert got[11][2:] == ("com/", "allow") and got[12][2:] == ("net/es/", "block")
    assert got[13] == ("", "", None, "allow") and got[14][2] is None and got[15] == ("", "/en/", None, "allow")


def test_repeats_ties_empty_and_clashing_columns(spark):
    out = urls.judge_urls(
        spark.createDataFrame([(1, "http://net/es/", "h", "v"), (1, "http://net/es/", "h", "v"), (None, "http://net/es/", "h", "v")],
                              "page_id long, url string, Host string, verdict string"),
        spark.createDataFrame(URL_RULES, RULES))
    assert sorted(c.lower() for c in out.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    assert [(r.host, r.verdict) for r in out.collect()] == [("net", "block")] * 3
    both = [("com", "/", "allow"), ("com", "/", "block"), ("b.com", "/", "allow"), ("com", "/xy", "block")]
    assert judged(spark, [(1, "http://com/"), (2, "http://b.com/xy")], both) == {
        1: ("com", "/", "com/", "block"), 2: ("b.com", "/xy", "b.com/", "allow")}
    assert judged(spark, []) == {}
    assert judged(spark, [(1, "http://com/")], []) == {1: ("com", "/", None, "allow")}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{sf}/pages.parquet'")
    df, res = QUERIES["op10_urls"](spark, f"/root/testdata/{sf}"), con.sql(OP10_SQL)
    rows, want = [tuple(r) for r in df.collect()], res.fetchall()
    assert rows and digest(df.columns, rows)[0] == digest(res.columns, want)[0]
