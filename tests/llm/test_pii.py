import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ferrule.llm import pii
from ferrule.llm.queries import OP13_SQL, QUERIES
from tools.oracle_check import digest


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    """The contract's base spans, by Python's own engine."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.digest_pii(pii.find_pii(df)).collect()}


def check_base(rows, texts):
    for i, t in enumerate(texts):
        want = base(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [rows[i][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(w[0] == k for w in want) for k in pii.BASE_KINDS]
        assert set(filter(None, joined.split(","))) <= set(rows[i].spans.split(","))


def test_base_spans_match_python(spark):
    rnd = random.Random(3)
    parts = ["a@b.c", "@", "..", "_x@d.e-", "1.2.3.4", "256.1.1.1", "0255.1.1.1", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-",
             "7", "+1 (555) 123-4567", "+", "(", ")", "é", "😀", "\n", "x", "+49", "0", "%", "GB82 WEST 1234 5698 7654 32", "card", "tel"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    check_base(found(spark, texts), texts)


def test_cases(spark):
    texts = [None, "", "a@b.c@d.e a@b.c_x@d.e", "€😀 a@b.co 1.2.3.4", "+1 234567 +1 (555) 123-4567...", "1.2.3.4.5.6.7.8"]
    rows = found(spark, texts)
    check_base(rows, texts)
    assert rows[0].spans == rows[1].spans == "" and rows[3].spans == "email:3:9,ip:10:17"
    rows = found(spark, [
        "call 555-123-4567 now", "the 555-123-4567 now", "+1 555-123-4567 call", "order 555-123-4567 call", "tel 12 555-123-4567",
        "card 378282246310005", "it is 378282246310005", "7536784127813050 4845168114407329 x", "IBAN DE89 3704 0044 0532 0130 00.",
        "DE89 3704 0044 0532 0130 01", "xGB82WEST12345698765432", "GB82WEST12345698765432"])
    assert [rows[i].spans for i in range(12)] == [
        "phone:5:17", "", "phone:0:15", "", "", "card:5:20", "", "card:0:16,card:17:33", "iban:5:32", "", "", "iban:0:22"]
    assert [rows[i].n_phone for i in range(3)] == [0, 0, 1] and rows[7].n_card == 0


def test_scores_follow_nearby_words(spark):
    df = spark.createDataFrame([("host 1.2.3.4", "x", 1), ("version 1.2.3.4", "x", 1), ("1.2.3.4", "x", 1), ("1.2.3.4", "x", 1)],
                               "text string, SPANS string, kind int")
    out = pii.find_pii(df)
    assert sorted(out.columns) == ["kind", "spans", "text"]
    got = sorted((r.spans[0].score, r.spans[0].base, r.spans[0].value) for r in out.collect())
    assert got == [(0.3, True, "1.2.3.4"), (0.6, True, "1.2.3.4"), (0.6, True, "1.2.3.4"), (0.8, True, "1.2.3.4")]
    assert pii.find_pii(df.limit(0)).collect() == []


def test_long_texts(spark):
    texts = ["x" * 2_000_000, "1" * 1_000_000, "a@" + "b." * 300_000 + "c", "1 " * 500_000, "+1" + "(" * 1_000_000, "me@x.yz " * 40_000]
    rows = found(spark, texts)
    assert [rows[i].spans for i in (0, 1, 3, 4)] == [""] * 4 and rows[2].spans == "email:0:600003"
    assert rows[5].n_email == 40_000 and rows[5].spans.endswith(f"email:{8 * 39_999}:{8 * 40_000 - 1}")


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op13_pii"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    df, res = QUERIES["op13_pii"](spark, f"/root/testdata/{sf}"), con.sql(OP13_SQL)
    rows, want = [tuple(r) for r in df.collect()], res.fetchall()
    assert rows and digest(df.columns, rows)[0] == digest(res.columns, want)[0]


def test_sql_follows_the_added_spans_too(spark, tmp_path):
    texts = ["call 555-123-4567 now", "x 555-123-4567 isbn tel", "+1 555-123-4567 call", "card 378282246310005", "7536784127813050 4845168114407329 x",
             "GB82 WEST 1234 5698 7654 32", "a DE89 3704 0044 0532 0130 00 b 0.0.0.256", "tel (555) 123 4567 12", None, "0000255.1.1.99999999999999999999"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, res = QUERIES["op13_pii"](spark, str(tmp_path)), con.sql(OP13_SQL)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(res.columns, res.fetchall())[0]
    assert df.where(F.col("spans").contains("iban")).count() == 2
