"""Property tests."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule.operators import apply as A
from ferrule.operators import rules as R
from ferrule.operators.catalog import ColumnSpec, TableSpec

SPEC = TableSpec("s.t", (ColumnSpec("k", "bigint", False, None, 19, 0), ColumnSpec("a", "int"),
                         ColumnSpec("b", "varchar", True, 4), ColumnSpec("d", "decimal", True, None, 6, 2)), ("k",))
ENV = R.Envelope("update_t", "s.t", ("k", "a", "b", "d"))
cell = st.one_of(st.none(), st.sampled_from(["1", "-7", "12.5", "1e3", "abc", "", "99999999999", "0.001", "12345",
                                             "xyzzy", "2147483648"]), st.text(max_size=6))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(cell, cell, cell, cell), min_size=1, max_size=30))
def test_partition_of_rows(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_no long, k string, a string, b string, d string")
    v = R.validate(df, SPEC, ENV).cache()
    acc = v.where(F.col("rule_id").isNull())
    rej = v.where(F.col("rule_id").isNotNull())
    # accepted + rejected = input, every rejected row has exactly one rule
    assert acc.count() + rej.count() == len(rows)
    assert rej.where(F.col("rule_message").isNull()).count() == 0
    # re-validating the accepted rows rejects none
    again = R.validate(acc.select(*df.columns), SPEC, ENV)
    assert again.where(F.col("rule_id").isNotNull()).count() == 0
    v.unpersist()


def test_apply_then_restore_from_before_image(spark):
    target = spark.createDataFrame([(i, i * 10, f"s{i}") for i in range(50)], "k long, a int, b string")
    batch = spark.createDataFrame([(i, -i, None) for i in range(0, 50, 3)], "k long, a int, b string")
    image = A.before_image(batch, target, "k", ["a", "b"])
    changed = A.apply_update(target, batch, "k")
    assert changed.exceptAll(target).count() == batch.count()
    restored = A.apply_update(changed, image, "k")
    assert restored.exceptAll(target).count() == 0 and target.exceptAll(restored).count() == 0


def test_resolve_duplicates_highest_row_wins(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 9), (2, None, 4), (2, "c", 1)], "k long, s string, row_no long")
    got = {r.k: (r.s, r.row_no) for r in A.resolve_duplicates(df, "k").collect()}
    assert got == {1: ("b", 9), 2: (None, 4)}


def test_sequence_keys_contiguous(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("row_no"), F.lit(1).alias("file_seq"),
                                     F.lit(1).alias("tab_seq")).repartition(13)
    out = A.sequence_keys(df, "key", 100, ["file_seq", "tab_seq", "row_no"])
    got = sorted((r.row_no, r.key) for r in out.collect())
    assert [k for _, k in got] == list(range(101, 5101))
