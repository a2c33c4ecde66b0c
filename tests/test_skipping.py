"""Key ranges and bits of a batch: what of a target is read, and that nothing it names is lost."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ferrule.operators import skipping as SK


def scanned(df):
    """Rows that the plan's scans gave, after running it."""
    df.count()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if "FileSourceScanExec" in p.getClass().getSimpleName():
            total += p.metrics().apply("numOutputRows").value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
        if hasattr(p, "plan") and p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
    return total


@pytest.fixture(scope="module")
def target(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("skip") / "t")
    (spark.range(0, 400_000, 1, 4).select(F.col("id").alias("k"), (F.col("id") % 97).alias("v"))
     .write.option("parquet.block.size", 64 << 10).option("parquet.page.size", 4 << 10).parquet(path))
    return spark.read.parquet(path)


def test_ranges_reach_the_scan(spark, target):
    keys = spark.createDataFrame([(k,) for k in [*range(1000, 1200), *range(300_000, 300_050)]] + [(None,), (10**12,)], "k long")
    plan = SK.maybe_touched(target, keys, "k", 1)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):plan.index("ReadSchema")]
    assert "GreaterThanOrEqual(k,1000)" in pushed and "LessThanOrEqual(k,10000" in pushed
    out = SK.maybe_touched(target, keys, "k")
    read, hit = scanned(out), SK.touched(target, keys, "k").count()
    assert hit == 250 and read < 400_000 / 4
    assert sorted(r.k for r in SK.touched(target, keys, "k").collect()) == [*range(1000, 1200), *range(300_000, 300_050)]


def test_bits_drop_rows_before_the_shuffle(spark, target):
    """Keys all over the target: ranges hold everything, the bit array little more than the hits."""
    keys = target.where(F.pmod(F.xxhash64("k"), F.lit(400)) == 0).select("k")
    n = keys.count()
    assert n <= SK.maybe_touched(target, keys, "k").count() < 1.1 * n
    assert SK.key_bits(keys, "k").count() <= min(n, SK.WORDS)
    assert SK.touched(target, keys, "k").exceptAll(target.join(keys, "k", "left_semi")).count() == 0


def test_the_exact_join_stays_above_the_bits(spark, target):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = SK.touched(target, spark.range(50).select(F.col("id").alias("k")), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin") < plan.index("FileScan")


VALUES = {
    "int": list(range(-50, 50)), "decimal(12,3)": [Decimal(i) / 8 for i in range(-50, 50)], "string": ["", " ", "a", "A", "é", "zz", "10", "9", "a'b", "\\"],
    "date": [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(40)], "timestamp_ntz": [dt.datetime(2000, 1, 1, 3, 4, 5, i) for i in range(40)],
    "double": [0.0, -0.0, 1.5, float("inf"), float("nan")], "boolean": [True, False], "binary": [b"", b"a"]}


@pytest.mark.parametrize("kind", VALUES)
def test_every_type_loses_nothing(spark, kind):
    rnd = random.Random(kind)
    rows = [(i, rnd.choice([*VALUES[kind], None])) for i in range(300)]
    keys = [(rnd.choice([*VALUES[kind], None]),) for _ in range(7)]
    target = spark.createDataFrame(rows, f"i int, k {kind}")
    batch = spark.createDataFrame(keys * 3, f"k {kind}")
    want = sorted(r.i for r in target.join(batch, "k", "left_semi").collect())
    assert sorted(r.i for r in SK.touched(target, batch, "k").collect()) == want
    assert SK.touched(target, batch.limit(0), "k").count() == 0 and SK.touched(target.limit(0), batch, "k").count() == 0


def test_a_hot_key_and_few_intervals(spark):
    keys = spark.createDataFrame([(7,)] * 5000 + [(i,) for i in range(0, 9000, 9)], "k long")
    ranges = SK.key_ranges(keys, "k", 8)
    assert 1 <= len(ranges) <= 8 and all(int(lo) <= int(hi) for lo, hi in ranges)
    assert all(any(int(lo) <= k <= int(hi) for lo, hi in ranges) for k in (7, *range(0, 9000, 9)))
