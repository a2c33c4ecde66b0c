import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm import sharding
from ferrule.llm.queries import QUERIES

from ..conftest import SF_MID, SF_SMALL


def shard_rows(spark, rows, schema="doc_id long, text string", **how):
    return sharding.shard_by_bytes(spark.createDataFrame(rows, schema), **how).collect()


def check(rows, want, shards=8, slack=None):
    """Every row once, equal texts together, gapless slots; returns bytes by shard."""
    key = lambda d, t: (d is None, d, t or "")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in want)
    slots, of = defaultdict(list), {}
    load = [0] * shards
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert of.setdefault(bytes(r.digest), r.shard) == r.shard
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return load


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query(spark, sf):
    want = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sharding.shard_by_bytes(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    load = check(got, want)
    group = defaultdict(int)
    for r in got:
        group[bytes(r.digest)] += r.size
    assert max(load) - min(load) <= max(max(group.values()) // 4, 64)
    out = QUERIES["op5_sharding"](spark, sf)
    assert {r.law for r in out.collect()} == {"bytes"} and out.count() == len(want)
    assert sorted((r.doc_id, r.shard, r.slot) for r in out.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in got)


def test_levels_agree_on_balance(spark):
    rows = [(i, "w" * (1 + (i * 7919) % 997) + str(i)) for i in range(700)] + [(i, "copy") for i in range(700, 1000)]
    for cell, fan in ((1000, 1000), (50, 1000), (10, 4)):
        load = check(shard_rows(spark, rows, cell_rows=cell, fan=fan), rows)
        assert max(load) - min(load) <= 0.02 * sum(load) / 8


def test_cases(spark):
    rows = [(1, None), (2, ""), (None, "x"), (None, "x"), (3, "é" * 200_000), (4, "x"), (4, "x"), (5, "\n")]
    got = shard_rows(spark, [(d, t, 7, "b") for d, t in rows], "doc_id long, text string, Shard int, bin string")
    check(got, rows)
    assert shard_rows(spark, []) == []
    assert [(r.shard, r.slot) for r in shard_rows(spark, [(1, "a"), (2, "b")], n_shards=1)] in ([(0, 0), (0, 1)], [(0, 1), (0, 0)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=60), st.integers(1, 9))
def test_differencing_keeps_all_and_balances(sizes, k):
    items = np.zeros((len(sizes), k), dtype=np.int64)
    items[:, 0] = sizes
    bins = sharding.difference(items)
    load = np.bincount(bins[:, 0], weights=sizes, minlength=k)
    assert all(sorted(row) == list(range(k)) for row in bins.tolist())
    assert load.sum() == sum(sizes) and load.max() - load.min() <= max(sizes)
