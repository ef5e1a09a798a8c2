"""Pairs within groups: every pair once, whatever the blocks."""

import itertools
import random

import pytest

from tessella.llm.blocks import pairs_within


@pytest.mark.parametrize("block", [3, 2000])
def test_every_pair_once(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice("aaaaabc"), i) for i in range(60)] + [(None, 99), (None, 100), ("d", 1)]
    got = [tuple(sorted((r.x_a, r.x_b))) + (r.k,) for r in pairs_within(spark.createDataFrame(rows, "k string, x long"), ["k"], ["x"], block).collect()]
    want = {(x, y, k) for (k, x), (m, y) in itertools.combinations(sorted(rows, key=lambda r: r[1]), 2) if k is not None and k == m}
    assert len(got) == len(set(got)) and set(got) == want


def test_rows_alike_are_no_pair(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "k string, x long")
    assert {(r.x_a, r.x_b) for r in pairs_within(df, ["k"], ["x"]).collect()} == {(1, 2)}
    assert pairs_within(df.limit(0), ["k"], ["x"]).count() == 0
