"""Measures against plain set arithmetic."""

from math import comb, sqrt
import random

import pytest

from pyspark.sql import functions as F

from tessella.functions import measures as m


def expected(a, b, v):
    a, b = min(a, v), min(b, v)
    if min(a, b, v) <= 0:
        return 0.0
    return sum(comb(a, k) * comb(v - a, b - k) / comb(v, b) * k / (a + b - k) for k in range(max(0, a + b - v), min(a, b) + 1))


def test_expected_jaccard_all_geometries(spark):
    rows = [(a, b, v) for v in range(0, 14) for a in range(0, 15) for b in range(0, 15)] + [(30, 40, 60), (100, 3, 400), (250, 250, 260)]
    df = spark.createDataFrame(rows, "a int, b int, v int").withColumns({"e": m.expected_jaccard(F.col("a"), F.col("b"), F.col("v")), "o": m.expected_overlap(F.col("a"), F.col("b"), F.col("v"))})
    for r in df.collect():
        assert r.e == pytest.approx(expected(r.a, r.b, r.v), abs=1e-9)
        if min(r.a, r.b, r.v) > 0:
            a, b = min(r.a, r.v), min(r.b, r.v)
            assert r.o == pytest.approx(a * b / (r.v * min(a, b)))


def tau_b(x, y):
    n = len(x)
    s = sum(((x[i] > x[j]) - (x[i] < x[j])) * ((y[i] > y[j]) - (y[i] < y[j])) for i in range(n) for j in range(i))
    tx, ty = sum(x[i] != x[j] for i in range(n) for j in range(i)), sum(y[i] != y[j] for i in range(n) for j in range(i))
    return s / sqrt(tx * ty) if tx and ty else None


def test_sets_and_rankings(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        rows.append(([f"t{x}" for x in rng.sample(range(12), rng.randint(0, 9))], [f"t{x}" for x in rng.sample(range(12), rng.randint(0, 9))]))
    rows += [(None, ["t1"]), ([], []), (["t1", "t2", "t1", "t3", "t4"], ["t4", "t3", "t2", "t1"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    out = df.select("a", "b", m.jaccard(a, b).alias("j"), m.overlap_coef(a, b).alias("o"), m.rank_biased_overlap(a, b).alias("rbo"), m.kendall_tau(a, b).alias("tau"), m.adjusted_jaccard(a, b, F.lit(15)).alias("aj"), m.consensus_core([a, b], 2).alias("core"), m.symmetric_difference(a, b).alias("sd"))
    for r in out.collect():
        x, y = r.a or [], r.b or []
        if not x or not y:
            assert (r.j, r.o, r.rbo, r.aj) == (None,) * 4
            continue
        common = set(x) & set(y)
        assert r.j == pytest.approx(len(common) / len(set(x) | set(y))) and r.o == pytest.approx(len(common) / min(len(x), len(y)))
        assert r.rbo == pytest.approx(0.1 * sum(0.9 ** (d - 1) * len(set(x[:d]) & set(y[:d])) / d for d in range(1, max(len(x), len(y)) + 1)))
        rx, ry = {t: i for i, t in enumerate(x)}, {t: i for i, t in enumerate(y)}
        keys = sorted(common)
        want = tau_b([rx[k] for k in keys], [ry[k] for k in keys]) if len(keys) >= 4 else None
        assert (r.tau is None) == (want is None) and (want is None or r.tau == pytest.approx(want))
        assert r.core == sorted(common) and r.sd == sorted(set(x) ^ set(y))
        if len(set(x)) == len(x):
            top, e = min(len(x), len(y)) / max(len(x), len(y)), expected(len(x), len(y), 15)
            assert (r.aj is None) == (top - e < 0.1) and (r.aj is None or r.aj == pytest.approx((r.j - e) / (top - e)))


def test_adjusted_values_are_one_for_nested_and_about_zero_by_chance(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [("nested", words[:5], words[:15])] + [("chance", rng.sample(words, 8), rng.sample(words, 12)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "kind string, a array<string>, b array<string>").withColumn("aj", m.adjusted_jaccard(F.col("a"), F.col("b"), F.lit(60)))
    got = {r.kind: r.m for r in df.groupBy("kind").agg(F.avg("aj").alias("m")).collect()}
    assert got["nested"] == pytest.approx(1) and abs(got["chance"]) < 0.02


def test_scores_with_missing_strategies(spark):
    from tessella.operators import evidence

    rows = [(1, ["a", "b"], ["a"], ["b", "c"], ["a", "c"], 9), (2, ["a"], [], ["a"], [], 5), (3, [], [], [], [], 0), (4, ["a", "b"], ["a", "b"], [], ["a", "b"], 2)]
    df = spark.createDataFrame(rows, "user_id int, H array<string>, R array<string>, CF array<string>, RO array<string>, vocabulary int").withColumn("h_rank", F.col("H")).withColumn("ro_rank", F.col("RO"))
    got = {r.user_id: r for r in evidence.measured(df).collect()}
    assert got[1].n_valid == 4 and got[1].ecs is not None and got[1].n_components == 3 and got[1].ecs_adj_complete
    assert got[2].ecs is None and got[2].ecs_primary_pairs == 1 and got[2].n_components == 1
    assert got[3].ecs is None and got[3].ecs_adj is None and got[3].n_degenerate == 0 and got[3].cc3 == []
    assert got[4].ecs_adj is None and got[4].n_degenerate == 2 and got[4].cc3 == ["a", "b"]
