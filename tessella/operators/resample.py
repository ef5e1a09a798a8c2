"""Inference by resampling, distributed over the rows of a group.

Every replicate's sum is built up from partial sums of the partitions (a few thousand doubles each), so a group of any
size is never one task. The draws of a row are a function of the seed and the row's key only, so results don't depend
on partitions. The bootstrap is the Poisson bootstrap over clusters: each cluster counts a Poisson(1) number of times.

Defined results: null values are left out; groups of one cluster or none have the interval (0, 0) and groups of one value
or none a null p-value; empty tables give no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
DRAWS = 1000
PERMUTATIONS = 10_000
#: Rows whose draws are made at once.
_STEP = 256
#: Rows of a part, about, in two-sample permutations.
_PART = 4096


def _generator(key: int, seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=(int(key) & 0xFFFFFFFFFFFFFFFF) << 64 | (seed & 0xFFFFFFFF)))


def _replicates(rows: DataFrame, group: list[str], n: int, seed: int, kind: str) -> DataFrame:
    """group..., part sums: arrays of n of sum(w * value) and sum(w * count) of a partition's rows (h, value, size)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for d in batches:
            d = d.astype({g: object for g in group})
            for key, part in d.groupby(group, dropna=False, sort=False) if group else [((), d)]:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                total = sums.setdefault(key, np.zeros((2, n)))
                h, x, c = part["h"].to_numpy(), part["value"].to_numpy(dtype=float), part["size"].to_numpy(dtype=float)
                for lo in range(0, len(h), _STEP):
                    if kind == "bootstrap":
                        w = np.stack([_generator(k, seed).poisson(1.0, n) for k in h[lo : lo + _STEP]]).astype(float)
                    else:
                        w = np.stack([np.unpackbits(np.frombuffer(_generator(k, seed).bytes(-(-n // 8)), dtype=np.uint8))[:n] for k in h[lo : lo + _STEP]]) * 2.0 - 1.0
                    total[0] += x[lo : lo + _STEP] @ w
                    total[1] += c[lo : lo + _STEP] @ w
        if sums:
            yield pd.DataFrame([(*k, list(v[0]), list(v[1])) for k, v in sums.items()], columns=[*group, "s", "c"])

    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group)
    parts = rows.select(*group, "h", "value", "size").mapInPandas(run, f"{kinds}{', ' if kinds else ''}s array<double>, c array<double>")
    each = parts.select(*group, F.posexplode(F.arrays_zip("s", "c")).alias("i", "x"))
    return each.groupBy(*group, "i").agg(F.sum("x.s").alias("s"), F.sum("x.c").alias("c"))


def bootstrap_mean(rows: DataFrame, group: list[str], cluster: list[str], value: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """group..., n, mean, ci_lower, ci_upper: 95 % percentile interval of the mean, resampling clusters."""
    have = rows.where(F.col(value).isNotNull())
    each = have.groupBy(*group, *[c for c in cluster if c not in group]).agg(F.sum(value).cast("double").alias("value"), F.count("*").alias("size"))
    each = each.withColumn("h", F.xxhash64(*cluster))
    base = each.groupBy(*group).agg(F.sum("size").alias("n"), (F.sum("value") / F.sum("size")).alias("mean"), F.count("*").alias("_clusters"))
    drawn = _replicates(each, group, draws, seed, "bootstrap").where("c > 0").withColumn("m", F.col("s") / F.col("c"))
    ci = drawn.groupBy(*group).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    joined = _join(base, ci, group)
    one = F.col("_clusters") <= 1
    return joined.select(*group, "n", "mean", F.when(one, 0.0).otherwise(F.col("lo")).alias("ci_lower"), F.when(one, 0.0).otherwise(F.col("hi")).alias("ci_upper"))


def _join(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    if not group:
        return a.join(F.broadcast(b))  # one row each
    renamed = b.withColumnsRenamed({g: f"_r_{g}" for g in group})
    on = None
    for g in group:
        c = F.col(g).eqNullSafe(F.col(f"_r_{g}"))
        on = c if on is None else on & c
    return a.join(renamed, on, "left").drop(*[f"_r_{g}" for g in group])


def sign_flip_test(rows: DataFrame, group: list[str], key: list[str], value: str, alternative: str = "greater", permutations: int = PERMUTATIONS, seed: int = SEED, least: int = 2) -> DataFrame:
    """group..., n, mean, p: sign-flip permutation test of mean 0 of paired differences; p = (count + 1) / (permutations + 1),
    null under least values."""
    have = rows.where(F.col(value).isNotNull()).select(*group, F.xxhash64(*key).alias("h"), F.col(value).cast("double").alias("value"), F.lit(1).alias("size"))
    base = have.groupBy(*group).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.sum("value").alias("_sum"))
    flips = _replicates(have, group, permutations, seed, "sign")
    both = _join(flips, base.select(*group, "_sum"), group)
    tol = F.abs("_sum") * 1e-12 + 1e-12
    hit = {"greater": F.col("s") >= F.col("_sum") - tol, "less": F.col("s") <= F.col("_sum") + tol, "two-sided": F.abs("s") >= F.abs("_sum") - tol}[alternative]
    p = both.groupBy(*group).agg(((F.count(F.when(hit, 1)) + 1) / F.lit(permutations + 1)).alias("p"))
    return _join(base, p, group).select(*group, "n", "mean", F.when(F.col("n") >= least, F.col("p")).alias("p"))


def _dealt(rows: DataFrame, taken: DataFrame, n: int, seed: int) -> DataFrame:
    """i, s: per replicate the sum of value over a random set of exactly k rows (h, value); taken: one row with k and n.

    Rows lie in 2^bits parts by the first bits of h. How many of the k fall in a part follows from the root down, where each
    node splits its number over its two halves by a hypergeometric draw that all parts below it repeat; within a part rows are
    taken one after another with probability still wanted / still left. So any set of k rows is as likely as any other, and
    no task sees more than a part."""
    bits = F.ceil(F.log2(F.greatest(F.col("n") / _PART, F.lit(1.0)))).cast("int")
    each = rows.join(F.broadcast(taken.select("n", bits.alias("bits"))))  # one row
    # shifted in two steps, as a shift by 64 is one by 0
    each = each.select("h", "value", "bits", F.expr("shiftrightunsigned(shiftrightunsigned(h, 1), 63 - bits)").alias("part"))
    sizes = each.groupBy("bits", "part").agg(F.count("*").alias("size"))
    up = sizes.select("part", "size", F.explode(F.expr("sequence(0, bits)")).alias("level"), F.expr("shiftright(part, bits - level)").alias("node"))
    nodes = up.groupBy("level", "node").agg(F.sum("size").alias("size"))
    half = nodes.select("level", F.col("node").bitwiseXOR(F.lit(1)).alias("node"), F.col("size").alias("other"))
    steps = up.drop("size").where("level > 0").join(nodes, ["level", "node"]).join(half, ["level", "node"], "left")
    paths = steps.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("level", "node", "size", F.coalesce("other", F.lit(0)).alias("other")))).alias("path"))
    paths = sizes.select("part").join(paths, "part", "left").join(F.broadcast(taken.select("k")))  # one row
    paths = paths.select(F.col("part").alias("at"), "path", "k")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        k = np.full(n, int(right["k"].iloc[0]), dtype=np.int64)
        for step in right["path"].iloc[0] if right["path"].iloc[0] is not None else []:
            level, node, size, other = (int(step[c]) for c in ("level", "node", "size", "other"))
            first, second = (other, size) if node & 1 else (size, other)
            split = np.random.default_rng([seed, 0, level, node >> 1]).hypergeometric(first, second, k)
            k = k - split if node & 1 else split
        rng = np.random.default_rng([seed, 1, int(key[0])])
        total = np.zeros(n)
        x = left.sort_values(["h", "value"])["value"].to_numpy(dtype=float)
        for i, v in enumerate(x):
            hit = rng.random(n) * (len(x) - i) < k
            total += v * hit
            k -= hit
        return pd.DataFrame({"s": [list(total)]})

    sums = each.select("part", "h", "value").groupBy("part").cogroup(paths.groupBy("at")).applyInPandas(run, "s array<double>")
    return sums.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"))


def two_sample_test(rows: DataFrame, side: str, key: list[str], value: str, permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """n_a, n_b, difference, p: permutation test of equal means of the rows with side true and false, two-sided; every
    replicate deals exactly n_a rows to one side."""
    have = rows.where(F.col(value).isNotNull() & F.col(side).isNotNull()).select(F.xxhash64(*key).alias("h"), F.col(value).cast("double").alias("value"), F.col(side).alias("side"))
    base = have.agg(F.count(F.when(F.col("side"), 1)).alias("n_a"), F.count(F.when(~F.col("side"), 1)).alias("n_b"), (F.avg(F.when(F.col("side"), F.col("value"))) - F.avg(F.when(~F.col("side"), F.col("value")))).alias("difference"), F.sum("value").alias("_s"))
    dealt = _dealt(have, base.select(F.col("n_a").alias("k"), (F.col("n_a") + F.col("n_b")).alias("n")), permutations, seed)
    drawn = dealt.join(F.broadcast(base))  # one row
    diff = F.try_divide("s", "n_a") - F.try_divide(F.col("_s") - F.col("s"), "n_b")
    p = drawn.agg(((F.count(F.when(F.abs(diff) >= F.abs("difference") - 1e-12, 1)) + 1) / F.lit(permutations + 1)).alias("p"))
    return base.join(F.broadcast(p)).select("n_a", "n_b", "difference", F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.col("p")).alias("p"))


def holm(tests: DataFrame, p: str = "p", family: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """tests with p_holm: step-down Bonferroni within a family, monotone; null p-values stay null and do not count."""
    fam = [F.col(c) for c in family or []] + [F.col(p).isNull()]
    up = Window.partitionBy(*fam).orderBy(F.col(p), *[F.col(c) for c in order or []])
    raw = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(Window.partitionBy(*fam)) - F.row_number().over(up) + 1))
    out = tests.withColumn("_raw", raw)
    return out.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.max("_raw").over(up.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def significant(p_holm: Column, alpha: float = 0.05) -> Column:
    return F.coalesce(p_holm <= alpha, F.lit(False))


def average_ranks(rows: DataFrame, group: list[str], value: str, out: str, buckets: int = 64) -> DataFrame:
    """rows with the average rank (ties share it) of value in its group. Values are cut into buckets by approximate
    quantiles; ranks are taken within buckets and shifted by the sizes of those below, so no group is one task."""
    cuts = rows.groupBy(*group).agg(F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)])).alias("_cuts"))
    cut = _join(rows, cuts, group).withColumn("_b", F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(value)))))
    sizes = cut.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    below = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.where("_b >= 0").withColumn("_base", F.coalesce(F.sum("_n").over(below), F.lit(0))).drop("_n")
    w = Window.partitionBy(*group, "_b").orderBy(value)
    ties = Window.partitionBy(*group, "_b", value)
    ranked = _join(cut, sizes, [*group, "_b"]).withColumn(out, F.when(F.col("_b") >= 0, F.col("_base") + F.rank().over(w) + (F.count("*").over(ties) - 1) / 2))
    return ranked.drop("_b", "_cuts", "_base")


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for k in range(1, 300):
        for num in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1.0 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h / a


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a rank correlation by the t distribution with n - 2 degrees of freedom."""

    @F.pandas_udf("double")
    def run(r: pd.Series, k: pd.Series) -> pd.Series:
        def one(x: float, m: float) -> float:
            if x != x or m < 3:
                return 1.0
            if abs(x) >= 1:
                return 0.0
            df = m - 2
            t2 = x * x * df / (1 - x * x)
            return _beta_tail(df / (df + t2), df / 2, 0.5)

        return pd.Series([one(x, m) for x, m in zip(r, k, strict=True)], dtype="float64")

    return run(rho, n.cast("double"))


def spearman(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """group..., n, rho, p: rank correlation; (0, 1) under three rows or where a side is constant."""
    have = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ranked = average_ranks(average_ranks(have, group, "_x", "_rx"), group, "_y", "_ry")
    out = ranked.groupBy(*group).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("r"), F.min("_x").alias("a"), F.max("_x").alias("b"), F.min("_y").alias("c"), F.max("_y").alias("d"))
    bad = (F.col("n") < 3) | (F.col("a") == F.col("b")) | (F.col("c") == F.col("d"))
    out = out.withColumn("rho", F.when(bad, 0.0).otherwise(F.col("r")))
    return out.select(*group, "n", "rho", F.when(bad, 1.0).otherwise(correlation_p(F.col("rho"), F.col("n"))).alias("p"))


def lift_tiers(rows: DataFrame, value: str = "ecs_lift") -> DataFrame:
    """rows with tier: up to the value at position n // 3 low, up to that at 2n // 3 mid, else high; null stays null and
    under three values there is no tier. Cut points are found from counts per value, not by sorting rows in one task."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    below = average_ranks(rows.where(F.col(value).isNotNull()).select(F.col(value).alias("_v")), [], "_v", "_r").groupBy("_v").agg(F.min("_r").alias("_r"))
    # a value of c ties with average rank r holds the positions r - (c + 1) / 2 to r + (c - 1) / 2 - 1, from 0
    at = below.join(counts, "_v").select("_v", (F.col("_r") - (F.col("_c") + 1) / 2).alias("lo"), (F.col("_r") + (F.col("_c") - 1) / 2 - 1 + 0.5).alias("hi"))
    n = counts.agg(F.sum("_c").alias("n"))
    held = at.join(F.broadcast(n))  # one row
    spot = lambda k: F.max(F.when((F.col("lo") <= F.expr(f"({k} * n) div 3")) & (F.expr(f"({k} * n) div 3") <= F.col("hi")), F.col("_v")))
    cuts = held.agg(F.max("n").alias("n"), spot(1).alias("c1"), spot(2).alias("c2"))
    v = F.col(value)
    tier = F.when(v.isNull() | (F.col("n") < 3), None).when(v <= F.col("c1"), "low").when(v <= F.col("c2"), "mid").otherwise("high")
    return rows.join(F.broadcast(cuts)).withColumn("tier", tier).drop("n", "c1", "c2")  # one row
