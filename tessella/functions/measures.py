"""Agreement measures on array columns. Sets are arrays of distinct tokens, rankings arrays of tokens in rank order.

A pair with an empty or null side is null, unless stated."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STRATEGIES = ("H", "R", "CF", "RO")
PAIRS = (("H", "R"), ("H", "CF"), ("H", "RO"), ("R", "CF"), ("R", "RO"), ("CF", "RO"))
EPSILON = 0.10


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _sided(a: Column, b: Column, value: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), value)


def jaccard(a: Column, b: Column) -> Column:
    return _sided(a, b, _common(a, b) / F.size(F.array_union(a, b)))


def overlap_coef(a: Column, b: Column) -> Column:
    return _sided(a, b, _common(a, b) / F.least(F.size(a), F.size(b)))


def mean_defined(values: list[Column]) -> Column:
    """Mean of the values that are not null; null if none is."""
    kept = F.array_compact(F.array(*values))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept))


def _log_choose(n: Column, r: Column) -> Column:
    return F.when(r <= 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(r, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log((n - r + i) / i)))


def expected_jaccard(a: Column, b: Column, vocabulary: Column) -> Column:
    """Mean Jaccard of random sets of sizes a and b out of a vocabulary: sum of hypergeometric weights by a recurrence.

    0 where a size or the vocabulary is not positive; sizes are clamped to the vocabulary."""
    v = vocabulary.cast("int")
    a, b = F.least(a.cast("int"), v), F.least(b.cast("int"), v)
    low, high = F.greatest(F.lit(0), a + b - v), F.least(a, b)
    start = F.exp(_log_choose(a, low) + _log_choose(v - a, b - low) - _log_choose(v, b))
    none = F.struct(start.alias("p"), F.lit(0.0).alias("s"))

    def step(acc: Column, k: Column) -> Column:
        s = acc["s"] + acc["p"] * k / F.greatest(a + b - k, F.lit(1))
        up = (a - k).cast("double") * (b - k) / ((k + 1) * F.greatest(v - a - b + k + 1, F.lit(1)))
        return F.struct((acc["p"] * up).alias("p"), s.alias("s"))

    total = F.aggregate(F.sequence(low, F.greatest(high, low)), none, step, lambda acc: acc["s"])
    return F.when((a > 0) & (b > 0) & (v > 0), total).otherwise(F.lit(0.0))


def expected_overlap(a: Column, b: Column, vocabulary: Column) -> Column:
    """Mean overlap coefficient of random sets: ab / (V min(a, b))."""
    a, b = F.least(a, vocabulary), F.least(b, vocabulary)
    return F.when((a > 0) & (b > 0), a * b / (vocabulary * F.least(a, b))).otherwise(F.lit(0.0))


def adjusted_jaccard(a: Column, b: Column, vocabulary: Column, eps: float = EPSILON) -> Column:
    """(J - E[J]) / (J max - E[J]); null where a side is empty, V is not positive or the divisor is under eps."""
    most = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    chance = expected_jaccard(F.size(a), F.size(b), vocabulary)
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (vocabulary > 0) & (most - chance >= eps), (jaccard(a, b) - chance) / (most - chance))


def adjusted(j: Column, size_a: Column, size_b: Column, chance: Column, eps: float = EPSILON) -> Column:
    """As adjusted_jaccard, from the Jaccard value and its chance value."""
    most = F.least(size_a, size_b) / F.greatest(size_a, size_b)
    return F.when(j.isNotNull() & (most - chance >= eps), (j - chance) / (most - chance))


def is_degenerate(a: Column, b: Column, vocabulary: Column, eps: float = EPSILON) -> Column:
    """Whether both sides hold something and yet the adjusted value is undefined."""
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0), F.lit(False)) & adjusted_jaccard(a, b, vocabulary, eps).isNull()


def _pairs_of(sets: dict[str, Column], f: Callable[[Column, Column], Column]) -> dict[str, Column]:
    return {f"{x}_{y}": f(sets[x], sets[y]) for x, y in PAIRS}


def pairwise_jaccard(sets: dict[str, Column]) -> dict[str, Column]:
    return _pairs_of(sets, jaccard)


def pairwise_overlap(sets: dict[str, Column]) -> dict[str, Column]:
    return _pairs_of(sets, overlap_coef)


def n_valid(sets: dict[str, Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.coalesce((F.size(c) > 0).cast("int"), F.lit(0)) for c in sets.values()])


def flat_score(pairs: dict[str, Column], valid: Column | None = None) -> Column:
    """Mean of the defined pairs without H_RO; null under three valid strategies where valid is given."""
    score = mean_defined([c for k, c in pairs.items() if k != "H_RO"])
    return score if valid is None else F.when(valid >= 3, score)


def composites(pairs: dict[str, Column]) -> dict[str, Column]:
    """er and ep of a pair map, and how many of their four pairs are defined."""
    four = [pairs["H_R"], pairs["R_RO"], pairs["H_CF"], pairs["CF_RO"]]
    return {"er": mean_defined(four[:2]), "ep": mean_defined(four[2:]), "n_pairs": F.size(F.array_compact(F.array(*four)))}


def adjusted_score(aj: dict[str, Column], filled: dict[str, Column]) -> dict[str, Column]:
    """er, ep, rp, ecs_adj, complete, n_components and n_degenerate from adjusted pairs; filled: whether both sides of a
    pair hold something."""
    er, ep, rp = mean_defined([aj["H_R"], aj["R_RO"]]), mean_defined([aj["H_CF"], aj["CF_RO"]]), aj["R_CF"]
    parts = F.size(F.array_compact(F.array(er, ep, rp)))
    bad = [(filled[k] & aj[k].isNull()).cast("int") for k in ("H_R", "R_RO", "H_CF", "CF_RO", "R_CF")]
    return {"er_adj": er, "ep_adj": ep, "rp_adj": rp, "ecs_adj": mean_defined([er, ep, rp]), "ecs_adj_complete": parts == 3, "n_components": parts, "n_degenerate": reduce(lambda x, y: x + y, bad)}


def random_score(chance: dict[str, Column]) -> Column:
    """Mean of the exact chance values (null where a side is empty) over the five pairs without H_RO."""
    return mean_defined([c for k, c in chance.items() if k != "H_RO"])


def rank_biased_overlap(a: Column, b: Column, p: float = 0.9) -> Column:
    """Truncated, not extrapolated: (1 - p) sum over depth d of p^(d-1) |A_d and B_d| / d; lists of length n that agree give 1 - p^n."""
    depth = F.greatest(F.size(a), F.size(b))
    at = lambda d: _common(F.slice(a, 1, d), F.slice(b, 1, d)) / d * F.pow(F.lit(p), d - 1)
    return _sided(a, b, F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.lit(0.0), lambda s, d: s + at(d)) * (1 - p))


def kendall_tau(a: Column, b: Column, least: int = 4) -> Column:
    """Tau-b of the ranks of common tokens (the last rank of a token counts); null under least tokens or where all tie."""
    last = lambda xs, t: F.array_size(xs) - F.array_position(F.reverse(xs), t) + 1
    ranks = F.transform(F.array_intersect(a, b), lambda t: F.struct(last(a, t).alias("x"), last(b, t).alias("y")))

    def count(f: Callable[[Column, Column], Column]) -> Column:
        inner = lambda r, i: F.aggregate(F.slice(ranks, i + 2, F.size(ranks)), F.lit(0), lambda s, q: s + f(r, q))
        return F.aggregate(F.transform(ranks, inner), F.lit(0), lambda s, x: s + x)

    score = count(lambda r, q: F.signum((r["x"] - q["x"]).cast("double") * (r["y"] - q["y"])).cast("int"))
    free_x, free_y = count(lambda r, q: (r["x"] != q["x"]).cast("int")), count(lambda r, q: (r["y"] != q["y"]).cast("int"))
    return F.when((F.size(ranks) >= least) & (free_x > 0) & (free_y > 0), score / F.sqrt(free_x.cast("double") * free_y))


def normalized_tau(tau: Column) -> Column:
    return (tau + 1) / 2


def consensus_core(sets: list[Column], threshold: Column | int) -> Column:
    """Tokens in at least threshold of the sets, sorted."""
    filled = [F.coalesce(s, F.array().cast("array<string>")) for s in sets]
    union = F.array_distinct(F.flatten(F.array(*filled)))
    holders = lambda t: reduce(lambda x, y: x + y, [F.array_contains(s, t).cast("int") for s in filled])
    return F.array_sort(F.filter(union, lambda t: holders(t) >= threshold))


def introduced_rate(introduced: Column, anchored: Column) -> Column:
    total = introduced + anchored
    return F.when(total > 0, introduced / total)


def minimality(changed: Column, words: Column) -> Column:
    """Distinct changed tokens per word of the text."""
    return F.when(words > 0, changed / words)


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))
