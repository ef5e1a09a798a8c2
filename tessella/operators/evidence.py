"""Evidence tables: one row per instance, strategy and token, and the wide form that measures work on.

Tokens are aggregated before they are gathered, so an array never holds more than an instance's distinct tokens. Null
properties or users give no evidence; repeated events change nothing; an empty table gives no instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import kernels
from tessella.functions import measures as m
from tessella.functions.stage import settled

# Which event type stands in for which strategy.
EVENT_STRATEGIES = {"click": "H", "view": "R", "purchase": "CF", "signup": "RO"}


def from_events(events: DataFrame) -> DataFrame:
    """user_id, strategy ('-' for vocabulary only), token, score (largest), first (earliest time and id), times."""
    kind = F.create_map(*[F.lit(x) for kv in EVENT_STRATEGIES.items() for x in kv])
    return (
        events.select("user_id", F.coalesce(kind[F.col("event_type")], F.lit("-")).alias("strategy"), F.get_json_object("props", "$.k").alias("token"), F.col("value").alias("score"), F.struct("ts", "event_id").alias("at"))
        .where("user_id is not null and token is not null")
        .groupBy("user_id", "strategy", "token")
        .agg(F.max("score").alias("score"), F.min("at").alias("first"), F.count("*").alias("times"))
    )


def wide(evidence: DataFrame) -> DataFrame:
    """dataset, model, instance_id, user_id, the sets H R CF RO, rankings h_rank (by score) and ro_rank (by time), vocabulary
    (distinct tokens), words (all tokens)."""
    of = lambda s: F.col("strategy") == s
    sets = [F.array_sort(F.collect_list(F.when(of(s), F.col("token")))).alias(s) for s in m.STRATEGIES]
    by_score = F.array_sort(F.collect_list(F.when(of("H"), F.struct((-F.coalesce("score", F.lit(0.0))).alias("o"), F.col("token").alias("token")))))
    by_time = F.array_sort(F.collect_list(F.when(of("RO"), F.struct(F.col("first").alias("o"), F.col("token").alias("token")))))
    rows = evidence.groupBy("user_id").agg(*sets, by_score.getField("token").alias("h_rank"), by_time.getField("token").alias("ro_rank"), F.countDistinct("token").cast("int").alias("vocabulary"), F.sum("times").alias("words"))
    inst = F.expr("user_id div 3")
    return rows.select((inst % 3).alias("dataset"), (F.col("user_id") % 3).alias("model"), inst.alias("instance_id"), "*")


def sets_of() -> dict[str, Column]:
    return {s: F.col(s) for s in m.STRATEGIES}


def measured(rows: DataFrame) -> DataFrame:
    """The wide rows with all pairwise, composite, adjusted, chance and rank measures.

    Pair values become columns before anything is derived from them, so each is computed once per row."""
    s, v = sets_of(), F.col("vocabulary")
    filled = {f"{x}_{y}": (F.size(x) > 0) & (F.size(y) > 0) for x, y in m.PAIRS}
    chance = {f"{x}_{y}": F.when(filled[f"{x}_{y}"], m.expected_jaccard(F.size(x), F.size(y), v)) for x, y in m.PAIRS}
    out = settled(rows, {**{f"jaccard_{k}": c for k, c in m.pairwise_jaccard(s).items()}, **{f"overlap_{k}": c for k, c in m.pairwise_overlap(s).items()}, **{f"chance_{k}": c for k, c in chance.items()}, "n_valid": m.n_valid(s)})
    j, o, e = ({k: F.col(f"{p}_{k}") for k in chance} for p in ("jaccard", "overlap", "chance"))
    out = settled(out, {f"aj_{x}_{y}": m.adjusted(j[f"{x}_{y}"], F.size(x), F.size(y), e[f"{x}_{y}"]) for x, y in m.PAIRS})
    comp = m.composites(j)
    out = settled(out, {"ecs": m.flat_score(j, F.col("n_valid")), "ecs_overlap": m.flat_score(o, F.col("n_valid")), "ecs_er": comp["er"], "ecs_ep": comp["ep"], "ecs_primary_pairs": comp["n_pairs"], **m.adjusted_score({k: F.col(f"aj_{k}") for k in chance}, filled), "ecs_random": m.random_score(e)})
    core = list(s.values())
    out = settled(out, {"ecs_lift": F.col("ecs") - F.col("ecs_random"), "kendall": m.kendall_tau(F.col("h_rank"), F.col("ro_rank")), "rbo": m.rank_biased_overlap(F.col("h_rank"), F.col("ro_rank")), "cc3": m.consensus_core(core, 3), "cc4": m.consensus_core(core, 4), "short_vocab": v <= 20})
    return out.withColumn("kendall_normalized", m.normalized_tau(F.col("kendall")))


def weighted_null(rows: DataFrame, key: Column) -> DataFrame:
    """rows with chance_H_RO and ecs_random_weighted: the chance agreement of H and RO, and the mean of that of the five other
    pairs whose sets aren't empty, where words are drawn by their salience (h_weights, two words or more)."""
    chance = {k: kernels.weighted_chance(F.size(k[0]), F.size(k[1]), F.col("h_weights"), key) for k in m.PAIRS}
    out = rows.withColumns({f"chance_{a}_{b}": c for (a, b), c in chance.items()})
    others = F.filter(F.array(*[F.col(f"chance_{a}_{b}") for a, b in m.PAIRS if (a, b) != ("H", "RO")]), lambda c: c.isNotNull())
    mean = F.try_divide(F.aggregate(others, F.lit(0.0), lambda x, c: x + c), F.size(others))
    return out.withColumn("ecs_random_weighted", mean).drop(*[f"chance_{a}_{b}" for a, b in m.PAIRS if (a, b) != ("H", "RO")])
