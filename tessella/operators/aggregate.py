"""Aggregates over the four levels model x dataset, overall, dataset and model, in one pass of grouping sets.

Means of no value are 0.0 (a row's undefined value is null), as are deviations of one value; counts tell the two apart.
Null measures are left out of means; rows of empty tables give no group but the overall one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import measures as m

_PAIR_NAMES = [f"{a}_{b}" for a, b in m.PAIRS]
LEVELS = {0: "model_dataset", 1: "model", 2: "dataset", 3: "overall"}


def safe_mean(c: Column | str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def rate(c: Column) -> Column:
    """Share of true over all rows, null as false."""
    return F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))


def mean_where(c: str, when: Column) -> Column:
    return safe_mean(F.when(when, F.col(c)))


def with_length(rows: DataFrame, words: Column) -> DataFrame:
    """length_stratum by fixed cuts: up to 20 words short, up to 50 medium, else long."""
    return rows.withColumn("length_stratum", F.when(words <= 20, "short").when(words <= 50, "medium").otherwise("long"))


def summary_columns() -> dict[str, Column]:
    """The aggregate columns by name, over measured rows."""
    ecs = F.col("ecs")
    full, part = F.col("n_valid") == 4, (F.col("n_valid") < 4) & ecs.isNotNull()
    out = {"n_instances": F.count("*"), "n_ecs": F.count("ecs"), "mean_ecs": safe_mean("ecs"), "std_ecs": F.coalesce(F.stddev_samp("ecs"), F.lit(0.0)), "median_ecs": F.coalesce(F.percentile("ecs", F.lit(0.5)), F.lit(0.0))}
    out |= {f"mean_jaccard_{k}": safe_mean(f"jaccard_{k}") for k in _PAIR_NAMES}
    out |= {f"mean_overlap_{k}": safe_mean(f"overlap_{k}") for k in _PAIR_NAMES}
    out |= {"mean_rbo": safe_mean("rbo"), "mean_kendall": safe_mean("kendall"), "mean_kendall_normalized": safe_mean("kendall_normalized")}
    out |= {"mean_ecs_overlap": safe_mean("ecs_overlap"), "mean_ecs_er": safe_mean("ecs_er"), "mean_ecs_ep": safe_mean("ecs_ep"), "mean_ecs_random": safe_mean("ecs_random"), "mean_ecs_lift": safe_mean("ecs_lift")}
    out |= {"mean_ecs_adj": safe_mean("ecs_adj"), "n_ecs_adj": F.count("ecs_adj"), "mean_ecs_adj_complete": mean_where("ecs_adj", F.col("ecs_adj_complete")), "n_ecs_adj_complete": F.count(F.when(F.col("ecs_adj_complete"), F.col("ecs_adj"))), "degenerate_pairs": F.coalesce(F.sum("n_degenerate"), F.lit(0))}
    out |= {"mean_er_adj": safe_mean("er_adj"), "mean_ep_adj": safe_mean("ep_adj"), "mean_rp_adj": safe_mean("rp_adj")}
    out |= {"mean_cc3_size": safe_mean(F.size("cc3")), "cc3_percent": rate(F.size("cc3") > 0) * 100, "mean_cc4_size": safe_mean(F.size("cc4")), "cc4_percent": rate(F.size("cc4") > 0) * 100}
    out |= {"complete_case_mean": mean_where("ecs", full), "complete_case_n": F.count(F.when(full, ecs)), "partial_mean": mean_where("ecs", part), "partial_n": F.count(F.when(part, ecs))}
    out |= {"short_vocab_mean": mean_where("ecs", F.col("short_vocab")), "long_vocab_mean": mean_where("ecs", ~F.col("short_vocab"))}
    return out


def weighted_columns() -> dict[str, Column]:
    """Means over rows with a score and a null weighted by salience (ecs_random_weighted, ecs_lift_weighted)."""
    lift = F.col("ecs_lift_weighted")
    return {"mean_ecs_random_weighted": mean_where("ecs_random_weighted", lift.isNotNull()), "mean_ecs_lift_weighted": safe_mean(lift), "n_lift_weighted": F.count(lift)}


def outcome_columns() -> dict[str, Column]:
    """Columns over measured replies with right (null where a label is missing), model_refused, declined, changed_share and cf_error."""
    right = F.col("right")
    out = {"n_instances": F.count("*"), "n_judged": F.count(right), "accuracy": safe_mean(right.cast("double"))}
    for name, when in (("correct", right), ("incorrect", ~right)):
        out |= {f"mean_ecs_{name}": mean_where("ecs", when), f"n_ecs_{name}": F.count(F.when(when, F.col("ecs"))), f"mean_ecs_adj_{name}": mean_where("ecs_adj", when)}
    out |= {"refusal_rate": rate(F.col("model_refused")), "declined_rate": rate(F.col("declined")), "cf_valid_rate": rate(F.col("cf_error").isNull()), "flip_rate": rate(~F.col("cf_error").isin("no reply", "no JSON object", "null", "no string", "unknown label", "no flip") | F.col("cf_error").isNull()), "mean_minimality": safe_mean("changed_share"), "n_minimality": F.count("changed_share")}
    return out


def pair_counts() -> Column:
    """Defined values of nine pair measures as a map."""
    names = [*[f"jaccard_{k}" for k in _PAIR_NAMES], "rbo", "kendall", "kendall_normalized"]
    return F.create_map(*[x for n in names for x in (F.lit(n), F.count(n))])


def grouped(rows: DataFrame, columns: dict[str, Column] | None = None) -> DataFrame:
    """level, model, dataset and the aggregate columns of every group of the four levels."""
    sets = [["model", "dataset"], ["model"], ["dataset"], []]
    by = rows.groupingSets([[F.col(c) for c in s] for s in sets], F.col("model"), F.col("dataset"))
    out = by.agg(F.grouping_id().alias("_g"), *[c.alias(k) for k, c in (columns or summary_columns()).items()])
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return out.withColumn("level", level[F.col("_g").cast("int")]).select("level", "model", "dataset", *[c for c in out.columns if c not in ("_g", "model", "dataset")])


def extremes(rows: DataFrame, n: int = 5, value: str = "ecs", group: str = "instance_id", order: str = "user_id") -> DataFrame:
    """The n highest and the n lowest rows, one per group in each list; ties by later order in the high list, earlier in the low."""
    from pyspark.sql import Window

    have = rows.where(F.col(value).isNotNull())
    out = None
    for kind, keys in (("high", [F.desc(value), F.desc(order)]), ("low", [F.asc(value), F.asc(order)])):
        best = have.groupBy(group).agg((F.max_by if kind == "high" else F.min_by)(F.struct(value, order), F.struct(value, order)).alias("x")).select(group, "x.*")
        top = best.orderBy(*keys).limit(n).withColumn("position", F.row_number().over(Window.orderBy(*keys))).withColumn("extreme", F.lit(kind))
        out = top if out is None else out.unionByName(top)
    return out.select("extreme", "position", group, order, value)


def unpivoted(rows: DataFrame, keys: list[str], values: list[str], name: str = "measure", value: str = "value") -> DataFrame:
    """One row per key and measure that is not null."""
    return rows.unpivot(keys, values, name, value).where(F.col(value).isNotNull())


def sensitivity(rows: DataFrame, group: list[str]) -> DataFrame:
    """group..., means and numbers of ecs and of the adjusted score over complete and over all available rows."""
    full = F.col("ecs_adj_complete")
    return rows.groupBy(*group).agg(
        safe_mean("ecs").alias("mean_ecs"),
        F.count("ecs").alias("n_ecs"),
        mean_where("ecs_adj", full).alias("mean_complete"),
        F.count(F.when(full, F.col("ecs_adj"))).alias("n_complete"),
        safe_mean("ecs_adj").alias("mean_available"),
        F.count("ecs_adj").alias("n_available"),
    )


def variant_delta(base: DataFrame, variant: DataFrame, key: str, group: list[str], value: str = "ecs") -> DataFrame:
    """group..., n, mean_delta: the variant's value less the base's, over rows where both are defined; 0.0 for none."""
    both = base.select(key, *group, F.col(value).alias("_b")).join(variant.select(key, F.col(value).alias("_v")), key)
    return both.groupBy(*group).agg(F.count(F.col("_v") - F.col("_b")).alias("n"), safe_mean(F.col("_v") - F.col("_b")).alias("mean_delta"))
