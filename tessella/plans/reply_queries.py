"""Queries that parse replies into evidence and measure it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions.measures import jaccard, minimality, symmetric_difference
from tessella.operators import aggregate, crossmodel, erasure, evidence, parse, resample
from tessella.session import materialise
from tessella.sources import sinks
from tessella.sources.tables import table


def _replies(spark, sf_dir):
    return materialise(parse.evidence_of_replies(table(spark, sf_dir, "instance_results")), "replies")


def parsed_confidence(spark, sf_dir):
    return parse.confidence(table(spark, sf_dir, "instance_results").select("result_id", "confidence_raw_response"), "confidence_raw_response").select("result_id", F.round("confidence_parsed", 6).alias("confidence"), "confidence_error")


def parsed_highlighting(spark, sf_dir):
    rows = table(spark, sf_dir, "instance_results").select("result_id", "text", "raw_highlighting")
    return parse.highlighting(rows, "raw_highlighting").select("result_id", F.array_join("h_top", " ").alias("top"), "h_error")


def parsed_rationale(spark, sf_dir):
    rows = table(spark, sf_dir, "instance_results").select("result_id", "text", "raw_rationale")
    return parse.rationale(rows, "raw_rationale").select("result_id", F.array_join("r_tokens", " ").alias("tokens"), "r_error")


def parsed_rank_ordering(spark, sf_dir):
    rows = table(spark, sf_dir, "instance_results").select("result_id", "text", "raw_rank_ordering")
    return parse.rank_ordering(rows, "raw_rank_ordering").select("result_id", F.array_join("ro_ranking", " ").alias("ranking"), "ro_error")


def parsed_counterfactual(spark, sf_dir):
    rows = table(spark, sf_dir, "instance_results").select("result_id", "text", "dataset", "predicted_label", "raw_counterfactual")
    out = parse.counterfactual(rows, "raw_counterfactual", "predicted_label", parse.label_set(F.col("dataset")))
    return out.select("result_id", "cf_label", F.array_join("cf_changed", " ").alias("changed"), F.round("cf_ratio", 6).alias("ratio"), "cf_error")


def parse_funnel(spark, sf_dir):
    return parse.funnel(_replies(spark, sf_dir))


def reply_agreement(spark, sf_dir):
    m = evidence.measured(_replies(spark, sf_dir))
    return m.select("result_id", *[F.round(c, 6).alias(c) for c in ("ecs", "ecs_overlap", "ecs_adj", "ecs_lift", "rbo", "kendall")], "n_valid", "vocabulary")


def _weighted(spark, sf_dir):
    """Measured replies with chance_H_RO, ecs_random_weighted and ecs_lift_weighted."""
    rows = materialise(evidence.weighted_null(_replies(spark, sf_dir), F.xxhash64("result_id")), "weighted")
    both = evidence.measured(rows)
    return both.withColumn("ecs_lift_weighted", F.col("ecs") - F.col("ecs_random_weighted"))


def reply_aggregates(spark, sf_dir):
    return aggregate.grouped(_weighted(spark, sf_dir), aggregate.summary_columns() | aggregate.weighted_columns())


def weighted_null(spark, sf_dir):
    """Chance agreement of H and RO where words are drawn by their salience, and the lift over it; the mean chance of the
    five other pairs, and the lift of the score over that."""
    r = _weighted(spark, sf_dir).where("h_weights is not null and (size(RO) > 0 or ecs_random_weighted is not null)")
    c, e = F.col("chance_H_RO"), F.when(F.col("ecs").isNotNull(), F.col("ecs_random_weighted"))
    return r.select("result_id", F.round(c, 6).alias("chance"), F.round(jaccard(F.col("H"), F.col("RO")) - c, 6).alias("lift"), F.round(e, 6).alias("ecs_random_weighted"), F.round("ecs_lift_weighted", 6).alias("ecs_lift_weighted"))


def confidence_correlation(spark, sf_dir):
    """Rank correlation of stated confidence and agreement per model."""
    m = evidence.measured(_replies(spark, sf_dir)).select("result_id", "model", "ecs_adj")
    c = parse.confidence(table(spark, sf_dir, "instance_results").select("result_id", "confidence_raw_response"), "confidence_raw_response").select("result_id", "confidence_parsed")
    return resample.spearman(materialise(m.join(c, "result_id"), "pairs"), ["model"], "confidence_parsed", "ecs_adj")


def _flips(spark, sf_dir):
    return materialise(erasure.scored_flips(_replies(spark, sf_dir), parse.label_set(F.col("dataset"))), "flips")


def erasure_rates(spark, sf_dir):
    """Flip rates of erased evidence under the word scorer."""
    return erasure.rates(_flips(spark, sf_dir))


def erasure_gap_tests(spark, sf_dir):
    """Flips of the consensus core less those of random words, tested per model and operator, with Holm correction."""
    gaps = erasure.core_gaps(_flips(spark, sf_dir))
    return resample.holm(resample.sign_flip_test(gaps, ["model", "operator"], ["result_id", "operator"], "gap", least=6))


def erasure_tier_gaps(spark, sf_dir):
    """Mean gap of the core over random words by tier of agreement and operator."""
    gaps = erasure.core_gaps(_flips(spark, sf_dir))
    tiers = resample.lift_tiers(materialise(evidence.measured(_replies(spark, sf_dir)), "measured")).select("result_id", "tier")
    return gaps.join(tiers.where("tier is not null"), "result_id").groupBy("tier", "operator").agg(F.count("gap").alias("n"), F.round(F.avg("gap"), 6).alias("mean_gap"))


def cross_model_replies(spark, sf_dir):
    """Agreement between models on the same instance, by dataset and strategy, raw and adjusted."""
    rows = _replies(spark, sf_dir)
    last = rows.groupBy("dataset", "instance_id", "model").agg(F.max_by(F.struct("H", "R", "CF", "RO", "vocabulary"), "result_id").alias("x")).select("dataset", "instance_id", "model", "x.*")
    out = crossmodel.agreement(crossmodel.model_pairs(materialise(last, "models")))
    return out.select("dataset", "strategy", "n_pairs", F.round("mean_jaccard", 6).alias("mean_jaccard"), "n_adjusted", F.round("mean_aj", 6).alias("mean_aj"))


def correctness_split(spark, sf_dir):
    """Agreement of replies with a right and a wrong prediction, and rates over all replies, at every level."""
    truth = table(spark, sf_dir, "instance_results").select("result_id", F.lower(F.trim("ground_truth_label")).alias("truth"), "model_refused", tx.is_refusal(F.col("raw_rationale")).alias("declined"))
    rows = evidence.measured(_replies(spark, sf_dir)).join(truth, "result_id")
    rows = rows.withColumns({"right": F.lower(F.trim("predicted_label")) == F.col("truth"), "changed_share": minimality(F.size("cf_changed"), F.size(tx.words(F.col("text"))))})
    return aggregate.grouped(rows, {k: F.round(c, 6) if k.startswith("mean") or k.endswith("rate") or k == "accuracy" else c for k, c in aggregate.outcome_columns().items()})


def free_cf_sensitivity(spark, sf_dir):
    """The scores with free rewrites as counterfactual evidence beside those with minimal ones."""
    rows = table(spark, sf_dir, "instance_results")
    out = None
    for name, ratio in (("minimal", parse.MAX_EDIT_RATIO), ("free", None)):
        m = evidence.measured(parse.evidence_of_replies(rows, ratio))
        s = aggregate.sensitivity(m, ["model"]).withColumn("variant", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def ablation_delta(spark, sf_dir):
    """Change of the score where counterfactual evidence is the symmetric difference of the two texts' word sets."""
    base = _replies(spark, sf_dir)
    differs = symmetric_difference(tx.token_set(F.col("text")), tx.token_set(F.col("cf_text")))
    changed = base.withColumn("CF", F.when(F.col("cf_text").isNotNull(), tx.normalize_tokens(differs)).otherwise(F.col("CF")))
    return aggregate.variant_delta(evidence.measured(base), evidence.measured(changed), "result_id", ["model", "dataset"])


def cf_minimality(spark, sf_dir):
    """Changed words per word of the text, per model, and how often the counterfactual passes all gates."""
    rows = _replies(spark, sf_dir).withColumn("share", minimality(F.size("cf_changed"), F.size(tx.words(F.col("text")))))
    return rows.groupBy("model").agg(F.round(F.avg("share"), 6).alias("minimality"), F.round(F.avg("cf_ratio"), 6).alias("edit_ratio"), F.round(aggregate.rate(F.col("cf_error").isNull()), 6).alias("valid_rate"))


def cf_tradeoff_unpivot(spark, sf_dir):
    """Means of minimal and free rewrites as rows of (variant, measure, value), the shape that is plotted."""
    return aggregate.unpivoted(free_cf_sensitivity(spark, sf_dir), ["model", "variant"], ["mean_ecs", "mean_complete", "mean_available"])


def coverage_rates(spark, sf_dir):
    """Per model and dataset how often each strategy gives valid evidence, over all replies."""
    ok = {s: F.round(aggregate.rate(F.col(c).isNull()), 6) for s, c in (("h_rate", "h_error"), ("r_rate", "r_error"), ("cf_rate", "cf_error"), ("ro_rate", "ro_error"))}
    return _replies(spark, sf_dir).groupBy("model", "dataset").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in ok.items()])


def parse_failures(spark, sf_dir):
    """Replies per strategy that gave no evidence, missing ones apart from failed ones."""
    f = parse.funnel(_replies(spark, sf_dir))
    return f.groupBy("strategy").agg(F.sum(F.when(F.col("error") == "no reply", F.col("n")).otherwise(0)).alias("no_reply"), F.sum(F.when(~F.col("error").isin("ok", "no reply"), F.col("n")).otherwise(0)).alias("failed"))


def execution_summary(spark, sf_dir):
    return sinks.execution_summary(table(spark, sf_dir, "instance_results"))


QUERIES = {
    f.__name__: f
    for f in (cf_tradeoff_unpivot, coverage_rates, parse_failures, erasure_gap_tests, free_cf_sensitivity, ablation_delta, cf_minimality, execution_summary, parsed_confidence, parsed_highlighting, parsed_rationale, parsed_rank_ordering, parsed_counterfactual, parse_funnel, reply_agreement, reply_aggregates, weighted_null, confidence_correlation, erasure_rates, erasure_tier_gaps, cross_model_replies, correctness_split)
}
ORACLE = {
    "execution_summary": """SELECT count(*) AS rows, count(DISTINCT lower(trim(model))) AS models, count(DISTINCT dataset) AS datasets, count(*) FILTER (model_refused) AS refused,
      sum(prompt_tokens)::bigint AS prompt_tokens, sum(response_tokens)::bigint AS response_tokens, min(recorded_at) AS first_at, max(recorded_at) AS last_at, floor(epoch(max(recorded_at) - min(recorded_at)))::bigint AS span_seconds FROM instance_results""",
}
