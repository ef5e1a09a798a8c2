"""Queries over evidence made from the events table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import measures as m
from tessella.functions import text as tx
from tessella.operators import aggregate, crossmodel, evidence, resample
from tessella.session import materialise
from tessella.sources.tables import table

_NAMES = [f"{a}_{b}" for a, b in m.PAIRS]


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.from_events(table(spark, sf_dir, "events"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.measured(evidence.wide(_evidence(spark, sf_dir)))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measured rows as a table, for queries that use them more than once."""
    return materialise(_measured(spark, sf_dir), "measured")


def _r(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def pairwise_jaccard(spark, sf_dir):
    return _measured(spark, sf_dir).select("user_id", *[_r(f"jaccard_{k}") for k in _NAMES])


def pairwise_overlap(spark, sf_dir):
    return _measured(spark, sf_dir).select("user_id", *[_r(f"overlap_{k}") for k in _NAMES])


def expected_jaccard_exact(spark, sf_dir):
    return _measured(spark, sf_dir).select("user_id", *[_r(f"chance_{k}") for k in _NAMES])


def expected_overlap(spark, sf_dir):
    rows = evidence.wide(_evidence(spark, sf_dir))
    each = {f"{a}_{b}": F.when((F.size(a) > 0) & (F.size(b) > 0), m.expected_overlap(F.size(a), F.size(b), F.col("vocabulary"))) for a, b in m.PAIRS}
    return rows.select("user_id", *[_r(c, k) for k, c in each.items()])


def adjusted_jaccard(spark, sf_dir):
    return _measured(spark, sf_dir).select("user_id", *[_r(f"aj_{k}") for k in _NAMES])


def ecs_by_instance(spark, sf_dir):
    return _measured(spark, sf_dir).select("user_id", _r("ecs"), _r("ecs_overlap"), _r("ecs_er"), _r("ecs_ep"), "ecs_primary_pairs", _r("ecs_random"), _r("ecs_lift"))


def ecs_adjusted(spark, sf_dir):
    return _measured(spark, sf_dir).select("user_id", _r("er_adj"), _r("ep_adj"), _r("rp_adj"), _r("ecs_adj"), "ecs_adj_complete", "n_components", "n_degenerate")


def consensus_core(spark, sf_dir):
    rows = evidence.wide(_evidence(spark, sf_dir))
    sets = [F.col(s) for s in m.STRATEGIES]
    return rows.select("user_id", F.array_join(m.consensus_core(sets, 3), ",").alias("cc3"), F.array_join(m.consensus_core(sets, 4), ",").alias("cc4"), "vocabulary")


def rank_measures(spark, sf_dir):
    return _measured(spark, sf_dir).select("user_id", _r("rbo"), _r("kendall"), _r("kendall_normalized"))


def implicit_ranks(spark, sf_dir):
    """Rank of each token of a strategy by its first occurrence."""
    ev = _evidence(spark, sf_dir).where("strategy <> '-'")
    w = Window.partitionBy("user_id", "strategy").orderBy("first")
    return ev.select("user_id", "strategy", "token", F.row_number().over(w).alias("rank"))


def topk_salience(spark, sf_dir):
    """The dynamic_k best tokens of H by score, ties by token."""
    rows = evidence.wide(_evidence(spark, sf_dir))
    k = tx.dynamic_k(F.col("vocabulary"), F.size("h_rank"))
    return rows.select("user_id", F.array_join(F.slice("h_rank", 1, F.greatest(k, F.lit(1))), ",").alias("top"))


def ecs_grouping_sets(spark, sf_dir):
    c = aggregate.summary_columns()
    keep = ["n_instances", "n_ecs", "mean_ecs", "std_ecs", "median_ecs", "mean_ecs_adj", "mean_rbo", "mean_cc3_size", "complete_case_n", "mean_ecs_lift"]
    return aggregate.grouped(_measured(spark, sf_dir), {k: F.round(c[k], 6) if k.startswith(("mean", "std", "median")) else c[k] for k in keep})


def aggregate_all(spark, sf_dir):
    """Every aggregate column at every level."""
    return aggregate.grouped(_measured(spark, sf_dir), {k: c if k.startswith("n_") or k.endswith("_n") or k == "degenerate_pairs" else F.round(c, 6) for k, c in aggregate.summary_columns().items()})


def pair_counts(spark, sf_dir):
    return aggregate.grouped(_measured(spark, sf_dir), {"pair_ns": F.to_json(aggregate.pair_counts())})


def length_strata(spark, sf_dir):
    """Scores by the number of words of the text; n counts the rows with a score."""
    rows = aggregate.with_length(_measured(spark, sf_dir), F.col("words"))
    return rows.groupBy("length_stratum").agg(F.count("ecs").alias("n"), F.round(aggregate.safe_mean("ecs"), 6).alias("mean_ecs"), F.round(aggregate.safe_mean("ecs_adj"), 6).alias("mean_ecs_adj"))


def vocab_strata(spark, sf_dir):
    return _measured(spark, sf_dir).groupBy("short_vocab").agg(F.count("*").alias("n"), F.round(aggregate.safe_mean("ecs"), 6).alias("mean_ecs"))


def cross_model_pairs(spark, sf_dir):
    rows = evidence.wide(_evidence(spark, sf_dir))
    return crossmodel.model_pairs(rows).select("dataset", "instance_id", "strategy", "model_a", "model_b", _r("jaccard"), _r("aj"))


def cross_model_agreement(spark, sf_dir):
    out = crossmodel.agreement(crossmodel.model_pairs(evidence.wide(_evidence(spark, sf_dir))))
    return out.select("dataset", "strategy", "n_pairs", _r("mean_jaccard"), "n_adjusted", _r("mean_aj"))


def cross_model_paired_delta(spark, sf_dir):
    rows = _kept(spark, sf_dir)
    return crossmodel.paired_delta(rows, crossmodel.model_pairs(rows)).select("dataset", "instance_id", _r("delta"), _r("delta_adj"))


def cross_model_delta_test(spark, sf_dir):
    rows = _kept(spark, sf_dir)
    d = crossmodel.paired_delta(rows, crossmodel.model_pairs(rows))
    test = resample.sign_flip_test(d, ["dataset"], ["dataset", "instance_id"], "delta_adj", "two-sided")
    ci = resample.bootstrap_mean(d, ["dataset"], ["dataset", "instance_id"], "delta_adj").drop("n", "mean")
    return resample.holm(test.join(ci, "dataset"))


def bootstrap_ci(spark, sf_dir):
    """Cluster bootstrap of mean ecs at the pooled level and per cell."""
    rows = _kept(spark, sf_dir)
    cell = resample.bootstrap_mean(rows, ["model", "dataset"], ["dataset", "instance_id"], "ecs")
    pooled = resample.bootstrap_mean(rows, [], ["dataset", "instance_id"], "ecs").select(F.lit(None).cast("bigint").alias("model"), F.lit(None).cast("bigint").alias("dataset"), "n", "mean", "ci_lower", "ci_upper")
    return cell.unionByName(pooled)


def permutation_family(spark, sf_dir, value: str = "ecs_adj", complete: bool = True):
    """Sign-flip tests of a cell's values over 0 with Holm correction; cells under six values are not tested."""
    rows = _kept(spark, sf_dir)
    rows = rows.where("ecs_adj_complete") if complete else rows
    return resample.holm(resample.sign_flip_test(rows, ["model", "dataset"], ["user_id"], value, least=6)).withColumn("significant", resample.significant(F.col("p_holm")))


def permutation_family_available(spark, sf_dir):
    return permutation_family(spark, sf_dir, "ecs_adj", False)


def permutation_family_lift(spark, sf_dir):
    return permutation_family(spark, sf_dir, "ecs_lift", False)


def two_sample_permutation(spark, sf_dir):
    return resample.two_sample_test(_kept(spark, sf_dir).withColumn("wide", F.col("vocabulary") > 50), "wide", ["user_id"], "ecs")


def spearman_rho(spark, sf_dir):
    return resample.spearman(_kept(spark, sf_dir), ["model"], "ecs", "vocabulary").select("model", "n", _r("rho"))


def spearman_test(spark, sf_dir):
    return resample.spearman(_kept(spark, sf_dir), ["model", "dataset"], "ecs", "vocabulary")


def lift_tiers(spark, sf_dir):
    return resample.lift_tiers(_kept(spark, sf_dir)).select("user_id", "tier")


def holm(spark, sf_dir):
    """Holm over the grouped p-like values of a table: mean event value per type and user third, scaled into (0, 1)."""
    p = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("third")).agg(F.round(F.avg(F.col("event_id") % 1000) / 20000, 6).alias("p"))
    return resample.holm(p, order=["event_type", "third"]).select("event_type", "third", "p", _r("p_holm"))


def extremes_topn(spark, sf_dir):
    rows = _kept(spark, sf_dir).withColumn("ecs", F.round("ecs", 6))
    return aggregate.extremes(rows, 5)


def measures_unpivot(spark, sf_dir):
    rows = _measured(spark, sf_dir).select("user_id", _r("ecs"), _r("ecs_adj"), _r("rbo"), _r("kendall"))
    return aggregate.unpivoted(rows, ["user_id"], ["ecs", "ecs_adj", "rbo", "kendall"])


def cell_means_pivot(spark, sf_dir):
    """Mean ecs of each dataset by model as columns."""
    return _measured(spark, sf_dir).groupBy("dataset").pivot("model", [0, 1, 2]).agg(F.round(F.avg("ecs"), 6)).withColumnsRenamed({"0": "model_0", "1": "model_1", "2": "model_2"})


def anti_join_resume(spark, sf_dir):
    """What a resumed run still has to do: users whose last event, by time and id, isn't an error."""
    ev = table(spark, sf_dir, "events").where("user_id is not null")
    done = ev.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last")).where("last = 'error'")
    return ev.select("user_id").distinct().join(done, "user_id", "left_anti")


def last_wins_dedup(spark, sf_dir):
    """The last event of each user and type, by time and id; aggregated, so a hot user is combined before the shuffle."""
    ev = table(spark, sf_dir, "events").where("user_id is not null")
    return ev.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("x")).select("user_id", "event_type", "x.event_id", _r(F.col("x.value"), "value"))


_BASE = """
WITH ev AS (
  SELECT user_id, CASE event_type WHEN 'click' THEN 'H' WHEN 'view' THEN 'R' WHEN 'purchase' THEN 'CF' WHEN 'signup' THEN 'RO' ELSE '-' END AS s,
         json_extract_string(props, '$.k') AS tok, value, ts, event_id
  FROM events WHERE user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL),
tk AS (SELECT user_id, s, tok, max(value) AS sc, min(ts) AS ts0, arg_min(event_id, (ts, event_id)) AS id0 FROM ev GROUP BY ALL),
u AS (SELECT user_id, count(DISTINCT tok) AS v FROM ev GROUP BY 1),
sets AS (SELECT user_id, s, list(tok) AS toks FROM tk WHERE s <> '-' GROUP BY ALL),
pr AS (SELECT a.user_id, a.s || '_' || b.s AS pair, len(a.toks) AS a, len(b.toks) AS b, len(list_intersect(a.toks, b.toks)) AS i, u.v
  FROM sets a JOIN sets b USING (user_id) JOIN u USING (user_id)
  WHERE (a.s || '_' || b.s) IN ('H_R', 'H_CF', 'H_RO', 'R_CF', 'R_RO', 'CF_RO')),
ks AS (SELECT *, unnest(range(greatest(0, a + b - v), least(a, b) + 1)) AS k FROM pr),
ex AS (SELECT user_id, pair, sum(exp(lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1) + lgamma(v - a + 1) - lgamma(b - k + 1) - lgamma(v - a - b + k + 1)
       - lgamma(v + 1) + lgamma(b + 1) + lgamma(v - b + 1)) * k / (a + b - k)) AS e FROM ks GROUP BY ALL),
m AS (SELECT pr.*, i / (a + b - i) AS j, i / least(a, b) AS o, ex.e, a * b / (v * least(a, b)) AS eo, least(a, b) / greatest(a, b) AS top
  FROM pr JOIN ex USING (user_id, pair)),
aj AS (SELECT *, CASE WHEN top - e >= 0.1 THEN (j - e) / (top - e) END AS aj FROM m),
sc AS (SELECT user_id, count(DISTINCT s) AS nv FROM tk WHERE s <> '-' GROUP BY 1),
inst AS (SELECT u.user_id, u.v, (u.user_id // 3) % 3 AS dataset, u.user_id % 3 AS model, u.user_id // 3 AS instance_id,
  CASE WHEN coalesce(sc.nv, 0) >= 3 THEN avg(j) FILTER (pair <> 'H_RO') END AS ecs, CASE WHEN coalesce(sc.nv, 0) >= 3 THEN avg(o) FILTER (pair <> 'H_RO') END AS ecs_overlap,
  avg(j) FILTER (pair IN ('H_R', 'R_RO')) AS ecs_er, avg(j) FILTER (pair IN ('H_CF', 'CF_RO')) AS ecs_ep, count(j) FILTER (pair IN ('H_R', 'R_RO', 'H_CF', 'CF_RO')) AS ecs_primary_pairs,
  avg(e) FILTER (pair <> 'H_RO') AS ecs_random, avg(aj) FILTER (pair IN ('H_R', 'R_RO')) AS er_adj, avg(aj) FILTER (pair IN ('H_CF', 'CF_RO')) AS ep_adj, max(aj) FILTER (pair = 'R_CF') AS rp_adj,
  count(*) FILTER (pair <> 'H_RO' AND aj IS NULL) AS n_degenerate, coalesce(sc.nv, 0) AS nv
  FROM u LEFT JOIN aj USING (user_id) LEFT JOIN sc USING (user_id) GROUP BY u.user_id, u.v, sc.nv),
ad AS (SELECT *, ecs - ecs_random AS ecs_lift, (er_adj IS NOT NULL)::int + (ep_adj IS NOT NULL)::int + (rp_adj IS NOT NULL)::int AS n_components,
  (coalesce(er_adj, 0) + coalesce(ep_adj, 0) + coalesce(rp_adj, 0)) / nullif((er_adj IS NOT NULL)::int + (ep_adj IS NOT NULL)::int + (rp_adj IS NOT NULL)::int, 0) AS ecs_adj FROM inst),
hr AS (SELECT user_id, tok, row_number() OVER (PARTITION BY user_id ORDER BY sc DESC, tok) AS r FROM tk WHERE s = 'H'),
rr AS (SELECT user_id, tok, row_number() OVER (PARTITION BY user_id ORDER BY ts0, id0) AS r FROM tk WHERE s = 'RO'),
cm AS (SELECT h.user_id, h.r AS x, q.r AS y FROM hr h JOIN rr q USING (user_id, tok)),
kt AS (SELECT p.user_id, CASE WHEN max(n) >= 4 THEN sum(sign((p.x - q.x) * (p.y - q.y))) / count(*) END AS tau
  FROM cm p JOIN cm q ON p.user_id = q.user_id AND p.x < q.x JOIN (SELECT user_id, count(*) AS n FROM cm GROUP BY 1) c ON c.user_id = p.user_id GROUP BY 1),
dp AS (SELECT user_id, unnest(range(1, greatest(h, q) + 1)) AS d FROM (SELECT user_id, max(r) AS h FROM hr GROUP BY 1) JOIN (SELECT user_id, max(r) AS q FROM rr GROUP BY 1) USING (user_id)),
rb AS (SELECT user_id, 0.1 * sum(power(0.9, d - 1) * n / d) AS rbo FROM (SELECT dp.user_id, d, count(cm.x) AS n FROM dp LEFT JOIN cm ON cm.user_id = dp.user_id AND cm.x <= d AND cm.y <= d GROUP BY ALL) GROUP BY 1),
hold AS (SELECT user_id, tok, count(DISTINCT s) AS n FROM tk WHERE s <> '-' GROUP BY ALL),
xs AS (SELECT x.user_id // 3 AS instance_id, (x.user_id // 3) % 3 AS dataset, x.s AS strategy, x.user_id % 3 AS model_a, y.user_id % 3 AS model_b, len(x.toks) AS a, len(y.toks) AS b, len(list_intersect(x.toks, y.toks)) AS i,
  greatest(p.v, q.v, len(x.toks) + len(y.toks) - len(list_intersect(x.toks, y.toks))) AS v FROM sets x JOIN sets y ON x.s = y.s AND x.user_id // 3 = y.user_id // 3 AND x.user_id < y.user_id JOIN u p ON p.user_id = x.user_id JOIN u q ON q.user_id = y.user_id),
xk AS (SELECT *, unnest(range(greatest(0, a + b - v), least(a, b) + 1)) AS k FROM xs),
xe AS (SELECT instance_id, dataset, strategy, model_a, model_b, any_value(i / (a + b - i)) AS j, any_value(least(a, b) / greatest(a, b)) AS top,
  sum(exp(lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1) + lgamma(v - a + 1) - lgamma(b - k + 1) - lgamma(v - a - b + k + 1) - lgamma(v + 1) + lgamma(b + 1) + lgamma(v - b + 1)) * k / (a + b - k)) AS e FROM xk GROUP BY ALL),
xa AS (SELECT *, CASE WHEN top - e >= 0.1 THEN (j - e) / (top - e) END AS aj FROM xe)
"""


def _pivot(col: str, prefix: str) -> str:
    cols = ", ".join(f"round(max({col}) FILTER (pair = '{k}'), 6) AS {prefix}{k}" for k in _NAMES)
    return f"{_BASE} SELECT u.user_id, {cols} FROM u LEFT JOIN aj USING (user_id) GROUP BY 1"


_GROUPS = "CASE GROUPING(model, dataset) WHEN 0 THEN 'model_dataset' WHEN 1 THEN 'model' WHEN 2 THEN 'dataset' ELSE 'overall' END AS level, model, dataset"

# one row per user with what is aggregated
_WIDE = (
    ", wp AS (SELECT user_id, "
    + ", ".join(f"max({c}) FILTER (pair = '{k}') AS {p}_{k}" for c, p in (("j", "jaccard"), ("o", "overlap")) for k in _NAMES)
    + """ FROM aj GROUP BY 1),
  n3 AS (SELECT user_id, count(*) FILTER (n >= 3) AS c3, count(*) FILTER (n >= 4) AS c4 FROM hold GROUP BY 1),
  w AS (SELECT ad.*, wp.* EXCLUDE (user_id), rbo, tau AS kendall, (tau + 1) / 2 AS kendall_normalized, coalesce(c3, 0) AS c3, coalesce(c4, 0) AS c4, n_components = 3 AS whole
    FROM ad LEFT JOIN wp USING (user_id) LEFT JOIN rb USING (user_id) LEFT JOIN kt USING (user_id) LEFT JOIN n3 USING (user_id))
"""
)


def _mean(value: str, name: str) -> str:
    return f"round(coalesce({value}, 0), 6) AS {name}"


_ALL = (
    _WIDE
    + f"SELECT {_GROUPS}, count(*) AS n_instances, count(ecs) AS n_ecs, "
    + ", ".join(
        [
            _mean("avg(ecs)", "mean_ecs"), _mean("stddev_samp(ecs)", "std_ecs"), _mean("quantile_cont(ecs, 0.5)", "median_ecs"),
            *[_mean(f"avg({p}_{k})", f"mean_{p}_{k}") for p in ("jaccard", "overlap") for k in _NAMES],
            *[_mean(f"avg({c})", f"mean_{c}") for c in ("rbo", "kendall", "kendall_normalized", "ecs_overlap", "ecs_er", "ecs_ep", "ecs_random", "ecs_lift", "ecs_adj", "er_adj", "ep_adj", "rp_adj")],
            "count(ecs_adj) AS n_ecs_adj", _mean("avg(ecs_adj) FILTER (whole)", "mean_ecs_adj_complete"), "count(ecs_adj) FILTER (whole) AS n_ecs_adj_complete", "coalesce(sum(n_degenerate), 0)::bigint AS degenerate_pairs",
            _mean("avg(c3)", "mean_cc3_size"), _mean("100 * avg((c3 > 0)::int)", "cc3_percent"), _mean("avg(c4)", "mean_cc4_size"), _mean("100 * avg((c4 > 0)::int)", "cc4_percent"),
            _mean("avg(ecs) FILTER (nv = 4)", "complete_case_mean"), "count(ecs) FILTER (nv = 4) AS complete_case_n", _mean("avg(ecs) FILTER (nv < 4)", "partial_mean"), "count(ecs) FILTER (nv < 4) AS partial_n",
            _mean("avg(ecs) FILTER (v <= 20)", "short_vocab_mean"), _mean("avg(ecs) FILTER (v > 20)", "long_vocab_mean"),
        ]
    )
    + " FROM w GROUP BY GROUPING SETS ((model, dataset), (model), (dataset), ())"
)

QUERIES = {
    f.__name__: f
    for f in (
        pairwise_jaccard, pairwise_overlap, expected_jaccard_exact, expected_overlap, adjusted_jaccard, ecs_by_instance, ecs_adjusted, consensus_core, rank_measures, implicit_ranks, topk_salience,
        ecs_grouping_sets, aggregate_all, pair_counts, length_strata, vocab_strata, cross_model_pairs, cross_model_agreement, cross_model_paired_delta, cross_model_delta_test, bootstrap_ci,
        permutation_family, permutation_family_available, permutation_family_lift, two_sample_permutation, spearman_rho, spearman_test, lift_tiers, holm, extremes_topn, measures_unpivot, cell_means_pivot,
        anti_join_resume, last_wins_dedup,
    )
}
ORACLE = {
    "pairwise_jaccard": _pivot("j", "jaccard_"),
    "pairwise_overlap": _pivot("o", "overlap_"),
    "expected_jaccard_exact": _pivot("e", "chance_"),
    "expected_overlap": _pivot("eo", ""),
    "adjusted_jaccard": _pivot("aj", "aj_"),
    "ecs_by_instance": _BASE + "SELECT user_id, round(ecs, 6) AS ecs, round(ecs_overlap, 6) AS ecs_overlap, round(ecs_er, 6) AS ecs_er, round(ecs_ep, 6) AS ecs_ep, ecs_primary_pairs::int AS ecs_primary_pairs, round(ecs_random, 6) AS ecs_random, round(ecs_lift, 6) AS ecs_lift FROM ad",
    "ecs_adjusted": _BASE + "SELECT user_id, round(er_adj, 6) AS er_adj, round(ep_adj, 6) AS ep_adj, round(rp_adj, 6) AS rp_adj, round(ecs_adj, 6) AS ecs_adj, n_components = 3 AS ecs_adj_complete, n_components, n_degenerate::int AS n_degenerate FROM ad",
    "consensus_core": _BASE + "SELECT u.user_id, coalesce(string_agg(tok, ',' ORDER BY tok) FILTER (n >= 3), '') AS cc3, coalesce(string_agg(tok, ',' ORDER BY tok) FILTER (n >= 4), '') AS cc4, u.v::int AS vocabulary FROM u LEFT JOIN hold USING (user_id) GROUP BY u.user_id, u.v",
    "rank_measures": _BASE + "SELECT u.user_id, round(rbo, 6) AS rbo, round(tau, 6) AS kendall, round((tau + 1) / 2, 6) AS kendall_normalized FROM u LEFT JOIN rb USING (user_id) LEFT JOIN kt USING (user_id)",
    "implicit_ranks": _BASE + "SELECT user_id, s AS strategy, tok AS token, (row_number() OVER (PARTITION BY user_id, s ORDER BY ts0, id0))::int AS rank FROM tk WHERE s <> '-'",
    "topk_salience": _BASE + "SELECT user_id, coalesce(string_agg(tok, ',' ORDER BY r) FILTER (r <= greatest(1, least(n, greatest(3, round_even(v / 5, 0))))), '') AS top FROM u LEFT JOIN hr USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM hr GROUP BY 1) USING (user_id) GROUP BY 1",
    "ecs_grouping_sets": _BASE
    + f""" SELECT {_GROUPS}, count(*) AS n_instances, count(ecs) AS n_ecs, round(coalesce(avg(ecs), 0), 6) AS mean_ecs, round(coalesce(stddev_samp(ecs), 0), 6) AS std_ecs, round(coalesce(quantile_cont(ecs, 0.5), 0), 6) AS median_ecs,
      round(coalesce(avg(ecs_adj), 0), 6) AS mean_ecs_adj, round(coalesce(avg(rbo), 0), 6) AS mean_rbo, round(coalesce(avg(coalesce(n3, 0)), 0), 6) AS mean_cc3_size, count(ecs) FILTER (nv = 4) AS complete_case_n, round(coalesce(avg(ecs_lift), 0), 6) AS mean_ecs_lift
      FROM ad LEFT JOIN rb USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n3 FROM hold WHERE n >= 3 GROUP BY 1) USING (user_id) GROUP BY GROUPING SETS ((model, dataset), (model), (dataset), ())""",
    "aggregate_all": _BASE + _ALL,
    "pair_counts": _BASE + _WIDE + f"SELECT {_GROUPS}, '{{' || " + " || ',' || ".join(f"'\"{c}\":' || count({c})" for c in [*[f"jaccard_{k}" for k in _NAMES], "rbo", "kendall", "kendall_normalized"]) + " || '}' AS pair_ns FROM w GROUP BY GROUPING SETS ((model, dataset), (model), (dataset), ())",
    "length_strata": _BASE + ", wc AS (SELECT user_id, count(*) AS words FROM ev GROUP BY 1) SELECT CASE WHEN words <= 20 THEN 'short' WHEN words <= 50 THEN 'medium' ELSE 'long' END AS length_stratum, count(ecs) AS n, round(coalesce(avg(ecs), 0), 6) AS mean_ecs, round(coalesce(avg(ecs_adj), 0), 6) AS mean_ecs_adj FROM ad JOIN wc USING (user_id) GROUP BY 1",
    "vocab_strata": _BASE + "SELECT v <= 20 AS short_vocab, count(*) AS n, round(coalesce(avg(ecs), 0), 6) AS mean_ecs FROM ad GROUP BY 1",
    "cross_model_pairs": _BASE + "SELECT dataset, instance_id, strategy, model_a, model_b, round(j, 6) AS jaccard, round(aj, 6) AS aj FROM xa",
    "cross_model_agreement": _BASE + "SELECT dataset, strategy, count(j) AS n_pairs, round(avg(j), 6) AS mean_jaccard, count(aj) AS n_adjusted, round(avg(aj), 6) AS mean_aj FROM xa GROUP BY ALL",
    "cross_model_paired_delta": _BASE + "SELECT c.dataset, c.instance_id, round(c.j - w.e, 6) AS delta, round(c.aj - w.ea, 6) AS delta_adj FROM (SELECT dataset, instance_id, avg(j) AS j, avg(aj) AS aj FROM xa GROUP BY ALL) c JOIN (SELECT instance_id, avg(ecs) AS e, avg(ecs_adj) AS ea FROM ad GROUP BY 1) w USING (instance_id)",
    "spearman_rho": _BASE
    + """, rk AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY ecs) + (count(*) OVER (PARTITION BY model, ecs) - 1) / 2 AS a, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2 AS b FROM ad WHERE ecs IS NOT NULL)
      SELECT model, count(*) AS n, round(CASE WHEN count(*) < 3 OR min(a) = max(a) OR min(b) = max(b) THEN 0 ELSE corr(a, b) END, 6) AS rho FROM rk GROUP BY 1""",
    "lift_tiers": _BASE
    + """, q AS (SELECT ecs_lift, row_number() OVER (ORDER BY ecs_lift) - 1 AS p, count(*) OVER () AS n FROM ad WHERE ecs_lift IS NOT NULL),
      c AS (SELECT max(ecs_lift) FILTER (p = n // 3) AS c1, max(ecs_lift) FILTER (p = 2 * n // 3) AS c2, max(n) AS n FROM q)
      SELECT user_id, CASE WHEN ecs_lift IS NULL OR n < 3 THEN NULL WHEN ecs_lift <= c1 THEN 'low' WHEN ecs_lift <= c2 THEN 'mid' ELSE 'high' END AS tier FROM ad, c""",
    "holm": """
WITH p AS (SELECT event_type, user_id % 3 AS third, round(avg(event_id % 1000) / 20000, 6) AS p FROM events GROUP BY ALL),
r AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, event_type, third) + 1)) AS raw FROM p)
SELECT event_type, third, p, round(max(raw) OVER (ORDER BY p, event_type, third ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r""",
    "extremes_topn": _BASE
    + """, g AS (SELECT instance_id, max((round(ecs, 6), user_id)) AS hi, min((round(ecs, 6), user_id)) AS lo FROM ad WHERE ecs IS NOT NULL GROUP BY 1),
      h AS (SELECT 'high' AS extreme, row_number() OVER (ORDER BY hi DESC) AS position, instance_id, hi[2] AS user_id, hi[1] AS ecs FROM g),
      l AS (SELECT 'low' AS extreme, row_number() OVER (ORDER BY lo) AS position, instance_id, lo[2] AS user_id, lo[1] AS ecs FROM g)
      SELECT extreme, position::int AS position, instance_id, user_id, ecs FROM h WHERE position <= 5 UNION ALL SELECT extreme, position::int, instance_id, user_id, ecs FROM l WHERE position <= 5""",
    "measures_unpivot": _BASE + ", a AS (SELECT user_id, round(ecs, 6) AS ecs, round(ecs_adj, 6) AS ecs_adj, round(rbo, 6) AS rbo, round(tau, 6) AS kendall FROM ad LEFT JOIN rb USING (user_id) LEFT JOIN kt USING (user_id)) UNPIVOT a ON ecs, ecs_adj, rbo, kendall INTO NAME measure VALUE value",
    "cell_means_pivot": _BASE + "SELECT dataset, " + ", ".join(f"round(avg(ecs) FILTER (model = {k}), 6) AS model_{k}" for k in range(3)) + " FROM ad GROUP BY 1",
    "anti_join_resume": "SELECT user_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IS NOT NULL) WHERE r = 1 AND event_type IS DISTINCT FROM 'error'",
    "last_wins_dedup": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IS NOT NULL) WHERE r = 1",
}
