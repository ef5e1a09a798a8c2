"""Curation queries over instances and decisions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import curate
from tessella.session import materialise
from tessella.sources.tables import table

POOL, TARGET = 300, 200


def _instances(spark, sf_dir):
    return curate.instances(table(spark, sf_dir, "instances"))


def _kept(spark, sf_dir):
    rows = curate.quality_filter(_instances(spark, sf_dir)).where("reason is null").drop("reason")
    return materialise(curate.length_buckets(rows), "kept")


def content_word_count(spark, sf_dir):
    return _instances(spark, sf_dir).select("instance_id", "content_words")


def dynamic_k(spark, sf_dir):
    return _instances(spark, sf_dir).select("instance_id", tx.dynamic_k(F.col("content_words")).alias("k"))


def quality_filter_reasons(spark, sf_dir):
    return curate.quality_filter(_instances(spark, sf_dir)).select("instance_id", "reason")


def quality_filter_tally(spark, sf_dir):
    return curate.tally(curate.quality_filter(_instances(spark, sf_dir)))


def length_buckets(spark, sf_dir):
    return _kept(spark, sf_dir).select("instance_id", "length_bucket")


def stratified_pool(spark, sf_dir):
    return curate.stratified_pool(_kept(spark, sf_dir), POOL, ["label", "length_bucket"]).groupBy("dataset", "label", "length_bucket").agg(F.count("*").alias("n"))


def stratified_pool_rows(spark, sf_dir):
    return curate.stratified_pool(_kept(spark, sf_dir), POOL, ["label", "length_bucket"]).select("instance_id", "dataset", "label", "length_bucket")


def near_dedup_pool(spark, sf_dir):
    pool = curate.stratified_pool(_kept(spark, sf_dir), POOL, ["label", "length_bucket"])
    return curate.greedy_near_dedup(pool).select("instance_id", "dataset")


def balanced_quotas(spark, sf_dir):
    rows = _kept(spark, sf_dir).where("label is not null")
    return curate.balanced_quotas(rows.groupBy("dataset", "label").agg(F.count("*").alias("available")), TARGET)


def select_balanced(spark, sf_dir):
    rows = _kept(spark, sf_dir).where("label is not null")
    return curate.select_balanced(rows, TARGET, ["genre", "length_bucket"]).groupBy("dataset", "label").agg(F.count("*").alias("n"))


def sample_balanced(spark, sf_dir):
    return curate.sample_balanced(_kept(spark, sf_dir), 120).select("instance_id", "dataset", "label")


def apply_decisions(spark, sf_dir):
    return curate.apply_decisions(_instances(spark, sf_dir), table(spark, sf_dir, "decisions")).select("instance_id", "verdict")


def decision_tally(spark, sf_dir):
    return curate.tally(curate.apply_decisions(_instances(spark, sf_dir), table(spark, sf_dir, "decisions")), "verdict")


def unknown_decisions(spark, sf_dir):
    """Decisions about texts that the gates dropped."""
    return curate.unknown_decisions(curate.quality_filter(_instances(spark, sf_dir)).where("reason is null"), table(spark, sf_dir, "decisions")).select("instance_id", "decision")


def label_distribution(spark, sf_dir):
    rows = _kept(spark, sf_dir)
    out = None
    for axis in ("label", "genre", "length_bucket"):
        d = curate.distribution(rows, ["dataset"], axis)
        out = d if out is None else out.unionByName(d)
    return out


def dataset_statistics(spark, sf_dir):
    return curate.statistics(_instances(spark, sf_dir)).select("dataset", "total", "average_text_length")


def seeded_slice(spark, sf_dir):
    """The first 50 instances of a seeded shuffle (the operator is a sample)."""
    return _instances(spark, sf_dir).withColumn("h", curate.draw(7)).orderBy("h").limit(50).select("instance_id")


def exact_dedup(spark, sf_dir):
    """Documents that repeat an earlier one's normalised text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalized_key(F.col("text"))).alias("key")).where("key is not null")
    first = docs.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "key").where("doc_id > first_id").select("doc_id", "first_id")


def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


def erase_mask(spark, sf_dir):
    return _erased(spark, sf_dir, "mask")


def erase_delete(spark, sf_dir):
    return _erased(spark, sf_dir, "delete")


# The words that the erasure queries take out.
ERASED = ["not", "no", "never", "nobody", "the", "a", "positive", "negative", "neutral", "hypothesis", "premise"]


def _erased(spark, sf_dir, operator):
    tokens = F.array(*[F.lit(w) for w in ERASED])
    return _instances(spark, sf_dir).select("instance_id", tx.erase(F.col("text"), tokens, operator).alias("text"))


def normalized_tokens(spark, sf_dir):
    return _instances(spark, sf_dir).where("text is not null").select("instance_id", F.array_join(tx.normalize_tokens(tx.words(F.col("text"))), " ").alias("tokens"))


PROMPTS = ["rationale_explain_prompt", "counterfactual_explain_prompt", "confidence_prompt"]
REPLIES = ["raw_highlighting", "raw_rank_ordering", "raw_rationale", "raw_counterfactual", "confidence_raw_response"]


def prompt_hash(spark, sf_dir):
    """The hash of every prompt of every result."""
    rows = table(spark, sf_dir, "instance_results").select("result_id", *PROMPTS).unpivot("result_id", PROMPTS, "prompt", "text")
    return rows.where("text is not null").select("result_id", "prompt", tx.prompt_hash(F.col("text")).alias("hash"))


def refusals(spark, sf_dir):
    """Whether each reply of each result holds a phrase of refusal."""
    rows = table(spark, sf_dir, "instance_results").select("result_id", *REPLIES).unpivot("result_id", REPLIES, "reply", "text")
    return rows.select("result_id", "reply", tx.is_refusal(F.col("text")).alias("is_refusal"))


_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_WORDS = f"list_filter(list_transform(regexp_split_to_array(text, '{_SPACE}'), lambda w: lower(trim(w, '{_PUNCT}'))), lambda w: w <> '')"
_I = f"""
WITH raw AS (SELECT instance_id, min((loaded_at, text, nullif(lower(trim(label)), ''), nullif(lower(trim(metadata.genre)), ''), dataset)) AS x FROM instances WHERE instance_id IS NOT NULL GROUP BY 1),
i AS (SELECT instance_id, x[2] AS text, x[3] AS label, x[4] AS genre, x[5] AS dataset FROM raw),
w AS (SELECT *, {_WORDS} AS ws, coalesce(len({_WORDS}), 0) AS content_words FROM i),
g AS (SELECT *, CASE WHEN text IS NULL OR regexp_full_match(text, '(?s){_SPACE[:-1]}*') THEN 'empty' WHEN content_words < {curate.MIN_WORDS} THEN 'too_short' WHEN length(text) > {curate.MAX_CHARS} THEN 'too_long'
  WHEN regexp_matches(text, '<[^>]+>|&[a-zA-Z]+;|#\\d+;') OR length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / length(text) > 0.3 THEN 'junk' END AS r0 FROM w),
q AS (SELECT *, CASE WHEN r0 IS NULL AND min(CASE WHEN r0 IS NULL THEN instance_id END) OVER (PARTITION BY r0, array_to_string(ws, ' ')) < instance_id THEN 'exact_dup' ELSE r0 END AS reason FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY content_words) - 1 AS p, count(*) OVER (PARTITION BY dataset) AS n FROM q WHERE reason IS NULL),
cut AS (SELECT dataset, max(content_words) FILTER (p = n // 3) AS t1, max(content_words) FILTER (p = 2 * n // 3) AS t2 FROM n GROUP BY 1),
k AS (SELECT n.*, CASE WHEN content_words <= t1 THEN 'short' WHEN content_words <= t2 THEN 'medium' ELSE 'long' END AS length_bucket, md5('42:' || instance_id) AS h, md5('43:' || instance_id) AS h2
  FROM n JOIN cut ON n.dataset IS NOT DISTINCT FROM cut.dataset),
st AS (SELECT dataset, label, length_bucket, row_number() OVER (PARTITION BY dataset ORDER BY label NULLS FIRST, length_bucket) AS o, count(*) OVER (PARTITION BY dataset) AS c FROM k GROUP BY dataset, label, length_bucket),
pk AS (SELECT k.*, row_number() OVER (PARTITION BY k.dataset, k.label, k.length_bucket ORDER BY h) AS r, {POOL} // c + (o <= {POOL} % c)::int AS quota
  FROM k JOIN st ON k.dataset IS NOT DISTINCT FROM st.dataset AND k.label IS NOT DISTINCT FROM st.label AND k.length_bucket = st.length_bucket),
lo AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY h2) AS r2 FROM pk WHERE r > quota),
pool AS (SELECT instance_id, dataset, label, length_bucket FROM pk WHERE r <= quota UNION ALL SELECT instance_id, lo.dataset, label, length_bucket FROM lo
  JOIN (SELECT dataset, {POOL} - count(*) AS short FROM pk WHERE r <= quota GROUP BY 1) s ON s.dataset IS NOT DISTINCT FROM lo.dataset WHERE r2 <= short),
d AS (SELECT instance_id, x[2] AS decision, x[3] AS reason FROM (SELECT instance_id, max((decided_at, decision, reason)) AS x FROM decisions GROUP BY 1)),
v AS (SELECT i.instance_id, CASE WHEN decision IS NULL THEN 'undecided' WHEN lower(trim(decision)) = 'keep' THEN 'keep' ELSE coalesce(nullif(trim(d.reason), ''), 'unspecified') END AS verdict FROM i LEFT JOIN d USING (instance_id))
"""
# what an even split leaves open is given out row by row, in rounds over the labels that have rows left
_QUOTAS = f""", la AS (SELECT dataset, label, count(*) AS available FROM k WHERE label IS NOT NULL GROUP BY ALL),
lb AS (SELECT *, least({TARGET}, sum(available) OVER (PARTITION BY dataset))::bigint AS t, row_number() OVER (PARTITION BY dataset ORDER BY label) AS o, count(*) OVER (PARTITION BY dataset) AS c FROM la),
lc AS (SELECT *, least(available, t // c + (o <= t % c)::int) AS base FROM lb),
ld AS (SELECT *, t - sum(base) OVER (PARTITION BY dataset) AS deficit FROM lc),
le AS (SELECT dataset, label, deficit, row_number() OVER (PARTITION BY dataset ORDER BY turn, o) AS place FROM (SELECT *, unnest(range(available - base)) AS turn FROM ld)),
lf AS (SELECT dataset, label, count(*) AS extra FROM le WHERE place <= deficit GROUP BY ALL),
bq AS (SELECT ld.dataset, ld.label, available, (base + coalesce(extra, 0))::bigint AS quota FROM ld LEFT JOIN lf ON lf.dataset IS NOT DISTINCT FROM ld.dataset AND lf.label = ld.label)
"""
_ERASED = "[" + ", ".join(f"'{w}'" for w in ERASED) + "]"
_BARE = "lower(trim(w, '.,!?;:()[]{}''\"'))"
_TOKENS = f"list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '')"

QUERIES = {
    f.__name__: f
    for f in (
        content_word_count, dynamic_k, quality_filter_reasons, quality_filter_tally, length_buckets, stratified_pool, stratified_pool_rows, near_dedup_pool, balanced_quotas, select_balanced, sample_balanced,
        apply_decisions, decision_tally, unknown_decisions, label_distribution, dataset_statistics, seeded_slice, exact_dedup, clean_html, erase_mask, erase_delete, normalized_tokens, prompt_hash, refusals,
    )
}
ORACLE = {
    "content_word_count": _I + "SELECT instance_id, content_words::int AS content_words FROM w",
    "dynamic_k": _I + "SELECT instance_id, greatest(3, round_even(content_words / 5, 0))::int AS k FROM w",
    "quality_filter_reasons": _I + "SELECT instance_id, reason FROM q",
    "quality_filter_tally": _I + "SELECT reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY 1",
    "length_buckets": _I + "SELECT instance_id, length_bucket FROM k",
    "stratified_pool": _I + "SELECT dataset, label, length_bucket, count(*) AS n FROM pool GROUP BY ALL",
    "stratified_pool_rows": _I + "SELECT * FROM pool",
    "sample_balanced": _I
    + """, c AS (SELECT dataset, label, count(*) AS c FROM k WHERE label IS NOT NULL GROUP BY ALL), s AS (SELECT dataset, least(greatest(120 // count(*), 1), min(c)) AS q FROM c GROUP BY 1)
      SELECT instance_id, dataset, label FROM (SELECT k.*, q, row_number() OVER (PARTITION BY k.dataset, label ORDER BY h) AS r FROM k JOIN s ON k.dataset IS NOT DISTINCT FROM s.dataset WHERE label IS NOT NULL) WHERE r <= q""",
    "apply_decisions": _I + "SELECT * FROM v",
    "decision_tally": _I + "SELECT verdict, count(*) AS n FROM v GROUP BY 1",
    "unknown_decisions": _I + "SELECT instance_id, lower(trim(decision)) AS decision FROM d WHERE instance_id NOT IN (SELECT instance_id FROM k)",
    "label_distribution": _I + "SELECT dataset, axis, coalesce(category, 'n/a') AS category, count(*) AS n FROM (SELECT dataset, 'label' AS axis, label AS category FROM k UNION ALL SELECT dataset, 'genre', genre FROM k UNION ALL SELECT dataset, 'length_bucket', length_bucket FROM k) GROUP BY ALL",
    "dataset_statistics": _I + "SELECT dataset, count(*) AS total, round(avg(length(text)), 6) AS average_text_length FROM i GROUP BY 1",
    "seeded_slice": "SELECT instance_id FROM (SELECT DISTINCT instance_id FROM instances WHERE instance_id IS NOT NULL) ORDER BY md5('7:' || instance_id) LIMIT 50",
    "exact_dedup": f"WITH k AS (SELECT doc_id, array_to_string({_WORDS}, ' ') AS key FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS first_id FROM k) SELECT * FROM f WHERE doc_id > first_id",
    "erase_mask": _I + f"SELECT instance_id, array_to_string(list_transform({_TOKENS}, lambda w: CASE WHEN list_contains({_ERASED}, {_BARE}) THEN '[MASK]' ELSE w END), ' ') AS text FROM i",
    "erase_delete": _I + f"SELECT instance_id, array_to_string(list_filter({_TOKENS}, lambda w: NOT list_contains({_ERASED}, {_BARE})), ' ') AS text FROM i",
    "balanced_quotas": _I + _QUOTAS + "SELECT dataset, label, available, quota FROM bq",
    "select_balanced": _I + _QUOTAS + "SELECT dataset, label, quota AS n FROM bq WHERE quota > 0",
    "prompt_hash": "SELECT result_id, prompt, substr(sha256(text), 1, 16) AS hash FROM (UNPIVOT (SELECT result_id, " + ", ".join(PROMPTS) + " FROM instance_results) ON " + ", ".join(PROMPTS) + " INTO NAME prompt VALUE text)",
    "refusals": "SELECT result_id, reply, coalesce(regexp_matches(lower(text), 'i cannot|i can''t|i''m unable|i am unable|not able to|i apologize|i''m sorry|i am sorry|cannot fulfill|cannot complete|not appropriate|against policy|not permitted'), false) AS is_refusal FROM (SELECT result_id, " + ", ".join(REPLIES) + " FROM instance_results) UNPIVOT INCLUDE NULLS (text FOR reply IN (" + ", ".join(REPLIES) + "))",
}
