"""Curation of labelled texts: gates, exact duplicates, length buckets, stratified pools, decisions, selection, datasheet.

Orders that decide are explicit: rows have an id, seeded draws go by md5 of seed and id. Ranks within a stratum are taken
in parts first (the best of each part, then of those), exact duplicates by aggregation, cut points from counts, so no hot
stratum, key or table is gathered in one task.

Defined results: null texts are empty (first gate); null labels and genres are strata of their own, named n/a in
distributions; null ids are left out; repeated ids count once (smallest text); empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as tx

REASONS = ("empty", "too_short", "too_long", "junk", "exact_dup")
MIN_WORDS, MAX_CHARS, NON_ASCII = 3, 600, 0.3
SEED = 42
#: Parts of a stratum whose best ranks are taken first.
PARTS = 16
#: Rows that the greedy near-duplicate pass takes in at most; it is for pools, larger sets have other operators.
POOL_LIMIT = 5000


def instances(rows: DataFrame) -> DataFrame:
    """instance_id, text, label, genre, dataset once per id, with content_words counted from the text."""
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    once = rows.where("instance_id is not null").groupBy("instance_id").agg(F.min(F.struct(F.col("loaded_at"), "text", clean(F.col("label")).alias("label"), clean(F.col("metadata.genre")).alias("genre"), "dataset")).alias("x"))
    return once.select("instance_id", F.col("x.text").alias("text"), F.col("x.label").alias("label"), F.col("x.genre").alias("genre"), F.col("x.dataset").alias("dataset"), tx.content_word_count(F.col("x.text")).alias("content_words"))


def gate(text: Column, content_words: Column, min_words: int = MIN_WORDS, max_chars: int = MAX_CHARS) -> Column:
    """First reason to drop a text, null if none: empty, too_short, too_long, junk."""
    return (
        F.when(text.isNull() | (F.btrim(F.regexp_replace(text, r"(?U)\s+", "")) == ""), "empty")
        .when(content_words < min_words, "too_short")
        .when(F.length(text) > max_chars, "too_long")
        .when(tx.has_markup(text) | (tx.non_ascii_share(text) > NON_ASCII), "junk")
    )


def quality_filter(rows: DataFrame, id_col: str = "instance_id", min_words: int = MIN_WORDS, max_chars: int = MAX_CHARS) -> DataFrame:
    """rows with reason: null for kept ones. Of equal keys among rows that passed the gates the smallest id is kept."""
    gated = rows.withColumn("reason", gate(F.col("text"), F.col("content_words"), min_words, max_chars)).withColumn("_key", F.when(F.col("reason").isNull(), F.md5(tx.normalized_key(F.col("text")))))
    first = gated.where("_key is not null").groupBy("_key").agg(F.min(id_col).alias("_first"))
    out = gated.join(first, "_key", "left")
    return out.withColumn("reason", F.when(F.col("_first") < F.col(id_col), "exact_dup").otherwise(F.col("reason"))).drop("_key", "_first")


def tally(rows: DataFrame, column: str = "reason") -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def tertiles(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """group..., t1, t2: values at positions n // 3 and 2n // 3 of the sorted values, from counts per value."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("c"))
    up = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = counts.withColumn("end", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy(*group)))
    holds = lambda k: F.max(F.when((F.expr(f"({k} * n) div 3") < F.col("end")) & (F.expr(f"({k} * n) div 3") >= F.col("end") - F.col("c")), F.col(value)))
    return at.groupBy(*group).agg(holds(1).alias("t1"), holds(2).alias("t2"))


def length_buckets(rows: DataFrame, group: str = "dataset", value: str = "content_words") -> DataFrame:
    """rows with length_bucket by the tertiles of their group."""
    cuts = tertiles(rows, [group], value).withColumnRenamed(group, "_g")
    c = F.col(value)
    return rows.join(cuts, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("length_bucket", F.when(c <= F.col("t1"), "short").when(c <= F.col("t2"), "medium").otherwise("long")).drop("_g", "t1", "t2")


def draw(seed: int, id_col: str = "instance_id") -> Column:
    """Seeded order of ids that SQL engines agree on."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def best_of(rows: DataFrame, keys: list[str], quota: Column, id_col: str = "instance_id", seed: int = SEED, rank: str = "_rank") -> DataFrame:
    """rows with their rank in the seeded order of their stratum, for ranks up to quota (a column of the rows)."""
    h = rows.withColumn("_h", draw(seed, id_col)).withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(PARTS)))
    first = h.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h", id_col))).where(F.col("_r") <= quota)
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy("_h", id_col))).where(F.col(rank) <= quota).drop("_h", "_part", "_r")


def stratum_quotas(rows: DataFrame, group: str, axes: list[str], size: int) -> DataFrame:
    """group, axes..., quota: size split evenly over the strata of a group, the remainder to the first in key order."""
    strata = rows.groupBy(group, *axes).agg(F.count("*").alias("available"))
    w = Window.partitionBy(group).orderBy(*axes)
    n = F.count("*").over(Window.partitionBy(group))
    return strata.withColumn("quota", F.floor(F.lit(size) / n) + (F.row_number().over(w) <= F.lit(size) % n).cast("int"))


def _on(a: list[str], suffix: str = "_q") -> Column:
    out = None
    for c in a:
        e = F.col(c).eqNullSafe(F.col(c + suffix))
        out = e if out is None else out & e
    return out


def stratified_pool(rows: DataFrame, size: int, axes: list[str], group: str = "dataset", seed: int = SEED) -> DataFrame:
    """Up to size rows per group: each stratum its quota in seeded order, topped up from the leftovers of all strata."""
    keys = [group, *axes]
    quotas = stratum_quotas(rows, group, axes, size).withColumnsRenamed({k: f"{k}_q" for k in keys})
    have = rows.join(quotas, _on(keys)).drop(*[f"{k}_q" for k in keys])
    picked = best_of(have, keys, F.col("quota"), seed=seed)
    short = picked.groupBy(group).agg((F.lit(size) - F.count("*")).alias("short")).withColumnRenamed(group, "_g")
    left = have.join(picked.select("instance_id"), "instance_id", "left_anti").join(short, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    more = best_of(left, [group], F.col("short"), seed=seed + 1)
    return picked.select(*rows.columns).unionByName(more.select(*rows.columns))


def balanced_quotas(labels: DataFrame, target: int, group: str = "dataset") -> DataFrame:
    """group, label, quota: target split evenly over a group's labels and capped by what is available; what is missing goes
    round the labels in key order, one at a time, to those with rows left (closed form by water filling)."""
    w = Window.partitionBy(group).orderBy("label")
    n = F.count("*").over(Window.partitionBy(group))
    total = F.sum("available").over(Window.partitionBy(group))
    t = F.least(F.lit(target), total)
    at = labels.withColumn("k", F.row_number().over(w)).withColumn("t", t).withColumn("even", F.floor(F.col("t") / n) + (F.row_number().over(w) <= F.col("t") % n).cast("int"))
    at = at.withColumn("base", F.least("even", "available")).withColumn("room", F.col("available") - F.col("base"))
    at = at.withColumn("deficit", F.col("t") - F.sum("base").over(Window.partitionBy(group)))
    # after L full rounds the labels have given sum(min(room, L)); the last round stops where the deficit is used up. The labels
    # in the order of their room tell the level: up to the room of the i-th, its forerunners are used up, the others alike
    up = Window.partitionBy(group).orderBy("room", "label")
    at = at.withColumn("n", n).withColumn("i", F.row_number().over(up))
    at = at.withColumn("given", F.sum("room").over(up.rowsBetween(Window.unboundedPreceding, 0)) + F.col("room") * (F.col("n") - F.col("i")))
    within = F.col("given") <= F.col("deficit")
    last = F.max(F.when(within, F.struct("i", "room", "given"))).over(Window.partitionBy(group))
    at = at.withColumn("last", F.coalesce(last, F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("room"), F.lit(0).cast("long").alias("given"))))
    more = F.coalesce(F.floor(F.try_divide(F.col("deficit") - F.col("last.given"), F.col("n") - F.col("last.i"))), F.lit(0))
    at = at.withColumn("level", F.col("last.room") + more).withColumn("rest", F.col("deficit") - F.col("last.given") - more * (F.col("n") - F.col("last.i")))
    takes = (F.col("room") > F.col("level")).cast("int")
    at = at.withColumn("extra", F.least("room", "level") + F.when((takes == 1) & (F.sum(takes).over(w.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("rest")), 1).otherwise(0))
    return at.select(group, "label", "available", (F.col("base") + F.col("extra")).cast("long").alias("quota"))


def select_balanced(rows: DataFrame, target: int, sub_axes: list[str], group: str = "dataset", seed: int = SEED) -> DataFrame:
    """rows reduced to target per group, balanced by label, each label spread over its other strata."""
    quotas = balanced_quotas(rows.groupBy(group, "label").agg(F.count("*").alias("available")), target, group)
    keys = [group, "label", *sub_axes]
    w = Window.partitionBy(group, "label").orderBy(*sub_axes)
    strata = rows.groupBy(*keys).agg(F.count("*").alias("have"))
    q = quotas.withColumnsRenamed({group: f"{group}_q", "label": "label_q"}).drop("available")
    n = F.count("*").over(Window.partitionBy(group, "label"))
    own = strata.join(q, _on([group, "label"])).withColumn("stratum_quota", F.floor(F.col("quota") / n) + (F.row_number().over(w) <= F.col("quota") % n).cast("int"))
    own = own.select(*[F.col(k).alias(f"{k}_q") for k in keys], "quota", "stratum_quota")
    have = rows.join(own, _on(keys)).drop(*[f"{k}_q" for k in keys])
    picked = best_of(have, keys, F.col("stratum_quota"), seed=seed)
    count = picked.groupBy(group, "label").agg(F.count("*").alias("got"))
    need = q.join(count.withColumnsRenamed({group: "_g", "label": "_l"}), F.col(f"{group}_q").eqNullSafe(F.col("_g")) & F.col("label_q").eqNullSafe(F.col("_l")), "left").select(f"{group}_q", "label_q", (F.col("quota") - F.coalesce("got", F.lit(0))).alias("short"))
    left = have.join(picked.select("instance_id"), "instance_id", "left_anti").join(need, _on([group, "label"])).drop(f"{group}_q", "label_q")
    more = best_of(left, [group, "label"], F.col("short"), seed=seed + 1)
    return picked.select(*rows.columns).unionByName(more.select(*rows.columns))


def sample_balanced(rows: DataFrame, size: int, group: str = "dataset", seed: int = SEED) -> DataFrame:
    """Of each label as many rows: min(max(size // labels, 1), rows of the scarcest label); unlabelled rows are left out."""
    labelled = rows.where("label is not null")
    counts = labelled.groupBy(group, "label").agg(F.count("*").alias("c")).groupBy(group).agg(F.least(F.greatest(F.floor(F.lit(size) / F.count("*")), F.lit(1)), F.min("c")).cast("long").alias("q")).withColumnRenamed(group, "_g")
    have = labelled.join(counts, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return best_of(have, [group, "label"], F.col("q"), seed=seed).drop("q", "_rank")


def last_decisions(decisions: DataFrame) -> DataFrame:
    """instance_id, decision (lower case), reason: the last decision of each id."""
    return decisions.where("instance_id is not null").groupBy("instance_id").agg(F.max(F.struct("decided_at", "decision", "reason")).alias("x")).select("instance_id", F.lower(F.trim("x.decision")).alias("decision"), F.col("x.reason").alias("reason"))


def apply_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows with verdict: keep, undecided, or the reason to drop (unspecified where there is none)."""
    verdict = F.when(F.col("decision").isNull(), "undecided").when(F.col("decision") == "keep", "keep").otherwise(F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("unspecified")))
    return rows.join(last_decisions(decisions), "instance_id", "left").withColumn("verdict", verdict).drop("decision", "reason")


def unknown_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    return last_decisions(decisions).join(rows.select("instance_id"), "instance_id", "left_anti")


def distribution(rows: DataFrame, group: list[str], axis: str) -> DataFrame:
    """group..., axis, category, n: value counts, missing ones as n/a."""
    return rows.groupBy(*group, F.coalesce(F.col(axis), F.lit("n/a")).alias("category")).agg(F.count("*").alias("n")).select(*group, F.lit(axis).alias("axis"), "category", "n")


def statistics(rows: DataFrame, group: str = "dataset") -> DataFrame:
    """group, total, average_text_length, label_distribution (JSON, by label)."""
    per = rows.groupBy(group, F.coalesce("label", F.lit("n/a")).alias("label")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count("text").alias("texts"))
    return per.groupBy(group).agg(F.sum("n").alias("total"), F.round(F.sum("chars") / F.sum("texts"), 6).alias("average_text_length"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n"))))).alias("label_distribution"))


def greedy_near_dedup(rows: DataFrame, group: str = "dataset", threshold: float = 0.9, seed: int = SEED) -> DataFrame:
    """rows of a pool kept in seeded order if under threshold Jaccard similarity to all kept before. For pools of at most
    POOL_LIMIT rows per group; larger groups are refused."""
    import pandas as pd

    schema = rows.withColumn("_h", draw(seed)).schema

    def run(d: pd.DataFrame) -> pd.DataFrame:
        if len(d) > POOL_LIMIT:
            raise ValueError(f"a pool of {len(d)} rows; at most {POOL_LIMIT} are compared greedily")
        d = d.sort_values(["_h", "instance_id"])
        kept: list[set] = []
        keep = []
        for t in d["_tokens"]:
            own = set(t)
            near = any(len(own & k) >= threshold * len(own | k) if own | k else True for k in kept)
            keep.append(not near)
            if not near:
                kept.append(own)
        return d[keep].drop(columns="_tokens")

    with_tokens = rows.withColumn("_h", draw(seed)).withColumn("_tokens", tx.token_set(F.coalesce("text", F.lit(""))))
    return with_tokens.groupBy(group).applyInPandas(run, schema).drop("_h")
