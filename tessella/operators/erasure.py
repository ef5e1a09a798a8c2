"""Erasure: what happens to a prediction when the words of the evidence are masked or deleted.

Predictions of erased texts are an input table keyed by model and text hash, as no model runs here; a text without a
prediction has an undefined flip, and undefined flips are left out of rates, which are null where nothing is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import measures as m
from tessella.functions import text as tx
from tessella.functions.stage import settled

OPERATORS = ("mask", "delete")
SEED, TRIALS = 42, 5


def known_predictions(results: DataFrame) -> DataFrame:
    """model, text_hash, label: the last prediction for each text."""
    rows = results.where("text is not null and predicted_label is not null")
    return rows.groupBy(F.lower(F.trim("model")).alias("model"), F.sha2("text", 256).alias("text_hash")).agg(F.max_by("predicted_label", F.struct("recorded_at", "result_id")).alias("label"))


def word_scorer(text: Column, labels: Column) -> Column:
    """A fixed linear classifier: the label with the largest sum of its words' weights (-100 to 100, by a checksum of label and
    word), the first of equals. Stands in for a model where none runs."""
    low = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    weight = lambda label, w: F.pmod(F.crc32(F.concat(label, F.lit(":"), w)), F.lit(201)) - 100
    sums = F.transform(labels, lambda x, i: F.struct(F.aggregate(low, F.lit(0).cast("bigint"), lambda s, w: s + weight(x, w)).alias("s"), (-i).alias("i"), x.alias("label")))
    return F.array_max(sums)["label"]


def targets(rows: DataFrame) -> DataFrame:
    """rows with one row per target: the four evidence sets, both consensus cores, and random words of the core's size
    (seeded, TRIALS draws)."""
    sets = [F.struct(F.lit(s).alias("target"), F.lit(0).alias("trial"), F.col(s).alias("tokens")) for s in m.STRATEGIES]
    core = m.consensus_core([F.col(s) for s in m.STRATEGIES], 3)
    pool = F.array_distinct(tx.stripped_words(F.col("text")))
    out = settled(rows, {"_core": core, "_pool": pool})
    some = lambda i: F.transform(F.slice(F.array_sort(F.transform("_pool", lambda w: F.struct(F.md5(F.concat(F.lit(f"{SEED}:{i}:"), F.col("result_id").cast("string"), F.lit(":"), w)).alias("h"), w.alias("w")))), 1, F.greatest(F.size("_core"), F.lit(1))), lambda e: e["w"])
    cores = [F.struct(F.lit("cc3").alias("target"), F.lit(0).alias("trial"), F.col("_core").alias("tokens")), F.struct(F.lit("cc4").alias("target"), F.lit(0).alias("trial"), m.consensus_core([F.col(s) for s in m.STRATEGIES], 4).alias("tokens"))]
    random = [F.struct(F.lit("random").alias("target"), F.lit(i).alias("trial"), F.when(F.size("_core") > 0, some(i)).alias("tokens")) for i in range(TRIALS)]
    return out.select("result_id", "model", "dataset", "instance_id", "text", "predicted_label", F.explode(F.array(*sets, *cores, *random)).alias("x")).select("result_id", "model", "dataset", "instance_id", "text", "predicted_label", "x.target", "x.trial", "x.tokens").where(F.size("tokens") > 0)


def _erased(rows: DataFrame) -> DataFrame:
    """The targets with both operators' erased texts."""
    each = settled(targets(rows), {"_low": F.transform("tokens", lambda t: F.lower(t))})
    both = F.explode(F.array(*[F.struct(F.lit(o).alias("operator"), tx.erase(F.col("text"), F.col("_low"), o).alias("erased")) for o in OPERATORS]))
    return each.withColumn("x", both).select("result_id", "model", "dataset", "instance_id", "text", "predicted_label", "target", "trial", F.size("tokens").alias("n"), "x.operator", "x.erased")


_FLIPS = ("result_id", "model", "dataset", "instance_id", "target", "trial", "operator", "n")


def flips(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """result_id, model, dataset, target, trial, operator, n, flipped (null without a prediction for the erased text)."""
    long = _erased(rows).withColumn("text_hash", F.sha2("erased", 256))
    return long.join(predictions, ["model", "text_hash"], "left").select(*_FLIPS, (F.col("label") != F.col("predicted_label")).alias("flipped"))


def scored_flips(rows: DataFrame, labels: Column) -> DataFrame:
    """As flips, with the word scorer's labels of the text and of the erased text."""
    before = settled(rows, {"predicted_label": word_scorer(F.col("text"), labels)})
    return _erased(before).select(*_FLIPS, (word_scorer(F.col("erased"), labels) != F.col("predicted_label")).alias("flipped"))


def per_instance(flipped: DataFrame) -> DataFrame:
    """One row per result, target and operator; random targets have the mean over their trials."""
    return flipped.groupBy("result_id", "model", "dataset", "target", "operator").agg(F.avg(F.col("flipped").cast("double")).alias("flip_rate"), F.max("n").alias("n"))


def rates(flipped: DataFrame) -> DataFrame:
    """model (null: pooled), target, operator, n_defined, rate."""
    return per_instance(flipped).groupingSets([[F.col("model"), F.col("target"), F.col("operator")], [F.col("target"), F.col("operator")]], F.col("model"), F.col("target"), F.col("operator")).agg(F.count("flip_rate").alias("n_defined"), F.avg("flip_rate").alias("rate"))


def core_gaps(flipped: DataFrame) -> DataFrame:
    """result_id, model, operator, gap: flip of the core less that of random words, where both are defined."""
    own = per_instance(flipped)
    rate = lambda t: F.max(F.when(F.col("target") == t, F.col("flip_rate")))
    return own.groupBy("result_id", "model", "operator").agg((rate("cc3") - rate("random")).alias("gap")).where("gap is not null")
