"""Agreement of the same evidence between models on the same instance.

Pairs of models are made within an instance's array of models, so nothing is joined with itself. Instances of one model
have no pair; an empty side leaves a pair undefined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import measures as m
from tessella.functions.stage import settled


def model_pairs(rows: DataFrame) -> DataFrame:
    """dataset, instance_id, strategy, model_a < model_b, jaccard and aj with the larger vocabulary of the two."""
    each = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("tokens")) for s in m.STRATEGIES])
    held = rows.groupBy("dataset", "instance_id").agg(F.array_sort(F.collect_list(F.struct("model", each.alias("sets"), "vocabulary"))).alias("models")).where(F.size("models") > 1)
    pairs = F.flatten(F.transform("models", lambda a, i: F.transform(F.slice("models", i + 2, F.size("models")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    long = held.select("dataset", "instance_id", F.explode(pairs).alias("p")).select("dataset", "instance_id", "p.a", "p.b", F.posexplode("p.a.sets").alias("i", "x"))
    long = long.select("dataset", "instance_id", F.col("x.strategy").alias("strategy"), F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), F.col("x.tokens").alias("ta"), F.col("b.sets")[F.col("i")]["tokens"].alias("tb"), F.greatest("a.vocabulary", "b.vocabulary").alias("v"))
    long = settled(long.withColumn("v", F.greatest("v", F.size(F.array_union("ta", "tb")))), {"jaccard": m.jaccard(F.col("ta"), F.col("tb"))})
    long = settled(long, {"chance": F.when(F.col("jaccard").isNotNull(), m.expected_jaccard(F.size("ta"), F.size("tb"), F.col("v")))})
    return long.select("dataset", "instance_id", "strategy", "model_a", "model_b", "jaccard", m.adjusted(F.col("jaccard"), F.size("ta"), F.size("tb"), F.col("chance")).alias("aj"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Mean raw and adjusted agreement between models by dataset and strategy."""
    return pairs.groupBy("dataset", "strategy").agg(F.count("jaccard").alias("n_pairs"), F.avg("jaccard").alias("mean_jaccard"), F.count("aj").alias("n_adjusted"), F.avg("aj").alias("mean_aj"))


def paired_delta(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per instance with two models or more: mean over model pairs less mean within models, raw and adjusted."""
    cross = pairs.groupBy("dataset", "instance_id").agg(F.avg("jaccard").alias("cross"), F.avg("aj").alias("cross_adj"))
    within = rows.groupBy("dataset", "instance_id").agg(F.avg("ecs").alias("within"), F.avg("ecs_adj").alias("within_adj"))
    return cross.join(within, ["dataset", "instance_id"]).select("dataset", "instance_id", (F.col("cross") - F.col("within")).alias("delta"), (F.col("cross_adj") - F.col("within_adj")).alias("delta_adj"))
