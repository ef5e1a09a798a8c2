"""Mixing sources to target weights, by a low-discrepancy schedule of equal-token blocks.

The tokens of all documents are cut into slots of ``block_tokens``. Slot k gets the point frac(k * golden ratio), which
falls into the interval of one source on the line of cumulative weights; the slots of a source are ranked, and its r-th
slot takes the r-th block of the source's shuffled token stream, starting over up to max_repeats times. Slots beyond the
last repeat stay unfilled: the source falls short. Ranks and running token sums are taken within buckets whose sums are
added up first, so no source is ever one task.

Defined results for unusual input: null and empty texts have no tokens; sources are compared trimmed and in lower case;
documents of other or null sources are not used but count for the total size; a source named twice in the targets has
the sum of its weights and the most repeats; weights are relative to their sum; null or negative weights and repeats are 0; sources without documents are
reported with 0 tokens; repeated rows of documents count as separate documents; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEED = 42
#: Slots aimed at, and the bounds of a block's tokens.
SLOTS = 16_384
LEAST_BLOCK, MOST_BLOCK = 64, 16_384
#: Documents of a source in a bucket, about.
BUCKET = 20_000
#: Cells on the line of cumulative weights by which slots are joined with sources.
CELLS = 1024
# The pattern that splits text before merges, and 2**32 divided by the golden ratio.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GOLDEN = 2654435769


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Batch encoder of a rank file (.tiktoken), a tokenizers file (.json) or a sentencepiece model (.model)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(e.encode_ordinary(t)) for t in texts]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source_name, tokens of every document."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.trim(F.col(source_col))).alias("source_name"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count(b.column(2).to_pylist()), pa.int64())], names=["doc_id", "source_name", "tokens"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, source_name string, tokens bigint")


def clean_targets(targets: DataFrame) -> DataFrame:
    """source_name, target_weight (of 1), max_repeats once per source."""
    each = (
        targets.where("source_name is not null")
        .groupBy(F.lower(F.trim("source_name")).alias("source_name"))
        .agg(F.sum(F.greatest(F.coalesce(F.col("target_weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("w"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    )
    whole = each.agg(F.sum("w").alias("all"))
    share = F.coalesce(F.try_divide("w", "all"), F.lit(0.0))
    # sums that miss 1 by rounding only are left as they are
    return each.join(F.broadcast(whole)).select("source_name", F.when(F.abs(F.col("all") - 1) < 1e-6, F.col("w")).otherwise(share).alias("target_weight"), "max_repeats")  # one row


def _block_tokens(total: int, block_tokens: int | None) -> int:
    return block_tokens or max(LEAST_BLOCK, min(MOST_BLOCK, total // SLOTS), total // 2**31)


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """slot, source_name, rank (from 0): the source of each slot and the slot's rank among the source's."""
    spark = targets.sparkSession
    ordered = targets.where("target_weight > 0")
    line = Window.orderBy("source_name")
    arcs = ordered.withColumn("hi", F.sum("target_weight").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("source_name").over(line))
    arcs = arcs.withColumn("lo", F.lag("hi", 1, 0.0).over(line)).withColumn("hi", F.when(F.col("next").isNull() & (F.abs(F.col("hi") - 1) < 1e-6), F.lit(1.0)).otherwise(F.col("hi")))
    arcs = arcs.select("source_name", "lo", "hi", F.explode(F.expr(f"sequence(cast(least(floor(lo * {CELLS}), {CELLS - 1}) as int), cast(least(floor(hi * {CELLS}), {CELLS - 1}) as int))")).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(2**32)) / F.lit(float(2**32))).alias("u"))
    placed = points.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int")).join(arcs, "cell").where("u >= lo and u < hi").select("slot", "source_name", F.expr("slot div 65536").alias("chunk"))
    sums = placed.groupBy("source_name", "chunk").count()
    before = Window.partitionBy("source_name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_name", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_name", "chunk").orderBy("slot")
    return placed.withColumn("r", F.row_number().over(inside) - 1).join(sums, ["source_name", "chunk"]).select("slot", "source_name", (F.col("base") + F.col("r")).alias("rank"))


def _totals(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source_name").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


def _plan(sized: DataFrame, targets: DataFrame, block_tokens: int | None) -> tuple[DataFrame, DataFrame, int, int]:
    """(totals by source with targets, schedule, tokens of all documents, tokens of a block)."""
    totals = materialise(_totals(sized), "totals")
    total = int(totals.agg(F.sum("tokens")).first()[0] or 0)
    block = _block_tokens(total, block_tokens)
    goal = clean_targets(targets)
    of = goal.join(totals, "source_name", "left").select("source_name", "target_weight", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    of = of.withColumn("blocks", F.expr(f"cast(ceil(tokens / {block}) as bigint)"))
    return of, schedule(goal, -(-total // block)), total, block


def mixture_report(sized: DataFrame, targets: DataFrame, block_tokens: int | None = None) -> DataFrame:
    """One row per source of the targets: its documents and tokens, the tokens it should and does provide, its actual
    share of the combined set, slots without tokens, and whether all its documents max_repeats times are too few."""
    of, slots, total, block = _plan(sized, targets, block_tokens)
    slots = slots.join(of.select("source_name", "blocks", "max_repeats", "tokens"), "source_name")
    filled = F.col("rank") < F.col("blocks") * F.col("max_repeats")
    last = F.col("rank") % F.greatest("blocks", F.lit(1)) == F.col("blocks") - 1
    size = F.when(filled, F.when(last, F.col("tokens") - (F.col("blocks") - 1) * block).otherwise(F.lit(block)))
    used = slots.groupBy("source_name").agg(F.sum(size).alias("provided"), F.count(F.when(~filled, 1)).alias("unfilled"))
    out = of.join(used, "source_name", "left").withColumn("provided_tokens", F.coalesce("provided", F.lit(0)).cast("bigint"))
    all_provided = out.agg(F.sum("provided_tokens").alias("combined"))
    return out.join(F.broadcast(all_provided)).select(  # one row
        "source_name",
        "target_weight",
        "max_repeats",
        "documents",
        "tokens",
        F.round(F.col("target_weight") * F.lit(total), 0).cast("bigint").alias("target_tokens"),
        "provided_tokens",
        F.round(F.coalesce(F.try_divide(F.col("provided_tokens").cast("double"), F.col("combined")), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("unfilled", F.lit(0)).alias("unfilled_slots"),
        (F.col("tokens") * F.col("max_repeats") < F.col("target_weight") * F.lit(total)).alias("short"),
    )


def placed_documents(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source_name, lo, hi: where the document's tokens lie in its source's shuffled stream."""
    order = sized.where("tokens > 0").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    sizes = order.groupBy("source_name").agg(F.expr(f"cast(least(ceil(count(*) / {BUCKET}), 1048576) as bigint)").alias("buckets"))
    order = order.join(sizes, "source_name").withColumn("bucket", F.expr("pmod(shiftrightunsigned(h, 20), buckets)"))
    sums = order.groupBy("source_name", "bucket").agg(F.sum("tokens").alias("s"))
    before = Window.partitionBy("source_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_name", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    running = Window.partitionBy("source_name", "bucket").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = order.withColumn("end", F.sum("tokens").over(running)).join(sums, ["source_name", "bucket"])
    return placed.select("doc_id", "source_name", (F.col("base") + F.col("end") - F.col("tokens")).alias("lo"), (F.col("base") + F.col("end")).alias("hi"))


def mixture(sized: DataFrame, targets: DataFrame, block_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """The combined set in order: slot, source_name, repeat (from 1), doc_id, from_token, to_token of the document."""
    of, slots, _, block = _plan(sized, targets, block_tokens)
    filled = slots.join(of.select("source_name", "blocks", "max_repeats"), "source_name").where("rank < blocks * max_repeats")
    filled = filled.select("slot", "source_name", F.expr("rank % nullif(blocks, 0)").alias("block"), F.expr("cast(rank div nullif(blocks, 0) + 1 as int)").alias("repeat"))
    docs = placed_documents(sized.join(of.select("source_name"), "source_name", "left_semi"), seed)
    pieces = docs.withColumn("block", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")))
    return filled.join(pieces, ["source_name", "block"]).select(
        "slot", "source_name", "repeat", "doc_id", (F.greatest("lo", F.col("block") * block) - F.col("lo")).alias("from_token"), (F.least("hi", (F.col("block") + 1) * block) - F.col("lo")).alias("to_token")
    )
