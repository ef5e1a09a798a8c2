"""Text values that were cut off, and how often each source cuts each field.

Every value is read once: where its content ends (``cut_length``), and what its end looks like (see ``replies``).
Lengths give discrete hazards, h(L) = values of length L / values of length L or more, by window functions, for each
source and field and for each field over all sources. Each is tested against the pooled hazard of the ``NEIGHBOURS``
lengths on either side (Poisson tail), with Benjamini-Hochberg control at ``FDR`` over the tests of a source and field.
Lengths with a significant excess are limits, whatever their values look like.
At a limit a value is cut if its end is incomplete or if, for an end without its stop, the excess hazard there and the
last words speak for a cut. Elsewhere only transfer cuts values, at a rate of its own per code point: a value is cut if
its structure is incomplete (open brackets, a mark, a broken word), or if its last words speak for a cut at that rate.
What the last words say is a ratio over the whole table: how often they stand inside sentences and how often at the end of
finished ones; words that stand in neither are no end.

Defined results for unusual input: null, empty and blank values are no cases; a null source is a source of its own; a null
text or prompt only takes away evidence; repeated rows count each; empty tables give empty results; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import replies
from tessella.session import materialise

NEIGHBOURS = 10
FDR = 0.01
#: Times the hazard around that a limit has at least; what is significant by many rows alone is no limit.
EXCESS = 1.5
#: The verdict of rows that count words inside sentences instead of values.
INSIDE = -1
FIELDS = {"raw_highlighting": None, "raw_rank_ordering": None, "raw_rationale": "rationale_explain_prompt"}


ENDS = "id {id}, source string, field_name string, n int, cut_length int, verdict int, words string"


def count_inside(counts: Counter[tuple[str, str]], field: str, tokens: list[str]) -> None:
    """Count what would be the last words of a sentence that stopped after any of its tokens but the last."""
    for i in range(1, len(tokens)):
        counts[field, replies.words_at(tokens, i)] += 1


def inside_rows(counts: Counter[tuple[str, str]], id_type: pa.DataType, source_type: pa.DataType) -> pa.RecordBatch:
    """Rows of ends that hold counts: field_name, n, words."""
    size = len(counts)
    of = list(counts)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(size, id_type), pa.nulls(size, source_type), pa.array([f for f, _ in of], pa.string()), pa.array(list(counts.values()), pa.int32()), pa.array([0] * size, pa.int32()), pa.array([INSIDE] * size, pa.int32()), pa.array([w for _, w in of], pa.string())],
        names=["id", "source", "field_name", "n", "cut_length", "verdict", "words"],
    )


def value_ends(results: DataFrame, fields: dict[str, str | None], id_col: str = "result_id", source_col: str = "model", text_col: str = "text", label_col: str = "predicted_label") -> DataFrame:
    """id, source, field_name, n, cut_length, verdict, words of every value that isn't null, and of verdict INSIDE the
    field_name, n and words of what stands n times inside sentences."""
    names = list(fields)
    prompts = [p for p in fields.values() if p]
    src = results.select(F.col(id_col).alias("id"), F.lower(F.trim(F.col(source_col))).alias("source"), F.col(text_col).alias("t"), F.col(label_col).alias("l"), *[F.col(f) for f in names], *[F.col(p).alias(f"_{p}") for p in prompts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels = b.column(2).to_pylist(), b.column(3).to_pylist()
            inside: Counter[tuple[str, str]] = Counter()
            for k, f in enumerate(names):
                prompt = b.column(b.schema.get_field_index(f"_{fields[f]}")).to_pylist() if fields[f] else [None] * b.num_rows
                rows, n, cut, verdicts, words = [], [], [], [], []
                for i, v in enumerate(b.column(4 + k).to_pylist()):
                    if v is None:
                        continue
                    reply = replies.read(v)
                    verdict, tokens = replies.ending(reply, texts[i], prompt[i], labels[i]) if v.strip() else (replies.COMPLETE, [])
                    count_inside(inside, f, tokens)
                    rows.append(i)
                    n.append(len(v))
                    cut.append(reply.end)
                    verdicts.append(verdict)
                    words.append(replies.words_at(tokens, len(tokens)))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array([f] * len(rows), pa.string()), pa.array(n, pa.int32()), pa.array(cut, pa.int32()), pa.array(verdicts, pa.int32()), pa.array(words, pa.string())],
                    names=["id", "source", "field_name", "n", "cut_length", "verdict", "words"],
                )
            yield inside_rows(inside, b.schema.field(0).type, b.schema.field(1).type)

    return src.mapInArrow(run, ENDS.format(id=src.schema["id"].dataType.simpleString()))


def _tail(counts: pd.Series, means: pd.Series) -> pd.Series:
    """P(X >= count) of Poisson variables."""
    out = []
    for c, m in zip(counts, means, strict=True):
        if c <= 0 or m <= 0:
            out.append(1.0 if c <= 0 else 0.0)
            continue
        if m > 1e4 or c > 1e4:
            out.append(0.5 * math.erfc((c - 0.5 - m) / math.sqrt(2 * m)))
            continue
        term, total, k = math.exp(c * math.log(m) - m - math.lgamma(c + 1)), 0.0, int(c)
        while True:
            total += term
            k += 1
            term *= m / k
            if term < 1e-18 * max(total, 1e-300) or k > c + 20 * math.sqrt(m) + 200:
                break
        out.append(min(1.0, total))
    return pd.Series(out, dtype="float64")


def length_hazards(ends: DataFrame) -> DataFrame:
    """pooled, source, field_name, cut_length, values, at_risk, hazard, near_hazard, p, q, is_limit of every length that
    occurs; pooled rows are those of all sources together, their source is null."""
    by = ends.where(f"cut_length > 0 and verdict <> {INSIDE}").groupBy("source", "field_name", "cut_length").agg(F.count("*").alias("values"))
    by = materialise(by, "lengths")
    pool = by.groupBy("field_name", "cut_length").agg(F.sum("values").alias("values"))
    by = by.select(F.lit(False).alias("pooled"), "source", "field_name", "cut_length", "values").unionByName(pool.select(F.lit(True).alias("pooled"), F.lit(None).cast("string").alias("source"), "field_name", "cut_length", "values"))
    key = ["pooled", "source", "field_name"]
    w, k, at = Window.partitionBy(*key).orderBy("cut_length"), NEIGHBOURS, F.col("cut_length")
    below, above = w.rangeBetween(-k, -1), w.rangeBetween(0, k)
    none = F.lit(0)
    risk = by.withColumns(
        {
            "at_risk": F.sum("values").over(w.rangeBetween(0, Window.unboundedFollowing)),
            "beyond": F.coalesce(F.sum("values").over(w.rangeBetween(k + 1, Window.unboundedFollowing)), none),
            "near_values": F.coalesce(F.sum("values").over(below), none) + F.sum("values").over(above) - F.col("values"),
            # a value of length l is at risk at each length up to l: counted over the neighbours, from 1 on
            "short": F.coalesce(F.sum(F.col("values") * at).over(below), none),
            "short_values": F.coalesce(F.sum("values").over(below), none),
            "long": F.sum(F.col("values") * at).over(above),
            "long_values": F.sum("values").over(above),
        }
    )
    low = F.greatest(at - k, F.lit(1))
    near_risk = F.col("short") - F.col("short_values") * (low - 1) + F.col("long") - F.col("long_values") * low + F.col("beyond") * (at + k - low)
    risk = risk.withColumn("near_hazard", (F.col("near_values") + 0.5) / F.greatest(near_risk, F.lit(1)))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            d["p"] = _tail(d["values"], d["at_risk"] * d["near_hazard"]).to_numpy()
            yield d[["pooled", "source", "field_name", "cut_length", "values", "at_risk", "near_hazard", "p"]]

    tested = risk.mapInPandas(test, "pooled boolean, source string, field_name string, cut_length int, values bigint, at_risk bigint, near_hazard double, p double")
    up, down = Window.partitionBy(*key).orderBy("p"), Window.partitionBy(*key).orderBy(F.desc("p"))
    raw = tested.withColumn("raw", F.col("p") * F.count("*").over(Window.partitionBy(*key)) / F.rank().over(up))
    q = F.least(F.lit(1.0), F.min("raw").over(down.rangeBetween(Window.unboundedPreceding, 0)))
    hazard = F.col("values") / F.col("at_risk")
    return raw.withColumn("q", q).select(*key, "cut_length", "values", "at_risk", hazard.alias("hazard"), "near_hazard", "p", "q", ((F.col("q") <= FDR) & (hazard >= F.col("near_hazard") * EXCESS)).alias("is_limit"))


def _priors(ends: DataFrame) -> DataFrame:
    """field_name, transfer (cuts per code point), unstopped (share of values without a stop), inside, finished (words seen
    inside sentences, and at the end of finished ones)."""
    real, v = F.col("verdict") != INSIDE, F.col("verdict")
    return ends.groupBy("field_name").agg(
        (F.count(F.when(v == replies.CUT, 1)) / F.greatest(F.sum(F.when(real, F.col("n"))), F.lit(1))).alias("transfer"),
        (F.count(F.when(v == replies.OPEN, 1)) / F.greatest(F.count(F.when(real, 1)), F.lit(1))).alias("unstopped"),
        F.coalesce(F.sum(F.when(~real, F.col("n").cast("bigint"))), F.lit(0)).alias("inside_all"),
        F.count(F.when((v == replies.COMPLETE) & (F.col("words") != ""), 1)).alias("finished_all"),
    )


def judged(ends: DataFrame) -> DataFrame:
    """The ends with is_limit, is_cut and at_limit (cut, and by a limit). Further columns stay."""
    values = ends.where(f"verdict <> {INSIDE}")
    limits = materialise(length_hazards(ends), "hazards")
    over = F.when(F.col("is_limit"), F.col("hazard") - F.col("near_hazard"))
    of_source = limits.where("not pooled").select(F.col("source").alias("s"), F.col("field_name").alias("f"), F.col("cut_length").alias("c"), over.alias("excess_own"), F.col("near_hazard").alias("near_own"))
    of_field = limits.where("pooled and is_limit").select(F.col("field_name").alias("f2"), F.col("cut_length").alias("c2"), over.alias("excess_all"))
    rows = values.join(of_source, F.col("source").eqNullSafe(F.col("s")) & (F.col("field_name") == F.col("f")) & (F.col("cut_length") == F.col("c")), "left")
    rows = rows.join(of_field, (F.col("field_name") == F.col("f2")) & (F.col("cut_length") == F.col("c2")), "left")
    rows = rows.withColumn("excess", F.greatest(F.coalesce("excess_own", F.lit(0.0)), F.coalesce("excess_all", F.lit(0.0))))
    keep = [c for c in ends.columns]
    # only ends without a stop are looked up
    sure = rows.where(f"verdict <> {replies.OPEN}").select(*keep, "excess", (F.col("verdict") == replies.CUT).alias("is_cut"))
    open_ends = rows.where(f"verdict = {replies.OPEN}").select(*keep, "excess", "near_own")
    asked = open_ends.select("field_name", "words").distinct()
    counted = ends.where(f"verdict = {INSIDE} or (verdict = {replies.COMPLETE} and words <> '')").groupBy("field_name", "words").agg(F.sum(F.when(F.col("verdict") == INSIDE, F.col("n").cast("bigint"))).alias("inside"), F.count(F.when(F.col("verdict") == replies.COMPLETE, 1)).alias("finished"))
    stats = counted.join(asked, ["field_name", "words"], "left_semi").join(_priors(ends), "field_name")
    looked = open_ends.join(stats, ["field_name", "words"], "left")
    for_cut = (F.col("excess") + F.col("transfer")) * F.coalesce("inside", F.lit(0)) / F.greatest("inside_all", F.lit(1))
    for_end = F.col("unstopped") * F.coalesce("near_own", F.lit(0.0)) * F.col("finished") / F.greatest("finished_all", F.lit(1))
    is_cut = F.coalesce((F.col("finished") == 0) | (for_cut > for_end), F.lit(True))
    out = sure.unionByName(looked.select(*keep, "excess", is_cut.alias("is_cut")))
    return out.select(*keep, (F.col("excess") > 0).alias("is_limit"), "is_cut", (F.col("is_cut") & (F.col("excess") > 0)).alias("at_limit"))


def cut_values(results: DataFrame, fields: dict[str, str | None] | None = None, **columns: str) -> DataFrame:
    """id, field_name of every value that was cut."""
    return judged(materialise(value_ends(results, fields or FIELDS, **columns), "ends")).where("is_cut").select("id", "field_name").distinct()


def cut_rates(results: DataFrame, fields: dict[str, str | None] | None = None, **columns: str) -> DataFrame:
    """source, field_name, replies, cut, cut_rate, cut_at_limit, cut_in_transfer, limits: how often each source cuts each
    field, and where."""
    ends = materialise(value_ends(results, fields or FIELDS, **columns), "ends")
    done = judged(ends).groupBy("source", "field_name").agg(F.count("*").alias("replies"), F.count(F.when(F.col("is_cut"), 1)).alias("cut"), F.count(F.when(F.col("at_limit"), 1)).alias("cut_at_limit"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("at_limit"), F.col("cut_length")))), ",").alias("limits"))
    return done.select("source", "field_name", "replies", "cut", F.round(F.col("cut") / F.col("replies"), 6).alias("cut_rate"), "cut_at_limit", (F.col("cut") - F.col("cut_at_limit")).alias("cut_in_transfer"), "limits")
