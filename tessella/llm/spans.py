"""Long spans that stand word for word in more than one document, by a log-structured fingerprint index.

Every window of ``min_chars`` code points holds at least one selected hash of ``GRAM`` code points (the smallest of the
window), so two texts with such a span in common share a fingerprint. Each batch of documents becomes one immutable
run of (fingerprint, text) rows, bucketed and sorted by fingerprint; a new run is merge-joined with the earlier ones
and itself, and runs of one level are compacted into one of the next. Candidate pairs are verified on whole texts.
A table given whole is read once and enters the index in ``BATCHES`` parts by a hash of the text, however it is stored.

Equal texts are one class (64-bit hash and length), so copies are fingerprinted and compared once. A fingerprint that
more than ``HOT`` texts of a run hold is not paired as it is: its texts get a key for each way a span of ``min_chars``
can lie over the hash, over all but ``GRID`` of the span, so that only texts which share nearly such a span meet; the
groups of a key are paired in blocks (``blocks``). HOT sets the cost only: either way every pair meets.

Defined results for unusual input: null texts and texts under ``min_chars`` share nothing; a null id is left out of
pairs; the same id twice counts as one document; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.blocks import pairs_within
from tessella.session import materialise, new_table_path

MIN_CHARS = 250
GRAM = 64
HOT = 50
GRID = 10
#: Parts in which a table that is given whole enters the index.
BATCHES = 4
#: Runs of a level that are compacted into one of the next level.
FANOUT = 2
#: Code points hashed at once.
CHUNK = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POWERS: dict[str, np.ndarray] = {}


def _cached_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["b"]) < n:
        size = max(n, 4096) * 2
        _POWERS["b"], _POWERS["i"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _POWERS["b"][:n], _POWERS["i"][:n]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k code points; equal runs have equal hashes wherever they stand."""
    n = len(codes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = _cached_powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[k:] - total[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Smallest value of each w values in a row, by running minima within blocks of w from either side."""
    n = len(values)
    if n < w:
        return np.empty(0, dtype=values.dtype)
    padded = np.full(-(-n // w) * w, _MAX, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def fingerprints(texts: list[str], min_chars: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, fingerprint) of texts that are long enough; one text may hold one twice."""
    keep = [i for i, t in enumerate(texts) if t is not None and len(t) >= min_chars]
    where, out = [], []
    start = 0
    while start < len(keep):
        stop, size = start, 0
        while stop < len(keep) and (stop == start or size + len(texts[keep[stop]]) <= CHUNK):
            size += len(texts[keep[stop]])
            stop += 1
        part = keep[start:stop]
        lengths = np.array([len(texts[i]) for i in part])
        codes = codes_of("".join([texts[i] for i in part]))
        minima = window_minima(gram_hashes(codes, gram), min_chars - gram + 1)
        owner = np.repeat(np.arange(len(part)), lengths)
        inside = owner[: len(minima)] == owner[min_chars - 1 : min_chars - 1 + len(minima)]
        minima, owner = minima[inside], owner[: len(inside)][inside]
        first = np.ones(len(minima), dtype=bool)
        first[1:] = (minima[1:] != minima[:-1]) | (owner[1:] != owner[:-1])
        where.append(np.array(part)[owner[first]])
        out.append(minima[first])
        start = stop
    if not out:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate(where), np.concatenate(out)


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th, n: the class of equal texts that each document belongs to."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.length(text_col).alias("n"))


def fingerprint_rows(docs: DataFrame, text_col: str, min_chars: int = MIN_CHARS, gram: int = GRAM) -> DataFrame:
    """fp, th, n for the texts of min_chars or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, fp = fingerprints(b.column(2).to_pylist(), min_chars, gram)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), b.column(0).take(pa.array(index)), b.column(1).take(pa.array(index))], names=["fp", "th", "n"])

    src = docs.where(F.length(text_col) >= min_chars).select(F.xxhash64(text_col).alias("th"), F.length(text_col).alias("n"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "fp bigint, th bigint, n int")


def batched_rows(docs: DataFrame, text_col: str, batches: list[DataFrame] | None, min_chars: int, gram: int) -> list[DataFrame]:
    """The fingerprint rows of each batch; without batches those of the table's parts by a hash of the text, read in one go."""
    if batches:
        return [fingerprint_rows(b, text_col, min_chars, gram) for b in batches]
    part = F.pmod(F.shiftright("th", 17), F.lit(BATCHES)).cast("int")
    rows = materialise(fingerprint_rows(docs, text_col, min_chars, gram).withColumn("batch", part), "fingerprints", ("batch",))
    return [rows.where(F.col("batch") == i).select("fp", "th", "n") for i in range(BATCHES)]


class FingerprintIndex:
    """Sorted immutable runs of fingerprints with levels."""

    def __init__(self, spark, min_chars: int = MIN_CHARS, gram: int = GRAM, buckets: int | None = None):
        self.spark, self.min_chars, self.gram = spark, min_chars, gram
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []
        self.written: list[tuple[str, str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex[:16]}"
        sorted_rows = rows.repartition(self.buckets, "fp").dropDuplicates(["fp", "th", "n"]).sortWithinPartitions("fp")
        path = new_table_path(self.spark, name)
        sorted_rows.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", path).option("compression", "zstd").saveAsTable(name)
        self.written.append((name, path))
        return name

    def add(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Write the run of a batch's fingerprint rows; returns it and the runs that were there before it."""
        name, before = self._write(rows), [r for _, r in self.runs]
        self.runs.append((0, name))
        return name, before

    def drop(self) -> None:
        """Drop all runs ever written, with their files."""
        fs = None
        for name, path in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            fs = fs or p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(p, True)
        self.runs, self.written = [], []

    def compact(self) -> None:
        """Merge runs of one level while a level holds FANOUT of them."""
        while True:
            levels = [lv for lv, _ in self.runs]
            full = next((lv for lv in sorted(set(levels)) if levels.count(lv) >= FANOUT), None)
            if full is None:
                return
            old = [r for lv, r in self.runs if lv == full]
            rows = self.spark.table(old[0])
            for r in old[1:]:
                rows = rows.unionAll(self.spark.table(r))
            self.runs = [x for x in self.runs if x[0] != full] + [(full + 1, self._write(rows))]


def _pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered pairs of different classes that share the keys."""
    first = a.select(*keys, F.col("th").alias("th_a"), F.col("n").alias("n_a"))
    second = b.select(*keys, F.col("th").alias("th_b"), F.col("n").alias("n_b"))
    joined = first.join(second, keys).where("th_a <> th_b or n_a <> n_b")
    swap = (F.col("th_a") > F.col("th_b")) | ((F.col("th_a") == F.col("th_b")) & (F.col("n_a") > F.col("n_b")))
    return joined.select(
        F.when(swap, F.col("th_b")).otherwise(F.col("th_a")).alias("th_a"),
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("th_a")).otherwise(F.col("th_b")).alias("th_b"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
    )


def _texts(docs: DataFrame, text_col: str, wanted: DataFrame, min_chars: int) -> DataFrame:
    """th, n, text once for each class in wanted."""
    src = docs.where(F.length(text_col) >= min_chars).select(F.xxhash64(text_col).alias("th"), F.length(text_col).alias("n"), F.col(text_col).alias("text"))
    return src.join(wanted, ["th", "n"], "left_semi").groupBy("th", "n").agg(F.first("text").alias("text"))


def _hot_keys(min_chars: int, gram: int):
    """Keys of texts over hot fingerprints: for each offset of the hash in a span, the hash of the span less GRID."""
    length = min_chars - GRID

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for th, n, hot, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                codes = codes_of(text)
                grams, spans = gram_hashes(codes, gram).view(np.int64), gram_hashes(codes, length).view(np.int64)
                at = np.flatnonzero(np.isin(grams, np.array(hot, dtype=np.int64)))
                for off in range(0, min_chars - gram + 1, GRID):
                    p = at - off
                    p = p[(p >= 0) & (p < len(spans))]
                    for x in np.unique(spans[p]):
                        for c, v in zip(out, (off, int(x), 0, th, n), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32())], names=["off", "span", "th", "n"])

    return run


def candidate_pairs(docs: DataFrame, text_col: str, batches: list[DataFrame], index: FingerprintIndex) -> DataFrame:
    """Pairs of classes that share a fingerprint, each batch of fingerprint rows joined with the runs before it and with itself."""
    spark, joins, hots = index.spark, [], []
    for batch in batches:
        run, before = index.add(batch)
        joins += [(run, run), *((run, r) for r in before)]
        hots.append(run)
        if batch is not batches[-1]:
            index.compact()
    counts = None
    for r in hots:
        h = spark.table(r).groupBy("fp").count()
        counts = h if counts is None else counts.unionAll(h)
    hot = materialise(counts.groupBy("fp").agg(F.sum("count").alias("count")).where(F.col("count") > HOT).select("fp"), "hot")
    any_hot = not hot.isEmpty()
    out = None
    for a, b in joins:
        left, right = spark.table(a), spark.table(b)
        if any_hot:
            left = left.join(hot, "fp", "left_anti")
        p = _pairs(left, right, ["fp"])
        out = p if out is None else out.unionAll(p)
    if any_hot:
        rows = None
        for r in hots:
            h = spark.table(r).join(hot, "fp", "left_semi")
            rows = h if rows is None else rows.unionAll(h)
        held = rows.groupBy("th", "n").agg(F.collect_set("fp").alias("hot"))
        with_text = held.join(_texts(docs, text_col, held.select("th", "n"), index.min_chars), ["th", "n"]).select("th", "n", "hot", "text")
        keys = with_text.mapInArrow(_hot_keys(index.min_chars, index.gram), "off int, span bigint, th bigint, n int")
        met = pairs_within(keys, ["off", "span"], ["th", "n"])
        swap = F.struct("th_a", "n_a") > F.struct("th_b", "n_b")
        side = lambda c, x, y: F.when(swap, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
        out = out.unionAll(met.select(side("th", "b", "a").alias("th_a"), side("n", "b", "a").alias("n_a"), side("th", "a", "b").alias("th_b"), side("n", "a", "b").alias("n_b")))
    return out.distinct()


def _verify(min_chars: int):
    """Of each pair of texts the intervals of the first and of the second that lie in spans they share."""

    def intervals(common: np.ndarray) -> list[dict[str, int]]:
        at = np.flatnonzero(common)
        if not len(at):
            return []
        cut = np.flatnonzero(np.diff(at) > min_chars)
        first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(at) - 1]))
        return [{"lo": int(at[i]), "hi": int(at[j]) + min_chars} for i, j in zip(first, last, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for b in batches:
            rows, spans_a, spans_b = [], [], []
            seen: tuple[str | None, np.ndarray] = (None, np.empty(0))
            for i, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                if seen[0] != x:
                    seen = (x, gram_hashes(codes_of(x), min_chars))
                hx, hy = seen[1], gram_hashes(codes_of(y), min_chars)
                cx = np.isin(hx, hy)
                if cx.any():
                    p = int(np.argmax(cx))
                    if x[p : p + min_chars] in y:
                        rows.append(i)
                        spans_a.append(intervals(cx))
                        spans_b.append(intervals(np.isin(hy, hx)))
            take = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*take.columns[:4], pa.array(spans_a, kind), pa.array(spans_b, kind)], names=["th_a", "n_a", "th_b", "n_b", "spans_a", "spans_b"])

    return run


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, gram: int = GRAM, batches: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes of documents, verified pairs of classes with the intervals that they share)."""
    docs = docs.select(id_col, text_col)
    index = FingerprintIndex(docs.sparkSession, min_chars, min(gram, min_chars))
    rows = batched_rows(docs, text_col, batches, min_chars, index.gram)
    pairs = materialise(candidate_pairs(docs, text_col, rows, index), "candidates")
    index.drop()
    ends = pairs.select(F.col("th_a").alias("th"), F.col("n_a").alias("n")).unionAll(pairs.select("th_b", "n_b")).distinct()
    texts = materialise(_texts(docs, text_col, ends, min_chars), "texts")
    a, b = texts.select(F.col("th").alias("th_a"), F.col("n").alias("n_a"), F.col("text").alias("a")), texts.select(F.col("th").alias("th_b"), F.col("n").alias("n_b"), F.col("text").alias("b"))
    both = pairs.join(a, ["th_a", "n_a"]).join(b, ["th_b", "n_b"]).select("th_a", "n_a", "th_b", "n_b", "a", "b")
    spans = "array<struct<lo:int,hi:int>>"
    found = both.mapInArrow(_verify(min_chars), f"th_a bigint, n_a int, th_b bigint, n_b int, spans_a {spans}, spans_b {spans}")
    return classes(docs.where(F.col(id_col).isNotNull()), id_col, text_col).distinct(), found


def shared_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, gram: int = GRAM, batches: list[DataFrame] | None = None) -> DataFrame:
    """doc_a < doc_b: every pair of documents with a span of min_chars in common."""
    members, found = shared_spans(docs, id_col, text_col, min_chars, gram, batches)
    of = found.select("th_a", "n_a", "th_b", "n_b")
    left = members.select(F.col("doc_id").alias("x"), F.col("th").alias("th_a"), F.col("n").alias("n_a"))
    right = members.select(F.col("doc_id").alias("y"), F.col("th").alias("th_b"), F.col("n").alias("n_b"))
    apart = of.join(left, ["th_a", "n_a"]).join(right, ["th_b", "n_b"]).where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    long = members.where(F.col("n") >= min_chars)
    copies = pairs_within(long, ["th", "n"], ["doc_id"]).select(F.least("doc_id_a", "doc_id_b").alias("doc_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_b"))
    return apart.unionAll(copies).distinct()


def shared_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, gram: int = GRAM, batches: list[DataFrame] | None = None) -> DataFrame:
    """One row per document: class_id (smallest id with the same text), links (other texts that share a span with it),
    copies (other documents with its text), shared_chars and share of its text."""
    members, found = shared_spans(docs, id_col, text_col, min_chars, gram, batches)
    found = materialise(found, "spans")
    sides = found.select(F.col("th_a").alias("th"), F.col("n_a").alias("n"), F.explode("spans_a").alias("s")).unionAll(found.select("th_b", "n_b", F.explode("spans_b")))
    links = found.select(F.col("th_a").alias("th"), F.col("n_a").alias("n")).unionAll(found.select("th_b", "n_b")).groupBy("th", "n").agg(F.count("*").alias("links"))
    order = Window.partitionBy("th", "n").orderBy("lo", "hi")
    covered = (
        sides.select("th", "n", "s.lo", "s.hi")
        .distinct()
        .withColumn("before", F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .groupBy("th", "n")
        .agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "before"))).alias("chars"))
    )
    size = members.groupBy("th", "n").agg(F.count("*").alias("members"), F.min("doc_id").alias("class_id"))
    per_class = size.join(covered, ["th", "n"], "left").join(links, ["th", "n"], "left")
    shared = F.when((F.col("members") > 1) & (F.col("n") >= min_chars), F.col("n").cast("bigint")).otherwise(F.coalesce("chars", F.lit(0).cast("bigint")))
    return members.join(per_class, ["th", "n"], "left").select(
        "doc_id",
        "class_id",
        F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce(F.col("members") - 1, F.lit(0)).alias("copies"),
        F.coalesce(shared, F.lit(0)).alias("shared_chars"),
        F.round(F.coalesce(F.try_divide(shared, F.col("n")), F.lit(0.0)), 6).alias("share"),
    )
