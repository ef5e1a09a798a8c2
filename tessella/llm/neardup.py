"""Texts that share most of their words, by meet-in-the-middle ball hashing.

The fingerprint of a text is its word set, cut by word hash into so many blocks that any pair over the threshold differs
in at most one word in some block (the pair's largest distance is known from the sizes; blocks = distance // 2 + 1, so one
block lies within radius 1). Of each block a text emits all variants within half that radius, rounded up: the block
itself and the block without each one of its words. Variants are shuffled once, by key, and sorted; sets under one key
whose sketches lie within the pair's largest distance are candidates, deduplicated and verified on the words. Two sets one word apart in a block meet
under a whole block, so pairs that only share a shortened one are left to other blocks. Sizes are put in classes, each at most 1/threshold wide, and a text emits variants for its own
class and the next, whose radius and number of blocks both sides share. So no pair over the threshold is missed.

Equal word sets are one class of documents and are hashed once. A variant that more than ``HOT`` sets emit (a block of
only frequent words) isn't paired as it is: its sets meet only where they also share one of the words that, by corpus
frequency, are the rarest n - ceil(threshold * n) + 1 of each set, as any pair over the threshold does; groups of a key
and a word are paired in blocks (``blocks``). HOT sets the cost only: either way every pair meets.

Defined results for unusual input: null and wordless texts are no case; null ids are left out; an id with several texts
holds for each of them; repeated rows count once; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.blocks import pairs_within
from tessella.llm.components import components
from tessella.session import materialise

THRESHOLD = 0.8
HOT = 64
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    """Distinct words in code point order: split at whitespace, ASCII punctuation stripped, lower case."""
    return sorted({w for w in (x.strip(string.punctuation).lower() for x in (text or "").split()) if w})


def _ceil(x: Fraction) -> int:
    return -(-x.numerator // x.denominator)


@lru_cache(maxsize=None)
def size_class(threshold: Fraction, k: int) -> tuple[int, int]:
    """Smallest and largest size of class k."""
    low = 1 if k == 0 else size_class(threshold, k - 1)[1] + 1
    return low, int(low / threshold)


@lru_cache(maxsize=None)
def blocks_of_class(threshold: Fraction, k: int) -> int:
    """Blocks that leave some block at most one word apart, for any pair whose larger set is of class k."""
    low, high = size_class(threshold, k)
    most = 0
    for b in {low, high, (low + high) // 2, *range(low, min(high, low + 64) + 1), *range(max(low, high - 64), high + 1)}:
        for a in range(_ceil(threshold * b), b + 1) if high < 2000 else (_ceil(threshold * b), b):
            most = max(most, a + b - 2 * _ceil(threshold / (1 + threshold) * (a + b)))
    if high >= 2000:
        most = max(most, int((1 - threshold) / (1 + threshold) * 2 * high) + 1)
    return most // 2 + 1


def class_of_size(threshold: Fraction, n: int) -> int:
    k = 0
    while size_class(threshold, k)[1] < n:
        k += 1
    return k


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def variants(hashes: np.ndarray, sizes: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, whether a whole block) of all variants; hashes: the word hashes of all sets in a row, sizes: how many each
    set has."""
    sets, keys, whole = [], [], []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    kinds = {int(n): class_of_size(threshold, int(n)) for n in np.unique(sizes) if n}
    own = np.array([kinds.get(int(n), -1) for n in sizes])
    spread = _mix(hashes)
    for up in (0, 1):
        level = own + up
        blocks = np.array([blocks_of_class(threshold, int(k)) if k >= up else 1 for k in level])
        first = np.concatenate(([0], np.cumsum(blocks)[:-1])) if len(blocks) else np.empty(0, dtype=int)
        slot = first[owner] + (spread % blocks[owner].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(blocks.sum()), dtype=np.uint64)
        np.add.at(total, slot, hashes)
        holder = np.repeat(np.arange(len(sizes)), blocks)
        number = np.arange(len(total)) - first[holder] if len(total) else np.empty(0, dtype=int)
        salt = _mix((level[holder].astype(np.uint64) << _U(32)) + (number.astype(np.uint64) << _U(8)))
        real = sizes[holder] > 0
        sets += [holder[real], owner]
        keys += [_mix(total ^ salt)[real], _mix((total[slot] - hashes) ^ salt[slot])]
        whole += [np.ones(int(real.sum()), dtype=bool), np.zeros(len(owner), dtype=bool)]
    return np.concatenate(sets), np.concatenate(keys), np.concatenate(whole)


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of each set, of which every word flips one: two sets differ in no more bits than words."""
    bits = _U(1) << (_mix(hashes ^ _U(0x5851F42D4C957F2D)) >> _U(58))
    out = np.zeros(len(sizes), dtype=np.uint64)
    np.bitwise_xor.at(out, np.repeat(np.arange(len(sizes)), sizes), bits)
    return out


def word_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, wid, n, words: the word set of every text that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [words_of(t) for t in b.column(1).to_pylist()]
            keep = [i for i, s in enumerate(sets) if s]
            wid = [xxhash.xxh64_intdigest("\n".join(sets[i])) for i in keep]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(np.array(wid, dtype=np.uint64).view(np.int64)), pa.array([len(sets[i]) for i in keep], pa.int32()), pa.array([sets[i] for i in keep], pa.list_(pa.string()))],
                names=["doc_id", "wid", "n", "words"],
            )

    src = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, wid bigint, n int, words array<string>")


def _emit(threshold: Fraction):
    """key, wid, n (negative for a shortened block), sketch of the variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_pylist()
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in flat), dtype=np.uint64, count=len(flat))
            sizes = np.asarray(b.column(1)).astype(np.int64)
            at, keys, whole = variants(hashes, sizes, threshold)
            sketch, n = pa.array(sketches(hashes, sizes).view(np.int64)), np.where(whole, sizes[at], -sizes[at]).astype(np.int32)
            for lo in range(0, len(at), 200_000):
                part = pa.array(at[lo : lo + 200_000])
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 200_000].view(np.int64)), b.column(0).take(part), pa.array(n[lo : lo + 200_000]), sketch.take(part)], names=["key", "wid", "n", "sketch"])

    return run


def _most_apart(sizes: np.ndarray, t: Fraction) -> np.ndarray:
    """Most words in which sets of these sizes together can differ."""
    p, q = t.numerator, t.denominator
    return sizes - 2 * ((sizes * p + p + q - 1) // (p + q))


def _meet(t: Fraction, hot: int):
    """Of variants sorted by key: wid_a < wid_b of the candidates under keys of up to hot sets, and for larger keys
    (crowded) key, wid_a, n and sketch of each variant. A key is held back until it is known to be one or the other."""

    def pairs(key: np.ndarray, wid: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        size, step = np.abs(n), 1
        at = np.flatnonzero(key[1:] == key[:-1])  # first of two rows, step apart, under one key
        while len(at):
            j = at + step
            near = np.bitwise_count((sketch[at] ^ sketch[j]).view(np.uint64)) <= _most_apart(size[at] + size[j], t)
            near &= ((n[at] > 0) | (n[j] > 0)) & (wid[at] != wid[j])
            x, y = wid[at[near]], wid[j[near]]
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
        return np.concatenate(a), np.concatenate(b)

    def out(a, b, key, n, sketch) -> pa.RecordBatch:
        m, c = len(a) - len(key), len(key)
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.concat_arrays([pa.array(b), pa.nulls(c, pa.int64())]), pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(key)]), pa.concat_arrays([pa.nulls(m, pa.int32()), pa.array(n)]), pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(sketch)])],
            names=["wid_a", "wid_b", "key", "n", "sketch"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = None, None  # rows of the last key, of which there may be more; the key, once it is crowded
        for b in batches:
            key, wid, n, sketch = (b.column(i).to_numpy() for i in range(4))
            if held is not None:
                key, wid, n, sketch = (np.concatenate(x) for x in zip(held, (key, wid, n, sketch), strict=True))
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.append(first, len(key)))
            over = (count > hot) | (key[first] == crowded if crowded is not None else False)
            crowded = key[-1] if over[-1] else None
            stop = len(key) if over[-1] else first[-1]  # a crowded key is passed on, any other last key waits
            held = (key[stop:], wid[stop:], n[stop:], sketch[stop:])
            many = np.repeat(over, count)[:stop]
            key, wid, n, sketch = key[:stop], wid[:stop], n[:stop], sketch[:stop]
            x, y = pairs(key[~many], wid[~many], n[~many], sketch[~many])
            yield out(np.concatenate([x, wid[many]]), y, key[many], np.abs(n[many]), sketch[many])
        if held is not None and len(held[0]):
            key, wid, n, sketch = held
            if len(key) > hot or crowded is not None and key[0] == crowded:
                yield out(wid, np.empty(0, dtype=np.int64), key, np.abs(n), sketch)
            else:
                x, y = pairs(*held)
                yield out(x, y, key[:0], n[:0], sketch[:0])

    return run


def _rare_words(sets: DataFrame, t: Fraction) -> DataFrame:
    """wid, word: of each set its rarest words, one of which any set over the threshold shares."""
    each = sets.select("wid", "n", F.explode("words").alias("word"))
    order = Window.partitionBy("wid").orderBy("df", "word")
    share = F.expr(f"n - (n * {t.numerator} + {t.denominator - 1}) div {t.denominator} + 1")
    return each.join(each.groupBy("word").agg(F.count("*").alias("df")), "word").withColumn("r", F.row_number().over(order)).where(F.col("r") <= share).select("wid", "word")


def class_pairs(sets: DataFrame, threshold: float = THRESHOLD, hot: int | None = None) -> DataFrame:
    """wid_a < wid_b of distinct word sets (wid, n, words) whose Jaccard similarity is threshold or more."""
    t = Fraction(threshold).limit_denominator(1000)
    p, q = t.numerator, t.denominator
    rows = sets.select("wid", "n", "words").mapInArrow(_emit(t), "key bigint, wid bigint, n int, sketch bigint")
    sorted_rows = rows.repartition("key").sortWithinPartitions("key")
    met = materialise(sorted_rows.mapInArrow(_meet(t, HOT if hot is None else hot), "wid_a bigint, wid_b bigint, key bigint, n int, sketch bigint"), "met")
    pairs = met.where("key is null").select("wid_a", "wid_b")
    held = met.where("key is not null").select("key", F.col("wid_a").alias("wid"), "n", "sketch").distinct()
    if not met.where("key is not null").isEmpty():
        rare = _rare_words(sets.join(held.select("wid").distinct(), "wid", "left_semi"), t)
        refined = pairs_within(held.join(rare, "wid"), ["key", "word"], ["wid"])
        most = f"n_a + n_b - 2 * (((n_a + n_b) * {p} + {p + q - 1}) div {p + q})"
        near = refined.where(f"bit_count(sketch_a ^ sketch_b) <= {most}")
        pairs = pairs.unionAll(near.select(F.least("wid_a", "wid_b").alias("wid_a"), F.greatest("wid_a", "wid_b").alias("wid_b")))
    x, y = sets.select(F.col("wid").alias("wid_a"), F.col("words").alias("x")), sets.select(F.col("wid").alias("wid_b"), F.col("words").alias("y"))
    both = pairs.distinct().join(x, "wid_a").join(y, "wid_b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("common") * q >= (F.size("x") + F.size("y") - F.col("common")) * p).select("wid_a", "wid_b")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, wid of every document with words, verified pairs of wids)."""
    rows = materialise(word_sets(docs, id_col, text_col), "wordsets")
    sets = materialise(rows.groupBy("wid", "n").agg(F.first("words").alias("words")), "sets")
    return rows.select("doc_id", "wid").distinct(), class_pairs(sets, threshold, hot)


def near_duplicate_pairs(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, hot: int | None = None) -> DataFrame:
    """a < b: all pairs of different ids over the threshold."""
    members, pairs = near_duplicates(docs, id_col, text_col, threshold, hot)
    a, b = members.select(F.col("doc_id").alias("x"), F.col("wid").alias("wid_a")), members.select(F.col("doc_id").alias("y"), F.col("wid").alias("wid_b"))
    apart = pairs.join(a, "wid_a").join(b, "wid_b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    copies = pairs_within(members, ["wid"], ["doc_id"]).select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b"))
    return apart.unionAll(copies).distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, hot: int | None = None) -> DataFrame:
    """One row per document with words: class_id (smallest id with its word set), group_id (smallest id linked to it over
    any number of links), links (other word sets over the threshold)."""
    members, pairs = near_duplicates(docs, id_col, text_col, threshold, hot)
    pairs = materialise(pairs, "links")
    links = pairs.select(F.col("wid_a").alias("wid")).unionAll(pairs.select("wid_b")).groupBy("wid").agg(F.count("*").alias("links"))
    linked = components(pairs.select(F.col("wid_a").alias("a"), F.col("wid_b").alias("b"))).withColumnRenamed("node", "wid")
    per_class = members.groupBy("wid").agg(F.min("doc_id").alias("class_id"))
    of = per_class.join(linked, "wid", "left").join(links, "wid", "left").withColumn("component", F.coalesce("component", "wid"))
    first = of.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return members.join(of.join(first, "component"), "wid").select("doc_id", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
