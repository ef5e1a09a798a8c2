"""Passages of held-out items inside a corpus, by a distributed positional inverted index.

The corpus is indexed in segments of up to ``CHUNK`` code points, whatever will be asked of it: one row for each term of a
segment with the term's positions there and the number of documents that hold it, in the order of terms, and one row (its
term is null) that says where the segment's documents start. Documents are apart by a gap. Segments don't share rows,
so building the index moves nothing between executors.

Items are terms with offsets, too. Joined with the corpus-wide document frequencies, the rarest term of each window of
``run`` item words is its anchor; anchors joined with the index give the segments in which an item can stand. The positions
of all terms that items hold then meet the items of a segment: an anchor's positions, moved back by its offset, are the
candidate places, and the lists of the other terms, moved alike, are intersected with them, the rarest first. A place where
``run`` consecutive words stand is a phrase match; one where each of them stands within ``slop`` words of its place is a
proximity match. A segment that more than ``ITEMS`` items can stand in is handled in parts.

Defined results for unusual input: null and empty texts hold nothing; items under ``run`` words never match; null ids are
left out; repeated rows count once; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialise

RUN = 10
SLOP = 3
CHUNK = 4_000_000
#: Items of a segment that are matched in one task.
ITEMS = 2000
#: Candidate places times item words that are looked at together.
CELLS = 4_000_000
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<!--.*?-->|<[/!?]?[A-Za-z][^<>]*>", re.S)
_FORMAT = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf") + "]")


def terms_of(text: str) -> list[str]:
    """Words of a text after entities, tags, format characters and compatibility forms are dealt with, case folded."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _FORMAT.sub("", text))
    return _WORD.findall(text.casefold())


def _segment(texts: list[str], gap: int) -> tuple[list[int], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the texts, terms in order, documents of each, where each term's positions begin, positions)."""
    terms: dict[str, int] = {}
    starts, parts, at = [], [], 0
    for t in texts:
        words = terms_of(t)
        starts.append(at)
        parts.append(np.fromiter((terms.setdefault(w, len(terms)) for w in words), dtype=np.int32, count=len(words)))
        at += len(words) + gap
    names = sorted(terms)
    rank = np.empty(len(names), dtype=np.int32)
    rank[np.fromiter((terms[w] for w in names), dtype=np.int64, count=len(names))] = np.arange(len(names), dtype=np.int32)
    of = rank[np.concatenate(parts)]
    pos = np.concatenate([np.arange(len(p), dtype=np.int32) + s for p, s in zip(parts, starts, strict=True)])
    order = np.argsort(of, kind="stable")
    of, pos = of[order], pos[order].astype(np.int32)
    doc = np.searchsorted(np.array(starts), pos, side="right")
    first = np.ones(len(of), dtype=bool)
    first[1:] = (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])
    dfs = np.bincount(of[first], minlength=len(names)).astype(np.int32)
    begin = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(names))))).astype(np.int32)
    return starts, names, dfs, begin, pos


def build_index(docs: DataFrame, id_col: str, text_col: str, slop: int = SLOP) -> DataFrame:
    """seg, term, df, positions of every term of every segment; seg, ids, starts of its documents where term is null."""
    src = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    ints, ids_type = pa.list_(pa.int32()), pa.list_(pa.string() if id_type == "string" else pa.int64())

    def rows(seg: int, ids: list, texts: list[str]) -> pa.RecordBatch:
        starts, names, dfs, begin, pos = _segment(texts, 2 * slop + 1)
        n = len(names)
        lists = pa.ListArray.from_arrays(pa.array(begin), pa.array(pos))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, seg)),
                pa.array([*names, None], pa.string()),
                pa.concat_arrays([pa.array(dfs), pa.array([0], pa.int32())]),
                pa.concat_arrays([lists, pa.array([[]], ints)]),
                pa.concat_arrays([pa.nulls(n, ids_type), pa.array([ids], ids_type)]),
                pa.concat_arrays([pa.nulls(n, ints), pa.array([starts], ints)]),
            ],
            names=["seg", "term", "df", "positions", "ids", "starts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[str] = []
        size = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield rows(seg, ids, texts)
                    seg, ids, texts, size = seg + 1, [], [], 0
        if ids:
            yield rows(seg, ids, texts)

    return materialise(src.mapInArrow(run, f"seg bigint, term string, df int, positions array<int>, ids array<{'string' if id_type == 'string' else 'bigint'}>, starts array<int>"), "postings")


def _near(sorted_places: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Whether some place is within slop of each wanted one."""
    if not len(sorted_places):
        return np.zeros(len(wanted), dtype=bool)
    i = np.searchsorted(sorted_places, wanted - slop)
    return (i < len(sorted_places)) & (sorted_places[np.minimum(i, len(sorted_places) - 1)] <= wanted + slop)


def _longest_runs(held: np.ndarray) -> np.ndarray:
    """Of each row the most consecutive true values."""
    best = np.zeros(len(held), dtype=np.int32)
    now = np.zeros(len(held), dtype=np.int32)
    for column in held.T:
        now = np.where(column, now + 1, 0).astype(np.int32)
        np.maximum(best, now, out=best)
    return best


def match_item(words: list[str], dfs: list[int], anchors: list[int], lists: dict[str, np.ndarray], starts: np.ndarray, gap: int, run_length: int, slop: int) -> dict[int, tuple[int, int]]:
    """Document of the segment -> (longest phrase, longest proximity match) of an item, where one is run_length or more."""
    none = np.empty(0, dtype=np.int64)
    of = [lists.get(w, none) for w in words]
    stops = np.append(starts[1:] - gap, np.iinfo(np.int64).max // 2)
    # candidates: an item's place and the document that its anchor stands in
    hits = np.concatenate([of[o] for o in anchors]) if anchors else none
    at = np.concatenate([of[o] - o for o in anchors]) if anchors else none
    places = np.unique(np.stack([at, np.searchsorted(starts, hits, side="right") - 1]), axis=1)
    order = sorted(range(len(words)), key=lambda o: (dfs[o], o))
    found: dict[int, tuple[int, int]] = {}
    step = max(1, CELLS // max(1, len(words)))
    for lo in range(0, places.shape[1], step):
        at, doc = places[:, lo : lo + step]
        # the rarest terms first; candidates that can't reach a run any more are left out
        held = np.zeros((len(at), len(words)), dtype=bool)
        missing = np.zeros(len(at), dtype=np.int32)
        for n, o in enumerate(order):
            held[:, o] = _near(of[o], at + o, slop) & (at + o >= starts[doc] - slop) & (at + o < stops[doc] + slop)
            missing += ~held[:, o]
            if n % 4 == 3:
                live = missing <= len(words) - run_length
                at, doc, held, missing = at[live], doc[live], held[live], missing[live]
                if not len(at):
                    break
        near = _longest_runs(held)
        at, doc, near = (x[near >= run_length] for x in (at, doc, near))
        if not len(at):
            continue
        exact = np.zeros(len(at), dtype=np.int32)
        for shift in range(-slop, slop + 1):
            at_word = [at + shift + o for o in range(len(words))]
            inside = [_near(x, p, 0) & (p >= starts[doc]) & (p < stops[doc]) for x, p in zip(of, at_word, strict=True)]
            np.maximum(exact, _longest_runs(np.stack(inside, axis=1)), out=exact)
        for d, x, y in zip(doc.tolist(), exact.tolist(), near.tolist(), strict=True):
            best = found.get(d, (0, 0))
            found[d] = (max(best[0], x), max(best[1], y))
    return found


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, q (hash of the text), off, term, words (how many the item has) of every word of every item."""
    src = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.xxhash64(text_col).alias("q"), F.col(text_col).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(2).to_pylist()):
                words = terms_of(text)
                at = pa.array([i] * len(words), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(range(len(words)), pa.int32()), pa.array(words, pa.string()), pa.array([len(words)] * len(words), pa.int32())], names=["item_id", "q", "off", "term", "words"])

    return materialise(src.mapInArrow(run, f"item_id {src.schema['item_id'].dataType.simpleString()}, q bigint, off int, term string, words int"), "itemterms")


def find_matches(index: DataFrame, terms: DataFrame, run: int = RUN, slop: int = SLOP) -> DataFrame:
    """doc_id, item_id, words, near of every match of the items (their terms) in the index."""
    vocabulary = materialise(terms.select("term").distinct(), "vocabulary")
    df = index.where("term is not null").select("term", "df").join(vocabulary, "term").groupBy("term").agg(F.sum("df").alias("df"))
    rated = materialise(terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))), "itemterms")
    ahead = Window.partitionBy("item_id", "q").orderBy("off").rowsBetween(0, run - 1)
    rarest = F.min(F.struct("df", "off", "term")).over(ahead)
    anchors = rated.withColumn("x", rarest).where(F.col("off") + run <= F.col("words")).select("item_id", "q", "x.off", "x.term").distinct()
    anchors = materialise(anchors, "anchors")
    hits = materialise(index.where("term is not null").select("term", "seg").join(anchors, "term").select("seg", "item_id", "q").distinct(), "hits")
    queries = rated.groupBy("item_id", "q").agg(F.array_sort(F.collect_list(F.struct("off", "term", "df"))).alias("of"))
    queries = queries.join(anchors.groupBy("item_id", "q").agg(F.array_sort(F.collect_set("off")).alias("anchors")), ["item_id", "q"])
    parts = hits.groupBy("seg").agg(F.ceil(F.count("*") / ITEMS).cast("int").alias("parts"))
    asked = hits.join(parts, "seg").withColumn("part", F.pmod(F.xxhash64("item_id", "q"), F.col("parts")).cast("int"))
    asked = asked.join(queries, ["item_id", "q"]).select("seg", "part", "item_id", F.col("of.term").alias("words"), F.col("of.df").alias("dfs"), "anchors")
    wanted = index.join(vocabulary, "term", "left_semi").unionByName(index.where("term is null"))
    wanted = wanted.join(parts, "seg").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("seg", "part", "term", "positions", "ids", "starts")
    id_type, item_type = index.schema["ids"].dataType.elementType.simpleString(), terms.schema["item_id"].dataType.simpleString()
    gap = 2 * slop + 1

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(right) and len(left):
            directory = left["term"].isna().to_numpy()
            ids, starts = left.loc[directory, "ids"].iloc[0], np.asarray(left.loc[directory, "starts"].iloc[0], dtype=np.int64)
            lists = {t: np.asarray(p, dtype=np.int64) for t, p in zip(left.loc[~directory, "term"], left.loc[~directory, "positions"], strict=True)}
            for r in right.itertuples():
                found = match_item(list(r.words), list(r.dfs), [int(x) for x in r.anchors], lists, starts, gap, run, slop)
                out += [(ids[d], r.item_id, x, y) for d, (x, y) in found.items()]
        return pd.DataFrame(out, columns=["doc_id", "item_id", "words", "near"])

    # the partitions are named, as small ones would be merged into one task by their bytes, and matching takes time
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (x.repartition(tasks, "seg", "part").groupBy("seg", "part") for x in (wanted, asked))
    found = left.cogroup(right).applyInPandas(match, f"doc_id {id_type}, item_id {item_type}, words int, near int")
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max("near").alias("near"))


def leak_matches(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", run: int = RUN, slop: int = SLOP) -> DataFrame:
    """doc_id, item_id, words, near: longest phrase and longest proximity match of the item in the document; at least one
    is run words or more."""
    return find_matches(build_index(docs, doc_col, text_col, slop), item_terms(items, item_col, text_col), run, slop)


def leaked_phrases(docs: DataFrame, items: DataFrame, **k) -> DataFrame:
    """doc_id, item_id: the document holds run or more consecutive words of the item."""
    return leak_matches(docs, items, **k).where(F.col("words") >= k.get("run", RUN)).select("doc_id", "item_id")


def leaked_items(docs: DataFrame, items: DataFrame, **k) -> DataFrame:
    """item_id, documents, near_documents, words: how many documents hold a phrase of the item or only a proximity match,
    and the longest phrase; items that did not leak are left out."""
    phrase = F.col("words") >= k.get("run", RUN)
    return leak_matches(docs, items, **k).groupBy("item_id").agg(F.count(F.when(phrase, 1)).alias("documents"), F.count(F.when(~phrase, 1)).alias("near_documents"), F.max("words").alias("words"))
