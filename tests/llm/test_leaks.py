"""Leaked passages against a walk over all word windows."""

import html
import random
import re
import unicodedata

from tessella.llm import leaks


def words(t):
    t = re.sub(r"<[/!?]?[A-Za-z][^<>]*>", "", html.unescape(t))
    t = unicodedata.normalize("NFKC", "".join(c for c in t if unicodedata.category(c) != "Cf"))
    return re.findall(r"[^\W_]+", t.casefold())


def brute(docs, items, run=10):
    grams = {}
    for i, t in items:
        w = words(t or "")
        for p in range(len(w) - run + 1):
            grams.setdefault(tuple(w[p : p + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t or "")
        if d is not None:
            out |= {(d, i) for p in range(len(w) - run + 1) for i in grams.get(tuple(w[p : p + run]), ()) if i is not None}
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def cases():
    rng = random.Random(11)
    w = lambda: rng.choice(["the", "a", "of", "red", "blue", f"n{rng.randint(0, 400)}"])
    items = [(i, " ".join(w() for _ in range(rng.randint(8, 30)))) for i in range(40)]
    docs = [(d, " ".join(w() for _ in range(rng.randint(0, 80)))) for d in range(120)]
    for d in range(60):
        iw = words(items[d % 40][1])
        n = rng.randint(8, 13)
        p = rng.randint(0, max(0, len(iw) - n))
        docs[d] = (d, docs[d][1] + "; " + ", ".join(iw[p : p + n]).upper() + ". " + docs[d + 1][1])
    docs += [(500, "The <b>re­d</b> &amp; " + items[3][1]), (501, None), (None, items[3][1]), (502, ""), (503, ""), (504, items[4][1] * 3), docs[0]]
    docs.append((507, " ".join(words(items[6][1])[:3])))
    docs.append((505, " ".join(words(items[5][1])[:5])))
    docs.append((506, " ".join(words(items[5][1])[5:])))
    return docs, [*items, (None, items[0][1]), (100, None), (101, ""), (102, "the the the the the the the the the the the the"), (0, items[0][1])]


def test_phrases(spark, monkeypatch):
    docs, items = cases()
    d, i = frames(spark, docs, items)
    want = brute(docs, items)
    assert len(want) > 20 and (500, 3) in want
    assert {tuple(r) for r in leaks.leaked_phrases(d, i).collect()} == want
    # segments of a few documents, seven items of a segment in a part, few places looked at together
    for name, value in (("CHUNK", 300), ("ITEMS", 7), ("CELLS", 50)):
        monkeypatch.setattr(leaks, name, value)
    assert {tuple(r) for r in leaks.leaked_phrases(d, i).collect()} == want


def test_one_index_answers_any_items(spark):
    """The index holds every term of the corpus, so items that come later need no second reading."""
    docs, items = cases()
    d, i = frames(spark, docs, items)
    index = leaks.build_index(d, "doc_id", "text").cache()
    held = {r.term for r in index.where("term is not null").collect()}
    assert held == {w for x, t in docs if x is not None for w in words(t or "")}
    for part in (i.where("item_id % 2 = 0"), i.where("item_id % 2 = 1")):
        got = leaks.find_matches(index, leaks.item_terms(part, "item_id", "text")).where("words >= 10").select("doc_id", "item_id")
        assert {tuple(r) for r in got.collect()} == brute(docs, [tuple(r) for r in part.collect()])


def test_proximity_and_report(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "other words that nobody ever wrote down in any text here")]
    docs = [(1, "x one two three four very five six seven eight nine ten y"), (2, "one two three four five six seven eight nine ten eleven"), (3, "twelve eleven ten nine eight seven six five four three two one")]
    d, i = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id): (r.words, r.near) for r in leaks.leak_matches(d, i).collect()}
    assert got == {(1, 1): (6, 10), (2, 1): (11, 11)}
    assert [tuple(r) for r in leaks.leaked_items(d, i).collect()] == [(1, 1, 1, 11)]


def test_runs_of_one_item_in_neighbouring_documents(spark):
    items = [(1, " ".join(f"t{i}" for i in range(40)))]
    gap = 2 * leaks.SLOP + 1
    docs = [(1, " ".join(f"t{i}" for i in range(12))), (2, " ".join(f"t{i}" for i in range(12 + gap, 40)))]
    d, i = frames(spark, docs, items)
    assert {tuple(r) for r in leaks.leaked_phrases(d.coalesce(1), i).collect()} == {(1, 1), (2, 1)}


def test_empty(spark):
    d, i = frames(spark, [(1, "a b c")], [(1, "a b c")])
    for x, y in ((d.limit(0), i), (d, i.limit(0)), (d, i)):
        assert leaks.leaked_phrases(x, y).count() == 0


def test_given(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert {tuple(r) for r in leaks.leaked_phrases(docs, items).collect()} == want and want
