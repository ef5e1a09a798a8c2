"""Shared spans against all pairs of long substrings."""

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from tessella.llm import spans


def brute(docs, length):
    index = defaultdict(set)
    for i, t in docs:
        if t is not None and i is not None:
            for p in range(len(t) - length + 1):
                index[t[p : p + length]].add(i)
    return {(a, b) for s in index.values() for a in s for b in s if a < b}


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def run(spark, docs, **k):
    df = frame(spark, docs)
    return {tuple(r) for r in spans.shared_pairs(df, batches=[df.where("coalesce(doc_id, 0) % 3 = 0"), df.where("doc_id % 3 = 1"), df.where("doc_id % 3 = 2")], **k).collect()}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab\U0001f600é", max_size=60), st.integers(1, 6), st.integers(0, 10))
def test_window_minima(text, k, more):
    h = spans.gram_hashes(spans.codes_of(text), k)
    assert len({(int(x), text[i : i + k]) for i, x in enumerate(h)}) == len({text[i : i + k] for i in range(len(h))})
    w = more + 1
    want = [min(h[i : i + w]) for i in range(len(h) - w + 1)]
    assert list(spans.window_minima(h, w)) == want


def test_planted(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh éö\U0001f600") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs = [[i, text(60)] for i in range(60)]
    for a, b, n in ((1, 2, 250), (3, 7, 249), (4, 9, 251), (5, 50, 120), (6, 8, 300)):
        docs[a][1] = (docs[a][1] + text(80))[:400]
        docs[b][1] = docs[b][1][:100] + docs[a][1][100 - 3 : 97 + n] + "#" + docs[b][1][:90]
    docs += [[100, docs[1][1]], [101, docs[1][1]], [102, None], [None, docs[1][1]], [103, ""], [104, "ab" * 400], [105, "ba" * 300], [1, docs[1][1]]]
    want = brute(docs, 250)
    assert (1, 2) in want and (3, 7) not in want and (4, 9) in want and (104, 105) in want
    assert run(spark, docs) == want


def test_hot_boilerplate(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT", 3)
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    plate = noise(55)
    docs = [(i, noise(70) + plate + noise(70)) for i in range(30)]
    docs += [(30 + i, docs[i][1][: 60 + 55 + i]) for i in range(20)]
    want = brute(docs, 60)
    assert want
    assert run(spark, docs, min_chars=60, gram=16) == want


def test_share(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    a, b = noise(300), noise(280)
    docs = [(1, a + noise(300)), (2, noise(100) + a + b), (3, b + noise(20)), (4, noise(500)), (5, noise(500)), (6, None), (7, "")]
    docs.append((8, docs[4][1]))
    got = {r.doc_id: r for r in spans.shared_share(frame(spark, docs)).collect()}
    assert [got[i].shared_chars for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [300, 580, 280, 0, 500, 0, 0, 500]
    assert got[8].class_id == 5 and got[2].links == 2 and got[5].copies == 1 and got[3].share == round(280 / 300, 6)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x" * 300, 2, 3), (2, "x" * 299, 1, 1)], "doc_id long, text string, th long, n long")
    assert [tuple(r) for r in spans.shared_pairs(df).collect()] == [(1, 2)]
    assert spans.shared_pairs(df.limit(0)).count() == 0 and spans.shared_share(df.limit(0)).count() == 0


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in spans.shared_pairs(docs).collect()} == brute(rows, 250)


def test_hashes_of_very_long_text():
    t = "lorem ipsum " * 200_000
    where, fp = spans.fingerprints([t, None, "short"], 250, 64)
    assert set(where) == {0} and len(np.unique(fp)) <= 12
