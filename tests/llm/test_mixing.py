"""Mixing: shares, repeats and whole documents."""

from collections import Counter, defaultdict

import pytest

from tessella.llm import mixing


def frames(spark):
    docs = [(i, " a" * (1 + i % 7), ["Big ", "big", "small", "none-asked", None][min(i % 10 // 2, 4) if i % 10 > 3 else 0]) for i in range(400)]
    docs += [(1000, None, "big"), (1001, "", "small"), (None, " a a", "big"), (1002, " a" * 5000, "long")]
    targets = [("big", 0.5, 2), ("SMALL", 0.3, 3), ("absent", 0.05, 9), ("long", 0.1, None), (None, 0.1, 2), ("big", None, 1), ("odd", -1.0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(targets, "source_name string, target_weight double, max_repeats int")


def test_schedule_is_even(spark):
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 1), ("c", 0.2, 1)], "source_name string, target_weight double, max_repeats int")
    rows = mixing.schedule(t, 5000).collect()
    seen = Counter(r.source_name for r in rows)
    assert abs(seen["a"] - 2500) <= 6 and abs(seen["b"] - 1250) <= 6 and abs(seen["c"] - 1000) <= 6 and sum(seen.values()) <= 5000
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.slot):
        by[r.source_name].append(r.rank)
    assert all(v == list(range(len(v))) for v in by.values())
    early = Counter(r.source_name for r in rows if r.slot < 100)
    assert abs(early["a"] - 50) <= 4


def test_mixture(spark, monkeypatch):
    docs, targets = frames(spark)
    sized = mixing.token_counts(docs).cache()
    size = {(r.doc_id, r.source_name): r.tokens for r in sized.collect()}
    assert size[1000, "big"] == 0 and size[None, "big"] == 2 and size[1002, "long"] == 5000
    total = sum(size.values())
    monkeypatch.setattr(mixing, "BUCKET", 17)
    report = {r.source_name: r for r in mixing.mixture_report(sized, targets, 8).collect()}
    assert set(report) == {"big", "small", "absent", "long", "odd"}
    rows = mixing.mixture(sized, targets, 8).collect()
    used = defaultdict(int)
    for r in rows:
        assert 0 <= r.from_token < r.to_token <= size[r.doc_id, r.source_name]
        used[r.source_name] += r.to_token - r.from_token
        assert r.repeat <= {"big": 2, "small": 3}[r.source_name]
    for s in ("big", "small"):
        mine = sum(n for (_, x), n in size.items() if x == s)
        assert report[s].tokens == mine and report[s].provided_tokens == used[s] <= mine * report[s].max_repeats
        assert report[s].short == (mine * report[s].max_repeats < report[s].target_weight * total)
        whole = Counter()
        for r in rows:
            if r.source_name == s and r.repeat == 1:
                whole[r.doc_id] += r.to_token - r.from_token
        if report[s].unfilled_slots:
            assert whole == {d: n for (d, x), n in size.items() if x == s and n}
    assert report["absent"].short and report["long"].short and not report["odd"].short
    slots = defaultdict(int)
    for r in rows:
        slots[r.slot] += r.to_token - r.from_token
    assert max(slots.values()) == 8
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1, abs=1e-4)


def test_even_shares_when_all_reach_their_weight(spark):
    docs = spark.createDataFrame([(i, " a" * 10, "xyz"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    t = spark.createDataFrame([("x", 0.5, 2), ("y", 0.3, 1), ("z", 0.2, 1)], "source_name string, target_weight double, max_repeats int")
    got = {r.source_name: r for r in mixing.mixture_report(mixing.token_counts(docs), t).collect()}
    assert all(abs(got[s].actual_share - w) < 0.02 and not got[s].short for s, w in (("x", 0.5), ("y", 0.3), ("z", 0.2)))


def test_empty(spark):
    docs, targets = frames(spark)
    sized = mixing.token_counts(docs)
    assert mixing.mixture(mixing.token_counts(docs.limit(0)), targets).count() == 0
    assert mixing.mixture(sized, targets.limit(0)).count() == 0 and mixing.mixture_report(sized, targets.limit(0)).count() == 0
    assert {r.provided_tokens for r in mixing.mixture_report(mixing.token_counts(docs.limit(0)), targets).collect()} == {0}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    docs, _ = frames(spark)
    got = {r.doc_id: r.tokens for r in mixing.token_counts(docs, tokenizer=f"/opt/tokenizers/{name}").collect()}
    assert got[1001] == 0 and got[1002] >= 5000


@pytest.mark.parametrize("weights", [(60.0, 40.0), (0.8, 0.8), (0.1, 0.1)])
def test_weights_are_relative(spark, weights):
    docs = spark.createDataFrame([(i, " a" * 10, "xy"[i % 2]) for i in range(2000)], "doc_id long, text string, source string")
    t = spark.createDataFrame([("x", weights[0], 3), ("y", weights[1], 3)], "source_name string, target_weight double, max_repeats int")
    got = {r.source_name: r for r in mixing.mixture_report(mixing.token_counts(docs), t).collect()}
    want = weights[0] / sum(weights)
    assert abs(got["x"].actual_share - want) < 0.01 and abs(got["x"].target_weight - want) < 1e-9
    assert got["x"].unfilled_slots == got["y"].unfilled_slots == 0
    assert abs(got["x"].provided_tokens + got["y"].provided_tokens - sum(r.tokens for r in got.values())) <= 2 * 128
