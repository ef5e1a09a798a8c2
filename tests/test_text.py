"""Text functions and kernels case by case."""

from difflib import SequenceMatcher
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest

from pyspark.sql import functions as F

from tessella.functions import kernels
from tessella.functions import text as tx

CASES = ["", None, "   ", "Hello, world!", "  spaced out\ttext \n", "café's C'EST  «là»", "$5 #1 a-b--c", "x" * 50_000, "Don't you 're [SEP] no"]


def one(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def py_words(t):
    import string

    return [w for w in (x.strip(string.punctuation).lower() for x in (t or "").split()) if w]


def test_tokens(spark):
    assert one(spark, CASES, tx.content_word_count) == [len(py_words(t)) for t in CASES]
    assert one(spark, CASES, tx.normalized_key) == [None if t is None else " ".join(py_words(t)) for t in CASES]
    assert one(spark, CASES, tx.token_set) == [None if t is None else sorted(set(py_words(t))) for t in CASES]
    assert one(spark, ["7", "12", "13", "1", "17", "100"], lambda c: tx.dynamic_k(c.cast("int"))) == [max(3, round(n / 5)) for n in (7, 12, 13, 1, 17, 100)]
    assert one(spark, ["Not", "the", "Text", "'Won't'", "[SEP]", "Great!", None], tx.normalize) == ["not", None, None, "won't", None, "great", None]
    assert one(spark, ["It's good, isn't it?", "you 're", "you're", "charm-less (é)"], tx.canonical_tokens) == [["it", "'s", "good", ",", "is", "n't", "it", "?"], ["you", "'re"], ["you", "'re"], ["charm-less", "(", "é", ")"]]
    assert one(spark, ["a", "a b", " ", None, "x-y"], tx.is_single_word) == [True, False, False, None, True]


def test_cleaning_and_markup(spark):
    got = one(spark, ["a &lt;b&gt;x&lt;/b&gt; #39; &amp; &bogus; ok", "plain", None, "<p>", "#1114112;#0;"], tx.clean_text)
    assert got == ["a x ' &  ok", "plain", None, "", ""]
    assert one(spark, ["<p>", "a &amp; b", "#39;", "fine & dandy <3", None], tx.has_markup) == [True, True, True, False, None]
    assert one(spark, ["ab", "aé", "éé", ""], tx.non_ascii_share) == [0.0, 0.5, 1.0, 0.0]


def test_erase_and_spans(spark):
    tokens = F.array(F.lit("good"), F.lit("film"))
    assert one(spark, ["A Good, film!\nnot good", None, ""], lambda c: tx.erase(c, tokens, "mask")) == ["A [MASK] [MASK] not [MASK]", None, ""]
    assert one(spark, ["A Good, film! not"], lambda c: tx.erase(c, tokens, "delete")) == ["A not"]
    assert one(spark, ["p Hypothesis: h", "none"], lambda c: tx.after_marker(c, "Hypothesis:")) == [" h", ""]
    assert one(spark, ["p Hypothesis: h", "none"], lambda c: tx.before_marker(c, "Hypothesis:")) == ["p Hypothesis:", "none"]
    assert one(spark, ["I CANNOT do it", "fine", None], tx.is_refusal) == [True, False, False]
    assert one(spark, ["0", "1", "7", "-1", "neg", "x", None], lambda c: tx.map_label(c, ["neg", "pos"])) == ["neg", "pos", None, None, "neg", None, None]
    assert one(spark, ["x"], lambda c: tx.render("a {input_text} b", input_text=c)) == ["a x b"]
    assert one(spark, ["{label_set}", "{other}", None], tx.leftover_placeholder) == [True, False, None]


def test_is_anchored(spark):
    df = spark.createDataFrame([("Film!", "a film here", True), ("fil", "a film", False), ("Don't", "I DON'T know", True), ("", "x", False)], "t string, x string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", tx.is_anchored(F.col("t"), F.col("x"))).collect())


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('Sure:\n```json\n{"a": [1, 2]}\n```\nbye', {"a": [1, 2]}),
        ('text {"a": "b"} more', {"a": "b"}),
        ('{"r": "he said "no" to it", "n": 1}', {"r": 'he said "no" to it', "n": 1}),
        ('{"r": "ends with "quote""}', {"r": 'ends with "quote"'}),
        ("[1, 2]", None),
        ("no json", None),
        ("", None),
        ('{"a": ', None),
    ],
)
def test_json_object(reply, want):
    got = kernels.json_object_of(reply)
    assert (json.loads(got) if got else None) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_word_distance(a, b):
    rows = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, rows = rows, [i]
        for j, y in enumerate(b, 1):
            rows.append(min(prev[j] + 1, rows[j - 1] + 1, prev[j - 1] + (x != y)))
    assert kernels.word_distance(a, b) == rows[-1]


def test_changed_words():
    a, b = "the film is good , truly good .".split(), "the movie is bad , truly good .".split()
    assert kernels.changed_words(a, b) == ["film", "good"]
    assert kernels.changed_words(a, [*a, "not"]) == []
    rng = random.Random(0)
    for _ in range(50):
        x, y = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in "xy")
        kept = {w for op, i, j, _, _ in SequenceMatcher(None, x, y).get_opcodes() if op in ("replace", "delete") for w in x[i:j]}
        assert set(kernels.changed_words(x, y)) == kept


def test_weighted_chance(spark):
    rows = [(1, 2, 2, {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}), (2, 2, 2, {"a": 1e9, "b": 1e9, "c": 1.0, "d": 1.0}), (3, 2, 2, {"a": 1.0}), (4, 0, 2, {"a": 1.0, "b": 1.0}), (5, 9, 9, {"a": 1.0, "b": 2.0})]
    df = spark.createDataFrame(rows, "k long, a int, b int, w map<string,double>")
    got = {r.k: r.x for r in df.select("k", kernels.weighted_chance(F.col("a"), F.col("b"), F.col("w"), F.col("k"), 4000).alias("x")).collect()}
    assert got[1] == pytest.approx(1 / 6 + 4 / 6 / 3, abs=0.02) and got[2] > 0.99 and got[3] is None and got[4] is None and got[5] == 1
