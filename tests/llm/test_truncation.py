"""Truncation: ends of replies by shape, and limits in planted lengths."""

import json
import random

import pytest

from tessella.llm import replies, truncation

TEXT = "With nimble direction the tale comforts even casual fans."


@pytest.mark.parametrize(
    ("value", "verdict"),
    [
        ("Ranking: fans > tale >", 1),
        ('{"salience": [["With", 7], ["nimble", 3]]}', 0),
        ('{"salience": [{"With": 7.5}, {"nimble": 3},]}', 0),
        ("Sure! {'rationale': 'It says \"fans\" twice over.'} // end", 0),
        ('```json\n{"ranking": ["fans", "tale"]}\n```', 0),
        ('{"salience": [["With", 7], ["nim', 1),
        ('{"salience": [{"With": 7.5}, {"nimble": 3', 1),
        ('```json\n{"ranking": ["fans", "ta\n```', 1),
        ('{"ranking": ["fans", "tale"…[output clipped]', 1),
        ('{"rationale": "It says ... (+14 chars)', 1),
        ('{"rationale": "It says \\', 1),
        ('{"rationale": "It says f�', 1),
        ("1. fans\n2. tale", 0),
        ("1. fans\n2. ta", 1),
        ("1. fans\n2.", 1),
        ("Ranking: fans > tale > ", 1),
        ("Ranking: fans > tale", 0),
        ("Ranking: fans > whole", 2),
        ('{"rationale": ""}', 0),
        ("", 0),
        ("N/A", 0),
        ("```json", 1),
        ("```json\n\n```", 0),
        ('{"rationale": "The tale is wa"}', 2),
        ("The tale is warm", 2),
        ("The tale is warm.", 0),
        (TEXT[:-1], 0),
        ("- The tale is warm, and it says so.", 0),
        ("<single sentence>", 2),
        ('{"rationale": "It says so."' + " " * 200_000 + "}", 0),
        ('{"rewritten": "a b c", "new_prediction": "x",}\n\nHope this helps', 0),
    ],
)
def test_endings(value, verdict):
    assert replies.ending(replies.read(value), TEXT, None, "positive")[0] == verdict


def rows(rng):
    out = []
    for i in range(3000):
        s = f"The words number {rng.randint(1, 10**rng.randint(1, 40))} give a reading that fits positive better than the other labels"
        v = json.dumps({"rationale": s + rng.choice([".", ".", ""])})
        cut = False
        if i % 12 == 0:
            cut, v = True, (v[:50] if i % 24 else v[: rng.randint(3, len(v) - 4)])
        elif i % 31 == 0:
            cut, v = True, json.dumps({"rationale": s[: s.rindex("fits") + 3]})
        out.append((i, ["Alpha ", "alpha", "BETA", None][i % 4], TEXT, "positive", "say why", v, cut))
    return out


def test_cut_values_and_limits(spark):
    data = rows(random.Random(4))
    extra = [(9001, "alpha", None, None, None, None, False), (9002, "alpha", TEXT, "positive", None, "", False), (9003, "alpha", TEXT, None, None, " ", False), (9004, None, TEXT, None, None, "x " * 300_000 + "and so.", False)]
    df = spark.createDataFrame(data + extra, "result_id long, model string, text string, predicted_label string, rationale_explain_prompt string, raw_rationale string, source boolean").withColumn("id", truncation.F.lit(1))
    fields = {"raw_rationale": "rationale_explain_prompt"}
    got = {r.id for r in truncation.cut_values(df, fields).collect()}
    assert got == {r[0] for r in data if r[6]}
    rates = {r.source: r for r in truncation.cut_rates(df, fields).collect()}
    assert set(rates) == {"alpha", "beta", None} and "50" in rates["alpha"].limits.split(",") and rates["alpha"].cut == rates["alpha"].cut_at_limit + rates["alpha"].cut_in_transfer
    assert truncation.cut_values(df.limit(0), fields).count() == 0 and truncation.cut_rates(df.limit(0), fields).count() == 0


def test_tail_is_that_of_the_poisson_distribution():
    import math

    import pandas as pd

    for c, m in ((3, 0.5), (1, 2.0), (40, 12.0), (0, 1.0)):
        want = 1 - sum(math.exp(-m) * m**k / math.factorial(k) for k in range(c))
        assert truncation._tail(pd.Series([c]), pd.Series([m]))[0] == pytest.approx(want, rel=1e-6, abs=1e-14)


def test_hazards_are_those_of_a_plain_count(spark):
    rng = random.Random(9)
    lengths = [rng.choice((1, 2, 3, 4, 7, 12, 13, 14, 15, 16, 30, 31, 33, 60)) for _ in range(400)] + [13] * 60
    rows = [(i, "ab"[i % 2], "f", n, n, 0, "") for i, n in enumerate(lengths)] + [(None, None, "f", 7, 0, truncation.INSIDE, "x y z")]
    ends = spark.createDataFrame(rows, truncation.ENDS.format(id="bigint"))
    got = truncation.length_hazards(ends).collect()
    assert {r.pooled for r in got} == {True, False}
    for r in got:
        own = [n for i, n in enumerate(lengths) if r.pooled or "ab"[i % 2] == r.source]
        risk = lambda at: sum(n >= at for n in own)  # noqa: B023,E731
        around = [at for at in range(max(1, r.cut_length - 10), r.cut_length + 11) if at != r.cut_length]
        assert r.at_risk == risk(r.cut_length) and r["values"] == own.count(r.cut_length)
        near = (sum(own.count(at) for at in around) + 0.5) / max(1, sum(map(risk, around)))
        assert r.near_hazard == pytest.approx(near)
    assert {r.cut_length for r in got if r.is_limit and r.pooled} >= {13}


def test_a_limit_decides_on_ends_that_words_leave_open(spark):
    """The same unstopped end is finished elsewhere, and cut where far more values stop than around."""
    def end(i, n, verdict, words, id_=True):
        return (i if id_ else None, "a" if id_ else None, "f", n, n, verdict, words)

    rows = [end(i, 40 + i % 400, 0, "all that is") for i in range(1200)]
    rows += [end(2000 + i, 40 + i % 60, 2, "all that is") for i in range(60)]
    rows += [end(3000 + i, 70, 2, "all that is") for i in range(300)]
    rows += [end(None, 40_000, truncation.INSIDE, "other words here", False), end(None, 3000, truncation.INSIDE, "all that is", False)]
    got = truncation.judged(spark.createDataFrame(rows, truncation.ENDS.format(id="bigint"))).where("is_cut").collect()
    assert {r.cut_length for r in got} == {70} and all(r.at_limit for r in got) and len(got) >= 300
