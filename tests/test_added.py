"""JSON repair, file order, quotas, the word scorer, outcome aggregates and SQL functions."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import kernels, registry
from tessella.operators import aggregate, curate, erasure
from tessella.sources import jsonl


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        (r'{"a":"x\\","b":"he said "hi" ok"}', {"a": "x\\", "b": 'he said "hi" ok'}),
        (r'{"a":"x\\\"y","b":1}', {"a": 'x\\"y', "b": 1}),
        ('{"a":"say "no""}', {"a": 'say "no"'}),
        ("no object", None),
    ],
)
def test_quotes_after_backslashes(reply, want):
    got = kernels.json_object_of(reply)
    assert (None if got is None else json.loads(got)) == want


def test_salience_entries():
    of = lambda s: [(e["word"], e["score"]) for e in kernels.salience_of(json.dumps({"salience": s}))]
    assert of([["a", 1], {"b": 2}, ["c"], 7, ["d", "x"], [1, True]]) == [("a", 1.0), ("b", 2.0), ("d", None), (None, 1.0)]
    assert of({"a": 3, "b": None}) == [("a", 3.0), ("b", None)] and of("text") == [] and kernels.salience_of("nothing") is None


def test_last_line_wins_over_several_files(spark, tmp_path):
    for name, decision in (("b.jsonl", "drop"), ("a.jsonl", "keep")):
        (tmp_path / name).write_text(json.dumps({"instance_id": "x", "decision": decision}) + "\n" + json.dumps({"instance_id": name, "decision": "keep"}) + "\n")
    got = [(r.instance_id, r.decision) for r in jsonl.read_decisions(spark, str(tmp_path)).collect()]
    assert got == [("x", "drop"), ("a.jsonl", "keep"), ("b.jsonl", "keep")]


@pytest.mark.parametrize("target", [0, 1, 7, 23, 60, 10**7])
def test_balanced_quotas_are_those_of_rounds(spark, target):
    have = {"a": 5, "b": 0, "c": 30, "d": 2, "e": 17}
    got = {r.label: r.quota for r in curate.balanced_quotas(spark.createDataFrame([("x", k, n) for k, n in have.items()], "dataset string, label string, available long"), target).collect()}
    t = min(target, sum(have.values()))
    want = {k: min(n, t // 5 + (i < t % 5)) for i, (k, n) in enumerate(sorted(have.items()))}
    while sum(want.values()) < t:
        for k in sorted(have):
            if want[k] < have[k] and sum(want.values()) < t:
                want[k] += 1
    assert got == want


def test_word_scorer_depends_on_words_only(spark):
    rows = [(1, "The good film"), (2, "film, GOOD the"), (3, ""), (4, None)]
    labels = F.array(F.lit("p"), F.lit("n"))
    got = {r.i: r.l for r in spark.createDataFrame(rows, "i int, t string").select("i", erasure.word_scorer(F.col("t"), labels).alias("l")).collect()}
    assert got[1] == got[2] and got[1] in "pn" and got[3] == "p"


def test_outcome_columns(spark):
    rows = [("m", "d", True, 0.5, 0.2, True, False, 0.1, None), ("m", "d", False, 0.1, None, False, False, None, "no flip"), ("m", "d", None, 0.9, 0.3, None, True, 0.3, "identical")]
    df = spark.createDataFrame(rows, "model string, dataset string, right boolean, ecs double, ecs_adj double, model_refused boolean, declined boolean, changed_share double, cf_error string")
    r = aggregate.grouped(df, aggregate.outcome_columns()).where("level = 'overall'").first()
    assert (r.n_instances, r.n_judged, r.accuracy) == (3, 2, 0.5) and (r.mean_ecs_correct, r.mean_ecs_incorrect, r.mean_ecs_adj_incorrect) == (0.5, 0.1, 0.0)
    assert r.refusal_rate == pytest.approx(1 / 3) and r.cf_valid_rate == pytest.approx(1 / 3) and r.flip_rate == pytest.approx(2 / 3) and r.mean_minimality == pytest.approx(0.2)


def test_sql_functions(spark):
    assert set(registry.register(spark)) == set(registry.FUNCTIONS)
    r = spark.sql("select set_jaccard(array('a','b'), array('b','c')) j, set_overlap(array('a','b'), array('b')) o, set_jaccard(array(), array('b')) e, set_difference(array('a','b'), array('b','c')) d, text_words(' a  b') w, evidence_size(40) k, changed_share(1, 4) c").first()
    assert (r.j, r.o, r.e, r.d, r.w, r.k, r.c) == (pytest.approx(1 / 3), 1.0, None, ["a", "c"], ["a", "b"], 8, 0.25)
