"""Curation, parsing, erasure, resampling, sources, sinks and streaming on small tables."""

from datetime import datetime
import json
import random

import pytest

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import aggregate, crossmodel, curate, erasure, evidence, parse, resample
from tessella.sources import jsonl, sinks
from tessella.streaming import ingest


def test_quality_gates(spark):
    texts = ["", None, "a b", "x " * 400, "one <b>two three", "ééééé éééé éé a", "the good film", "The GOOD film!", "another good film", "   "]
    rows = [(f"i{k}", t, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "instance_id string, text string, reason2 int").withColumn("content_words", tx.content_word_count(F.col("text")))
    got = {r.instance_id: r.reason for r in curate.quality_filter(df).collect()}
    assert got == {"i0": "empty", "i1": "empty", "i2": "too_short", "i3": "too_long", "i4": "junk", "i5": "junk", "i6": None, "i7": "exact_dup", "i8": None, "i9": "empty"}
    assert curate.quality_filter(df.limit(0)).count() == 0


def test_tertiles_by_position(spark):
    rng = random.Random(2)
    groups = {"a": [rng.randint(1, 5) for _ in range(20)], "b": [1], "c": [3, 3, 3], None: [1, 2]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "dataset string, content_words int")
    got = {r.dataset: (r.t1, r.t2) for r in curate.tertiles(df, ["dataset"], "content_words").collect()}
    assert got == {g: (sorted(v)[len(v) // 3], sorted(v)[2 * len(v) // 3]) for g, v in groups.items()}


def quotas(available, target):
    labels = sorted(available)
    target = min(target, sum(available.values()))
    base, rem = divmod(target, len(labels))
    q = {x: min(base + (i < rem), available[x]) for i, x in enumerate(labels)}
    missing = target - sum(q.values())
    while missing:
        for x in labels:
            if missing and q[x] < available[x]:
                q[x] += 1
                missing -= 1
    return q


def test_balanced_quotas(spark):
    rng = random.Random(5)
    cases = {f"d{i}": {f"l{j}": rng.randint(1, 30) for j in range(rng.randint(1, 5))} for i in range(40)}
    df = spark.createDataFrame([(d, x, n) for d, c in cases.items() for x, n in c.items()], "dataset string, label string, available long")
    got = {(r.dataset, r.label): r.quota for r in curate.balanced_quotas(df, 37).collect()}
    assert got == {(d, x): n for d, c in cases.items() for x, n in quotas(c, 37).items()}


def test_pools_and_selection(spark):
    rng = random.Random(6)
    rows = [(f"i{k}", rng.choice(["x", "y", None]), rng.choice(["short", "long"]), rng.choice(["g", None]), "d1" if k % 3 else "d2", f"text {rng.randint(0, 400)}") for k in range(500)]
    df = spark.createDataFrame(rows, "instance_id string, label string, length_bucket string, genre string, dataset string, text string")
    pool = curate.stratified_pool(df, 60, ["label", "length_bucket"])
    assert {r.dataset: r["count"] for r in pool.groupBy("dataset").count().collect()} == {"d1": 60, "d2": 60}
    assert pool.select("instance_id").distinct().count() == 120
    assert max(r["count"] for r in pool.groupBy("dataset", "label", "length_bucket").count().collect()) == 10
    chosen = curate.select_balanced(df.where("label is not null"), 50, ["genre", "length_bucket"])
    assert {(r.dataset, r.label): r["count"] for r in chosen.groupBy("dataset", "label").count().collect()} == {(d, x): 25 for d in ("d1", "d2") for x in "xy"}
    even = curate.sample_balanced(df, 31)
    assert {r["count"] for r in even.groupBy("dataset", "label").count().collect()} == {15}
    kept = curate.greedy_near_dedup(pool)
    assert kept.select("dataset", "text").distinct().count() == kept.count() == pool.select("dataset", "text").distinct().count()
    assert curate.stratified_pool(df.limit(0), 10, ["label"]).count() == 0


def test_decisions(spark):
    ts = lambda d: datetime(2031, 1, d)
    dec = spark.createDataFrame([("a", "keep", "", ts(1)), ("a", "DROP", "odd", ts(2)), ("b", " Keep ", None, ts(1)), ("c", "drop", " ", ts(1)), (None, "drop", "x", ts(1)), ("z", "keep", "", ts(1)), ("b", " Keep ", None, ts(1))], "instance_id string, decision string, reason string, decided_at timestamp")
    rows = spark.createDataFrame([(x,) for x in "abcd"], "instance_id string")
    assert {r.instance_id: r.verdict for r in curate.apply_decisions(rows, dec).collect()} == {"a": "odd", "b": "keep", "c": "unspecified", "d": "undecided"}
    assert [r.instance_id for r in curate.unknown_decisions(rows, dec).collect()] == ["z"]


TEXT = "Premise: The old film was never good.\nHypothesis: The film was bad."


def replies(spark, **k):
    row = {"result_id": 1, "text": TEXT, "dataset": "mnli", "predicted_label": "entailment", "reply": None} | k
    return spark.createDataFrame([tuple(row.values())], "result_id int, text string, dataset string, predicted_label string, reply string")


@pytest.mark.parametrize(
    ("reply", "value", "error"),
    [('{"confidence": 87}', 0.87, None), ('{"confidence": "87%"}', 0.87, None), ('{"confidence": 1}', 1.0, None), ('{"confidence": true}', 1.0, None), ('{"confidence": 250}', 1.0, None), ('{"confidence": -3}', None, "negative"), ('{"confidence": "high"}', None, "not numeric"), ('{"confidence": null}', None, "not numeric"), ('{"confidence": [1]}', None, "not numeric"), ("87", None, "no JSON object"), (None, None, "no reply")],
)
def test_confidence(spark, reply, value, error):
    r = parse.confidence(replies(spark, reply=reply), "reply").first()
    assert (r.confidence_parsed, r.confidence_error) == (value, error)


def test_highlighting(spark):
    for salience in ([["film", 3], ["Film!", 9], ["old", 5], ["the", 9], ["(", 4], ["absent", 9], ["never", 0.5], ["two words", 3], ["bad", 2]], [{"film": 9}, {"old": 5}, {"bad": 2}], {"film": 9, "old": 5, "bad": 2}):
        r = parse.highlighting(replies(spark, reply=json.dumps({"salience": salience})), "reply").first()
        assert r.h_error is None and r.h_top == ["film", "old", "bad"] and r.h_weights == {"film": 9.0, "old": 5.0, "bad": 2.0}
    for reply, error in (('{"salience": []}', "no salience"), ('{"salience": [["film", 2]]}', "under two entries"), ("x", "no JSON object"), (None, "no reply"), ('{"salience": 3}', "no salience")):
        assert parse.highlighting(replies(spark, reply=reply), "reply").first().h_error == error


def test_rationale_and_ranking(spark):
    r = parse.rationale(replies(spark, reply=json.dumps({"rationale": "The film is not old, never a Film; it was absent."})), "reply").first()
    assert r.r_tokens == ["film", "old", "never"] and r.r_error is None
    assert parse.rationale(replies(spark, reply='{"rationale": "nothing here"}'), "reply").first().r_error == "nothing anchored"
    r = parse.rank_ordering(replies(spark, reply=json.dumps({"ranking": ["Film", "film", "the", "old!", "never", "gone", "two words", 3, "bad"]})), "reply").first()
    assert r.ro_ranking == ["Film", "old!", "never", "bad"]
    assert parse.rank_ordering(replies(spark, reply='{"ranking": ["film", "old"]}'), "reply").first().ro_error == "under three items"
    assert parse.rank_ordering(replies(spark, reply='{"ranking": "film"}'), "reply").first().ro_error == "under three items"
    assert parse.rank_ordering(replies(spark, reply='{"ranking": ["film", "the", "a"]}'), "reply").first().ro_error == "under three left"


def test_counterfactual_gates(spark):
    labels = F.array(F.lit("entailment"), F.lit("neutral"))
    put = lambda text, label="neutral": json.dumps({"rewritten": text, "new_prediction": label})
    good = TEXT.replace("was bad", "was great")
    cases = [
        ("x", "no JSON object"),
        ('{"rewritten": null, "new_prediction": "neutral"}', "null"),
        ('{"rewritten": {"a": 1}, "new_prediction": "neutral"}', "no string"),
        (put(good, "other"), "unknown label"),
        (put(good, "entailment"), "no flip"),
        (put(TEXT + " "), "identical"),
        (put(TEXT.replace("bad.", "bad .")), "canonically identical"),
        (put("The film was great."), "marker dropped"),
        (put(TEXT.replace("old", "new")), "edited outside the span"),
        (put("Premise: The old film was never good.\nHypothesis:"), "empty span"),
        (put(TEXT.replace("was bad", "was not bad")), "insertions only"),
        (put(TEXT.replace("The film was bad.", "No movie is great here.")), "too many edits"),
        (put(good), None),
        (None, "no reply"),
    ]
    for reply, error in cases:
        r = parse.counterfactual(replies(spark, reply=reply), "reply", "predicted_label", labels).first()
        assert r.cf_error == error, reply
    r = parse.counterfactual(replies(spark, reply=put(good)), "reply", "predicted_label", labels).first()
    assert r.cf_changed == ["bad"] and r.cf_ratio == pytest.approx(1 / 5) and r.cf_label == "neutral"


def test_evidence_and_erasure_of_replies(spark, sf):
    rows = parse.evidence_of_replies(spark.read.parquet(f"{sf}/instance_results.parquet"))
    m = evidence.measured(rows).select("ecs_adj", "jaccard_H_RO", "vocabulary", "H", "text").collect()
    assert len(m) == spark.read.parquet(f"{sf}/instance_results.parquet").count() and any(r.ecs_adj is not None for r in m)
    assert all(r.jaccard_H_RO is None or 0 <= r.jaccard_H_RO <= 1 for r in m)
    one = spark.createDataFrame([(1, "m", "d", "i", "good film now", "pos", ["good"], ["good"], ["good", "film"], [])], "result_id int, model string, dataset string, instance_id string, text string, predicted_label string, H array<string>, R array<string>, CF array<string>, RO array<string>")
    known = spark.createDataFrame([("[MASK] film now", "neg"), ("film now", "pos")], "t string, label string").select(F.lit("m").alias("model"), F.sha2("t", 256).alias("text_hash"), "label")
    got = {(r.target, r.operator): (r.n_defined, r.rate) for r in erasure.rates(erasure.flips(one, known)).where("model = 'm'").collect()}
    assert got["H", "mask"] == (1, 1.0) and got["H", "delete"] == (1, 0.0) and got["CF", "mask"] == (0, None) and got["cc3", "mask"] == (1, 1.0) and ("RO", "mask") not in got


def test_weighted_null_of_the_five_other_pairs(spark):
    four = {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}
    rows = [(1, ["a", "b"], ["c"], ["a", "b", "c", "d"], [], four), (2, ["a"], [], [], ["b"], four), (3, ["a"], ["a"], ["a"], ["a"], {"a": 1.0}), (4, ["a"], ["a"], ["a"], ["a"], None)]
    df = spark.createDataFrame(rows, "k long, H array<string>, R array<string>, CF array<string>, RO array<string>, h_weights map<string,double>")
    got = {r.k: r for r in evidence.weighted_null(df, F.col("k")).collect()}
    # sets of 2 and 1, 2 and 4, 1 and 4 of four equal words
    assert got[1].ecs_random_weighted == pytest.approx((0.5 * 0.5 + 0.5 + 0.25) / 3, abs=0.02) and got[1].chance_H_RO is None
    assert got[2].ecs_random_weighted is None and got[2].chance_H_RO == pytest.approx(0.25, abs=0.1)
    assert got[3].ecs_random_weighted is None and got[4].ecs_random_weighted is None


def test_weighted_lift_in_queries(spark, sf):
    from tessella.plans import reply_queries

    each = [r for r in reply_queries.weighted_null(spark, sf).collect() if r.ecs_lift_weighted is not None]
    over = reply_queries.reply_aggregates(spark, sf).where("level = 'overall'").first()
    assert each and over.n_lift_weighted == len(each) and over.mean_ecs_lift_weighted == pytest.approx(sum(r.ecs_lift_weighted for r in each) / len(each), abs=1e-5)
    assert any(r.chance is None for r in each)


def test_holm_and_sign_flip(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", 0.9)], "k string, p double")
    assert {r.k: r.p_holm and round(r.p_holm, 6) for r in resample.holm(p).collect()} == {"a": 0.04, "c": 0.09, "b": 0.09, "e": 0.9, "d": None}
    rows = [("up", i, 1.0 + i / 10) for i in range(8)] + [("none", i, (-1.0) ** i) for i in range(8)] + [("single", 0, 1.0), ("null", 0, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {r.g: r.p for r in resample.sign_flip_test(df, ["g"], ["g", "i"], "v", permutations=4000).collect()}
    assert got["up"] == pytest.approx(1 / 256, abs=0.003) and got["none"] == pytest.approx(163 / 256, abs=0.04) and got["single"] is None and "null" not in got
    again = {r.g: r.p for r in resample.sign_flip_test(df.repartition(5), ["g"], ["g", "i"], "v", permutations=4000).collect()}
    assert again == got


def _mean_gap_p(a, b, n, rng):
    both, hits, seen = a + b, 0, abs(sum(a) / len(a) - sum(b) / len(b))
    for _ in range(n):
        rng.shuffle(both)
        hits += abs(sum(both[: len(a)]) / len(a) - sum(both[len(a) :]) / len(b)) >= seen - 1e-12
    return (hits + 1) / (n + 1)


@pytest.mark.parametrize("part", [4096, 16])
def test_two_samples_of_unequal_sizes(spark, monkeypatch, part):
    monkeypatch.setattr(resample, "_PART", part)
    rng = random.Random(12)
    a, b = [rng.gauss(0.35, 1) for _ in range(8)], [rng.gauss(0, 1) for _ in range(392)]
    df = spark.createDataFrame([(i, i < 8, v) for i, v in enumerate(a + b)] + [(900, None, 1.0), (901, True, None)], "i int, s boolean, v double")
    got = resample.two_sample_test(df, "s", ["i"], "v", permutations=4000).first()
    assert (got.n_a, got.n_b) == (8, 392) and got.difference == pytest.approx(sum(a) / 8 - sum(b) / 392)
    assert got.p == pytest.approx(_mean_gap_p(a, b, 4000, rng), abs=0.05)
    assert resample.two_sample_test(df.repartition(5), "s", ["i"], "v", permutations=4000).first().p == got.p
    assert resample.two_sample_test(df.where("s"), "s", ["i"], "v").first().p is None
    assert resample.two_sample_test(df.limit(0), "s", ["i"], "v").first().p is None


def test_dealt_sets_have_their_size_and_are_uniform(spark, monkeypatch):
    monkeypatch.setattr(resample, "_PART", 2)
    df = spark.range(12).select(F.xxhash64("id").alias("h"), F.pow(F.lit(2.0), F.col("id")).alias("value"))
    taken = spark.createDataFrame([(3, 12)], "k long, n long")
    sets = [f"{int(r.s):012b}" for r in resample._dealt(df, taken, 6000, 1).collect()]
    assert len(sets) == 6000 and {s.count("1") for s in sets} == {3} and len(set(sets)) == 220
    assert all(abs(sum(s[i] == "1" for s in sets) - 1500) < 170 for i in range(12))
    assert all(abs(sum(s[i] == s[j] == "1" for s in sets) - 6000 / 22) < 85 for i in range(12) for j in range(i))


def test_bootstrap(spark):
    rng = random.Random(1)
    vals = [rng.gauss(5, 2) for _ in range(400)]
    df = spark.createDataFrame([("a", i // 2, v) for i, v in enumerate(vals)] + [("b", 1, 3.0), ("b", 1, 4.0)], "g string, c int, v double")
    got = {r.g: r for r in resample.bootstrap_mean(df, ["g"], ["c"], "v").collect()}
    assert got["a"].mean == pytest.approx(sum(vals) / 400) and got["a"].ci_lower < got["a"].mean < got["a"].ci_upper
    assert got["a"].ci_upper - got["a"].ci_lower == pytest.approx(2 * 1.96 * 2 / 20, rel=0.25)
    assert (got["b"].ci_lower, got["b"].ci_upper) == (0.0, 0.0)


def test_ranks_and_correlation(spark):
    rng = random.Random(4)
    rows = [("a", float(rng.randint(0, 30)), rng.random()) for _ in range(500)] + [("b", 1.0, 2.0), ("b", 1.0, 3.0), ("b", 1.0, 1.0), ("c", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    xs = [r[1] for r in rows if r[0] == "a"]
    want = {x: sum(v < x for v in xs) + (sum(v == x for v in xs) + 1) / 2 for x in set(xs)}
    got = {r.x: r.rk for r in resample.average_ranks(df.where("g = 'a'"), ["g"], "x", "rk", 8).collect()}
    assert got == want
    s = {r.g: (r.n, r.rho, r.p) for r in resample.spearman(df, ["g"], "x", "y").collect()}
    assert s["b"] == (3, 0.0, 1.0) and "c" not in s and 0 <= s["a"][2] <= 1
    line = spark.createDataFrame([(float(i), float(i * i)) for i in range(9)], "x double, y double")
    assert resample.spearman(line, [], "x", "y").first().rho == pytest.approx(1)
    # t = 2.0 with 10 degrees of freedom has p = 0.0734
    from math import sqrt

    r = spark.range(1).select(resample.correlation_p(F.lit(2 / sqrt(14)), F.lit(12)).alias("p")).first()
    assert r.p == pytest.approx(0.07339, abs=1e-4)


def test_tiers_and_extremes(spark):
    df = spark.createDataFrame([(i, i % 4, v) for i, v in enumerate([0.1, 0.1, 0.2, 0.3, None, 0.3, 0.4])], "user_id int, instance_id int, ecs double").withColumn("ecs_lift", F.col("ecs"))
    tiers = {r.user_id: r.tier for r in resample.lift_tiers(df).collect()}
    vals = sorted(v for v in [0.1, 0.1, 0.2, 0.3, 0.3, 0.4])
    lo, hi = vals[2], vals[4]
    assert tiers == {r.user_id: None if r.ecs is None else "low" if r.ecs <= lo else "mid" if r.ecs <= hi else "high" for r in df.collect()}
    top = aggregate.extremes(df, 2).collect()
    assert [(r.extreme, r.user_id) for r in top] == [("high", 6), ("high", 5), ("low", 0), ("low", 1)]


def test_cross_model(spark):
    none = []
    rows = [(0, 0, 7, ["a", "b"], none, none, none, 9), (0, 1, 7, ["a", "c"], ["x"], none, none, 4), (0, 2, 7, ["a", "b"], none, none, none, 4), (0, 1, 8, ["a"], none, none, none, 4)]
    df = spark.createDataFrame(rows, "dataset int, model int, instance_id int, H array<string>, R array<string>, CF array<string>, RO array<string>, vocabulary int")
    got = {(r.instance_id, r.strategy, r.model_a, r.model_b): r.jaccard for r in crossmodel.model_pairs(df).collect()}
    assert len(got) == 12 and got[7, "H", 0, 2] == 1 and got[7, "H", 0, 1] == pytest.approx(1 / 3) and got[7, "R", 0, 1] is None


def test_readers(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"instance_id": "a", "text": "t", "extra": 1}\n\n{"instance_id": "b", "label": "l"}\n{"instance_id": "a", "text": "t2"}\nbroken\n', encoding="utf-8")
    rows = jsonl.read_curated(spark, str(p)).collect()
    assert [(r.instance_id, r.text, r.label) for r in rows] == [("a", "t", ""), ("b", "", "l"), ("a", "t2", ""), ("", "", "")] and rows[0].metadata == {"extra": "1"}
    c = jsonl.read_checkpoint(spark, str(p)).collect()
    assert [r.instance_id for r in c] == ["a", "b"] and json.loads(c[0].value)["text"] == "t2" and jsonl.broken_lines(spark, str(p)) == 1
    with pytest.raises(jsonl.DataLoadError):
        jsonl.read_curated(spark, str(tmp_path / "none.jsonl"))
    work = spark.createDataFrame([("a",), ("z",)], "instance_id string")
    assert [r.instance_id for r in jsonl.remaining(work, jsonl.read_checkpoint(spark, str(p))).collect()] == ["z"]
    names = jsonl.model_names(spark.createDataFrame([("m1",), ("m2",)], "model string"), spark.createDataFrame([("m1", "One")], "model string, model_name string"))
    assert {r.model: r.model_name for r in names.collect()} == {"m1": "One", "m2": "m2"}
    ring = jsonl.next_in_ring(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "model string, position int"))
    assert {r.model: r.heldout for r in ring.collect()} == {"a": "b", "b": "c", "c": "a"}
    assert jsonl.merged_settings({"a": {"x": 1}}, {"a": {"x": 2, "y": 3}, "b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}
    assert jsonl.resolve_template({"H": "g", "H_multiclass": "m", "H_mnli": "d"}, "H", "mnli", 3) == "d" and jsonl.resolve_template({"H": "g", "H_multiclass": "m"}, "H", "x", 3) == "m" and jsonl.resolve_template({"H": "g"}, "H", "x", 2) == "g"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [2.0]), (2, "x", [])], "a int, b string, c array<double>")
    sinks.append_checkpoint(df, str(tmp_path / "ck"))
    sinks.append_checkpoint(df, str(tmp_path / "ck"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "ck")).count() == 4
    assert sinks.write_csv(df, str(tmp_path / "csv"), ["b", "a", "gone"]) and spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["b", "a"]
    assert not sinks.write_csv(df.limit(0), str(tmp_path / "none"), ["a"]) and not (tmp_path / "none").exists()
    sinks.write_document(df, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text())[0] == {"a": 1, "b": None, "c": [2.0]}
    sinks.write_report(str(tmp_path / "r.md"), "Title", {"One": df.select("a", "b")})
    assert "| 1 | - |" in (tmp_path / "r.md").read_text() and r"\toprule" in sinks.latex_table(df.select("a"), "c", "t")
    with pytest.raises(ValueError, match="placeholder"):
        sinks.check_rendered("a {name} b")
    assert sinks.highlighted("Good films, good", ["good", "good films"], "<", ">") == "<Good films>, <good>" and sinks.highlighted("x", []) == "x"
    assert set(sinks.environment()) >= {"python", "packages"} and len(sinks.manifest({"r": str(tmp_path / "r.md")})["r"]["sha256"]) == 64


def test_client_hook(spark):
    from tessella.operators.inference import answer

    df = spark.createDataFrame([(1, "ab"), (2, None)], "i int, p string")
    assert {r.i: r.reply for r in answer(df, "p", lambda: lambda prompts: [p.upper() for p in prompts]).collect()} == {1: "AB", 2: None}


def test_streaming(spark, sf, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    for k in range(2):
        shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / f"{k}.parquet")
    events = spark.read.parquet(f"{sf}/events.parquet")
    ddl = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    q = ingest.write_once(ingest.event_stream(spark, str(tmp_path / "in"), ddl, 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    for frame in (ingest.windowed(ingest.deduplicated(ingest.event_stream(spark, str(tmp_path / "in"), ddl)), ["event_type"]), ingest.sessions(ingest.event_stream(spark, str(tmp_path / "in"), ddl))):
        assert frame.isStreaming
