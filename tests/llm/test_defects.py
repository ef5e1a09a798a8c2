"""Reply defects: kinds of replies, decoys, and the conditional random field against all tag sequences."""

from itertools import product
import json
import random

import numpy as np

from tessella.llm import defects
from tessella.llm.crf import ChainField, train


def test_decoding_finds_the_best_sequence():
    rng = np.random.default_rng(1)
    model = ChainField(rng.normal(size=(4, 3)), rng.normal(size=(3, 3)))
    seqs = [rng.integers(0, 2, size=(n, 4)) for n in (1, 2, 3, 4, 3, 0)]
    score = lambda s, t: sum((s[i] @ model.weights)[t[i]] for i in range(len(t))) + sum(model.moves[a, b] for a, b in zip(t, t[1:]))  # noqa: B905,E731
    for s, got in zip(seqs, model.decode(seqs), strict=True):
        assert tuple(got) == max(product(range(3), repeat=len(s)), key=lambda t: score(s, t))


def test_training_learns_emissions_and_moves():
    rng = np.random.default_rng(2)
    seqs, tags = [], []
    for _ in range(400):
        y = [int(rng.integers(0, 2))]
        while len(y) < 5:
            y.append(y[-1] if rng.random() < 0.9 else 1 - y[-1])
        x = np.array([[1, t if rng.random() < 0.7 else 1 - t] for t in y], dtype=np.float32)
        seqs.append(x)
        tags.append(np.array(y))
    model = train(seqs[:300], tags[:300], 2)
    right = np.mean([np.mean(g == t) for g, t in zip(model.decode(seqs[300:]), tags[300:], strict=True)])
    alone = np.mean([np.mean(x[:, 1] == t) for x, t in zip(seqs[300:], tags[300:], strict=True)])
    assert right > alone + 0.05 and model.moves[0, 0] > model.moves[0, 1]


TEXT = "Profit at the brewery reached 32 million as the port abandoned a transfer. Envoys said little about the talks."
ASK = 'The label given to this text was Business.\n\nText: "{t}"\n\n{q}\n\nReply with JSON only: {f}'
PROMPTS = {"raw_rationale": ASK.format(t=TEXT, q="Say in a single sentence why Business was chosen.", f='{"rationale": "<single sentence>"}'), "raw_counterfactual": ASK.format(t=TEXT, q="Change as few words as you can so that the label becomes Sports.", f='{"rewritten": "<changed text>", "new_prediction": "<label>"}'), "confidence_raw_response": ASK.format(t=TEXT, q="How sure are you that Business is right, from 0 to 100?", f='{"confidence": <0-100>}')}
CASES = [
    ("raw_rationale", '{"rationale": "The critic is unable to praise \\"brewery\\", and that refusal reads as Business overall."}', ""),
    ("raw_rationale", "The words \"brewery\" and \"port\" carry a reading that fits Business better than the other labels", ""),
    ("raw_rationale", "I'm sorry, but I must decline explaining this text. Is there something else you need?", "refusal"),
    ("raw_rationale", '{"error": "Thank you for asking; still, I cannot assist with that; please send a different text."}', "refusal"),
    ("raw_rationale", '{"rationale": "Désolé, je ne peux pas répondre à cette demande."}', "refusal"),
    ("raw_rationale", '{"rationale": "<single sentence>"}', "echo"),
    ("raw_rationale", '{"rationale": "Say in a single sentence why Business was chosen."}', "echo"),
    ("raw_rationale", json.dumps({"rationale": TEXT.upper()}), "echo"),
    ("raw_rationale", PROMPTS["raw_rationale"], "echo"),
    ("raw_rationale", "<single sentence>", "echo"),
    ("raw_rationale", '{"rationale": "Le texte a été classé Business parce que « brewery » donne le ton."}', "other_language"),
    ("raw_rationale", "Текст получил метку Business, потому что «port» задаёт тон.", "other_language"),
    ("raw_rationale", '{"rationale": "The words \\"brewery\\" and \\"po', "truncated"),
    ("raw_rationale", '{"rationale": "The words \\"brewery\\" and \\"port\\" carry a reading that fits Busi"}', "truncated"),
    ("raw_rationale", "", "empty"),
    ("raw_rationale", '```json\n{"rationale": null}\n```', "empty"),
    ("raw_rationale", "N/A", "empty"),
    ("raw_counterfactual", json.dumps({"rewritten": TEXT.replace("brewery", "stadium"), "new_prediction": "Sports"}), ""),
    ("raw_counterfactual", json.dumps({"rewritten": TEXT.replace(",", "").lower().replace(" ", "  "), "new_prediction": "Sports"}), "echo"),
    ("raw_counterfactual", '{"rewritten": "<changed text>", "new_prediction": "<label>"}', "echo"),
    ("raw_counterfactual", '{"rewritten": "Das Orchester in Skyse stoppte trotz Regens den Plan und nannte 872 Gründe.", "new_prediction": "Sports"}', "other_language"),
    ("raw_counterfactual", json.dumps({"rewritten": TEXT})[:60], "truncated"),
    ("raw_counterfactual", '{"rewritten": "", "new_prediction": ""}', "empty"),
    ("confidence_raw_response", '{"confidence": 91}', ""),
    ("confidence_raw_response", "```json\n{\"confidence\": \"91%\"}\n```", ""),
    ("confidence_raw_response", "Roughly 73 percent, given how plainly the passage is written.", ""),
    ("confidence_raw_response", "91", ""),
    ("confidence_raw_response", '{"confidence": <0-100>}', "echo"),
    ("confidence_raw_response", '{"confi', "truncated"),
    ("confidence_raw_response", "Estoy seguro en un 66 por ciento de que esta clasificación es correcta.", "other_language"),
    ("confidence_raw_response", '{"confidence": "I cannot assist with that."}', "refusal"),
    ("confidence_raw_response", '{"confidence": "  "}', "empty"),
]
SCHEMA = "result_id long, text string, predicted_label string, model string, raw_rationale string, raw_counterfactual string, confidence_raw_response string, rationale_explain_prompt string, counterfactual_explain_prompt string, confidence_prompt string"


def row(i, field, value, text=TEXT, label="Business", prompts=PROMPTS):
    return (i, text, label, ["m ", "M", None][i % 3], *[value if f == field else None for f in defects.FIELDS], *[prompts.get(f) for f in defects.FIELDS])


def test_kinds_of_replies(spark):
    rng = random.Random(1)
    data = [row(i, f, v) for i, (f, v, _) in enumerate(CASES)]
    good = [f'The words "{rng.choice(["brewery", "port", "talks"])}" and "million" carry a reading that fits Business better than the other labels.' for _ in range(200)]
    data += [row(1000 + i, "raw_rationale", v) for i, v in enumerate(good)]
    data += [row(2000, "raw_rationale", good[0], None, None, {}), row(2001, "raw_rationale", " ", None, None, {}), row(2002, None, None), row(2003, "raw_rationale", "The words carry a reading. " * 20_000)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("id", defects.F.lit(1)).withColumn("words", defects.F.lit(""))
    got = {(r.id, r.field_name): r.defect for r in defects.pair_defects(df).collect()}
    want = {(i, f): d for i, (f, _, d) in enumerate(CASES) if d} | {(2001, "raw_rationale"): "empty"}
    assert got == want
    rates = defects.defect_rates(df).collect()
    assert sum(r.replies for r in rates) == len(want) and {r.source for r in rates} <= {"m", None}


def test_empty_table(spark):
    df = spark.createDataFrame([row(1, None, None)], SCHEMA)
    assert defects.pair_defects(df.limit(0)).count() == 0 and defects.pair_defects(df).count() == 0
