"""Replies to evidence from semi-structured text: the JSON object, typed fields with gates, and the reason where a gate fails.

Every parser adds columns to the reply's row; the first failed gate gives the error, null replies give the error
'no reply' and are no failure of parsing. Words are anchored in the row's own text. No lemma table is needed; one may be
joined to the normalised tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import kernels, measures
from tessella.functions import text as tx
from tessella.functions import vocabulary as v
from tessella.functions.stage import settled

# Labels by dataset, and the marker behind which a pair's text may be edited.
LABELS = {"sst2": ["negative", "positive"], "mnli": ["entailment", "neutral", "contradiction"], "ag_news": ["World", "Sports", "Business", "Sci/Tech"]}
SPAN_MARKER = "Hypothesis:"
MAX_EDIT_RATIO = 0.3
_PADDING = v.PUNCTUATION + "“”‘’"


def label_set(dataset: Column) -> Column:
    out = F.array().cast("array<string>")
    for d, labels in LABELS.items():
        out = F.when(F.lower(F.trim(dataset)) == d, F.array(*[F.lit(x) for x in labels])).otherwise(out)
    return out


def _typed(obj: str, path: str, kind: str) -> Column:
    """A string-typed field; null for values of other JSON types."""
    return F.expr(f"case when schema_of_variant(variant_get({obj}, '{path}')) = '{kind}' then try_variant_get({obj}, '{path}', 'string') end")


def with_object(rows: DataFrame, reply: str, name: str = "_obj") -> DataFrame:
    """rows with the reply's JSON object as a variant; null where there is none. Replies that are an object as they stand are
    parsed in the JVM; only the others go through the tolerant kernel."""
    whole = F.when(F.col(reply).rlike(r"^\s*\{"), F.try_parse_json(F.col(reply)))
    out = settled(rows, {"_whole": whole})
    out = out.withColumn("_rest", kernels.extract_json(F.when(F.col("_whole").isNull(), F.col(reply))))
    return settled(out, {name: F.coalesce(F.col("_whole"), F.try_parse_json("_rest"))}).drop("_whole", "_rest")


def confidence(rows: DataFrame, reply: str) -> DataFrame:
    """rows with confidence in [0, 1] and confidence_error. Numbers or numeric strings, also with %; over 1 per hundred."""
    out = with_object(rows, reply)
    value = F.expr("variant_get(_obj, '$.confidence')")
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", F.expr("regexp_replace(trim(try_variant_get(_obj, '$.confidence', 'string')), '%+$', '')")).when(kind == "BOOLEAN", F.expr("cast(try_variant_get(_obj, '$.confidence', 'boolean') as int)").cast("string")).when(~kind.rlike("^(ARRAY|OBJECT|VOID)"), F.expr("try_variant_get(_obj, '$.confidence', 'string')"))
    number = text.try_cast("double")
    error = F.when(F.col(reply).isNull(), "no reply").when(F.col("_obj").isNull(), "no JSON object").when(number.isNull() | F.isnan(number), "not numeric").when(number < 0, "negative")
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(number > 1, number / 100).otherwise(number)))
    return out.withColumns({"confidence_error": error, "confidence_parsed": F.when(error.isNull(), scaled)}).drop("_obj")


def classification(rows: DataFrame, reply: str, labels: Column) -> DataFrame:
    """rows with label_parsed (one of labels, as written) and label_error."""
    out = with_object(rows, reply).withColumn("_l", _typed("_obj", "$.label", "STRING"))
    error = F.when(F.col(reply).isNull(), "no reply").when(F.col("_obj").isNull(), "no JSON object").when(F.col("_l").isNull(), "label is no string").when(~F.array_contains(labels, F.col("_l")), "unknown label")
    return out.withColumns({"label_error": error, "label_parsed": F.when(error.isNull(), F.col("_l"))}).drop("_obj", "_l")


def highlighting(rows: DataFrame, reply: str, text: str = "text") -> DataFrame:
    """rows with h_top (the dynamic_k most salient normal forms), h_weights (map of all) and h_error. Pairs, one-key objects
    or an object of word: score; of a word the largest score; under two valid entries is an error."""
    out = settled(rows.withColumn("_e", kernels.salience(F.col(reply))), {"_in": tx.input_words(F.col(text))})
    good = F.filter("_e", lambda e: (e["score"] >= 1) & tx.is_single_word(e["word"]) & (F.btrim(e["word"], F.lit(_PADDING)) != "") & F.array_contains(F.col("_in"), tx.pre_normalize(e["word"])))
    out = settled(out, {"_n": F.filter(F.transform(good, lambda e: F.struct(tx.normalize(e["word"]).alias("word"), e["score"].alias("score"))), lambda e: e["word"].isNotNull())})
    # sorted by word and falling score, the first of each word has its largest score
    out = settled(out, {"_s": F.array_sort(F.transform("_n", lambda e: F.struct(e["word"].alias("word"), (-e["score"]).alias("o"))))})
    lead = F.filter("_s", lambda e, i: (i == 0) | (F.get(F.col("_s"), i - 1)["word"] != e["word"]))
    out = settled(out, {"_best": F.transform(lead, lambda e: F.struct(e["word"].alias("word"), (-e["o"]).alias("score")))})
    error = F.when(F.col(reply).isNull(), "no reply").when(F.col("_e").isNull(), "no JSON object").when(F.coalesce(F.size("_e"), F.lit(0)) <= 0, "no salience").when(F.size("_best") < 2, "under two entries")
    ranked = F.transform(F.array_sort(F.transform("_best", lambda e: F.struct((-e["score"]).alias("o"), e["word"].alias("word")))), lambda e: e["word"])
    k = tx.dynamic_k(F.size(tx.stripped_words(F.col(text))), F.size("_best"))
    out = out.withColumn("h_error", error)
    ok = F.col("h_error").isNull()
    return out.withColumns({"h_top": F.when(ok, F.slice(ranked, 1, F.greatest(k, F.lit(1)))), "h_weights": F.when(ok, F.map_from_entries("_best"))}).drop("_e", "_in", "_n", "_s", "_best")


def rationale(rows: DataFrame, reply: str, text: str = "text") -> DataFrame:
    """rows with rationale, r_tokens (content words of it that stand in the text, in order) and r_error."""
    out = settled(with_object(rows, reply), {"rationale": F.nullif(_typed("_obj", "$.rationale", "STRING"), F.lit("")), "_in": tx.input_words(F.col(text))})
    drop = sorted({*v.PARSER_STOPWORDS, *v.DISCOURSE_WORDS} - set(v.POLARITY_WORDS))
    short = [w for w in v.POLARITY_WORDS if len(w) == 1]
    keep = F.filter(tx.stripped_words(F.col("rationale")), lambda w: ((F.length(w) > 1) | w.isin(*short, "")) & ~w.isin(*drop))
    out = settled(out, {"_t": F.filter(F.array_distinct(keep), lambda w: F.array_contains(F.col("_in"), w))})
    error = F.when(F.col(reply).isNull(), "no reply").when(F.col("_obj").isNull(), "no JSON object").when(F.col("rationale").isNull(), "no rationale").when(F.coalesce(F.size("_t"), F.lit(0)) <= 0, "nothing anchored")
    return out.withColumn("r_error", error).withColumn("r_tokens", F.when(F.col("r_error").isNull(), F.col("_t"))).drop("_obj", "_in", "_t")


def rank_ordering(rows: DataFrame, reply: str, text: str = "text") -> DataFrame:
    """rows with ro_ranking (words in rank order) and ro_error. Single words, the first of equal forms, no stopwords but
    polarity words, anchored; at least three before and after."""
    out = with_object(rows, reply).withColumn("_items", F.expr("case when schema_of_variant(variant_get(_obj, '$.ranking')) like 'ARRAY%' then try_variant_get(_obj, '$.ranking', 'array<variant>') end"))
    words = F.transform("_items", lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    single = F.filter(words, lambda w: w.isNotNull() & tx.is_single_word(w))
    forms = F.filter(F.transform(single, lambda w: F.struct(w.alias("w"), tx.pre_normalize(w).alias("f"))), lambda e: e["f"] != "")
    out = settled(out, {"_forms": forms, "_in": tx.input_words(F.col(text))})
    first = F.filter("_forms", lambda e, i: F.array_position(F.transform("_forms", lambda q: q["f"]), e["f"]) == i + 1)
    stop = sorted(set(v.PARSER_STOPWORDS) - set(v.POLARITY_WORDS))
    kept = F.filter(first, lambda e: ~e["f"].isin(*stop) & F.array_contains(F.col("_in"), e["f"]))
    out = settled(out, {"_kept": F.transform(kept, lambda e: e["w"])})
    error = F.when(F.col(reply).isNull(), "no reply").when(F.col("_obj").isNull(), "no JSON object").when(F.coalesce(F.size("_items"), F.lit(0)) < 3, "under three items").when(F.size("_kept") < 3, "under three left")
    return out.withColumn("ro_error", error).withColumn("ro_ranking", F.when(F.col("ro_error").isNull(), F.col("_kept"))).drop("_obj", "_items", "_forms", "_in", "_kept")


def counterfactual(rows: DataFrame, reply: str, label: str, labels: Column, text: str = "text", marker: str | None = SPAN_MARKER, max_ratio: float | None = MAX_EDIT_RATIO) -> DataFrame:
    """rows with cf_text, cf_label, cf_changed (words of the text that were replaced or deleted), cf_ratio and cf_error: the
    first gate of JSON, nulls, types, label set, flip, identity, canonical identity, span, insertions, edit ratio."""
    out = with_object(rows, reply)
    kind = lambda k: F.expr(f"coalesce(schema_of_variant(variant_get(_obj, '$.{k}')), 'VOID')")
    out = settled(out, {"_tk": kind("rewritten"), "_lk": kind("new_prediction"), "_t": _typed("_obj", "$.rewritten", "STRING"), "_p": _typed("_obj", "$.new_prediction", "STRING"), "_a": tx.canonical_tokens(F.col(text))})
    out = settled(out, {"_b": tx.canonical_tokens(F.col("_t"))})
    has = F.contains(F.col(text), F.lit(marker)) if marker else F.lit(False)
    span = lambda c: F.when(has, tx.after_marker(c, marker)).otherwise(c) if marker else c
    out = settled(out, {"_sa": tx.canonical_tokens(span(F.col(text))), "_sb": tx.canonical_tokens(span(F.col("_t")))})
    out = settled(out, {"_d": kernels.edits(F.col("_a"), F.col("_b"), F.col("_sa"), F.col("_sb"))})
    error = F.when(F.col(reply).isNull(), "no reply").when(F.col("_obj").isNull(), "no JSON object").when((F.col("_tk") == "VOID") | (F.col("_lk") == "VOID"), "null").when(F.col("_t").isNull(), "no string")
    error = error.when(F.col("_p").isNull() | ~F.array_contains(labels, F.col("_p")), "unknown label").when(F.col("_p") == F.col(label), "no flip").when(F.btrim(F.col("_t")) == F.btrim(F.col(text)), "identical")
    error = error.when(F.col("_a") == F.col("_b"), "canonically identical")
    if marker:
        error = error.when(has & ~F.contains(F.col("_t"), F.lit(marker)), "marker dropped").when(has & (tx.collapse_ws(tx.before_marker(F.col(text), marker)) != tx.collapse_ws(tx.before_marker(F.col("_t"), marker))), "edited outside the span").when(has & (F.size("_sb") == 0), "empty span")
    error = error.when(F.size("_d.changed") == 0, "insertions only")
    if max_ratio is not None:
        error = error.when(F.col("_d.ratio") > max_ratio, "too many edits")
    out = out.withColumn("cf_error", error)
    ok = F.col("cf_error").isNull()
    return out.withColumns({"cf_text": F.when(ok, F.col("_t")), "cf_label": F.when(ok, F.col("_p")), "cf_changed": F.when(ok, F.col("_d.changed")), "cf_ratio": F.col("_d.ratio")}).drop("_obj", "_tk", "_lk", "_t", "_p", "_a", "_b", "_sa", "_sb", "_d")


def evidence_of_replies(results: DataFrame, max_ratio: float | None = MAX_EDIT_RATIO) -> DataFrame:
    """The wide evidence rows (H, R, CF, RO, h_rank, ro_rank, vocabulary) of replies: result_id, dataset, model,
    instance_id. Replies that fail a gate give an empty set; without max_ratio free rewrites count as evidence, too."""
    rows = results.select("result_id", F.lower(F.trim("dataset")).alias("dataset"), F.lower(F.trim("model")).alias("model"), "instance_id", "text", "predicted_label", "raw_highlighting", "raw_rationale", "raw_counterfactual", "raw_rank_ordering")
    rows = counterfactual(rank_ordering(rationale(highlighting(rows, "raw_highlighting"), "raw_rationale"), "raw_rank_ordering"), "raw_counterfactual", "predicted_label", label_set(F.col("dataset")), max_ratio=max_ratio)
    none = F.array().cast("array<string>")
    k = tx.dynamic_k(F.size(tx.stripped_words(F.col("text"))))
    rows = settled(rows, {"H": F.array_sort(F.coalesce("h_top", none)), "R": F.coalesce(tx.normalize_tokens(F.col("r_tokens"), split=False), none), "CF": F.coalesce(tx.normalize_tokens(F.col("cf_changed"), split=False), none), "ro_rank": F.coalesce(F.filter(F.transform("ro_ranking", lambda w: tx.normalize(w)), lambda w: w.isNotNull()), none), "h_rank": F.coalesce("h_top", none)})
    rows = settled(rows, {"RO": F.array_sort(F.array_distinct(F.slice("ro_rank", 1, F.greatest(F.coalesce(k, F.lit(3)), F.lit(1)))))})
    own = F.coalesce(tx.normalize_tokens(tx.words(F.col("text")), split=False), none)
    return rows.withColumn("vocabulary", F.size(F.array_distinct(F.flatten(F.array(own, *[F.col(s) for s in measures.STRATEGIES])))))


def funnel(rows: DataFrame) -> DataFrame:
    """strategy, error, n: how replies passed the gates (error 'ok' where they did)."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.coalesce(F.col(c), F.lit("ok")).alias("error")) for s, c in (("H", "h_error"), ("R", "r_error"), ("CF", "cf_error"), ("RO", "ro_error"))]))
    return rows.select(each.alias("x")).select("x.*").groupBy("strategy", "error").agg(F.count("*").alias("n"))
