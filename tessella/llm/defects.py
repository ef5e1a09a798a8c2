"""Unusable replies to prompts: empty, truncated, refusal, echo, other_language.

A reply's content is cut into clauses, each with binary features (below); a linear-chain conditional random field tags
them as answer, refusal, echo, foreign or unfinished, and the share of the content that each tag covers gives the
defect. The field is trained on a sample of at most ``SAMPLE`` replies, whose clauses are labelled where the evidence of
the features is of one kind; model_refused is not trusted. Whether the last clause is finished is judged as in
``truncation``; where only a look-up of the last words can tell, the reply is tagged for either outcome.

Defined results for unusual input: null replies are no case (the call was not made); blank replies are empty; a null text,
prompt or label only takes away evidence; repeated rows count each; empty tables give empty results; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import replies, truncation
from tessella.llm.crf import ChainField, train
from tessella.session import materialise

#: Replies of each field, at most, of which the field's clauses are sampled for training.
SAMPLE = 6000
#: Clauses of a reply, at most, that the field is trained on; replies of any length are tagged whole.
LONGEST = 64
FIELDS = {"raw_rationale": "rationale_explain_prompt", "raw_counterfactual": "counterfactual_explain_prompt", "confidence_raw_response": "confidence_prompt"}
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
DEFECTS = {REFUSAL: "refusal", ECHO: "echo", FOREIGN: "other_language"}
FEATURES = ("bias", "first", "last", "only", "declines", "speaker", "apology", "error_key", "in_text", "in_prompt", "slot", "whole", "foreign", "foreign_strong", "own_language", "label", "quotes", "number", "rewrite", "unfinished")

# Function words by language.
_WORDS = {
    "en": "the and of is that with for was in to this by it as which but are from not be has have an or would so on at because while than their its says over since although against one after before every until without under",
    "fr": "le la les de et est des que qui dans une un pour ce cette du au aux je ne pas plus avec sur mais sans par il elle car à sont reste parce toute mieux surtout tandis depuis avant après",
    "de": "der die das und ist von den dem ein eine nicht als für mit zu auf im am dass wie bei aber sich ich es war wer nach über an vor zum zur während denn weil sie wurde sind dieses diese jede trotz seit ohne bleibt eher",
    "es": "el la los las de y que en una un por con para es del al se su como pero más no lo sobre resulta ese esa qué desde mientras hace porque casi según pese ya este esta tras",
    "it": "il lo la gli di che è una un per con del della non sono perché si al alla ma come dal nel questo più le e fanno",
    "pt": "o a os as de e que em um uma para com não do da dos por se mas ao na no mais é são como pelo pela porque",
    "nl": "de het een en van is dat die niet op te met voor aan er zijn maar als bij ook door naar deze dit wordt omdat",
    "pl": "i w na się że jest do nie z to za ze dla jak ale tylko oraz ponieważ tę ta ten jego jej który która mu go dlaczego przez po od",
    "cs": "a v na se že je do ne z to za pro jak ale jen nebo protože který která jeho její s i",
    "sv": "och att det som en på är av för med den till inte om ett men har från jag eftersom",
    "da": "og at det som en på er af for med den til ikke om et men har fra jeg fordi",
    "ro": "și în de la cu nu este o un pe care pentru din că mai se sau dar prin deoarece",
    "tr": "ve bir bu için ile de da çok daha olarak ne gibi ama değil olan çünkü",
    "hu": "a az és hogy nem is egy ez azt van mert de csak még mint",
    "fi": "ja on ei se että hän mutta kun niin tai joka ovat koska",
    "id": "dan yang di ini itu untuk dengan dari tidak adalah pada karena ke",
    "la": "et in est non ad cum sed ut ex quod qui per",
    "ru": "и в не на что с по как это его из но за то к потому для текст",
}
_LISTS = {k: frozenset(v.split()) for k, v in _WORDS.items()}
# Writing systems by a range of letters, for languages without a word list above.
_SCRIPTS = (("ru", "Ѐ", "ӿ"), ("el", "Ͱ", "Ͽ"), ("he", "֐", "׿"), ("ar", "؀", "ۿ"), ("hi", "ऀ", "ॿ"), ("th", "฀", "๿"), ("ja", "぀", "ヿ"), ("zh", "一", "鿿"), ("ko", "가", "힯"))
# How a writer speaks of declining (verb phrases), in whose person, and in which polite forms.
_DECLINES = re.compile(
    r"""\b(?:(?:can(?:['’]?t|not)|could\s?n['’]?t|won['’]?t|will\s+not|unable\s+to|not\s+able\s+to|must|have\s+to|need\s+to|would\s+rather\s+not|(?:would\s+)?prefer\s+not\s+to|refuse\s+to|not\s+comfortable)\s+
        (?:\w+\s+)?(?:assist|help\w*|comply|complete|answer\w*|engage|decline|pass\s+on|take\s+part|provide|do|discuss|respond|fulfil\w*|continue|rate|explain\w*|judge|participate|support|process|analyse|analyze|refuse|share|give|rewrite|offer|be)
      | not\s+be\s+appropriate | (?:request|task)\s+(?:is\s+)?(?:declined|refused|denied) | goes?\s+against\s+(?:my|our|the) | (?:guidelines|policy|policies|rules|instructions)\s+(?:prevent|forbid|prohibit|do\s+not\s+allow|don['’]t\s+allow|bar) | no\s+answer\s+follows
      | falls?\s+outside\s+(?:what|my|of) | (?:may|might|would)\s+(?:breach|violate) | I\s+(?:respectfully\s+)?declin\w+
      | ne\s+(?:peux|puis|pourrai|souhaite|suis\s+pas)\b | (?:dois|préfère|vais|préférerais)\s+(?:\w+\s+)?(?:décliner|refuser|m['’]abstenir|ne\s+pas) | (?:pas\s+en\s+mesure|refuse\s+de|m['’]est\s+impossible|sort\s+de\s+mon|contraire\s+à\s+mes)
      | kann\s+(?:ich\s+)?(?:\w+\s+){0,5}nicht | (?:möchte|werde|darf|will)\s+(?:ich\s+)?(?:\w+\s+){0,5}(?:nicht|ablehnen) | (?:muss|lehne)\s+(?:ich\s+)?(?:\w+\s+){0,6}(?:ablehnen|verzichten|ab) | nicht\s+(?:möglich|in\s+der\s+Lage|erlaubt|beantworten|helfen) | gegen\s+meine
      | no\s+(?:puedo|podré|debo|quiero|me\s+es\s+posible) | (?:debo|tengo\s+que|prefiero)\s+(?:rechazar|declinar|no\b|abstenerme) | va\s+(?:en\s+)?contra\s+(?:de\s+)?mis | fuera\s+de\s+mi
      | non\s+posso | nie\s+mogę | не\s+могу | não\s+posso | kan\s+(?:ik\s+)?niet )""",
    re.X | re.I,
)
_SPEAKER = re.compile(r"\b(?:I|I['’](?:m|ve|d|ll)|me|my|we|our|je|j['’]|me|mes|mon|ma|moi|ich|mir|mich|mein\w*|yo|mi|mis|io|mio|miei|eu|ik|assistant|language\s+model|modèle\s+de\s+langage|Sprachmodell|modelo\s+de\s+lenguaje|(?:this|that|the|your)\s+(?:request|task)|Request|cette\s+demande|diese\w*\s+(?:Anfrage|Bitte)|esta\s+(?:petición|solicitud))\b|\bpuedo\b|\bdebo\b|не могу|nie mogę|^It\s+would\s+not\s+be\b", re.I)
_APOLOGY = re.compile(r"^\W*(?:sorry|unfortunately|regrettably|apologies|i(?:['’]m|\s+am)\s+(?:very\s+|so\s+)?(?:sorry|afraid)|i\s+apologi[sz]e|as\s+an?\s+(?:ai|language\s+model|assistant)|thank\s+you\s+for|désolé|malheureusement|je\s+regrette|je\s+suis\s+désolé|leider|entschuldig\w*|tut\s+mir\s+leid|es\s+tut|lo\s+siento|lamentablemente|disculp\w*|perdón|mi\s+dispiace|przykro|извините|к\s+сожалению)\b", re.I)
_SLOT = re.compile(r"^\W*<[^<>\n]{1,60}>\W*$")
_CUTS = re.compile(r"(?<=[.!?;。])\s+|\n+")
_TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SPANS = re.compile(r"""\\?["«„“][^"»“”«„\n]{1,60}\\?["»“”]|(?<!\w)'[^'\n]{1,40}'(?!\w)""")


@lru_cache(maxsize=200_000)
def _languages_of_word(word: str) -> tuple[str, ...]:
    return tuple(k for k, v in _LISTS.items() if word in v)


def language_scores(text: str) -> tuple[dict[str, int], int]:
    """(function words by language, words) of a text; letters of other scripts count for their language."""
    words = _TOKENS.findall(text.lower())
    scores: dict[str, int] = {}
    for w in words:
        for part in w.replace("’", "'").split("'"):
            for k in _languages_of_word(part):
                scores[k] = scores.get(k, 0) + 1
    if not text.isascii():
        for k, lo, hi in _SCRIPTS:
            n = sum(1 for w in words if lo <= w[0] <= hi)
            if n:
                scores[k] = scores.get(k, 0) + 2 * n
    return scores, len(words)


@lru_cache(maxsize=20_000)
def language_of(text: str) -> str:
    scores, _ = language_scores(text)
    return max(sorted(scores), key=lambda k: scores[k]) if scores else ""


def clauses_of(content: str) -> list[str]:
    return [c for c in (x.strip() for x in _CUTS.split(content)) if c and re.search(r"\w", c)]


def features(reply: replies.Reply, text: str | None, prompt: str | None, label: str | None, unfinished: bool) -> tuple[np.ndarray, list[int]]:
    """(a row of features per clause, lengths of the clauses)."""
    parts = clauses_of(reply.content)
    frame = (prompt or "").replace(text, " ") if text else (prompt or "")
    own = language_of(frame) or "en"
    all_text, all_prompt = replies.plain(text), replies.plain(prompt)
    rewrite = reply.key == "rewritten" or "rewritten" in frame
    body = replies.plain(reply.content)
    whole = bool(body) and bool(all_text) and (body == all_text or (len(body) >= 12 and body in all_text)) or len(all_prompt) >= 12 and all_prompt in body
    rows = np.zeros((len(parts), len(FEATURES)), dtype=np.float32)
    for i, c in enumerate(parts):
        x = dict.fromkeys(FEATURES, False)
        x["bias"] = True
        x["first"], x["last"], x["only"] = i == 0, i == len(parts) - 1, len(parts) == 1
        bare = _SPANS.sub(" ", c)
        declines, speaker, apology = bool(_DECLINES.search(bare)), bool(_SPEAKER.search(bare)), bool(_APOLOGY.match(bare))
        x["declines"], x["speaker"], x["apology"] = declines and speaker, speaker, apology
        x["error_key"] = reply.key in ("error", "refusal", "message")
        flat = replies.plain(c)
        x["in_text"] = len(flat) >= 12 and flat in all_text
        x["in_prompt"] = len(flat) >= 12 and flat in all_prompt and not x["in_text"]
        x["slot"] = bool(_SLOT.match(c))
        x["whole"] = whole
        scores, n = language_scores(bare)
        mine = scores.get(own, 0)
        other = max((v for k, v in scores.items() if k != own), default=0)
        x["foreign"] = other >= 2 and other > mine * 1.5 or other >= 1 and mine == 0 and n >= 6
        x["foreign_strong"] = other >= 3 and other > mine * 2 or other >= 2 and mine == 0
        x["own_language"] = mine > other or n < 3
        x["label"] = bool(label) and label.casefold() in c.casefold()
        x["quotes"] = bare != c
        x["number"] = any(ch.isdigit() for ch in c)
        x["rewrite"] = rewrite
        x["unfinished"] = unfinished and i == len(parts) - 1
        rows[i] = [x[f] for f in FEATURES]
    return rows, [len(c) for c in parts]


_AT = {f: i for i, f in enumerate(FEATURES)}


def seed_tags(rows: np.ndarray) -> np.ndarray | None:
    """Tags of clauses whose evidence is of one kind; None if it is mixed."""
    has = rows > 0.5
    out = np.full(len(rows), ANSWER)
    for i, r in enumerate(has):
        at = lambda f: r[_AT[f]]  # noqa: B023,E731
        kinds = []
        if at("unfinished"):
            kinds.append(UNFINISHED)
        if at("declines") or (at("apology") and at("speaker") and not at("quotes")) or at("error_key"):
            kinds.append(REFUSAL)
        if at("slot") or at("whole") or (at("in_prompt") and not at("quotes")) or (at("in_text") and not at("rewrite")):
            kinds.append(ECHO)
        if at("foreign_strong") and not at("in_text"):
            kinds.append(FOREIGN)
        if len(kinds) > 1 and kinds[0] != UNFINISHED:
            return None
        if kinds:
            out[i] = kinds[0]
    return out


def _prior() -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Made-up clauses of each kind, so that every tag is trained even where the sample lacks it."""
    kinds = {
        ANSWER: [("own_language", "label", "quotes"), ("own_language", "label"), ("own_language", "number"), ("own_language", "rewrite"), ("own_language", "rewrite", "in_text"), ("number",), ("own_language", "speaker", "number"), ("foreign", "in_text", "rewrite")],
        REFUSAL: [("own_language", "speaker", "declines"), ("own_language", "speaker", "declines", "apology"), ("own_language", "error_key", "speaker", "declines")],
        ECHO: [("own_language", "in_prompt"), ("slot",), ("own_language", "in_text", "whole"), ("own_language", "in_text", "whole", "rewrite")],
        FOREIGN: [("foreign", "foreign_strong"), ("foreign", "foreign_strong", "label", "quotes"), ("foreign", "foreign_strong", "rewrite")],
        UNFINISHED: [("own_language", "unfinished", "last"), ("own_language", "unfinished", "last", "quotes"), ("unfinished", "last", "foreign"), ("own_language", "unfinished", "last", "rewrite")],
    }
    rows, tags = [], []
    for tag, cases in kinds.items():
        for case in cases:
            x = np.zeros((1, len(FEATURES)), dtype=np.float32)
            x[0, [_AT[f] for f in ("bias", "first", "last", "only", *case)]] = 1
            rows.append(x)
            tags.append(np.array([tag]))
    return rows, tags


def defect_of(reply: replies.Reply, blank: bool, tags: np.ndarray, lengths: list[int], rewrite: bool) -> str:
    """The defect that the tags' shares of the content amount to; '' for none."""
    if blank:
        return "empty"
    if len(tags) == 0:
        return "empty" if not re.search(r"\d", reply.content) else ""
    if tags[-1] == UNFINISHED:
        return "truncated"
    share = np.bincount(tags, weights=lengths, minlength=len(TAGS)) / max(1, sum(lengths))
    if rewrite and share[ECHO] < 1 and share[ECHO] >= max(share[REFUSAL], share[FOREIGN]):
        return ""
    if share[REFUSAL] >= 0.3:
        return "refusal"
    top = max(DEFECTS, key=lambda k: share[k])
    return DEFECTS[top] if share[top] >= 0.5 else ""


def _columns(results: DataFrame, fields: dict[str, str], id_col: str, text_col: str, label_col: str, source_col: str = "") -> DataFrame:
    source = F.lower(F.trim(F.col(source_col))) if source_col in results.columns else F.lit(None).cast("string")
    return results.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(label_col).alias("l"), source.alias("source"), *[F.col(f) for f in fields], *[F.col(p).alias(f"_{p}") for p in fields.values()])


def fit(results: DataFrame, fields: dict[str, str], id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> ChainField:
    """The conditional random field, trained on the clauses of at most sample rows, drawn by a hash of the id."""
    size = results.count()
    src = _columns(results, fields, id_col, text_col, label_col)
    if size > sample:
        src = src.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample / size))
    rows, tags = _prior()
    for r in src.limit(sample).collect():
        for f, p in fields.items():
            if r[f] is None or not r[f].strip():
                continue
            reply = replies.read(r[f])
            verdict, _ = replies.ending(reply, r["t"], r[f"_{p}"], r["l"])
            if verdict == replies.OPEN:
                continue
            x, _ = features(reply, r["t"], r[f"_{p}"], r["l"], verdict == replies.CUT)
            y = seed_tags(x)
            if 0 < len(x) <= LONGEST and y is not None:
                rows.append(x)
                tags.append(y)
    return train(rows, tags, len(TAGS))


def tagged(results: DataFrame, model: ChainField, fields: dict[str, str], id_col: str, text_col: str, label_col: str, source_col: str) -> DataFrame:
    """The ends of the replies as in ``truncation.value_ends``, with if_finished and if_cut: the defect of each reply for
    either judgement of its end."""
    src = _columns(results, fields, id_col, text_col, label_col, source_col)
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels = b.column(1).to_pylist(), b.column(2).to_pylist()
            inside: Counter[tuple[str, str]] = Counter()
            for k, f in enumerate(names):
                prompts = b.column(4 + len(names) + k).to_pylist()
                rows, n, ends, verdicts, words, info, seqs, made = [], [], [], [], [], [], [], {}
                for i, v in enumerate(b.column(4 + k).to_pylist()):
                    if v is None:
                        continue
                    reply = replies.read(v)
                    verdict, tokens = replies.ending(reply, texts[i], prompts[i], labels[i]) if v.strip() else (replies.COMPLETE, [])
                    truncation.count_inside(inside, f, tokens)
                    blank = verdict != replies.CUT and (not v.strip() or replies.is_nothing(reply))
                    x, lengths = features(reply, texts[i], prompts[i], labels[i], verdict == replies.CUT)
                    rows.append(i)
                    n.append(len(v))
                    ends.append(reply.end)
                    verdicts.append(verdict)
                    words.append(replies.words_at(tokens, len(tokens)))
                    rewrite = bool(prompts[i]) and "rewritten" in prompts[i]
                    info.append((reply, blank, lengths, rewrite, verdict == replies.CUT and not len(x)))
                    seqs.append(x)
                    if verdict == replies.OPEN and len(x):
                        again = x.copy()
                        again[-1, _AT["unfinished"]] = 1
                        made[len(rows) - 1] = again
                plain_tags = model.decode(seqs)
                cut_tags = dict(zip(made, model.decode(list(made.values())), strict=True))
                finished = ["truncated" if n[4] else defect_of(n[0], n[1], t, n[2], n[3]) for n, t in zip(info, plain_tags, strict=True)]
                cut = [defect_of(n[0], n[1], cut_tags[j], n[2], n[3]) if j in cut_tags else finished[j] for j, n in enumerate(info)]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(3).take(at), pa.array([f] * len(rows), pa.string()), pa.array(n, pa.int32()), pa.array(ends, pa.int32()), pa.array(verdicts, pa.int32()), pa.array(words, pa.string()), pa.array(finished, pa.string()), pa.array(cut, pa.string())],
                    names=_TAGGED,
                )
            counts = truncation.inside_rows(inside, b.schema.field(0).type, b.schema.field(3).type)
            none = pa.nulls(counts.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*counts.columns, none, none], names=_TAGGED)

    return src.mapInArrow(run, truncation.ENDS.format(id=src.schema["id"].dataType.simpleString()) + ", if_finished string, if_cut string")


_TAGGED = ["id", "source", "field_name", "n", "cut_length", "verdict", "words", "if_finished", "if_cut"]


def pair_defects(results: DataFrame, fields: dict[str, str] | None = None, id_col: str = "result_id", text_col: str = "text", label_col: str = "predicted_label", sample: int = SAMPLE, source_col: str = "model") -> DataFrame:
    """id, field_name, defect of every defective reply."""
    fields = fields or FIELDS
    model = fit(results, fields, id_col, text_col, label_col, sample)
    found = materialise(tagged(results, model, fields, id_col, text_col, label_col, source_col), "tagged")
    judged = truncation.judged(found)
    unstopped = (F.col("verdict") == replies.OPEN) & F.col("is_cut")
    return judged.select("id", "field_name", F.when(unstopped, F.col("if_cut")).otherwise(F.col("if_finished")).alias("defect")).where("defect <> ''").distinct()


def defect_rates(results: DataFrame, source_col: str = "model", **columns) -> DataFrame:
    """source, field_name, defect, replies, share: how often each source's replies to each prompt are defective."""
    fields = columns.get("fields") or FIELDS
    id_col = columns.get("id_col", "result_id")
    replied = results.select(F.col(id_col).alias("id"), F.lower(F.trim(F.col(source_col))).alias("source"), F.explode(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields])).alias("field_name")).where("field_name is not null")
    total = replied.groupBy("source", "field_name").agg(F.count("*").alias("all"))
    count = replied.join(pair_defects(results, source_col=source_col, **columns), ["id", "field_name"]).groupBy("source", "field_name", "defect").agg(F.count("*").alias("replies"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("field_name") == F.col("f"))
    return count.join(total.select(F.col("source").alias("s"), F.col("field_name").alias("f"), "all"), same).select("source", "field_name", "defect", "replies", F.round(F.col("replies") / F.col("all"), 6).alias("share"))
