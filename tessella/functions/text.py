"""Text functions on columns: cleaning, tokens, normalisation, erasure. Null in, null out unless stated."""

from __future__ import annotations

from collections.abc import Iterator
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import vocabulary as v

_WS = r"(?U)\s+"


def _lit_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def words(c: Column) -> Column:
    """Whitespace tokens; none for blank text."""
    return F.filter(F.split(c, _WS), lambda w: w != "")


def stripped_words(c: Column) -> Column:
    """Whitespace tokens without ASCII punctuation at their ends, empty ones left out, in lower case."""
    return F.filter(F.transform(words(c), lambda w: F.lower(F.btrim(w, F.lit(v.PUNCTUATION)))), lambda w: w != "")


def content_word_count(c: Column) -> Column:
    """Tokens with something left after stripping punctuation; 0 for null."""
    return F.coalesce(F.size(stripped_words(c)), F.lit(0))


def normalized_key(c: Column) -> Column:
    """Key under which texts are exact duplicates."""
    return F.array_join(stripped_words(c), " ")


def token_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(stripped_words(c)))


def dynamic_k(words_in_text: Column, cap: Column | None = None) -> Column:
    """max(3, a fifth of the words rounded half to even), at most cap."""
    k = F.greatest(F.lit(3), F.bround(words_in_text / 5).cast("int"))
    return F.least(k, cap) if cap is not None else k


def pre_normalize(c: Column) -> Column:
    return F.btrim(F.lower(F.btrim(F.btrim(c), F.lit("'\"*"))), F.lit(v.PUNCTUATION))


def normalize(c: Column, stopwords: list[str] | None = None) -> Column:
    """Normal form of one word; null for stopwords and discourse words, polarity words always stay. Lemmas are joined
    by the caller (``operators.normalise``)."""
    # the pattern only runs on the words that hold it; most calls are per word of a text
    bare = F.when(F.contains(F.upper(c), F.lit("[SEP]")), F.regexp_replace(c, r"(?i)\[SEP\]", "")).otherwise(c)
    w = F.btrim(F.lower(F.btrim(bare)), F.lit(v.PUNCTUATION))
    drop = {*(stopwords or v.NORMALISER_STOPWORDS), *v.DISCOURSE_WORDS} - set(v.POLARITY_WORDS)
    return F.when((w != "") & ~w.isin(*sorted(drop)), w)


def normalize_tokens(tokens: Column, split: bool = True) -> Column:
    """Sorted set of the normal forms of an array's words; multi-word items are split unless there are none."""
    parts = F.flatten(F.transform(tokens, lambda t: F.split(F.btrim(t), _WS))) if split else tokens
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda w: normalize(w)), lambda w: w.isNotNull())))


def normalize_input(c: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(c, r"(?i)\[SEP\]", " ")))


def input_words(c: Column) -> Column:
    """Words of an input text, by which evidence is anchored."""
    return F.array_distinct(F.regexp_extract_all(normalize_input(c), F.lit(r"(?U)([\w'-]+)"), 1))


def is_anchored(token: Column, text: Column) -> Column:
    """Whether the token is a word of the text (without lemmas)."""
    t = pre_normalize(token)
    return (t != "") & F.array_contains(input_words(text), t)


def canonical_tokens(c: Column) -> Column:
    """Tokens that do not depend on spacing: clitics split off, punctuation detached, lower case."""
    t = F.regexp_replace(F.lower(F.btrim(c)), v.CLITICS, " $1")
    return words(F.regexp_replace(t, "(?U)" + v.DETACHED, " $1 "))


def is_single_word(c: Column) -> Column:
    return (F.length(F.btrim(c)) > 0) & ~F.contains(F.btrim(c), F.lit(" "))


def collapse_ws(c: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(c, _WS, " ")))


def before_marker(c: Column, marker: str) -> Column:
    """Text up to and with the first marker; all of it where there is none."""
    at = F.instr(c, marker)
    return F.when(at == 0, c).otherwise(F.substring(c, F.lit(1), at + F.lit(len(marker) - 1)))


def after_marker(c: Column, marker: str) -> Column:
    at = F.instr(c, marker)
    return F.when(at == 0, F.lit("")).otherwise(F.substring(c, at + F.lit(len(marker)), F.length(c)))


def erase(text: Column, tokens: Column, operator: str, mask: str = "[MASK]") -> Column:
    """Mask or delete the words of a text that are in tokens (in lower case); the rest is joined by single spaces."""
    bare = lambda w: F.lower(F.btrim(w, F.lit(v.ERASURE_PUNCTUATION)))
    if operator == "mask":
        kept = F.transform(words(text), lambda w: F.when(F.array_contains(tokens, bare(w)), F.lit(mask)).otherwise(w))
    elif operator == "delete":
        kept = F.filter(words(text), lambda w: ~F.array_contains(tokens, bare(w)))
    else:
        raise ValueError(f"unknown operator {operator!r}")
    return F.array_join(kept, " ")


def is_refusal(reply: Column) -> Column:
    """Whether a reply holds a refusal phrase; false for null."""
    low = F.lower(reply)
    return F.coalesce(F.exists(_lit_array(v.REFUSAL_PHRASES), lambda p: F.contains(low, p)), F.lit(False))


def has_markup(c: Column) -> Column:
    return c.rlike(r"<[^>]+>|&[a-zA-Z]+;|#\d+;")


def non_ascii_share(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[\x00-\x7F]", "")) / F.greatest(F.length(c), F.lit(1))


def assemble_pair(premise: Column, hypothesis: Column) -> Column:
    """One text of a pair; the first alone where the second is null or empty."""
    return F.when(F.length(hypothesis) > 0, F.concat(F.lit("Premise: "), premise, F.lit("\nHypothesis: "), hypothesis)).otherwise(premise)


def map_label(raw: Column, labels: list[str]) -> Column:
    """Digits as an index into labels, out of range kept as they are; null where the result is no label (also -1)."""
    i = F.when(raw.rlike(r"^\d+$"), raw.cast("int"))
    named = F.when(i < len(labels), F.element_at(_lit_array(labels), i + 1)).otherwise(raw)
    return F.when(named.isin(*labels), named)


def prompt_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def render(template: str, **values: Column) -> Column:
    """A template with {name} replaced by columns."""
    out = F.lit(template)
    for k, c in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), c)
    return out


def leftover_placeholder(c: Column) -> Column:
    return c.rlike(r"\{(label_set|input_text|predicted_label|other_labels_quoted|other_labels)\}")


def quote_labels(labels: Column) -> Column:
    """'"a" or "b"'."""
    return F.array_join(F.transform(labels, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " or ")


_TAG, _CODE, _ENTITY = re.compile(r"<[^>]+>"), re.compile(r"#(\d+);"), re.compile(r"&[a-zA-Z]+;")


def clean_one(text: str) -> str:
    """Entities resolved, tags dropped, bare character codes resolved, other entities dropped."""
    text = _TAG.sub("", html.unescape(text))
    text = _CODE.sub(lambda m: chr(int(m.group(1))) if 0 < int(m.group(1)) < 0x110000 and not 0xD800 <= int(m.group(1)) < 0xE000 else "", text)
    return _ENTITY.sub("", text)


def clean_text(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(clean_one, na_action="ignore")

    needs = c.rlike(r"[<&#]")
    return F.when(needs, run(F.when(needs, c))).otherwise(c)
