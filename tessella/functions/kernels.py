"""What built-in functions can't express, as Arrow batch functions: tolerant JSON, word edits, weighted chance agreement."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCED = re.compile(r"```(?:\w+)?[ \t]*\r?\n?(.*?)```", re.S)
_BRACED = re.compile(r"\{.*\}", re.S)
#: Quotes that no backslash escapes; a backslash escapes the character after it, also another backslash.
_QUOTE = re.compile(r'((?<!\\)(?:\\\\)*")')
#: Marks at the ends of changed words that are not part of them; hyphens within words stay.
_EDGE = "!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~-–—‘’“”…"


def escape_inner_quotes(text: str) -> str:
    """Quotes inside string values escaped: a quote ends a string only before , } ] : or the end."""
    parts = _QUOTE.split(text)
    for i in range(1, len(parts), 2):  # escaped backslashes before a quote belong to what stands before
        parts[i - 1], parts[i] = parts[i - 1] + parts[i][:-1], '"'
    inside = False
    for i in range(1, len(parts), 2):
        if not inside:
            inside = True
            continue
        rest = parts[i + 1].lstrip()
        ends = not rest and i + 2 >= len(parts) or rest[:1] in tuple(",}]:")
        if ends:
            inside = False
        else:
            parts[i] = '\\"'
    return "".join(parts)


def _load(text: str) -> dict | None:
    try:
        obj = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return obj if isinstance(obj, dict) else None


def json_object_of(reply: str) -> str | None:
    """The JSON object in a reply as canonical text: of the whole, the first fence or the widest braces, as it is or with
    inner quotes escaped; None where there is no object."""
    text = reply.strip()
    found = [text]
    for pattern, group in ((_FENCED, 1), (_BRACED, 0)):
        if (m := pattern.search(text)) is not None:
            found.append(m.group(group).strip())
    for change in (lambda t: t, escape_inner_quotes):
        for t in found:
            obj = _load(change(t))
            if obj is not None:
                return json.dumps(obj, ensure_ascii=False)
    return None


def _score(v) -> float | None:
    return float(v) if isinstance(v, (bool, int, float)) and abs(v) < 1e300 else None


def salience_of(reply: str) -> list[dict] | None:
    """word and score of each entry of a reply's salience: pairs, objects of one key, or an object of word: score; None without
    a JSON object."""
    text = json_object_of(reply)
    if text is None or "NaN" in text or "Infinity" in text:
        try:
            json.loads(text or "x", parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            return None
    held = json.loads(text).get("salience")
    if isinstance(held, dict):
        return [{"word": k, "score": _score(v)} for k, v in held.items()]
    out = []
    for e in held if isinstance(held, list) else []:
        if isinstance(e, list) and len(e) == 2:
            out.append({"word": e[0] if isinstance(e[0], str) else None, "score": _score(e[1])})
        elif isinstance(e, dict) and len(e) == 1:
            word, value = next(iter(e.items()))
            out.append({"word": word, "score": _score(value)})
    return out


def salience(reply: Column) -> Column:
    @F.pandas_udf("array<struct<word:string,score:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(salience_of, na_action="ignore")

    return run(reply)


def extract_json(reply: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(json_object_of, na_action="ignore")

    return run(reply)


def word_distance(a: list[str], b: list[str]) -> int:
    """Fewest insertions, deletions and replacements of words; common ends are left out first."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    ids = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([ids[w] for w in b])
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, w in enumerate(a):
        best = np.empty_like(row)
        best[0] = i + 1
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != ids[w]))
        row = np.minimum.accumulate(best - steps) + steps  # insertions run along the row
    return int(row[-1])


def changed_words(a: list[str], b: list[str]) -> list[str]:
    """Words of a that are replaced or deleted on the way to b, without marks at their ends, distinct and sorted."""
    out = set()
    for kind, lo, hi, _, _ in SequenceMatcher(None, a, b).get_opcodes():
        if kind in ("replace", "delete"):
            out |= {w.strip(_EDGE) for w in a[lo:hi]}
    return sorted(out - {""})


def edits(original: Column, rewritten: Column, span_a: Column, span_b: Column) -> Column:
    """struct(changed, ratio) of token arrays: changed words of the original, and the edit distance of the spans per word of
    the original span (0 for two empty spans, 1 for one)."""

    @F.pandas_udf("struct<changed:array<string>,ratio:double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            rows = []
            for a, b, x, y in zip(*cols, strict=True):
                if a is None or b is None:
                    rows.append((None, None))
                    continue
                x, y = list(x), list(y)
                ratio = (0.0 if not y else 1.0) if not x else 1.0 if not y else word_distance(x, y) / len(x)
                rows.append((changed_words(list(a), list(b)), ratio))
            yield pd.DataFrame(rows, columns=["changed", "ratio"])

    return run(original, rewritten, span_a, span_b)


def weighted_chance(size_a: Column, size_b: Column, weights: Column, key: Column, draws: int = 500, seed: int = 42) -> Column:
    """Mean Jaccard of sets of the two sizes drawn without replacement in proportion to the weights (a map), by draws
    seeded from seed and the row's key; null without two weights or a positive size."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for cols in batches:
            out = []
            for a, b, w, k in zip(*cols, strict=True):
                w = dict(w) if w is not None else {}
                if len(w) < 2 or pd.isna(a) or pd.isna(b) or a < 1 or b < 1:
                    out.append(None)
                    continue
                v = np.maximum(np.array([w[t] for t in sorted(w)], dtype=float), 1e-9)
                na, nb = min(int(a), len(v)), min(int(b), len(v))
                rng = np.random.default_rng([seed, int(k) & 0xFFFFFFFF])
                # the smallest of exponential times with rates w are a draw without replacement
                first = np.argsort(rng.exponential(size=(draws, len(v))) / v, axis=1)[:, :na]
                second = np.argsort(rng.exponential(size=(draws, len(v))) / v, axis=1)[:, :nb]
                held = np.zeros((draws, len(v)), dtype=bool)
                np.put_along_axis(held, first, True, axis=1)
                common = np.take_along_axis(held, second, axis=1).sum(axis=1)
                out.append(float((common / (na + nb - common)).mean()))
            yield pd.Series(out, dtype="float64")

    return run(size_a, size_b, weights, key)
