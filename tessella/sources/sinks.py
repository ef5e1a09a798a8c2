"""Writers: record files, CSV with fixed columns, one-document JSON, Markdown and LaTeX tables, manifests, environment.

Tables are written by the executors; only reports (aggregates, a few rows) are collected."""

from __future__ import annotations

import hashlib
import json
import platform
import re
import subprocess
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a report at most; reports are of aggregates.
REPORT_ROWS = 10_000


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """One JSON object per line; sets (arrays) are to be sorted by the caller, nulls are kept."""
    w = df.write.mode(mode).option("ignoreNullFields", False)
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> bool:
    """The columns that exist, with a header; nothing at all for no rows. Whether it wrote."""
    if df.isEmpty():
        return False
    df.select(*[c for c in columns if c in df.columns]).write.mode("overwrite").option("header", True).csv(path)
    return True


def _rows(df: DataFrame) -> list[dict]:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report holds at most {REPORT_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def write_document(df: DataFrame, path: str) -> None:
    """A report as one JSON array."""
    Path(path).write_text(json.dumps(_rows(df), indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def shown(value: object, digits: int = 3) -> str:
    if value is None:
        return "-"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


_BRACES = re.compile(r"\{[a-zA-Z_][\w.]*\}")


def check_rendered(text: str) -> str:
    """The text, if no placeholder is left in it."""
    if (m := _BRACES.search(text)) is not None:
        raise ValueError(f"placeholder left: {m.group(0)}")
    return text


def markdown_table(df: DataFrame, columns: list[str] | None = None, digits: int = 3) -> str:
    columns = columns or df.columns
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(shown(r[c], digits) for c in columns) + " |" for r in _rows(df.select(*columns))]
    return check_rendered("\n".join(lines) + "\n")


def latex_table(df: DataFrame, caption: str, label: str, columns: list[str] | None = None, digits: int = 3) -> str:
    columns = columns or df.columns
    tex = lambda s: re.sub(r"([&%$#_{}])", r"\\\1", s)
    body = [" & ".join(tex(shown(r[c], digits)) for c in columns) + r" \\" for r in _rows(df.select(*columns))]
    head = " & ".join(tex(c) for c in columns) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}", ""])


def write_report(path: str, title: str, tables: dict[str, DataFrame], digits: int = 3) -> None:
    """A Markdown report of a table per heading."""
    parts = [f"# {title}\n"] + [f"## {k}\n\n{markdown_table(df, digits=digits)}" for k, df in tables.items()]
    Path(path).write_text("\n".join(parts), encoding="utf-8")


def execution_summary(results: DataFrame) -> DataFrame:
    """One row: rows, models, datasets, refused, tokens, first and last time and the seconds between them."""
    refused = F.coalesce(F.col("model_refused"), F.lit(False))
    out = results.agg(
        F.count("*").alias("rows"),
        F.countDistinct(F.lower(F.trim("model"))).alias("models"),
        F.countDistinct("dataset").alias("datasets"),
        F.count(F.when(refused, 1)).alias("refused"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("response_tokens").alias("response_tokens"),
        F.min("recorded_at").alias("first_at"),
        F.max("recorded_at").alias("last_at"),
    )
    return out.withColumn("span_seconds", F.expr("cast(timestampdiff(SECOND, first_at, last_at) as bigint)"))


def highlighted(text: str, words: list[str], start: str = "\033[1;32m", end: str = "\033[0m") -> str:
    """The text with whole words marked for a terminal; the longest match counts."""
    if not words:
        return text
    either = "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return re.sub(rf"(?i)(?<!\w)(?:{either})(?!\w)", lambda m: f"{start}{m.group(0)}{end}", text)


def manifest(files: dict[str, str]) -> dict[str, dict[str, str]]:
    """name: file and the SHA-256 of its content."""
    return {k: {"file": p, "sha256": hashlib.sha256(Path(p).read_bytes()).hexdigest()} for k, p in files.items()}


def environment() -> dict[str, object]:
    """Python, platform, packages, and the commit if there is one."""
    import numpy
    import pandas
    import pyspark

    def git(*a: str) -> str:
        try:
            return subprocess.run(["git", *a], capture_output=True, text=True, timeout=10).stdout.strip()
        except OSError:
            return ""

    return {"python": sys.version.split()[0], "platform": platform.platform(), "packages": {m.__name__: m.__version__ for m in (numpy, pandas, pyspark)}, "commit": git("rev-parse", "HEAD"), "changed": bool(git("status", "--porcelain"))}
