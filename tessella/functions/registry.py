"""The measures as SQL functions: temporary functions whose bodies are expressions, so the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SETS = "a ARRAY<STRING>, b ARRAY<STRING>"
#: name -> (arguments, type, body)
FUNCTIONS = {
    "set_jaccard": (_SETS, "DOUBLE", "CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    "set_overlap": (_SETS, "DOUBLE", "CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / least(size(array_distinct(a)), size(array_distinct(b))) END"),
    "set_difference": (_SETS, "ARRAY<STRING>", "array_sort(array_union(array_except(a, b), array_except(b, a)))"),
    "text_words": ("t STRING", "ARRAY<STRING>", r"filter(split(t, '(?U)\\s+'), w -> w <> '')"),
    "evidence_size": ("words INT", "INT", "greatest(3, cast(bround(words / 5) as int))"),
    "changed_share": ("changed INT, words INT", "DOUBLE", "CASE WHEN words > 0 THEN changed / words END"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions in the session; their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
