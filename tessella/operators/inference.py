"""The place where a model would answer: not part of the engine, which takes replies as a table.

``answer`` calls a client of the user's per partition, batch by batch; rows that already have a reply are not asked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def answer(rows: DataFrame, prompt: str, make_client: Callable[[], Callable[[list[str]], list[str | None]]], out: str = "reply") -> DataFrame:
    """rows with a reply to each prompt; make_client is called once per task and gives a function of a list of prompts.
    Null prompts have null replies."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make_client()
        for d in batches:
            has = d[prompt].notna()
            d[out] = None
            if has.any():
                d.loc[has, out] = ask(d.loc[has, prompt].tolist())
            yield d

    return rows.mapInPandas(run, schema)
