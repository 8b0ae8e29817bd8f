"""Where a user's own model or score comes in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predict(wanted: DataFrame, docs: DataFrame, model: Callable[[str, str], str | None]) -> DataFrame:
    """Ask a model for the wanted (doc_id, field_name) of documents (doc_id, text), in batches within partitions.

    Only wanted rows reach it; a document without text is not asked for."""
    rows = wanted.join(docs.where("text is not null and text != ''"), "doc_id").select("doc_id", "field_name", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["value"] = [model(k, t) for k, t in zip(batch["field_name"], batch["text"])]
            yield batch[["doc_id", "field_name", "value"]]

    return rows.mapInPandas(run, "doc_id long, field_name string, value string")


def _partial(a: str, b: str) -> int:
    """100 times the best Indel similarity of the shorter text with a window of the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0
    # the longest common subsequence of each window by bits: one whole-number step a character
    places: dict[str, int] = {}
    for j, y in enumerate(short):
        places[y] = places.get(y, 0) | 1 << j
    full, best = (1 << len(short)) - 1, 0
    for k in range(len(long) - len(short) + 1):
        free = full
        for x in long[k : k + len(short)]:
            met = free & places.get(x, 0)
            free = ((free + met) | (free - met)) & full
        best = max(best, len(short) - free.bit_count())
    return 200 * best // (2 * len(short))


def _fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _partial(x, y) for x, y in zip(a, b)], dtype="Int32")


def fuzzy_score(a: Column, b: Column) -> Column:
    """The exact partial ratio for those who need it; ``rules.partial_ratio`` stays inside the JVM."""
    return F.pandas_udf(_fuzzy, "int")(a, b)
