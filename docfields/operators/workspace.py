"""Search, order and key figures of a workspace of documents."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Filters:
    """What a search may ask for; what is not set does not filter."""

    text: str | None = None
    must: tuple[str, ...] = ()
    must_not: tuple[str, ...] = ()
    city: str | None = None
    state: str | None = None
    live_on: date | None = None
    value: tuple[float | None, float | None] = (None, None)
    emd: tuple[float | None, float | None] = (None, None)
    closing: tuple[date | None, date | None] = (None, None)
    columns: tuple[str, ...] = field(default=("title", "authority", "department"))


def search(df: DataFrame, f: Filters) -> DataFrame:
    """Rows that meet every filter; one conjunction, so the scan gets what it can push down."""
    anywhere = F.lower(F.concat_ws(" ", *f.columns))
    tests: list[Column] = []
    if f.text:
        tests.append(F.contains(anywhere, F.lit(f.text.lower())))
    tests += [F.contains(anywhere, F.lit(w.lower())) for w in f.must] + [~F.contains(anywhere, F.lit(w.lower())) for w in f.must_not]
    tests += [F.lower(c) == v.lower() for c, v in (("city", f.city), ("state", f.state)) if v]
    if f.live_on:
        tests.append(F.col("deadline") >= F.lit(f.live_on))
    for c, (low, high) in (("tender_value", f.value), ("emd", f.emd), ("deadline", f.closing)):
        tests += [F.col(c) >= F.lit(low)] * (low is not None) + [F.col(c) <= F.lit(high)] * (high is not None)
    for t in tests:
        df = df.where(t)
    return df


def ordered(df: DataFrame, by: str) -> DataFrame:
    """All rows: deadline first to last, value, confidence or update (updated_at) from the top; nulls last, ties by id."""
    order = {"deadline": ("asc", "deadline"), "value": ("desc", "tender_value"), "confidence": ("desc", "parse_confidence"), "updated": ("desc", "updated_at")}[by]
    return df.orderBy(F.asc_nulls_last(order[1]) if order[0] == "asc" else F.desc_nulls_last(order[1]), "id")


def kpis(df: DataFrame, as_of: Column) -> DataFrame:
    """Live, still ingesting, closing within seven days, and surely parsed."""
    left = F.datediff("deadline", as_of)
    return df.agg(
        F.count_if(left >= 0).alias("live"), F.count_if(F.col("parse_status") == "processing").alias("ingesting"), F.count_if(left.between(0, 7)).alias("closing_soon"), F.count_if(F.col("parse_confidence") >= 85).alias("high_match")
    )


def merge_lists(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """All of the first list and what only the second has."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(*first.columns))


def with_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents with the sorted names of their children (parent_id, name)."""
    listed = children.groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("children"), F.count("*").alias("n"))
    return parents.join(listed, "id", "left").select("id", F.coalesce("children", F.lit("")).alias("children"), F.coalesce("n", F.lit(0)).alias("n"))
