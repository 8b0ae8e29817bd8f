"""Nested sections of texts as intervals: one pass cuts the texts at their headings, everything else is an as-of window or an equal join.

A text is known by its key columns, doc_id unless told otherwise; texts that share a key are taken for one. Places count characters from 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of headings: (level, kind, pattern at the start of a line whose first group is the number). The first kind that fits counts.
KINDS = (
    (1, "SECTION", r"SECTION[ \t-]*([IVXLC]+|[0-9]+)\b"),
    (1, "ANNEXURE", r"ANNEXURE[ \t-]*([IVXLC]+|[0-9]+|[A-Z])\b"),
    (2, "CLAUSE", r"CLAUSE[ \t-]*(?:NO\.?[ \t]*)?([0-9]+(?:\.[0-9]+)*)"),
    (4, "ITEM", r"([0-9]+(?:\.[0-9]+){2,})(?:[.\s]|\z)"),
    (3, "ITEM", r"([0-9]+\.[0-9]+)(?:[.\s]|\z)"),
    (2, "ITEM", r"([0-9]+)(?:[.\s]|\z)"),
)


def section_table(docs: DataFrame, kinds=KINDS, key: list[str] | None = None) -> DataFrame:
    """A row for each heading's piece of a text: the sections, each with its place in the tree.

    Columns: the key, n (0 for what stands before the first heading), level, kind, number, label (KIND-NUMBER in capitals), heading (its line), start and stop
    (the section with all below it is substr(text, start, stop - start)), parent (its n; null at the top), path (labels from the top down), above (their
    n), own (the text up to the next heading of any level). A section goes on to the next heading of its level or a higher one. A null text has no rows, an
    empty one a single piece. Each piece of text moves once; ends come from a running minimum over the pieces from the last to the first, so a text's work
    grows with its headings, times the number of levels."""
    key = key or ["doc_id"]
    head = lambda pattern: rf"(?i)^[ \t]*{pattern}"
    cut = r"(?i)\n(?=[ \t]*(?:" + "|".join(pattern for _, _, pattern in kinds) + "))"
    pieces = docs.where("text is not null").select(*key, F.length("text").alias("size"), F.posexplode(F.split("text", cut)).alias("k", "own")).withColumn("line", F.substring_index("own", "\n", 1))
    line = F.col("line")
    first = F.coalesce(*[F.when(line.rlike(head(p)), F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind"), F.upper(F.regexp_extract(line, head(p), 1)).alias("number"))) for level, kind, p in kinds])
    # what the windows need is read from a piece before them, so a piece's text goes along only if it is asked for
    flat = pieces.withColumn("h", first).select(*key, "k", "size", "own", (F.length("own") + 1).alias("taken"), F.coalesce("h.level", F.lit(0)).alias("level"), "h.kind", "h.number", F.concat_ws("-", "h.kind", "h.number").alias("label"), F.when(F.col("h").isNotNull(), F.trim("line")).alias("heading"))
    levels = sorted({level for level, _, _ in kinds})
    forward, backward = Window.partitionBy(*key).orderBy("k"), Window.partitionBy(*key).orderBy(F.desc("k"))
    before, after = forward.rowsBetween(Window.unboundedPreceding, 0), backward.rowsBetween(Window.unboundedPreceding, -1)
    # one sort for everything that comes from above, and one for the ends
    ancestors = [F.last(F.when(F.col("level").between(1, level), F.struct("level", "k", "label")), ignorenulls=True).over(before).alias(f"_{level}") for level in levels]
    placed = flat.select("*", F.first("level").over(before).alias("opening"), F.sum("taken").over(before).alias("upto"), *ancestors)
    placed = placed.withColumns({"start": (1 + F.col("upto") - F.col("taken")).cast("int"), "shift": F.when(F.col("opening") == 0, 0).otherwise(1)})
    next_start = lambda level: F.min(F.when(F.col("level") <= level, F.col("start"))).over(after)
    stop = reduce(lambda c, level: c.when(F.col("level") == level, next_start(level)), levels, F.when(F.col("level") == 0, F.min("start").over(after)))
    held = lambda level: F.when((F.col(f"_{level}")["level"] == level) & (F.col("level") >= level), F.col(f"_{level}"))
    tree = placed.withColumn("tree", F.filter(F.array(*[held(level) for level in levels]), lambda x: x.isNotNull())).withColumn("stop", F.coalesce(stop - 1, F.col("size") + 1))
    # without a heading at its very start a text opens with a piece of level 0; else numbers begin at 1
    n = lambda k: k + F.col("shift")
    return tree.select(*key, n(F.col("k")).alias("n"), "level", "kind", "number", "label", "heading", "start", "stop", n(F.get(F.col("tree"), F.size("tree") - 2)["k"]).alias("parent"), F.transform("tree", lambda x: x["label"]).alias("path"), F.transform("tree", lambda x: n(x["k"])).alias("above"), "own")


def in_sections(values: DataFrame, sections: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Values (key, place and more) with the innermost section that holds their place, as struct ``section`` (n, level, label, heading, path).

    Sections nest, so the innermost one is that of the last heading up to the place: an as-of join by one window, whatever the depth. Values before every section, or of a text without one, get null."""
    key = key or ["doc_id"]
    marks = sections.select(*key, F.col("start").alias("place"), F.lit(0).alias("is_value"), F.struct("n", "level", "label", "heading", "path").alias("section"))
    rows = values.select(*key, "place", F.lit(1).alias("is_value"), F.struct(*[F.col(c) for c in values.columns if c not in (*key, "place")]).alias("value"))
    order = Window.partitionBy(*key).orderBy("place", "is_value").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(rows, allowMissingColumns=True).withColumn("section", F.last("section", ignorenulls=True).over(order))
    return both.where("is_value = 1").select(*key, "place", "value.*", "section")


# fixed values: what ends a slice of a section
STOPS = r"SECTION|ANNEXURE|CLAUSE|[0-9]+[.\s]"


def first_slice(text: Column, heading: str, inner: str, group: int = 1, stops: str = STOPS) -> Column:
    """The inner pattern's group in the first slice that has it. A slice begins after a heading, which may stand anywhere, and ends before the next line that begins with a stop; case does not count.

    The text is cut at the stops once, and each piece has one slice at most, so the work grows with the text."""
    pieces = F.split(text, rf"(?i)\n(?=[ \t]*(?:{stops}))")
    slices = F.transform(pieces, lambda p: F.regexp_extract(p, rf"(?is)(?:{heading})(.*)\z", 1))
    values = F.transform(slices, lambda s: F.regexp_extract(s, rf"(?i){inner}", group))
    return F.get(F.filter(values, lambda v: v != ""), F.lit(0))


def deferred_values(sections: DataFrame, heading: str, inner: str, refer: str, group: int = 1, key: list[str] | None = None) -> DataFrame:
    """Values of the sections whose heading line matches, or of the sections that they point to.

    A section's own value is the inner pattern's group in its own text. Without one, a reference (the pattern ``refer``, group 1 a label such as SECTION-III in any
    case, with a space or dash) takes the first value inside the section of that label, whatever its depth; of several such sections the first with a value.
    Columns: the key, n, heading, target, value, status: own, deferred, unresolved (a reference that leads nowhere) or none. Only values move to the sections
    above them, a row each level; texts stay where they are."""
    key = key or ["doc_id"]
    value = F.nullif(F.regexp_extract("own", rf"(?i){inner}", group), F.lit(""))
    target = F.nullif(F.upper(F.regexp_replace(F.regexp_extract("own", rf"(?i){refer}", 1), r"[ \t-]+", "-")), F.lit(""))
    read = sections.withColumn("value", value)
    # texts are cut once: a section goes to the labels above it with its value, and to the label that it refers to with the question
    asks = F.when(F.col("heading").rlike(rf"(?i){heading}"), F.array(F.struct(F.when(F.col("value").isNull(), target).alias("target"), F.lit(True).alias("asks")))).otherwise(F.array())
    held = F.when(F.col("value").isNotNull(), F.transform(F.array_distinct("path"), lambda p: F.struct(p.alias("target"), F.lit(False).alias("asks")))).otherwise(F.array())
    rows = read.select(*key, "n", "heading", "value", F.inline(F.concat(asks, held)))
    theirs = F.min(F.when(~F.col("asks"), F.struct("n", "value"))).over(Window.partitionBy(*key, "target"))["value"]
    joined = rows.withColumn("theirs", F.when(F.col("target").isNotNull(), theirs)).where("asks").withColumnRenamed("value", "mine")
    status = F.when(F.col("mine").isNotNull(), "own").when(F.col("theirs").isNotNull(), "deferred").when(F.col("target").isNotNull(), "unresolved").otherwise("none")
    return joined.select(*key, "n", "heading", "target", F.coalesce("mine", "theirs").alias("value"), status.alias("status"))
