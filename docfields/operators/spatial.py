"""Blocks, cells, lines and regions of a page: spatial and as-of joins, clustering, boxes.

Every join has the equal key (doc_id, page_no), so no operator forms a product beyond one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions import scalars as S

PAGE = ["doc_id", "page_no"]


def _as(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*PAGE, *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def contained_pairs(blocks: DataFrame, regions: DataFrame, carry: tuple[str, ...] = (), region_carry: tuple[str, ...] = ()) -> DataFrame:
    """Blocks in regions (with ord): the centre inside, or at least half of the block's area. A row each pair: ord, region_ord, shared, and the named columns to carry along, those of the region as region_ ones.

    The centre must lie in the region, or the boxes meet; both are tested page by page, in bands of 100 in y: a block goes to each band that it touches, a region too, and
    a pair counts in the first band that both touch."""
    box = ("ord", "x1", "y1", "x2", "y2")
    b, r = _as(blocks, "b", *dict.fromkeys(box + carry)), _as(regions, "r", *dict.fromkeys(box + region_carry))
    bands = lambda df, p: df.withColumn(f"{p}_band", F.floor(F.col(f"{p}_y1") / 100)).withColumn("band", F.explode(F.sequence(f"{p}_band", F.greatest(f"{p}_band", F.floor(F.col(f"{p}_y2") / 100)))))
    # rows that a generator makes count as one each in Spark's estimates, so it would broadcast regions of any number
    pairs = bands(b, "b").join(bands(r, "r").hint("merge"), [*PAGE, "band"]).where(F.col("band") == F.greatest("b_band", "r_band"))
    return _contained(pairs).select(*PAGE, F.col("b_ord").alias("ord"), F.col("r_ord").alias("region_ord"), "shared", *[F.col(f"b_{c}").alias(c) for c in carry], *[F.col(f"r_{c}").alias(f"region_{c}") for c in region_carry])


def _contained(pairs: DataFrame) -> DataFrame:
    cx, cy = F.col("b_x1") + F.col("b_x2"), F.col("b_y1") + F.col("b_y2")
    centre = cx.between(2 * F.col("r_x1"), 2 * F.col("r_x2")) & cy.between(2 * F.col("r_y1"), 2 * F.col("r_y2"))
    shared = S.intersection(*[F.col(f"{p}_{c}") for p in "br" for c in ("x1", "y1", "x2", "y2")])
    area = (F.col("b_x2") - F.col("b_x1")) * (F.col("b_y2") - F.col("b_y1"))
    return pairs.withColumn("shared", shared).where(centre | ((area > 0) & (2 * shared >= area)))


def contained_blocks(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks in a region: the centre inside it, or at least half of the block's area."""
    b, r = _as(blocks, "b", "ord", "x1", "y1", "x2", "y2"), _as(regions, "r", "x1", "y1", "x2", "y2")
    return _contained(b.join(r, PAGE)).select(*PAGE, F.col("b_ord").alias("ord"), "shared")


def nearest_block(anchors: DataFrame, blocks: DataFrame, reach: int = 150) -> DataFrame:
    """The nearest block right of an anchor (centres within 30 in y) or below it (within 150 in x), closer than ``reach``.

    Distances are of doubled centres, squared, so they are integers; ties go to the first block. Centres are dealt to squares of ``reach``: an anchor meets
    the blocks of its own square and the eight around it, not the whole page."""
    a, b = _as(anchors, "a", "ord", "x1", "y1", "x2", "y2"), _as(blocks, "b", "ord", "x1", "y1", "x2", "y2")
    square = lambda p, axis: F.floor((F.col(f"{p}_{axis}1") + F.col(f"{p}_{axis}2")) / (2 * reach))
    around = lambda axis: F.explode(F.array(*[square("a", axis) + d for d in (-1, 0, 1)]))
    a = a.withColumn("sx", around("x")).withColumn("sy", around("y"))
    b = b.withColumn("sx", square("b", "x")).withColumn("sy", square("b", "y"))
    dx = F.col("b_x1") + F.col("b_x2") - F.col("a_x1") - F.col("a_x2")
    dy = F.col("b_y1") + F.col("b_y2") - F.col("a_y1") - F.col("a_y2")
    right = (F.col("b_x1") >= F.col("a_x2")) & (F.abs(dy) < 60)
    below = (F.col("b_y1") >= F.col("a_y2")) & (F.abs(dx) < 300)
    near = a.join(b, [*PAGE, "sx", "sy"]).where(F.col("a_ord") != F.col("b_ord")).withColumn("d", dx * dx + dy * dy).where((right | below) & (F.col("d") < 4 * reach * reach))
    best = near.groupBy(*PAGE, "a_ord").agg(F.min(F.struct("d", "b_ord")).alias("m"))
    return best.select(*PAGE, F.col("a_ord").alias("ord"), F.col("m.b_ord").alias("match_ord"), F.col("m.d").alias("distance"))


def adjacent_rows(blocks: DataFrame, gap: int = 50) -> DataFrame:
    """Each block with the next in order, if that begins within ``gap`` of the block's end."""
    page = Window.partitionBy(*PAGE).orderBy("ord")
    nexts = blocks.select(*PAGE, "ord", "y2", F.lead("ord").over(page).alias("next_ord"), F.lead("y1").over(page).alias("next_y1"))
    return nexts.where(F.abs(F.col("next_y1") - F.col("y2")) < gap).select(*PAGE, "ord", "next_ord")


def mutual_pairs(left: DataFrame, right: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cells of two columns that are each other's largest overlap in y; the first wins ties. Columns to carry along come back as a_ and b_ ones."""
    a, b = _as(left, "a", "ord", "y1", "y2", *carry), _as(right, "b", "ord", "y1", "y2", *carry)
    overlap = F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1")
    return _mutual(a.join(b, PAGE).withColumn("overlap", overlap).where("overlap > 0"), carry)


def mutual_cells(pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``mutual_pairs`` of pages' cells that stand in two arrays, a and b (ord, y1, y2 and what to carry along): they need not be made twice and joined."""
    overlap = lambda a, b: F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    pair = lambda a, b: F.struct(a["ord"].alias("a_ord"), b["ord"].alias("b_ord"), overlap(a, b).alias("overlap"), *[x[c].alias(f"{p}_{c}") for p, x in (("a", a), ("b", b)) for c in carry])
    met = F.flatten(F.transform("a", lambda a: F.transform(F.filter("b", lambda b: overlap(a, b) > 0), lambda b: pair(a, b))))
    return _mutual(pages.select(*PAGE, F.inline(met)), carry)


def _mutual(pairs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    ra = F.row_number().over(Window.partitionBy(*PAGE, "a_ord").orderBy(F.desc("overlap"), "b_ord"))
    rb = F.row_number().over(Window.partitionBy(*PAGE, "b_ord").orderBy(F.desc("overlap"), "a_ord"))
    return pairs.withColumn("ra", ra).withColumn("rb", rb).where("ra = 1 and rb = 1").select(*PAGE, "a_ord", "b_ord", "overlap", *[f"{p}_{c}" for p in "ab" for c in carry])


def greedy_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left cells in order each take the unused right cell of the largest overlap in y: a fold over one page's cells."""
    cells = lambda df, p: _as(df, p, "ord", "y1", "y2").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col(f"{p}_ord").alias("ord"), F.col(f"{p}_y1").alias("y1"), F.col(f"{p}_y2").alias("y2")))).alias(p))
    start = F.expr("cast(array() as array<struct<a_ord: bigint, b_ord: bigint, overlap: bigint>>)")

    def step(done: Column, cell: Column) -> Column:
        used = F.transform(done, lambda d: d["b_ord"])
        free = F.filter(F.col("b"), lambda r: ~F.array_contains(used, r["ord"]) & (F.least(cell["y2"], r["y2"]) > F.greatest(cell["y1"], r["y1"])))
        scored = F.transform(free, lambda r: F.struct((F.greatest(cell["y1"], r["y1"]) - F.least(cell["y2"], r["y2"])).alias("k"), r["ord"].alias("o")))
        best = F.array_min(scored)
        return F.when(F.size(free) == 0, done).otherwise(F.concat(done, F.array(F.struct(cell["ord"].alias("a_ord"), best["o"].alias("b_ord"), (-best["k"]).alias("overlap")))))

    both = cells(left, "a").join(cells(right, "b"), PAGE)
    return both.select(*PAGE, F.inline(F.aggregate("a", start, step)))


def context_above(boxes: DataFrame, blocks: DataFrame, pattern: str, group: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each box (doc_id, page_no, ord, y1) with what the pattern finds in the closest block that ends above it and has it, or nulls: context_ord and context, and the named columns of the box to carry along.

    Of blocks that end level the first in order counts. Boxes and blocks that have it go once through a window in y, so a page is no product."""
    found = F.nullif(F.regexp_extract("text", pattern, group), F.lit(""))
    kept = F.struct(*carry) if carry else F.lit(None)
    tops = boxes.select(*PAGE, F.col("y1").alias("y"), F.lit(0).alias("is_block"), F.col("ord").alias("k"), F.lit(None).alias("c"), kept.alias("box"))
    ends = blocks.where(found.isNotNull()).select(*PAGE, F.col("y2").alias("y"), F.lit(1).alias("is_block"), F.col("ord").alias("k"), F.struct(F.col("ord").alias("context_ord"), found.alias("context")).alias("c"), F.lit(None).alias("box"))
    # a box comes before the blocks that end where it begins
    order = Window.partitionBy(*PAGE).orderBy("y", "is_block", F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return ends.unionByName(tops).withColumn("c", F.last("c", ignorenulls=True).over(order)).where("is_block = 0").select(*PAGE, F.col("k").alias("ord"), "c.*", *[F.col("box")[c].alias(c) for c in carry])


def context_below(boxes: DataFrame, blocks: DataFrame, pattern: str, most: int = 10, group: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each box (doc_id, page_no, ord, y2) with what the pattern finds in the first of the ``most`` blocks below it that has it, or nulls: context_ord and context, and the named columns of the box to carry along.

    Blocks begin below the box's end and count from top to bottom, level ones in order. Two windows in y: one over boxes and blocks counts the blocks down to each, one over boxes and the blocks with the pattern goes from the bottom up."""
    found = F.nullif(F.regexp_extract("text", pattern, group), F.lit(""))
    kept = F.struct(*carry) if carry else F.lit(None)
    tops = blocks.select(*PAGE, F.col("y1").alias("y"), F.lit(0).alias("is_box"), F.col("ord").alias("k"), found.alias("found"), F.lit(None).alias("box"))
    ends = boxes.select(*PAGE, F.col("y2").alias("y"), F.lit(1).alias("is_box"), F.col("ord").alias("k"), F.lit(None).alias("found"), kept.alias("box"))
    order = [F.col("y"), F.col("is_box"), F.col("k")]
    upto = Window.partitionBy(*PAGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*PAGE).orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    counted = tops.unionByName(ends).withColumn("nth", F.count_if(F.col("is_box") == 0).over(upto)).where("is_box = 1 or found is not null")
    both = counted.withColumn("c", F.last(F.when(F.col("found").isNotNull(), F.struct("nth", F.col("k").alias("context_ord"), F.col("found").alias("context"))), ignorenulls=True).over(later))
    near = F.when(F.col("c.nth") <= F.col("nth") + most, F.col("c"))
    return both.where("is_box = 1").select(*PAGE, F.col("k").alias("ord"), near["context_ord"].alias("context_ord"), near["context"].alias("context"), *[F.col("box")[c].alias(c) for c in carry])


def header_above(blocks: DataFrame, strict: bool = True) -> DataFrame:
    """Each block that is no header with the last header whose y1 is less (or not greater): an as-of join by one window."""
    frame = Window.partitionBy(*PAGE).orderBy("y1").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    header = F.max(F.when(F.col("is_header"), F.struct("y1", "ord"))).over(frame)
    return blocks.withColumn("h", header).where(~F.col("is_header")).select(*PAGE, "ord", F.col("h.ord").alias("header_ord"))


def segments(blocks: DataFrame) -> DataFrame:
    """Blocks by the header segment that holds their y1; before the first header they go, and without any header all are in segment 0."""
    page = Window.partitionBy(*PAGE)
    frame = page.orderBy("y1").rangeBetween(Window.unboundedPreceding, 0)
    marked = blocks.withColumn("any", F.max(F.col("is_header").cast("int")).over(page)).withColumn("h", F.max(F.when(F.col("is_header"), F.struct("y1", "ord"))).over(frame))
    return marked.where((F.col("any") == 0) | F.col("h").isNotNull()).select(*PAGE, "ord", F.coalesce("h.ord", F.lit(0)).alias("segment"))


# fixed values: characters of ticked and empty boxes
CHECKED, UNCHECKED = "\uf050þ✔☑", "\uf04f¨☐"


def glyph_states(blocks: DataFrame) -> DataFrame:
    """A row for each box character of blocks (text, font if there is one) with its state: CHECKED, UNCHECKED, or AMBIGUOUS_CHECKBOX for any other
    character of a wingdings font."""
    font = F.contains(F.lower("font"), F.lit("wingdings")) if "font" in blocks.columns else F.lit(False)
    chars = blocks.select("*", F.posexplode(F.split("text", "")).alias("place", "glyph")).where("glyph != ''")
    state = F.when(F.contains(F.lit(CHECKED), F.col("glyph")), "CHECKED").when(F.contains(F.lit(UNCHECKED), F.col("glyph")), "UNCHECKED").when(F.coalesce(font, F.lit(False)), "AMBIGUOUS_CHECKBOX")
    return chars.withColumn("state", state).where("state is not null")


def glyph_labels(glyphs: DataFrame, labels: DataFrame) -> DataFrame:
    """The nearest label of each glyph, centres within 25 in y; ties go to the first."""
    a, b = _as(glyphs, "a", "ord", "x1", "y1", "x2", "y2"), _as(labels, "b", "ord", "x1", "y1", "x2", "y2")
    dx = F.col("b_x1") + F.col("b_x2") - F.col("a_x1") - F.col("a_x2")
    dy = F.col("b_y1") + F.col("b_y2") - F.col("a_y1") - F.col("a_y2")
    near = a.join(b, PAGE).where(F.abs(dy) <= 50)
    return near.groupBy(*PAGE, "a_ord").agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), F.col("b_ord"))).alias("m")).select(*PAGE, F.col("a_ord").alias("ord"), F.col("m.b_ord").alias("label_ord"))


def text_in_boxes(boxes: DataFrame, blocks: DataFrame, left: int = 5, up: int = 5, right: int = 5, down: int = 5) -> DataFrame:
    """The texts that meet each box (doc_id, page_no, x1, y1, x2, y2) widened by a margin, in order: a row a box that any meets."""
    a, b = _as(boxes, "a", "x1", "y1", "x2", "y2"), _as(blocks, "b", "ord", "x1", "y1", "x2", "y2", "text")
    meets = (F.col("b_x1") < F.col("a_x2") + right) & (F.col("b_x2") > F.col("a_x1") - left) & (F.col("b_y1") < F.col("a_y2") + down) & (F.col("b_y2") > F.col("a_y1") - up)
    listed = F.sort_array(F.collect_list(F.struct("b_ord", "b_text")))
    box = [f"a_{c}" for c in ("x1", "y1", "x2", "y2")]
    texts = a.distinct().join(b, PAGE).where(meets).groupBy(*PAGE, *box).agg(F.array_join(F.transform(listed, lambda x: x["b_text"]), " ").alias("text"))
    return texts.select(*PAGE, *[F.col(c).alias(c[2:]) for c in box], "text")


def words_to_lines(blocks: DataFrame) -> DataFrame:
    """Hull, text in x order and mean confidence of each (block, line)."""
    words = F.sort_array(F.collect_list(F.struct("x1", "ord", "text")))
    return blocks.groupBy(*PAGE, "block_no", "line_no").agg(
        *[F.min(c).alias(c) for c in ("x1", "y1")], *[F.max(c).alias(c) for c in ("x2", "y2")], F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("line_text"), F.avg("conf_pct").alias("conf")
    )


def detect_tables(blocks: DataFrame, gap: int = 40) -> DataFrame:
    """Lines split at gaps of more than ``gap`` in x; a page is a table at 35 % lines of several columns, or two such of two lines."""
    line = Window.partitionBy(*PAGE, "line_no").orderBy("x1", "ord")
    columns = blocks.withColumn("new", (F.col("x1") - F.lag("x2").over(line) > gap).cast("int")).groupBy(*PAGE, "line_no").agg((1 + F.coalesce(F.sum("new"), F.lit(0))).alias("columns"))
    pages = columns.groupBy(*PAGE).agg(F.count("*").alias("lines"), F.count_if(F.col("columns") > 1).alias("multi"))
    return pages.withColumn("is_table", (F.col("multi") * 100 >= F.col("lines") * 35) | ((F.col("lines") >= 2) & (F.col("multi") >= 2)))


def cluster_lines(blocks: DataFrame, tolerance: int = 12) -> DataFrame:
    """Blocks sorted by y1 join the current line while |y1 - its mean| is within the tolerance.

    The running mean depends on the order, so it is a fold over one page's blocks, inside the JVM. Only sums and counts run along:
    the fold keeps an array of line numbers, and pages are bounded by what a page holds."""
    pages = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y1", "ord"))).alias("b"))
    numbers = _line_numbers(F.transform("b", lambda b: b["y1"]), tolerance)
    lines = pages.select(*PAGE, F.explode(F.arrays_zip(F.col("b"), numbers.alias("line"))).alias("x"))
    return lines.select(*PAGE, F.col("x.b.ord").alias("ord"), F.col("x.line").alias("line"))


def lines_of(blocks: DataFrame, carry: tuple[str, ...], tolerance: int = 12, name: str = "cells") -> DataFrame:
    """The lines of ``cluster_lines``, from 1, each with the named columns of its blocks as one array, from top to bottom. The blocks are brought together once and not joined again."""
    pages = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("y1", "ord", F.struct(*carry).alias("c")))).alias("b"))
    kind = ", ".join(f"{c}: {blocks.schema[c].dataType.simpleString()}" for c in carry)
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("n"), F.expr(f"cast(array() as array<struct<{kind}>>)").alias("open"), F.expr(f"cast(array() as array<array<struct<{kind}>>>)").alias("out"))

    def step(a: Column, b: Column) -> Column:
        one, state = F.array(b["c"]), lambda s, n, o, out: F.struct(s.alias("s"), n.alias("n"), o.alias("open"), out.alias("out"))
        # the first block opens a line; later ones close the line before
        new = F.abs(b["y1"] * a["n"] - a["s"]) > tolerance * a["n"]
        return F.when(new, state(b["y1"], F.lit(1).cast("long"), one, F.concat(a["out"], F.array(a["open"])))).otherwise(state(a["s"] + b["y1"], a["n"] + 1, F.concat(a["open"], one), a["out"]))

    lines = F.aggregate("b", start, step, lambda a: F.concat(a["out"], F.array(a["open"])))
    return pages.select(*PAGE, F.posexplode(lines).alias("line", name)).withColumn("line", F.col("line") + 1)


def _line_numbers(places: Column, tolerance: int) -> Column:
    """The number of each place's line, from 1; places in order."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("line"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(a: Column, y: Column) -> Column:
        new = (a["n"] == 0) | (F.abs(y * a["n"] - a["s"]) > tolerance * a["n"])
        state = lambda s, n, line: F.struct(s.alias("s"), n.alias("n"), line.alias("line"), F.concat(a["out"], F.array(line)).alias("out"))
        # the test stands once: a lambda evaluates each use anew
        return F.when(new, state(y, F.lit(1).cast("long"), a["line"] + 1)).otherwise(state(a["s"] + y, a["n"] + 1, a["line"]))

    return F.aggregate(places, start, step)["out"]


def _line_means(places: Column, tolerance: int) -> Column:
    """The mean of each line's places as a whole number, line by line; places in order. The fold holds the sums of the line that is open and the means of those before."""
    mean = lambda a: F.array((a["s"] / a["n"]).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("n"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(a: Column, y: Column) -> Column:
        new = F.abs(y * a["n"] - a["s"]) > tolerance * a["n"]
        open_ = F.struct((a["s"] + y).alias("s"), (a["n"] + 1).alias("n"), a["out"].alias("out"))
        return F.when(new, F.struct(y.alias("s"), F.lit(1).cast("long").alias("n"), F.concat(a["out"], mean(a)).alias("out"))).otherwise(open_)

    return F.aggregate(places, start, step, lambda a: F.concat(a["out"], mean(a)))


def _celled(blocks: DataFrame, gap: int, column_width: int, sure: int | None, sure_gap: int) -> DataFrame:
    column = F.col("col") if "col" in blocks.columns else F.floor(F.col("x1") / column_width)
    reach = F.lit(gap) if sure is None else F.when(F.col("conf_pct") >= sure, sure_gap).otherwise(gap)
    order = Window.partitionBy(*PAGE, "col").orderBy("y1", "ord")
    low = F.max("y2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = blocks.withColumn("col", column).withColumn("new", F.coalesce((F.col("y1") - low > reach).cast("int"), F.lit(1)))
    return flagged.withColumn("cell", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def merge_cells(blocks: DataFrame, gap: int = 20, column_width: int = 200, sure: int | None = None, sure_gap: int = 0) -> DataFrame:
    """Blocks of a column become one cell while the next begins within the gap of the lowest end so far: gaps and islands.

    A block of at least the confidence ``sure`` may lie ``sure_gap`` off. The column is ``col`` if blocks have one (of ``grid``), else x1 by width."""
    return _celled(blocks, gap, column_width, sure, sure_gap).groupBy(*PAGE, "col", "cell").agg(F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.count("*").alias("n"))


def cell_texts(blocks: DataFrame, gap: int = 20, column_width: int = 200, sure: int | None = None, sure_gap: int = 0) -> DataFrame:
    """The cells of ``merge_cells`` with their texts from top to bottom, the least confidence and the first block's number as ord."""
    texts = F.sort_array(F.collect_list(F.struct("y1", "ord", F.trim("text").alias("text"))))
    cells = _celled(blocks, gap, column_width, sure, sure_gap).groupBy(*PAGE, "col", "cell").agg(F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.min("conf_pct").alias("conf_pct"), texts.alias("t"))
    return cells.select(*PAGE, "col", "cell", "y1", "y2", "conf_pct", F.col("t")[0]["ord"].alias("ord"), F.array_join(F.transform("t", lambda b: b["text"]), " ").alias("text"))


def words_to_cells(blocks: DataFrame, gap: int = 15) -> DataFrame:
    """Words in (y, x) order; a new cell unless the next is within 5 in y and less than ``gap`` behind in x."""
    order = Window.partitionBy(*PAGE).orderBy("y1", "x1", "ord")
    new = ~((F.abs(F.col("y1") - F.lag("y1").over(order)) < 5) & (F.col("x1") - F.lag("x2").over(order) < gap))
    cells = blocks.withColumn("new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("cell", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cells.groupBy(*PAGE, "cell").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.count("*").alias("n"))


def x_histogram(blocks: DataFrame, width: int = 20) -> DataFrame:
    """The two fullest bins of x1 by page; the bin seen first wins ties."""
    bins = blocks.groupBy(*PAGE, F.floor(F.col("x1") / width).alias("bin")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("n"), "first"))
    return bins.withColumn("rank", rank).where("rank <= 2").select(*PAGE, "rank", "bin", "n")


def column_split(blocks: DataFrame, default: int = 300, width: int = 20, narrowest: int = 0) -> DataFrame:
    """x between two columns: midway between the two fullest bins if they are four bins apart and both sides hold 15 %; else the largest balanced gap of x1, else the default."""
    blocks = blocks.where(F.col("x2") - F.col("x1") >= narrowest)
    top = x_histogram(blocks, width).groupBy(*PAGE).agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.count("*").alias("k"))
    mid = F.when((F.col("k") == 2) & (F.col("high") - F.col("low") >= 4), F.floor((F.col("low") + F.col("high") + 1) * width / 2))
    sided = blocks.join(top.select(*PAGE, mid.alias("mid")), PAGE).groupBy(*PAGE, "mid").agg(F.count_if(F.col("x1") < F.col("mid")).alias("left"), F.count("*").alias("all"))
    fair = F.when((F.col("left") * 100 >= 15 * F.col("all")) & ((F.col("all") - F.col("left")) * 100 >= 15 * F.col("all")), F.col("mid"))
    order = Window.partitionBy(*PAGE).orderBy("x1", "ord")
    gaps = blocks.withColumn("rn", F.row_number().over(order)).withColumn("all", F.count("*").over(Window.partitionBy(*PAGE))).withColumn("next", F.lead("x1").over(order))
    inner = gaps.where("rn * 100 >= 15 * `all` and rn * 100 <= 85 * `all` and next > x1")
    best = inner.groupBy(*PAGE).agg(F.max(F.struct((F.col("next") - F.col("x1")).alias("gap"), (-F.col("x1")).alias("k"))).alias("m"))
    return sided.join(best, PAGE, "left").select(*PAGE, F.coalesce(fair, F.floor(-F.col("m.k") + F.col("m.gap") / 2), F.lit(default)).cast("long").alias("split"))


def split_pages(blocks: DataFrame, *columns: str, default: int = 300, width: int = 20, narrowest: int = 0) -> DataFrame:
    """Pages with their ``column_split`` as split and the named columns of their blocks as one array, rows. The blocks come together once, bin by bin and then page by page, so nothing is joined."""
    wide = F.col("x2") - F.col("x1") >= narrowest
    row = F.struct("x1", "ord", F.coalesce(wide, F.lit(False)).alias("wide"), F.struct(*columns).alias("c"))
    bins = blocks.groupBy(*PAGE, F.floor(F.col("x1") / width).alias("bin")).agg(F.count_if(wide).alias("n"), F.min(F.when(wide, F.col("ord"))).alias("first"), F.collect_list(row).alias("rows"))
    pages = bins.groupBy(*PAGE).agg(F.sum("n").alias("all"), F.collect_list(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("k"), "first", "bin"))).alias("bins"), F.flatten(F.collect_list("rows")).alias("rows")).where("`all` > 0")
    top = pages.withColumn("top", F.transform(F.slice(F.sort_array("bins"), 1, 2), lambda b: b["bin"])).withColumn("low", F.array_min("top")).withColumn("high", F.array_max("top"))
    mids = top.withColumn("mid", F.when((F.size("top") == 2) & (F.col("high") - F.col("low") >= 4), F.floor((F.col("low") + F.col("high") + 1) * width / 2)))
    sided = mids.withColumn("left", F.when(F.col("mid").isNotNull(), F.size(F.filter("rows", lambda r: r["wide"] & (r["x1"] < F.col("mid"))))))
    fair = F.when((F.col("left") * 100 >= 15 * F.col("all")) & ((F.col("all") - F.col("left")) * 100 >= 15 * F.col("all")), F.col("mid"))
    placed = F.sort_array(F.transform(F.filter("rows", lambda r: r["wide"]), lambda r: F.struct(r["x1"].alias("x1"), r["ord"].alias("ord"))))
    gap = lambda w, r, i: F.when(((i + 1) * 100 >= 15 * F.col("all")) & ((i + 1) * 100 <= 85 * F.col("all")) & (F.get(w, i + 1)["x1"] > r["x1"]), F.struct((F.get(w, i + 1)["x1"] - r["x1"]).alias("gap"), (-r["x1"]).alias("k")))
    best = F.get(F.transform(F.array(placed), lambda w: F.array_max(F.transform(w, lambda r, i: gap(w, r, i)))), F.lit(0))
    # only pages without two full bins look for their gaps
    middle = F.get(F.transform(F.array(best), lambda m: F.floor(-m["k"] + m["gap"] / 2)), F.lit(0))
    return sided.select(*PAGE, F.coalesce(fair, middle, F.lit(default)).cast("long").alias("split"), F.transform("rows", lambda r: r["c"]).alias("rows"))


def cells_in(rows: Column, gap: int = 20) -> Column:
    """The cells of ``cell_texts`` that one column's blocks make (y1, ord, y2, conf_pct, text; all longs and a string), as an array fold: y1, y2, conf_pct, ord and text of each. Only the cell that is open runs along."""
    opened = "cast(array() as array<struct<y1: bigint, y2: bigint, conf_pct: bigint, ord: bigint, texts: array<string>>>)"
    start = F.struct(F.lit(None).cast("long").alias("low"), F.expr(opened).alias("open"), F.expr(opened).alias("out"))
    cell = lambda b: F.struct(b["y1"].alias("y1"), b["y2"].alias("y2"), b["conf_pct"].alias("conf_pct"), b["ord"].alias("ord"), F.array(F.trim(b["text"])).alias("texts"))

    def step(a: Column, b: Column) -> Column:
        more = lambda c: F.struct(F.least(c["y1"], b["y1"]).alias("y1"), F.greatest(c["y2"], b["y2"]).alias("y2"), F.least(c["conf_pct"], b["conf_pct"]).alias("conf_pct"), c["ord"].alias("ord"), F.concat(c["texts"], F.array(F.trim(b["text"]))).alias("texts"))
        low = F.greatest(a["low"], b["y2"]).alias("low")
        # a block within the gap of the lowest end so far goes to the open cell, any other one closes it
        return F.when(b["y1"] - a["low"] <= gap, F.struct(low, F.transform(a["open"], more).alias("open"), a["out"].alias("out"))).otherwise(F.struct(low, F.array(cell(b)).alias("open"), F.concat(a["out"], a["open"]).alias("out")))

    done = F.aggregate(F.sort_array(F.transform(rows, lambda b: F.struct(*[b[c].alias(c) for c in ("y1", "ord", "y2", "conf_pct", "text")]))), start, step, lambda a: F.concat(a["out"], a["open"]))
    return F.transform(done, lambda c: F.struct(*[c[x].alias(x) for x in ("y1", "y2", "conf_pct", "ord")], F.array_join(c["texts"], " ").alias("text")))


def reading_order(regions: DataFrame) -> DataFrame:
    """Regions numbered from the top, then from the left."""
    return regions.withColumn("reading_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y1", "x1", "x2", "y2")) - 1)


def page_markup(regions: DataFrame) -> DataFrame:
    """Region tags with boxes in (y1, x1) order, one a line. Regions with a text or a confidence (conf_pct) show them; blank lines go."""
    box = F.format_string(" bbox=\"%d,%d,%d,%d\"", "x1", "y1", "x2", "y2")
    sure = F.coalesce(F.concat(F.lit(' conf="'), F.col("conf_pct").cast("string"), F.lit('"')), F.lit("")) if "conf_pct" in regions.columns else F.lit("")
    head = F.concat(F.lit("<"), "region_type", box, sure)
    inner = F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n") if "text" in regions.columns else F.lit("")
    tag = F.when(F.coalesce(inner, F.lit("")) == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">\n"), inner, F.lit("\n</"), F.col("region_type"), F.lit(">")))
    return regions.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y1", "x1", tag.alias("t")))), lambda x: x["t"]), "\n").alias("markup"))


def grid(blocks: DataFrame, x_tolerance: int = 20, y_tolerance: int = 12) -> DataFrame:
    """Rows by ``cluster_lines``; columns are the clusters that the same fold makes of x1, each known by its mean as a whole number. A block goes to the
    column of the nearest such number, the first of several, which need not be the cluster it was counted in. The texts of each (row,
    column) from top to bottom and left to right, and the mean x1 and y1. A page's blocks are brought together once, as one array, and both folds go over it."""
    pages = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y1", "ord", "x1", "text"))).alias("b"))
    across = F.array_sort(F.transform("b", lambda b: F.struct(b["x1"].alias("at"), b["ord"].alias("ord"))))
    folded = pages.withColumn("rows", _line_numbers(F.transform("b", lambda b: b["y1"]), y_tolerance)).withColumn("columns", _line_means(F.transform(across, lambda b: b["at"]), x_tolerance))
    nearest = lambda b: F.array_min(F.transform("columns", lambda c, k: F.struct(F.abs(b["x1"] - c).alias("far"), (k + 1).alias("line"))))["line"]
    cells = F.transform("b", lambda b, k: F.struct(F.get(F.col("rows"), k).alias("row"), nearest(b).alias("column"), *[b[c].alias(c) for c in ("y1", "x1", "ord", "text")]))
    texts = F.sort_array(F.collect_list(F.struct("y1", "x1", "ord", "text")))
    return folded.select(*PAGE, F.inline(cells)).groupBy(*PAGE, "row", "column").agg(
        F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("cell_text"), F.avg("x1").alias("x"), F.avg("y1").alias("y")
    )
