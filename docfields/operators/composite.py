"""Candidates and records that several spatial operators make together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions import scalars as S
from docfields.operators import rules as Ru
from docfields.operators import spatial as P

BLOCK = [*P.PAGE, "ord"]


def anchored_candidates(blocks: DataFrame) -> DataFrame:
    """A value block for each anchor (is_header): right of it on its line, else the next in order, else the nearest; with the path's score."""
    line = Window.partitionBy(*P.PAGE, "line_no").orderBy("x1", "ord")
    anchors = blocks.where("is_header")
    row = blocks.withColumn("match_ord", F.lead("ord").over(line)).where("is_header and match_ord is not null").select(*P.PAGE, "ord", "match_ord", F.lit("row").alias("path"), F.lit(95).alias("score"), F.lit(0).alias("p"))
    after = P.adjacent_rows(blocks, 20).join(anchors.select(*P.PAGE, "ord"), BLOCK, "left_semi").select(*BLOCK, F.col("next_ord").alias("match_ord"), F.lit("next").alias("path"), F.lit(85).alias("score"), F.lit(1).alias("p"))
    near = P.nearest_block(anchors, blocks).select(*P.PAGE, "ord", "match_ord", F.lit("near").alias("path"), F.lit(80).alias("score"), F.lit(2).alias("p"))
    every = row.unionByName(after).unionByName(near)
    return every.groupBy(*BLOCK).agg(F.min_by(F.struct("match_ord", "path", "score"), "p").alias("b")).select(*BLOCK, "b.*")


#: What a rule's anchor in a block is worth in percent, and what the way to its value adds.
ANCHOR, BY_SCRIPT = 35, 40
WAYS = {"row": 60, "same": 60, "next": 50, "near": 50}


def field_candidates(blocks: DataFrame, rules: list[tuple[str, tuple[str, ...], tuple[str, ...], str]], gap: int = 50) -> DataFrame:
    """Values of rules (field_name, anchors, anchors in the other script, type) on pages: a row for each rule and block that holds its anchor.

    The value is of the first way that gives one of the rule's type: the rest of the block's line, left to right; the block's own text, if the
    value is not all of it; the next block in order, if it begins within ``gap``; the nearest block right or below whose text has one. Columns
    doc_id, page_no, ord, field_name, value, path and conf_pct, 100 at most. The rules are the program's, so no join brings them."""
    line = Window.partitionBy(*P.PAGE, "line_no")
    page = Window.partitionBy(*P.PAGE).orderBy("ord")
    beside = F.filter(F.array_sort(F.collect_list(F.struct("x1", "ord", "text")).over(line)), lambda b: b["ord"] != F.col("ord"))
    rest = F.array_join(F.transform(beside, lambda b: F.trim(b["text"])), " ")
    following = F.when(F.abs(F.lead("y1").over(page) - F.col("y2")) < gap, F.lead("text").over(page))
    held = blocks.select(*BLOCK, "x1", "y1", "x2", "y2", "text", rest.alias("rest"), following.alias("following"), S.match_normalize(F.col("text")).alias("plain"))
    any_of = lambda anchors: F.col("plain").rlike("|".join(Ru.anchor_pattern(a) for a in anchors)) if anchors else F.lit(False)
    hits = [F.when(any_of(script), BY_SCRIPT).when(any_of(anchors), ANCHOR) for _, anchors, script, _ in rules]
    matched = F.filter(F.array(*[F.struct(F.lit(name).alias("field_name"), F.lit(kind).alias("kind"), hit.alias("anchor")) for (name, _, _, kind), hit in zip(rules, hits)]), lambda r: r["anchor"].isNotNull())
    anchored = held.select("*", F.explode(matched).alias("r")).select(*held.columns, "r.*")
    kinds = sorted({kind for *_, kind in rules})
    typed = lambda text: F.coalesce(*[F.when(F.col("kind") == kind, Ru.typed(text, kind)) for kind in kinds])
    # way by way, each value a column of its own: every use of an expression would type the text anew
    read = anchored.withColumn("row", typed(F.col("rest"))).withColumn("own", F.when(F.col("row").isNull(), typed(F.col("text")))).withColumn("same", F.when(F.col("own") != F.trim("text"), F.col("own")))
    read = read.withColumn("next", F.when(F.col("row").isNull() & F.col("same").isNull(), typed(F.col("following"))))
    first = F.coalesce(*[F.when(F.col(way).isNotNull(), F.struct(F.lit(way).alias("path"), F.col(way).alias("value"))) for way in ("row", "same", "next")])
    # every anchor is read once: those without a value meet their page's blocks, the others go through the same join without a partner
    read = read.withColumn("found", first).withColumn("once", F.when(F.col("found").isNotNull(), F.monotonically_increasing_id()))
    every = _or_nearest_typed(read, blocks, typed)
    worth = F.create_map(*[F.lit(x) for kv in WAYS.items() for x in kv])[F.col("path")]
    return every.withColumn("conf_pct", F.least(F.lit(100), F.col("anchor") + worth)).drop("anchor")


def _or_nearest_typed(anchors: DataFrame, blocks: DataFrame, typed, reach: int = 150) -> DataFrame:
    """Anchors with the value that was found (path, value), else that of the nearest block right of or below them that has one of their type; without either they go."""
    b = blocks.select(*[F.col(c).alias(f"b_{c}") for c in (*P.PAGE, "ord", "x1", "y1", "x2", "y2")], F.col("text").alias("b_text"))
    dx = F.col("b_x1") + F.col("b_x2") - F.col("x1") - F.col("x2")
    dy = F.col("b_y1") + F.col("b_y2") - F.col("y1") - F.col("y2")
    beside = ((F.col("b_x1") >= F.col("x2")) & (F.abs(dy) < 60)) | ((F.col("b_y1") >= F.col("y2")) & (F.abs(dx) < 300))
    page = (F.col("doc_id") == F.col("b_doc_id")) & (F.col("page_no") == F.col("b_page_no"))
    pairs = anchors.join(b, page & F.col("found").isNull() & (F.col("ord") != F.col("b_ord")) & beside & (dx * dx + dy * dy < 4 * reach * reach), "left")
    valued = pairs.withColumn("v", F.when(F.col("b_ord").isNotNull(), typed(F.col("b_text")))).where("found is not null or v is not null")
    best = valued.groupBy(*BLOCK, "field_name", "anchor", "found", "once").agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "b_ord", "v")).alias("m"))
    return best.select(*BLOCK, "field_name", F.coalesce("found.value", "m.v").alias("value"), F.coalesce("found.path", F.lit("near")).alias("path"), "anchor")


def kv_candidates(docs: DataFrame, most: int = 200) -> DataFrame:
    """Label and value of each line with a colon; long values go."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.contains("line", F.lit(":")))
    label, value = F.trim(F.regexp_extract("line", "^([^:]*):(.*)$", 1)), F.trim(F.regexp_extract("line", "^([^:]*):(.*)$", 2))
    return lines.select("doc_id", "line_no", label.alias("label"), value.alias("value")).where((F.length("label") > 0) & F.length("value").between(1, most - 1))


def form_candidates(blocks: DataFrame, anchors: dict[str, tuple[str, ...]], headers: tuple[str, ...] = (), least: int = 80, gap: int = 20, most: int = 200) -> DataFrame:
    """Labelled values of forms: a row for each label that is like an anchor of a field, with what it labels.

    Ways: colon, a block's text before and behind its first colon; suffix, what follows an anchor inside a block, of less than ``most`` characters (confidence 85 percent of the
    block's); pair, the cells left and right of the page's column split that are each other's largest overlap in y. A label's anchor is that of the best ``rules.partial_ratio``, ``least`` or more, of several the first named. A left cell like a header (score 85)
    is no label. Confidence is the least one of the blocks times the score. Columns doc_id, page_no, ord (of the label), field_name, value, way, conf_pct.

    Anchors and headers are the program's, so no join brings them. The left cells of a page meet its right cells; a null or blank text, label or value gives nothing. Without blocks of a page there is no row."""
    named = [(phrase.lower(), field) for field, phrases in anchors.items() for phrase in phrases]
    low = F.lower("text")
    rest = lambda phrase: F.trim(F.regexp_replace(F.substring(F.col("text"), F.locate(phrase, low) + len(phrase), F.length("text")), r"^[:\-/\s\x{0900}-\x{097F}]+", ""))
    none = F.lit(None).cast("string")
    # what blocks say by themselves: behind a colon, behind an anchor
    colon = F.when(F.contains("text", F.lit(":")), F.struct(none.alias("field_name"), F.trim(F.substring_index("text", ":", 1)).alias("label"), F.trim(F.regexp_replace("text", r"^[^:]*:", "")).alias("value"), F.lit("colon").alias("way")))
    suffixes = [F.when(F.contains(low, F.lit(phrase)), F.struct(F.lit(field).alias("field_name"), none.alias("label"), rest(phrase).alias("value"), F.lit("suffix").alias("way"))) for phrase, field in named]
    said = F.filter(F.array_distinct(F.array(colon, *suffixes)), lambda x: x.isNotNull() & (x["value"] != "") & ((x["way"] == "colon") | (F.length(x["value"]) < most)))
    own = blocks.select(*BLOCK, "conf_pct", F.inline(said))
    # the blocks come together page by page once, for the split, the cells and the pairs
    pages = P.split_pages(blocks.withColumns({c: F.col(c).cast("long") for c in ("y1", "y2", "conf_pct", "ord")}), "y1", "ord", "y2", "conf_pct", "text", "x1")
    side = lambda keeps: P.cells_in(F.filter("rows", keeps), gap)
    celled = pages.select(*P.PAGE, side(lambda r: r["x1"] < F.col("split")).alias("a"), side(lambda r: r["x1"] >= F.col("split")).alias("b"))
    pairs = P.mutual_cells(celled, ("text", "conf_pct"))
    pair = pairs.select(*P.PAGE, F.col("a_ord").alias("ord"), F.least("a_conf_pct", "b_conf_pct").alias("conf_pct"), none.alias("field_name"), F.col("a_text").alias("label"), F.trim("b_text").alias("value"), F.lit("pair").alias("way"))

    every = own.unionByName(pair.where("value != ''")).withColumn("t", F.trim(F.regexp_replace(F.lower("label"), r"[\x{0900}-\x{097F}]+", " "))).where("t != '' or way = 'suffix'")
    # a phrase is scored only against labels that may be like it, and once a label: the best one is a row of its own, or each use would score anew
    scores = [F.when(Ru.may_be_like(F.col("t"), phrase, least), F.struct(Ru.partial_ratio(F.col("t"), F.lit(phrase), least).alias("score"), F.lit(-k).alias("rank"), F.lit(field).alias("field_name"))) for k, (phrase, field) in enumerate(named)]
    for h in headers:
        like = F.when(Ru.may_be_like(F.col("t"), h.lower(), 85), Ru.partial_ratio(F.col("t"), F.lit(h.lower()), 85).isNotNull()).otherwise(False)
        every = every.where((F.col("way") != "pair") | ~like)
    by_anchor = F.array(F.struct(F.lit(85).cast("long").alias("score"), F.lit(0).alias("rank"), F.col("field_name")))
    best = F.when(F.col("way") == "suffix", by_anchor).otherwise(F.filter(F.array(F.array_max(F.array(*scores))), lambda b: b["score"] >= least))
    read = every.select(*BLOCK, "value", "way", "conf_pct", F.explode(best).alias("b"))
    return read.select(*BLOCK, "b.field_name", "value", "way", (F.col("conf_pct") * F.col("b.score") / 100).alias("conf_pct"))


def schedules(blocks: DataFrame) -> DataFrame:
    """A record for each header segment: its blocks as a map from ordinal to text, and their number."""
    rows = P.segments(blocks).join(blocks.select(*BLOCK, "text"), BLOCK)
    entries = F.sort_array(F.collect_list(F.struct("ord", "text")))
    return rows.groupBy(*P.PAGE, "segment").agg(F.map_from_entries(entries).alias("specs"), F.count("*").alias("n"))


# fixed values: words that make a column's role, rows that are specifications, items and ends of tables
ROLES = {"consignee_name": r"consignee|reporting|officer", "consignee_address": r"address|पता", "quantity": r"quantity|मात्रा", "delivery_days": r"delivery|days"}
SPECIFICATION = r"battery capacity|nominal battery voltage|battery voltage|capacity at 10-h|voltage|capacity|specification|oem"
NOT_SPECIFICATION = r"dated|schedule|consignee|delivery"
ITEM = r"(?i)^(.{5,120}?)\(\s*(\d+)\s*(?:pieces|piece|pcs|nos|no|qty)?\s*\)"
SCHEDULE = r"(?i)Schedule\s*(\d+)"
TABLE_END = r"total|योग|schedule"


def schedule_records(blocks: DataFrame, tolerance: int = 12) -> DataFrame:
    """Schedules of pages with consignee, quantity, days, item and specifications, out of the lines of their tables.

    A line with a consignee and a quantity or days heads a table: its cells' words are the columns' roles until a line of totals or a schedule. A line
    that names a schedule, or a further item with its number of pieces, begins the next. Of several values the last counts; a number in the item's
    line stands in for a missing quantity. Lines are clustered page by page, with their texts, so nothing is joined; states are windows over them. Columns doc_id, page_no,
    schedule, one for each role, item and specs (name=value in the order of lines)."""
    cells = F.transform(F.sort_array("c"), lambda c: F.trim(c["text"]))
    lines = P.lines_of(blocks, ("x1", "ord", "text"), tolerance, "c").select(*P.PAGE, "line", cells.alias("cells")).withColumn("t", F.array_join("cells", " ")).withColumn("low", F.lower("t"))
    head = F.lower(F.col("cells")[0])
    role_of = lambda c: F.coalesce(*[F.when(F.lower(c).rlike(words), role) for role, words in ROLES.items()])
    several = F.size("cells") >= 2
    heads = F.col("low").rlike(ROLES["consignee_name"]) & (F.col("low").rlike(ROLES["quantity"]) | F.col("low").rlike(ROLES["delivery_days"]))
    spec = several & head.rlike(SPECIFICATION) & ~head.rlike(NOT_SPECIFICATION)
    # patterns of an item and a schedule run once a line, and only where their bracket or word stands
    read = lines.withColumn("number", F.when(F.contains("low", F.lit("schedule")), F.regexp_extract("t", SCHEDULE, 1).try_cast("int")))
    read = read.withColumn("item0", F.when(F.col("number").isNull() & F.contains("t", F.lit("(")), F.regexp_extract("t", ITEM, 0)))
    kind = F.when(F.col("number").isNotNull(), "schedule").when(F.col("item0") != "", "item").when(spec, "spec").when(heads, "head").when(F.col("low").rlike(TABLE_END), "end").otherwise("body")
    # the end of a table is a head without columns
    roles = F.when(F.col("kind") == "head", F.transform("cells", role_of)).when(F.col("kind").isin("end", "schedule"), F.array().cast("array<string>"))
    told = read.withColumn("kind", kind).withColumn("roles0", roles).withColumn("item", F.when(F.col("kind") == "item", F.col("item0"))).drop("low", "item0")
    order = Window.partitionBy(*P.PAGE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("kind") == "schedule", F.struct("number", "items"))
    placed = told.withColumn("roles", F.last("roles0", ignorenulls=True).over(order)).withColumn("items", F.count("item").over(order)).withColumn("named", F.last(named, ignorenulls=True).over(order))
    # items since the schedule's line, or on the page without one
    further = F.greatest(F.lit(0), F.col("items") - F.coalesce("named.items", F.lit(0)) - 1)
    placed = placed.withColumn("schedule", (F.coalesce("named.number", F.lit(1)) + further).cast("int"))
    value = lambda role: F.when((F.col("kind") == "body") & several, F.get(F.col("cells"), (F.array_position("roles", F.lit(role)) - 1).cast("int")))
    digits = lambda role: F.nullif(F.regexp_replace(role, r"\D", ""), F.lit("")).try_cast("int")
    name = F.trim(F.regexp_replace(F.regexp_replace(F.col("cells")[0], r"^[^a-zA-Z0-9\s]+", ""), r"^[/\\_.:\-]+\s*", ""))
    entry = F.when(F.col("kind") == "spec", F.concat(name, F.lit("="), F.array_join(F.slice("cells", 2, F.size("cells")), " ")))
    found = placed.select(*P.PAGE, "schedule", "line", "item", "t", "kind", entry.alias("entry"), *[value(role).alias(role) for role in ROLES]).where(F.coalesce(*ROLES).isNotNull() | F.col("kind").isin("item", "spec"))
    pieces = F.when(F.col("kind") == "item", F.regexp_extract("t", ITEM, 2).try_cast("int"))
    found = found.select(*P.PAGE, "schedule", "line", "item", pieces.alias("pieces"), "entry", "consignee_name", "consignee_address", digits("quantity").alias("quantity"), digits("delivery_days").alias("delivery_days"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line")))
    return found.groupBy(*P.PAGE, "schedule").agg(
        last("consignee_name").alias("consignee_name"), last("consignee_address").alias("consignee_address"), F.coalesce(last("quantity"), last("pieces")).alias("quantity"), last("delivery_days").alias("delivery_days"),
        last("item").alias("item"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("entry").isNotNull(), F.struct("line", "entry")))), lambda e: e["entry"]), ";").alias("specs"),
    )


def clause_tables(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Texts of the blocks in table regions by the header above them, in bins of ten in y, then in x order."""
    inside = P.contained_blocks(blocks, regions.where("region_type = 'table'")).select(*BLOCK).distinct()
    headed = P.header_above(blocks).where("header_ord is not null")
    rows = blocks.join(inside, BLOCK, "left_semi").join(headed, BLOCK)
    texts = F.sort_array(F.collect_list(F.struct(F.floor(F.col("y1") / 10).alias("bin"), F.col("x1"), F.col("ord"), F.col("text"))))
    return rows.groupBy(*P.PAGE, "header_ord").agg(F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("text"))


# fixed values: clauses of the tables that are read, how a part's amount stands in one, and words of the notes below
CLAUSES = r"\b(1\.2|2\.1|2\.3|2\.2)\b"
PART_AMOUNT = r"(?i)(Part\s*(?:-?\s*\d+|1\s*&\s*2)[\s\S]*?[\d\.]+\s*(?:Lakh|Crore|Cr))"
NOTE = r"(?is)^.*?(?:line of credit|bank).*$"


def part_amounts(blocks: DataFrame, tables: DataFrame, clause: str, words: tuple[str, ...], noted: bool = False) -> DataFrame:
    """``clause_part_amounts`` of one clause: doc_id, page_no, ord, value, note."""
    return clause_part_amounts(blocks, tables, [(clause, words, noted)]).drop("clause")


def clause_part_amounts(blocks: DataFrame, tables: DataFrame, clauses: list[tuple[str, tuple[str, ...], bool]]) -> DataFrame:
    """Amounts of the parts in tables of clauses (number, words, whether a note is wanted): "Part n ... number Lakh, Crore or Cr" in a table's text, joined by "; ", and the note below it if wanted.

    A table belongs to the clause whose number stands closest above it; without a number above, to each clause whose words it has, all of them. Its text is that of the blocks within it, in bins of ten in y (half a bin rounds
    to the even one), then from left to right. Tables are rows (doc_id, page_no, ord, x1, y1, x2, y2). Columns doc_id, page_no, ord, clause, value, note; tables without amounts have no row. A note is what
    one of the ten blocks below says of a line of credit or a bank, with single spaces, 200 characters at most as in the records that it goes to.

    Tables take what stands above and below them along to their blocks, so blocks and tables are joined once, for all clauses."""
    box = ("x1", "y1", "x2", "y2")
    placed = P.context_above(tables, blocks, CLAUSES, carry=box).select(*BLOCK, *box, F.col("context").alias("above"))
    below = F.lit(None).cast("string")
    if any(noted for *_, noted in clauses):
        placed = P.context_below(placed, blocks, NOTE, carry=(*box, "above"))
        below = F.left(F.trim(F.regexp_replace("context", r"\s+", " ")), F.lit(200))
    placed = placed.select(*BLOCK, *box, "above", below.alias("below"))
    held = P.contained_pairs(blocks, placed, ("x1", "y1", "text"), ("above", "below"))
    texts = F.sort_array(F.collect_list(F.struct(F.bround(F.col("y1") / 10).alias("bin"), "x1", "ord", F.trim("text").alias("text"))))
    text = held.groupBy(*P.PAGE, F.col("region_ord").alias("ord")).agg(F.first("region_above").alias("above"), F.first("region_below").alias("below"), F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("text"))
    low = F.lower("text")

    def meant(clause: str, words: tuple[str, ...], noted: bool) -> Column:
        said = F.col("above").isNull()
        for word in words:
            said = said & F.contains(low, F.lit(word))
        note = F.col("below") if noted else F.lit(None).cast("string")
        return F.when((F.col("above") == clause) | said, F.struct(F.lit(clause).alias("clause"), note.alias("note")))

    of = text.select(*BLOCK, "text", F.inline(F.array_compact(F.array(*[meant(*c) for c in clauses]))))
    amounts = F.transform(F.regexp_extract_all("text", F.lit(PART_AMOUNT), 1), lambda m: F.trim(m))
    return of.select(*BLOCK, "clause", F.array_join(amounts, "; ").alias("value"), "note").where("value != ''")


class KeywordWindows:
    """Table function: places of a keyword in a text, overlaps included, and what follows each."""

    def eval(self, text: str, keyword: str, after: int):
        at = text.find(keyword) if text else -1
        while at >= 0:
            yield at + 1, text[at + len(keyword) : at + len(keyword) + after]
            at = text.find(keyword, at + 1)


def keyword_udtf(docs: DataFrame, keyword: str, after: int) -> DataFrame:
    """``KeywordWindows`` by lateral join; ``extract.keyword_windows`` is the form inside the JVM."""
    windows = F.udtf(KeywordWindows, returnType="place int, right string")
    return docs.lateralJoin(windows(F.col("text").outer(), F.lit(keyword), F.lit(after))).select("doc_id", "place", "right")


class LineCluster:
    """Table function over blocks in the order of pages, each page's from k = 1 in (y1, ord) order: a block goes to the line whose mean y1 is within the tolerance, else begins the next line.

    Blocks come in Arrow batches. Only a line's sum and count are held, from batch to batch too, so a page may have any number of blocks."""

    def __init__(self):
        self.total, self.count, self.line = 0, 0, 0

    def eval(self, blocks, tolerance):
        import pyarrow as pa

        most, total, count, line, lines = tolerance[0].as_py(), self.total, self.count, self.line, []
        for k, y in zip(blocks.column("k").to_pylist(), blocks.column("y1").to_pylist()):
            if k == 1:
                count, line = 0, 0
            if count == 0 or abs(y * count - total) > most * count:
                total, count, line = 0, 0, line + 1
            total += y
            count += 1
            lines.append(line)
        self.total, self.count, self.line = total, count, line
        yield pa.table({**{c: blocks.column(c) for c in ("doc_id", "page_no", "ord")}, "line": pa.array(lines, pa.int32())})


def line_udtf(blocks: DataFrame, tolerance: int = 12) -> DataFrame:
    """``LineCluster`` over a table argument; ``spatial.cluster_lines`` is the form inside the JVM, which holds a page as one array.

    The window that numbers a page's blocks brings them together and in order, by document if they are dealt out so; PARTITION BY of the argument would shuffle them again and call Python once a block."""
    lines = F.arrow_udtf(LineCluster, returnType="doc_id long, page_no long, ord long, line int")
    k = F.row_number().over(Window.partitionBy(*P.PAGE).orderBy("y1", "ord"))
    return lines(blocks.select(*P.PAGE, "ord", "y1", k.alias("k")).asTable(), F.lit(tolerance))
