"""Operators over pages and files against plain loops."""

import random

from conftest import DATA
from pyspark.sql import functions as F

from docfields.catalog import QUERIES
from docfields.operators import composite as C
from docfields.operators import spatial as P
from docfields.sources import io

BOXES = "doc_id long, page_no long, ord long, x1 long, y1 long, x2 long, y2 long, text string"


def page_blocks(rng, page, n):
    return [(1, page, i, x, y, x + rng.randint(0, 90), y + rng.randint(0, 250), rng.choice(["clause 1.2", "2.3 or 2.1", "bank", "x", "", None])) for i in range(n) for x, y in [(rng.randint(-200, 600), rng.randint(-300, 600))]]


def test_context_and_neighbours(spark):
    rng = random.Random(3)
    rows = [b for page in range(6) for b in page_blocks(rng, page, [1, 2, 15, 60, 60, 60][page])]
    blocks = spark.createDataFrame(rows, BOXES)
    above = {(r.page_no, r.ord): (r.context_ord, r.context) for r in P.context_above(blocks, blocks, C.CLAUSES).collect()}
    below = {(r.page_no, r.ord): (r.context_ord, r.context) for r in P.context_below(blocks, blocks, "bank", 4).collect()}
    near = {(r.page_no, r.ord): (r.match_ord, r.distance) for r in P.nearest_block(blocks, blocks).collect()}
    inside = {(r.page_no, r.ord, r.region_ord) for r in P.contained_pairs(blocks, blocks).collect()}
    for _, page, i, x1, y1, x2, y2, _ in rows:
        others = [b for b in rows if b[1] == page]
        best = max((b for b in others if b[6] < y1 and b[7] and ("1.2" in b[7] or "2.3" in b[7])), key=lambda b: (b[6], -b[2]), default=None)
        assert above.pop((page, i)) == ((best[2], best[7].split()[1] if "clause" in best[7] else "2.3") if best else (None, None))
        hit = next((b for b in sorted((b for b in others if b[4] > y2), key=lambda b: (b[4], b[2]))[:4] if b[7] == "bank"), None)
        assert below.pop((page, i)) == ((hit[2], "bank") if hit else (None, None))
        found = []
        for b in others:
            dx, dy = b[3] + b[5] - x1 - x2, b[4] + b[6] - y1 - y2
            if b[2] != i and ((b[3] >= x2 and abs(dy) < 60) or (b[4] >= y2 and abs(dx) < 300)) and dx * dx + dy * dy < 90000:
                found.append((dx * dx + dy * dy, b[2]))
            cx, cy = x1 + x2, y1 + y2
            centre = 2 * b[3] <= cx <= 2 * b[5] and 2 * b[4] <= cy <= 2 * b[6]
            shared, area = max(0, min(x2, b[5]) - max(x1, b[3])) * max(0, min(y2, b[6]) - max(y1, b[4])), (x2 - x1) * (y2 - y1)
            assert ((page, i, b[2]) in inside) == (centre or (area > 0 and 2 * shared >= area))
        assert near.pop((page, i), None) == ((min(found)[1], min(found)[0]) if found else None)
    assert not above and not below and not near


def test_large_page(spark):
    """Thirty thousand blocks on one page: no product of the page."""
    blocks = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("page_no"), F.col("id").alias("ord"), (F.col("id") % 100 * 100).alias("x1"), F.floor(F.col("id") / 100).alias("y1")).select("*", (F.col("x1") + 50).alias("x2"), (F.col("y1") * 40).alias("y")).select("doc_id", "page_no", "ord", "x1", F.col("y").alias("y1"), "x2", (F.col("y") + 10).alias("y2"), F.lit("bank").alias("text"))
    assert P.context_below(blocks, blocks, "bank").where("context_ord = ord div 100 * 100 + 100").count() == 29_900
    assert P.nearest_block(blocks, blocks).where("match_ord = ord + 100").count() == 29_900
    assert P.contained_pairs(blocks, blocks).count() == 30_000


def test_line_table_function(spark):
    rng = random.Random(9)
    blocks = spark.createDataFrame([b for page in range(5) for b in page_blocks(rng, page, 40)], BOXES)
    lines = lambda df: sorted((r.page_no, r.ord, r.line) for r in df.collect())
    assert lines(C.line_udtf(blocks, 9)) == lines(P.cluster_lines(blocks, 9))
    assert C.line_udtf(blocks.limit(0)).count() == 0


def test_files(spark, tmp_path):
    for name, content in {"a.pdf": b"%PDF-1.7 x", "b/c.xlsx": b"PK\x03\x04 y", "d.txt": b"text", "f.pdf": b"%PDF" + b"x" * 500}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    files = io.read_files(spark, f"file://{tmp_path}/in", 400)
    assert files.where("length > 400").first().content is None
    checked = io.check_documents(files.union(spark.createDataFrame([("/in/e.pdf", 0, None)], files.schema)), 400)
    io.route_files(checked, f"file://{tmp_path}/out")
    name = F.substring_index("path", "/in/", -1).alias("name")
    valid, rejected = (spark.read.parquet(f"file://{tmp_path}/out/outcome={x}").select(name, "kind", "reason", "content").collect() for x in ("valid", "rejected"))
    assert {(r.name, r.kind, bytes(r.content)) for r in valid} == {("a.pdf", "pdf", b"%PDF-1.7 x"), ("b/c.xlsx", "excel", b"PK\x03\x04 y")}
    assert {(r.name, r.reason, r.content) for r in rejected} == {("d.txt", "not_document", None), ("e.pdf", "empty", None), ("f.pdf", "too_large", None)}
    typed = spark.createDataFrame([(b"hello", "Application/PDF"), (b"hello", "application/vnd.openxmlformats-officedocument"), (b"hello", None), (None, "x/pdf")], "content binary, content_type string").withColumn("length", F.length("content"))
    assert [(r.kind, r.reason) for r in io.check_documents(typed).collect()] == [("pdf", "ok"), ("excel", "ok"), (None, "not_document"), ("pdf", "empty")]


def test_form_candidates(spark):
    rows = [
        ("EMD Detail", 0, 0, 90), ("7", 400, 2, 90), ("Bid Validity", 0, 40, 80), ("(Days)", 0, 55, 60), ("90", 400, 42, 70), ("Bid Validity (Days): 60", 0, 100, 50), ("", 400, 100, 90), (None, 400, 140, 90),
        ("दिन/Payment Terms - 30 days", 0, 200, 100), ("Payment Terms " + "x" * 200, 0, 260, 100), (":", 0, 300, 100), ("nothing", 400, 301, 100),
    ]
    blocks = spark.createDataFrame([(1, 1, i, x, y, x + 300, y + 10, c, t) for i, (t, x, y, c) in enumerate(rows)], "doc_id long, page_no long, ord long, x1 long, y1 long, x2 long, y2 long, conf_pct long, text string")
    anchors = {"validity": ("Bid Validity (Days)", "Validity"), "payment": ("Payment Terms",), "emd": ("EMD Detail",)}
    read = lambda df: sorted((r.ord, r.field_name, r.value, r.way, r.conf_pct) for r in df.collect())
    wanted = [
        (2, "validity", "90", "pair", 60.0), (5, "validity", "(Days): 60", "suffix", 42.5), (5, "validity", "60", "colon", 50.0), (5, "validity", "60", "suffix", 42.5), (8, "payment", "30 days", "suffix", 85.0),
    ]
    assert read(C.form_candidates(blocks, anchors, ("EMD Detail",))) == sorted(wanted)
    assert (0, "emd", "7", "pair", 90.0) in read(C.form_candidates(blocks, anchors))
    assert read(C.form_candidates(blocks.limit(0), anchors, ("EMD Detail",))) == []


def test_views_are_dealt_out_by_document_once(spark, monkeypatch):
    import re

    from conftest import DATA
    from docfields.plans import fixtures as X

    shuffles = lambda df: len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))
    monkeypatch.setattr(X, "DEALT_ROWS", {"lineitem": 1000, "orders": 100})
    for name, (_, _, _) in X.DEALT.items():
        plain = spark.sql(X.VIEWS[name], **{x: X.table(spark, DATA, x) for x in re.findall(r"\{([a-z]\w*)\}", X.VIEWS[name])})
        dealt = X.view(spark, DATA, name)
        assert plain.schema.names == dealt.schema.names and plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty()
        assert shuffles(dealt) == 1 and dealt.rdd.getNumPartitions() > 4
    blocks = X.view(spark, DATA, "blocks")
    for found in (P.segments(blocks), P.merge_cells(blocks), P.words_to_cells(blocks), P.detect_tables(blocks), P.context_below(blocks.where("is_header"), blocks, "N [0-9]", 3).where("ord = 1")):
        assert shuffles(found) <= 2


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_line_table_function_is_dealt_once(spark):
    """The function's blocks come as one window has them; with PARTITION BY in the argument they were shuffled again, a Python call a block."""
    from conftest import DATA
    from docfields.plans import fixtures as X

    assert exchanges(C.line_udtf(X.view(spark, DATA, "blocks"))) == 1
    long = spark.range(25_000).selectExpr("1L as doc_id", "1L as page_no", "id as ord", "id * 13 as y1")  # several batches: a line goes on in the next one
    assert C.line_udtf(long, 13).where("line = 1 + ord div 2").count() == 25_000


def test_grid_brings_a_page_together_once(spark):
    from conftest import DATA
    from docfields.plans import fixtures as X

    found = P.grid(X.view(spark, DATA, "blocks"))
    assert exchanges(found) == 1 and "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_field_candidates_read_anchors_once(spark):
    from conftest import DATA
    from docfields.catalog import QUERIES

    assert QUERIES["x14_field_candidates"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_few_rows_a_partition():
    from docfields.plans import fixtures as X

    assert X.DEALT_ROWS["lineitem"] <= 50_000 and X.DEALT_ROWS["orders"] <= 5_000  # a task's sorts hold about 2.5 kB a row


def test_lines_of_is_cluster_lines_with_texts(spark):
    rng = random.Random(16)
    blocks = spark.createDataFrame([(k % 3, 1 + k % 2, k, rng.randrange(300), rng.randrange(90), f"t{k}") for k in range(120)], "doc_id long, page_no long, ord long, x1 long, y1 long, text string")
    found = {(r.doc_id, r.page_no, c.ord): (r.line, c.text) for r in P.lines_of(blocks, ("ord", "text")).collect() for c in r.cells}
    assert found == {(r.doc_id, r.page_no, r.ord): (r.line, f"t{r.ord}") for r in P.cluster_lines(blocks).collect()}


def test_schedule_records_join_nothing(spark):
    """Spark takes the blocks that a view makes of an order for few rows, so a join would broadcast them all through the driver."""
    plan = QUERIES["x16_schedule_records"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_part_amounts_join_once_and_broadcast_nothing(spark):
    plan = QUERIES["x17_part_amounts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("Join") == 1 and "Broadcast" not in plan


def test_part_amounts_of_clauses_are_those_of_each(spark):
    rng = random.Random(17)
    rows = [(1, p, i, x, y, x + 60, y + 8, rng.choice(["see 1.2", "2.3", "Part 1 value 7 Lakh", "part-2 executed 5 Cr", "working capital", "a  bank", None])) for p in range(8) for i in range(40) for x, y in [(rng.randrange(300), rng.randrange(400))]]
    blocks = spark.createDataFrame(rows, BOXES)
    tables = spark.createDataFrame([(1, p, n, 0, y, 400, y + 90) for p in range(8) for n, y in enumerate((0, 60, 250))], BOXES.replace(", text string", ""))
    clauses = [("1.2", ("executed", "value"), False), ("2.3", ("working", "capital"), True)]
    both = [tuple(r) for r in C.clause_part_amounts(blocks, tables, clauses).collect()]
    each = [(*r[:3], c[0], *r[3:]) for c in clauses for r in C.part_amounts(blocks, tables, *c).collect()]
    assert sorted(both, key=str) == sorted(each, key=str) and any(r[-1] for r in both)


def test_form_pages_are_split_and_celled_as_rows_are(spark):
    """Arrays of a page's blocks give what column_split, cell_texts and mutual_pairs give by windows and joins."""
    rng = random.Random(15)
    rows = []
    for page in range(60):
        xs = [rng.choice([[0, 400], [0, 30], [0, 200, 210, 500], list(range(0, 600, 37))])][0]
        for i in range(rng.choice([1, 2, 7, 40])):
            x, y = rng.choice(xs) + rng.randrange(3), rng.randrange(0, 700)
            rows.append((page, 1, i, x, y, x + rng.choice([-5, 40, 90]), y + rng.randint(0, 30), rng.randrange(50, 100), rng.choice([" a", "b ", "c: d", None])))
    blocks = spark.createDataFrame(rows, "doc_id long, page_no long, ord long, x1 long, y1 long, x2 long, y2 long, conf_pct long, text string")
    pages = P.split_pages(blocks, "y1", "ord", "y2", "conf_pct", "text", "x1")
    assert {(r.doc_id, r.split) for r in pages.collect()} == {(r.doc_id, r.split) for r in P.column_split(blocks).collect()}
    side = lambda keeps: P.cells_in(F.filter("rows", keeps))
    celled = pages.select("doc_id", "page_no", side(lambda r: r["x1"] < F.col("split")).alias("a"), side(lambda r: r["x1"] >= F.col("split")).alias("b"))
    cells = P.cell_texts(blocks.join(P.column_split(blocks), ["doc_id", "page_no"]).withColumn("col", (F.col("x1") >= F.col("split")).cast("int")))
    found = {(r.doc_id, k, *c) for r in celled.collect() for k in "ab" for c in r[k]}
    assert found == {(r.doc_id, "ab"[r.col], r.y1, r.y2, r.conf_pct, r.ord, r.text) for r in cells.collect()}
    named = ("doc_id", "a_ord", "b_ord", "overlap", "a_text", "b_text")
    both = [sorted((tuple(r[c] for c in named) for r in df.collect()), key=str) for df in (P.mutual_cells(celled, ("text",)), P.mutual_pairs(cells.where("col = 0"), cells.where("col = 1"), ("text",)))]
    assert both[0] == both[1] and both[0]


def test_form_candidates_read_blocks_twice_and_join_nothing(spark):
    plan = QUERIES["x15_form_candidates"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 2
