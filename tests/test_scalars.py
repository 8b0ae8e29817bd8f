"""Input and output pairs of the column functions."""

import datetime
import random
import re
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docfields.functions import scalars as S
from docfields.operators import composite as C
from docfields.operators import extract as X
from docfields.operators import resolve as R
from docfields.operators import rules as Ru
from docfields.operators import spatial as P
from docfields.operators import status as St
from docfields.operators import workspace as Wk

PAIRS = [
    (S.parse_money, "Rs. 1,50,000/-", Decimal(150000)), (S.parse_money, "Rs 2.5 Lakh", Decimal(250000)), (S.parse_money, "3.5 Crores", Decimal(35000000)),
    (S.parse_money, "* 1,50,000/-", Decimal(150000)), (S.parse_money, "Not Found", None), (S.parse_money, None, None), (S.currency_text, "15 Lakh (s)", "1500000"),
    (S.currency_text, "₹ 43,000", "43000"), (S.currency_text, " 50,000/- ", "50000"), (S.parse_int, "60 Days", 60), (S.parse_int, "1,50,000", 1),
    (S.parse_decimal, "5.5 percent", Decimal("5.50")), (S.parse_int, "No value", None), (S.parse_datetime, "12-04-2025 14:00:00", datetime.datetime(2025, 4, 12, 14)),
    (S.parse_datetime, "12/04/2025 02:00 PM", datetime.datetime(2025, 4, 12, 14)), (S.split_modes, "Demand Draft or Bank Guarantee", ["DD", "BG"]),
    (S.split_modes, "Random text", ["Random text"]), (S.format_grouped, "19417700", "1,94,17,700"), (S.duration_days, "seven months", 210), (S.duration_days, "2 weeks", 14),
    (S.fraction_rate, "½", Decimal("0.5")), (S.fraction_rate, "1/2", Decimal("0.5")), (S.clean_name, "Shri Anon Person, Manager", "Anon Person"), (S.canonical_key, " Bid Validity (Days)", "bid_validity_days"),
    (S.title_from_filename, "/a/b/Some_File-name.pdf", "Some File name"), (S.normalize_text, "a \n\t b", "a b"), (S.parse_bool, "Not Required", False),
]


@pytest.mark.parametrize("function, value, expected", PAIRS)
def test_pair(spark, function, value, expected):
    df = spark.createDataFrame([(value,)], "c string")
    got = df.select(function(F.col("c")).alias("x")).head()["x"]
    assert got == expected


def occurrences(spark, rows):
    return spark.createDataFrame(rows, "tender_id long, ord long, field_name string, page long, total_pages long, conf_pct long, value_raw string")


def test_best_value(spark):
    df = occurrences(spark, [(1, 1, "tender_value", 1, 16, 80, "A"), (1, 2, "tender_value", 12, 16, 95, "B"), (2, 1, "tender_value", 1, 16, 50, "A"), (2, 2, "tender_value", 1, 16, 50, "B"), (3, 1, "tender_value", 1, 16, 90, "Not Found")])
    found = {r["tender_id"]: r["value"] for r in R.resolve_best(df).collect()}
    assert found == {1: "A", 2: None}


def test_best_value_does_not_depend_on_row_order(spark):
    df = occurrences(spark, [(k % 7, k, "pbg_percentage", k % 16 + 1, 16, 50 + 10 * (k % 5), f"v{k % 3}") for k in range(200)])
    once, again = (sorted(map(tuple, R.resolve_best(x).collect())) for x in (df, df.repartition(7, "ord")))
    assert once == again


def test_lines(spark):
    df = spark.createDataFrame([(1, 1, k, 0, y, 10, y + 5, "t", True) for k, y in enumerate((10, 12, 40))], "doc_id long, page_no long, ord long, x1 long, y1 long, x2 long, y2 long, text string, is_header boolean")
    assert [r["line"] for r in P.cluster_lines(df).orderBy("ord").collect()] == [1, 1, 2]


def test_greedy_pairs_use_each_cell_once(spark):
    cells = lambda rows: spark.createDataFrame([(1, 1, k, a, b) for k, (a, b) in enumerate(rows)], "doc_id long, page_no long, ord long, y1 long, y2 long")
    found = P.greedy_pairs(cells([(100, 140), (200, 220)]), cells([(195, 225), (110, 135)])).collect()
    assert sorted((r["a_ord"], r["b_ord"]) for r in found) == [(0, 1), (1, 0)]


def test_upsert_overwrites_with_nulls_and_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    updates = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    once = St.upsert(target, updates, "k", ["v"]).drop("updated")
    twice = St.upsert(once, updates, "k", ["v"]).drop("updated")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]


def test_contained(spark):
    """Items of any length against ``in``: inside words, of one to several words, repeated, empty and null."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 4)))
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 30)))) for k in range(60)] + [(60, "the cat sat"), (60, "the cat sat"), (61, ""), (62, None)]
    items = [(0, "cat"), (1, ""), (2, None), (3, "c"), (4, "at"), (5, "he cat sa"), (6, "missing"), (7, " "), (8, "cat sat on"), (9, "the cat sat")]
    for k in range(10, 110):
        text = docs[rng.randrange(60)][1]
        a = rng.randrange(len(text) + 1)
        items.append((k, text[a : a + rng.randint(1, 25)]))
    for part in (items, items[9:10], [i for i in items if i[1] and len(i[1].split(" ")) > 4], [(2, None)]):
        found = Ru.contained(spark.createDataFrame(part, "item_id long, v string"), spark.createDataFrame(docs, "doc_id long, t string"))
        assert sorted(map(tuple, found.collect())) == sorted({(i, d) for i, v in part for d, t in docs if v is not None and t is not None and v in t})


@pytest.mark.parametrize("keyword, regex", [(" the", False), ("a", False), ("aa", False), (".+", False), ("[ab]a", True)])
def test_keyword_windows(spark, keyword, regex):
    rng = random.Random(5)
    docs = [(k, "".join(rng.choices(["a", "b", " the", " ", ".+"], k=rng.randint(0, 60)))) for k in range(40)] + [(7, "aa the"), (None, "a.+"), (3, None), (4, "")]
    expected = []
    for d, text in docs:
        for n, m in enumerate(re.finditer(keyword if regex else re.escape(keyword), text or "")):
            expected.append((d, n, m.start() + 1, text[max(0, m.start() - 7) : m.start()], text[m.end() : m.end() + 5]))
    found = X.keyword_windows(spark.createDataFrame(docs, "doc_id long, text string"), keyword, 7, 5, regex).select("doc_id", "n", "place", "left", "right")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_keyword_windows_take_linear_time(spark):
    df = spark.createDataFrame([(1, "ab the cd" * 200_000)], "doc_id long, text string")
    began = time.time()
    X.keyword_windows(df, " the", 20, 20).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 30


def test_orders_of_a_workspace(spark):
    rows = [(1, 5, 10, 80, 3), (2, None, None, None, None), (3, 5, 2, 90, 9), (4, 7, 2, 90, 1)]
    df = spark.createDataFrame(rows, "id long, deadline int, tender_value int, parse_confidence int, updated_at int").repartition(3)
    orders = {by: [r["id"] for r in Wk.ordered(df, by).collect()] for by in ("deadline", "value", "confidence", "updated")}
    assert orders == {"deadline": [1, 3, 4, 2], "value": [1, 3, 4, 2], "confidence": [3, 4, 1, 2], "updated": [3, 1, 4, 2]}


def test_slots_of_contacts(spark):
    """Every document's contacts by a plain loop."""
    rng = random.Random(2)
    names = ["Arun Rao", "Meera Sen", "R. K. Das", "Om", "Sen Gupta"]
    docs, emails = [], []
    for d in range(60):
        docs += [(d, k, n) for k, n in enumerate(rng.sample(names, rng.randint(1, 5)))]
        emails += [(d, k, e) for k, e in enumerate(rng.sample(["arun@x", "sen@y", "info@z", "das.r@q", "gupta.sen@w"], rng.randint(0, 4)))]
    expected = []
    for d in range(60):
        own, taken = [n for i, _, n in docs if i == d][:3], []
        mails = [e for i, _, e in emails if i == d]
        for n in own:
            free = [e for e in mails if e not in taken and any(w in e for w in re.split("[ .]+", n.lower()) if len(w) > 2)]
            taken.append(free[0] if free else None)
        for k, t in enumerate(taken):
            free = [e for e in mails if e not in taken]
            taken[k] = t if t is not None else free[0] if free else None
        row = [x for n, e in zip(own, taken) for x in (n, e)]
        expected.append((d, *row, *[None] * (6 - len(row))))
    found = X.contact_slots(spark.createDataFrame(docs, "doc_id long, n int, name string"), spark.createDataFrame(emails, "doc_id long, n int, email string"))
    assert sorted(map(tuple, found.collect())) == expected


def test_contacts(spark):
    text = "Contact Person: Mr. Arun Rao, Phone: 01123456789, email: a.rao@x.org\nNodal Officer: Dr. Meera Sen Extn: 12-345, Delhi 110001\nConsignee: ARUN\nContact: arun rao, b@y.org\nTender Inviting Authority: Om P\nName of Competent Authority: Narasingha Rao\nDesignation of Competent Authority: CM"
    found = X.contacts(spark.createDataFrame([(1, text), (2, "no one"), (3, None)], "doc_id long, text string")).orderBy("n").collect()
    assert [tuple(r)[2:] for r in found] == [
        ("Arun Rao", "Contact Person", "01123456789", "a.rao@x.org", None), ("Meera Sen", "Nodal Officer", "Extn: 12-345", None, "110001"), ("ARUN", "Consignee", None, None, None),
        ("Om P", "Tender Inviting Authority", None, None, None), ("Narasingha Rao", "Competent Authority", None, None, None),
    ]


def test_plans_have_no_nested_loop(spark):
    from conftest import DATA
    from docfields.catalog import QUERIES

    for name in ("r1_classify_status", "a7_status_rollup", "x12_products", "x19_anchor_check", "x21_exempt_financial", "u2_schema_difference", "u3_out_of_scope", "e1_register_rule"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
    plan = QUERIES["w1_resolve_best"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_pages_of_a_document_stay_apart(spark):
    """Two pages that look alike give each operator's one-page result twice."""
    one = [(1, 1, k, x, y, x + 30, y + 10, f"t{k}", 100, k % 3 == 0, k % 2, y // 12) for k, (x, y) in enumerate([(0, 0), (200, 0), (10, 14), (210, 15), (0, 40), (205, 60)])]
    schema = "doc_id long, page_no long, ord long, x1 long, y1 long, x2 long, y2 long, text string, conf_pct long, is_header boolean, block_no int, line_no int"
    single = spark.createDataFrame(one, schema)
    double = spark.createDataFrame(one + [(1, 2, *r[2:]) for r in one], schema)
    boxes = lambda df: df.where("ord = 0").select("doc_id", "page_no", *[(F.col(c) + 5).alias(c) for c in ("x1", "y1", "x2", "y2")])
    operators = [P.words_to_lines, P.detect_tables, P.cluster_lines, P.merge_cells, P.words_to_cells, P.x_histogram, P.column_split, P.grid, P.header_above, P.segments, P.adjacent_rows,
                 lambda df: P.nearest_block(df.where("is_header"), df), lambda df: P.text_in_boxes(boxes(df), df), lambda df: P.greedy_pairs(df.where("x1 < 100"), df.where("x1 >= 100")),
                 lambda df: X.tag_spans(df.withColumn("tag", F.col("block_no"))), C.schedules, C.anchored_candidates]
    for k, f in enumerate(operators):
        found, twice = (sorted((tuple(r.asDict().values()) for r in f(df).collect()), key=str) for df in (single, double))
        assert twice == sorted(found + [(1, 2, *r[2:]) for r in found], key=str) and found, k


def test_operators_take_empty_tables(spark):
    empty = occurrences(spark, [])
    assert R.resolve_best(empty).count() == 0 and R.evidence_summary(empty, "tender_id").count() == 0 and St.coverage_confidence(empty).count() == 0


def windows_by_plain_loops(text, family):
    words, before, after = X.FAMILIES[family]
    spans = []
    for m in re.finditer(f"(?i)(?:{words})", text):
        low, high = max(0, m.start() - before), min(len(text), m.end() + after)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(high, spans[-1][1])
        else:
            spans.append([low, high])
    return " ".join(text[a:b] for a, b in spans)


def test_family_windows(spark):
    rng = random.Random(6)
    bits = ["payment ", "Payment terms", "released on ", "x" * 50, "y " * 100, "z" * 430, "payments. ", "\x01 80% on delivery \x02", "\n", "LD ", "net worth"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(60)] + ["", "payment", "payment \x01 80% on delivery of goods", "q" * 31 + "payment" + "r" * 401]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for family in ("payment", "damages", "worth"):
        found = df.select("doc_id", X.family_windows(F.col("text"), family).alias("w")).collect()
        assert {r["doc_id"]: r["w"] for r in found} == {k: windows_by_plain_loops(t, family) for k, t in enumerate(texts)}
    terms = {r["doc_id"]: r for r in X.clause_windows(df).collect()}
    assert terms[62]["supply_pct"] == "80%"


def test_windows_of_a_hundred_thousand_words(spark):
    df = spark.createDataFrame([(1, "payment " * 100_000), (2, ("payment " + "x " * 300) * 2_000)], "doc_id long, text string")
    began = time.time()
    assert len(X.clause_windows(df).collect()) == 2
    assert time.time() - began < 60


def test_clause_references(spark):
    text = "See clause 4.2 and sec-IV. Payment terms apply here. As in para 7, net worth of GCC 12 counts. Security deposit: none."
    found = X.clause_references(spark.createDataFrame([(1, text), (2, "payment only"), (3, None)], "doc_id long, text string"), ("payment", "worth", "deposit"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "deposit", "GCC 12"), (1, "payment", "para 7"), (1, "worth", "GCC 12")]


def test_clause_references_by_plain_loops(spark):
    """Against loops over every word; some texts hold the character that marks a cut."""
    rng = random.Random(9)
    bits = ["payment ", "Payment terms", "clause 4.2 ", "sec-IV ", "x" * 60, "y " * 210, X.CUT, "GCC 12", " net worth ", "LD ", "LD ", "para 7", "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(120)] + [None, "", "clause 3 LD" + " LD" * 300, "LD" * 5 + " LD," * 200 + "clause 3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    families, wanted = ("payment", "damages", "worth"), {}
    for k, text in enumerate(texts):
        for f in families:
            for m in re.finditer(X.family_pattern(f), text or ""):
                ahead = re.search(X.REFERENCE, text[m.end() : m.end() + X.FAMILIES[f][2]])
                behind = [r[0] for r in re.finditer(X.REFERENCE, text[max(0, m.start() - X.FAMILIES[f][1]) : m.start()])]
                if ahead or behind:
                    wanted[k, f] = (ahead[0] if ahead else behind[-1]).strip()
                    break
    assert {(r.doc_id, r.family): r.reference for r in X.clause_references(df, families).collect()} == wanted
    windows = df.where("text is not null").select("doc_id", *[X.family_windows(F.col("text"), f).alias(f) for f in families]).collect()
    assert all(r[f] == windows_by_plain_loops(texts[r.doc_id], f) for r in windows for f in families)


def test_clause_references_stay_in_their_row(spark):
    from conftest import DATA
    from docfields.catalog import QUERIES

    plan = QUERIES["x7_clause_references"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("FileScan") == 1
    df = spark.createDataFrame([(1, "payment " * 100_000), (2, ("payment " + "x " * 300) * 2_000 + "clause 4")], "doc_id long, text string")
    began = time.time()
    assert [tuple(r) for r in X.clause_references(df, ("payment",)).collect()] == [] and time.time() - began < 40


def test_texts_without_a_stem_are_not_cut(spark):
    plan = X.clause_windows(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") >= len(X.FAMILIES)


def test_addresses_in_long_runs(spark):
    texts = ["a" * 1_000_000, "x" * 500_000 + "@b.org", "a@b.com-x@y.org, A@B.com;q@r.s t@u.vw", "@@a@b.c@d.ef", "a@" + "b." * 100 + "org", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: r["emails"] for r in X.distinct_emails(df).collect()}
    assert time.time() - began < 20
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    for k in (2, 3, 4):
        assert (found.get(k) or "") == ";".join(dict.fromkeys(m.lower() for m in plain.findall(texts[k])))
    assert found[1] == texts[1]


def test_grid_takes_the_nearest_column(spark):
    """Against plain loops, by hand-made places of which some lie between two clusters."""
    xs = [20, 20, 40, 40, 45, 45, 45, 300]
    clusters = []
    for x in sorted(xs):
        if not clusters or abs(x - sum(clusters[-1]) / len(clusters[-1])) > 12:
            clusters.append([])
        clusters[-1].append(x)
    centres = [int(sum(c) / len(c)) for c in clusters]
    nearest = [min(range(len(centres)), key=lambda k: abs(x - centres[k])) for x in xs]
    rows = [(1, 1, k, x, k * 100, x + 10, k * 100 + 10, f"t{k}") for k, x in enumerate(xs)]
    found = P.grid(spark.createDataFrame(rows, "doc_id long, page_no long, ord long, x1 long, y1 long, x2 long, y2 long, text string"), x_tolerance=12).collect()
    first = min(r["column"] for r in found)
    assert {r["cell_text"]: r["column"] - first for r in found} == {f"t{k}": c for k, c in enumerate(nearest)}


def test_grid_columns_differ_from_the_fold(spark):
    rng = random.Random(4)
    moved = 0
    for seed in range(3):
        xs = sorted(rng.randrange(0, 200) for _ in range(40))
        clusters, own = [], []
        for x in xs:
            if not clusters or abs(x - sum(clusters[-1]) / len(clusters[-1])) > 20:
                clusters.append([])
            clusters[-1].append(x)
            own.append(len(clusters) - 1)
        centres = [int(sum(c) / len(c)) for c in clusters]
        nearest = [min(range(len(centres)), key=lambda k: abs(x - centres[k])) for x in xs]
        moved += nearest != own
        rows = [(seed, 1, k, x, k * 100, x + 10, k * 100 + 10, f"t{k}") for k, x in enumerate(xs)]
        found = P.grid(spark.createDataFrame(rows, "doc_id long, page_no long, ord long, x1 long, y1 long, x2 long, y2 long, text string")).collect()
        first = min(r["column"] for r in found)
        assert {r["cell_text"]: r["column"] - first for r in found} == {f"t{k}": c for k, c in enumerate(nearest)}
    assert moved
