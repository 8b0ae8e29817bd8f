"""Sections of texts against plain loops."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docfields.operators import sections as Se

LINES = ["SECTION-I", "Section 2 terms", "ANNEXURE B", "CLAUSE 3 pay 5%", "1. one", "1.1 two 7%", "1.1.2 three", "4 four", "word", "", "see 9%", "  2.1 indented", "ANNEXURES", "12x"]
FORMS = [(1, "SECTION", r"SECTION[ \t-]*([IVXLC]+|\d+)\b"), (1, "ANNEXURE", r"ANNEXURE[ \t-]*([IVXLC]+|\d+|[A-Z])\b"), (2, "CLAUSE", r"CLAUSE[ \t-]*(\d+(?:\.\d+)*)"), (0, "ITEM", r"(\d+(?:\.\d+)*)(?:[.\s]|$)")]


def plain_sections(text):
    rows, place = [], 1
    for j, line in enumerate(text.split("\n")):
        for level, kind, form in FORMS:
            m = re.match(form, line.strip(" \t"), re.I)
            if m:
                rows.append([level or min(4, 2 + m[1].count(".")), f"{kind}-{m[1].upper()}", place])
                break
        else:
            if j == 0:
                rows.append([0, "", place])
        place += len(line) + 1
    out, first = [], 0 if rows[0][0] == 0 else 1
    for i, (level, label, start) in enumerate(rows):
        later = [r[2] - 1 for r in rows[i + 1 :] if level == 0 or r[0] <= level]
        path, low = [], level + 1
        for above, name, _ in reversed(rows[: i + 1]):
            if 0 < above < low:
                path, low = [name, *path], above
        out.append((i + first, level, label, start, later[0] if later else len(text) + 1, tuple(path)))
    return out


def test_table_and_values(spark):
    rng = random.Random(5)
    texts = ["", "x", "1", "SECTION-I", "\n\n", *["\n".join(rng.choices(LINES, k=rng.randint(1, 25))) for _ in range(150)]]
    docs = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string")
    table = Se.section_table(docs)
    found = {}
    for r in table.collect():
        assert texts[r.doc_id][r.start - 1 : r.stop - 1].startswith(r.own)
        found.setdefault(r.doc_id, []).append((r.n, r.level, r.label, r.start, r.stop, tuple(r.path)))
    wanted = {i: plain_sections(t) for i, t in enumerate(texts)}
    assert {k: sorted(v) for k, v in found.items()} == wanted

    values = docs.select("doc_id", F.instr("text", "%").alias("place"), F.lit("v").alias("what")).where("place > 0")
    for r in Se.in_sections(values, table).collect():
        inner = [s for s in wanted[r.doc_id] if s[3] <= r.place < s[4]][-1]
        assert (r.section.n, r.section.label, tuple(r.section.path), r.what) == (inner[0], inner[2], inner[5], "v")


def test_first_slice(spark):
    rows = [("Deposit terms\n1. x 4%\n2. DEPOSIT is\n 6 % now", None), ("deposit\nof 3%\nSECTION 4%\ndeposit 5%", "3"), ("deposit\nSECTION 1\n8%\nClause 2 Deposit 7%", "7"), ("no", None), ("", None), (None, None)]
    docs = spark.createDataFrame(rows, "text string, want string")
    for r in docs.select("want", Se.first_slice(F.col("text"), "deposit", "([0-9]+) ?%").alias("got")).collect():
        assert r.got == r.want


def test_deferred(spark):
    text = "SECTION-I\n1. Payment as per section IV\n2. Payment 5%\n3. Payment per Annexure C\n4. Payment\nSECTION IV\n1. none\n1.1 deep 8%\nSECTION-IV\n9%"
    sections = Se.section_table(spark.createDataFrame([(1, text, "x"), (2, "", "x")], "doc_id long, text string, value string"))
    rows = Se.deferred_values(sections, "payment", "([0-9]+)%", r"per ((?:section|annexure)[ -]*[a-z]+)").orderBy("n").collect()
    assert [(r.n, r.target, r.value, r.status) for r in rows] == [(2, "SECTION-IV", "8", "deferred"), (3, None, "5", "own"), (4, "ANNEXURE-C", None, "unresolved"), (5, None, None, "none")]


@pytest.mark.parametrize("line", ["1.1 item of 5%", "SECTION-I\n1. a", "\n" * 5])
def test_long_texts(spark, line):
    """A hundred thousand headings, or empty lines, in one text."""
    docs = spark.createDataFrame([(1, "\n".join([line] * 100_000))], "doc_id long, text string")
    start = time.time()
    table = Se.section_table(docs)
    counted = table.agg(F.count("*").alias("n"), F.max("stop").alias("stop"), F.max(F.size("path")).alias("depth")).first()
    assert counted.n == {"1": 100_000, "S": 200_000, "\n": 1}[line[0]] and counted.depth == {"1": 1, "S": 2, "\n": 0}[line[0]]
    assert docs.select(Se.first_slice(F.col("text"), "item of", "([0-9])%").alias("v")).first().v == ("5" if line[0] == "1" else None)
    assert time.time() - start < 40


def test_words_are_looked_for_after_the_texts_are_dealt_out(spark):
    from conftest import DATA
    from docfields.catalog import QUERIES

    plan = QUERIES["x7_clause_references"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "Filter RLIKE" not in plan


def test_lookup_keys_are_not_shuffled(spark):
    from conftest import DATA
    from docfields.catalog import QUERIES

    plan = QUERIES["j2_lookup_fields"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sections_are_made_where_their_texts_are(spark):
    from conftest import DATA
    from docfields.catalog import QUERIES

    for name in ("x2_section_table", "x10_mentions"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan, name


def test_sections_are_sorted_twice_and_cut_once(spark):
    from conftest import DATA
    from docfields.catalog import QUERIES

    plan = lambda name: QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan("x2_section_table").count("Sort [") == 2
    assert plan("j19_deferred_sections").count("Generate posexplode") == 1


def test_mentions_look_at_first_letters_first(spark):
    from docfields.operators import extract as X

    text = "See xBOQ, BOQ_1 and corrigendum 2.  Then\tannexure-ii.PDF again?\n\nVolume III!  An addendum;Specification 4 holds. scheduled... schedule"
    both = spark.createDataFrame([(text,)], "text string").select(*[F.regexp_extract_all("text", F.lit(p), 1) for p in (X.MENTIONS, X._MENTION)], *[F.split("text", p) for p in (r"(?<=[.!?])\s+", r"\s(?<=[.!?]\s)\s*")]).head()
    assert both[0] == both[1] and len(both[0]) == 7 and both[2] == both[3]
