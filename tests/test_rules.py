"""Rules against brute force."""

import random
import re
from functools import cache

from pyspark.sql import functions as F

from docfields.functions import scalars as S
from docfields.operators import rules


@cache
def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@cache
def ratio(text, anchor):
    n = len(anchor)
    least = min(edits(text[k : k + n], anchor) for k in range(max(1, len(text) - n + 1)))
    return (100 * n - 100 * least) // n


def plain(line):
    return re.sub("[\u0900-\u097f]+", " ", line.lower()).strip(" ")


def brute(docs, labels, least, headers=()):
    """labels: (name, section), headers: names, both in order of precedence."""
    found = set()
    for d, text in docs:
        current = None
        for k, line in enumerate(text.split("\n")):
            begins = next((h for h in headers if ratio(plain(line), h.lower()) >= 85), None)
            if begins is not None:
                current = begins
                continue
            scores = [(-ratio(plain(line), name.lower()), i) for i, (name, section) in enumerate(labels) if section in (None, current)]
            if scores and -min(scores)[0] >= least:
                found.add((d, k, labels[min(scores)[1]][0], -min(scores)[0]))
    return found


NAMES = ["Total Quantity", "Delivery Period", "Delivery Peroid", "Bid No", "EMD", "Q", "Contract Period", "Estimated Bid Value", "Bid Life Cycle (From Publish Date)"]


def texts():
    rng, out = random.Random(4), []
    for d in range(12):
        lines = ["1. Total Quantity: 5", " total Quantity", "The delivery period is long", "x" * 90 + " Bid No: 7", "\u092c\u093f\u0921 Contract \u0915 Period", "", "Botal Quantity"] if d == 0 else []
        for _ in range(8):
            name = list(rng.choice(NAMES))
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(name) + 1)
                name[k : k + rng.randint(0, 1)] = rng.choice(["", "e", "z", " t"])
            lines.append("".join(rng.choices("abdeit .:", k=rng.randint(0, 100))) + "".join(name) + "".join(rng.choices("aeit 1:", k=rng.randint(0, 30))))
        out.append((d, "\n".join(lines)))
    return out


def test_fuzzy_labels(spark):
    docs = texts()
    frame, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in NAMES], "field_name string")
    for least in (80, 60, 95, 0):
        found = {tuple(r) for r in rules.fuzzy_labels(frame, labels, least).collect()}
        expected = brute(docs, [(x, None) for x in sorted(NAMES)], least)
        assert not found ^ expected, (least, sorted(found ^ expected))


def test_fuzzy_labels_in_sections(spark):
    docs = [(1, "Delivery Period: 1\nBID DETAILS\nDelivery Period: 2\nTotal Quantity\nBUYER DETAlLS\nDelivery Period: 3\nTotal Quantity"), (2, "x\nBID DETAILS BUYER DETAILS\nTotal Quantity")]
    names, headers = [("Total Quantity", "BUYER DETAILS"), ("Total Quantity\u200b", None), ("Delivery Period", "BID DETAILS")], ["BUYER DETAILS", "BID DETAILS"]
    labels = spark.createDataFrame([(*x, k) for k, x in enumerate(names)], "field_name string, section string, precedence int")
    sections = spark.createDataFrame([(x, k) for k, x in enumerate(headers)], "section string, precedence int")
    found = {tuple(r) for r in rules.fuzzy_labels(spark.createDataFrame(docs, "doc_id long, text string"), labels, 80, sections).collect()}
    assert found == brute(docs, names, 80, headers) and (1, 2, "Delivery Period", 100) in found and not any(r[:2] == (1, 5) for r in found)


def test_exact_partial_ratio():
    """The bitwise form against the table of common subsequences."""
    from docfields.operators.models import _partial

    def plain(a, b):
        short, long = sorted((a, b), key=len)
        best = 0
        for k in range(len(long) - len(short) + 1):
            window, last = long[k : k + len(short)], [0] * (len(short) + 1)
            for x in window:
                row = [0]
                for j, y in enumerate(short):
                    row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
                last = row
            best = max(best, 100 * last[-1] // len(short)) if short else 0
        return best

    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abc d", k=rng.randint(0, n)))
    for _ in range(400):
        a, b = text(12), text(30)
        assert _partial(a, b) == _partial(b, a) == plain(a, b)


def test_fuzzy_labels_of_very_long_lines(spark):
    """The same labels as before wherever they stand, in time that grows with the line."""
    import time

    filler = "".join(random.Random(3).choices("abcdefghij klmnop", k=60_000))
    docs = spark.createDataFrame([(1, filler + " Total Quantty " + filler[:200]), (2, filler), (3, "Delivery Perod: 5\n" + filler + "delivery period")], "doc_id long, text string")
    labels = spark.createDataFrame([("Total Quantity",), ("Delivery Period",), ("Warranty",)], "field_name string")
    began = time.time()
    found = sorted(map(tuple, rules.fuzzy_labels(docs, labels).collect()))
    near = ratio(" total quantty " + filler[:20], "total quantity"), ratio("delivery perod: 5", "delivery period")
    assert found == [(1, 0, "Total Quantity", near[0]), (3, 0, "Delivery Period", near[1]), (3, 1, "Delivery Period", 100)]
    assert time.time() - began < 30


def test_partial_ratio_by_pieces(spark):
    texts = ["", "bid", "x" * 300 + "payment trms" + "y" * 300, "z" * 255 + "Payment terms".lower(), "q" * 600, "päyment terms", "terms of payment"]

    anchor = "payment terms"
    plain = {t: int((100 - 100 * min(edits(t[k : k + 13], anchor) for k in range(max(1, len(t) - 12))) / 13) // 1) for t in texts}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.partial_ratio(F.col("t"), F.lit(anchor)).alias("all"), rules.partial_ratio(F.col("t"), F.lit(anchor), 80).alias("some"), rules.may_be_like(F.col("t"), anchor, 80).alias("may")).collect()
    for r in rows:
        assert r["all"] == plain[r["t"]] and r["some"] == (r["all"] if r["all"] >= 80 else None)
        assert r["may"] or r["some"] is None


def test_long_texts_are_not_broadcast(spark):
    from conftest import DATA
    from docfields.catalog import QUERIES

    for name in ("j12_fuzzy_label_join", "x19_supported_values"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan, name


def test_address_with_a_longer_number(spark):
    cases = {
        "Cell 1, Block 2, City, 1310000": ("Cell 1", "Block 2, City", "1310000"), "Cell 100000, Block 2, City, 1310000": ("Cell 100000", "Block 2, City", "1310000"), "Cell 1, Block 2, City, 110001": ("Cell 1", "Block 2, City", "110001"),
        "Plot 7, Pune 411001, 01123456789": ("Plot 7", "Pune 411001, 01123456789", "411001"), "City, 110001, 23456789": ("City", "23456789", "110001"), "House 12": ("House 12", None, None),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", S.address_parts(F.col("c")).alias("a")).select("c", "a.*").collect()
    assert {r["c"]: (r["line1"], r["line2"], r["pin"]) for r in rows} == cases
