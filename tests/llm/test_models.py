"""Nets against plain loops, pages without marks, and pages made to be slow."""

import random
import time

import numpy as np
import pytest

from conftest import DATA

WORDS = "river stone market council people report winter bridge music school paper garden history number letter engine doctor village forest history".split()


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + rng.choice(".!?")


def unmarked_page(rng):
    """Html of div, ul, p and headings without class or id, and the text of its article."""
    article = [sentence(rng, rng.randint(3, 8)).rstrip(".!?")] + [sentence(rng, rng.randint(14, 60)) for _ in range(rng.randint(2, 8))]
    links = "".join(f"<li><a href='/{k}'>{rng.choice(WORDS).title()}</a></li>" for k in range(rng.randint(3, 7)))
    menu = f"<ul>{links}</ul>" if rng.random() < 0.6 else f"<div><ul>{links}</ul></div>"
    inner = f"<h1>{article[0]}</h1>" + "".join(f"<p>{p}</p>" for p in article[1:])
    holder = rng.choice([f"<div>{inner}</div>", f"<div><div>{inner}</div></div>", f"<section>{inner}</section>"])
    foot = f"<div>{rng.choice(['Copyright 2024 ', '© '])}{rng.choice(WORDS).title()}</div>"
    return f"<html><body>{menu}{holder}{foot}</body></html>", "\n\n".join(article)


@pytest.fixture(scope="module")
def labeller(spark):
    from docfields.llm.html_main import learn

    return learn(spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/pages.parquet"))


def test_pages_without_marks(spark, labeller):
    from docfields.llm.html_main import main_text

    rng = random.Random(8)
    pages = [unmarked_page(rng) for _ in range(20)]
    df = spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in main_text(df, labeller).collect()}
    same = [found[k] == text for k, (_, text) in enumerate(pages)]
    kept = sum(len(set(found[k].split("\n\n")) - set(t.split("\n\n"))) for k, (_, t) in enumerate(pages))
    assert sum(same) >= 18 and kept <= 2, (same, kept)


def test_remarks_beside_an_article(spark, labeller):
    from docfields.llm.html_main import blocks

    page = "<html><body><article><h1>Title</h1><p>The first paragraph has many words, and it says something.</p></article><div class='disqus_thread'><p>Nice post!</p><p>I do not agree with that.</p></div></body></html>"
    own = blocks(page)
    assert [b.text for b, y in zip(own, labeller.labels([own])[0]) if y] == ["Title", "The first paragraph has many words, and it says something."]


def test_page_labeller_forward_by_plain_loops(labeller):
    from docfields.llm import html_main as H

    rng = random.Random(2)
    pages = [H.blocks(unmarked_page(rng)[0])[: k + 1] for k in (0, 3, 7)]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for page, found in zip(pages, labeller.labels(pages)):
        x = labeller.vectors(H._features([page]))
        sides = []
        for d, turn in (("f", 1), ("b", -1)):
            h, c, out = np.zeros(H.HIDDEN), np.zeros(H.HIDDEN), []
            for row in x[::turn]:
                z = np.concatenate([row, h]) @ labeller.p["w" + d] + labeller.p["o" + d]
                f, i, g, q = sigmoid(z[: H.HIDDEN]), sigmoid(z[H.HIDDEN : 2 * H.HIDDEN]), np.tanh(z[2 * H.HIDDEN : 3 * H.HIDDEN]), sigmoid(z[3 * H.HIDDEN :])
                c = f * c + i * g
                h = q * np.tanh(c)
                out.append(h)
            sides.append(out[::turn])
        plain = [float(sigmoid(np.concatenate([a, b, row]) @ labeller.p["v"] + labeller.p["c"])[0]) for a, b, row in zip(*sides, x)]
        assert [p >= 0.5 for p in plain] == found.tolist()


def test_toxicity_forward_by_plain_loops():
    import pyarrow as pa

    from docfields.llm import text as T
    from docfields.llm import toxicity as X

    net = X.Net()
    rng = np.random.default_rng(1)
    net.p = {k: v + rng.normal(0, 0.1, v.shape).astype(np.float32) for k, v in net.p.items()}
    net.p["e"][:, X.BUCKETS] = 0
    texts = ["one two three four", "", None, "alone", "a b", "word " * 50]
    for words in T.pieces(pa.array(texts), prefix=X.PREFIX):
        for d, got in enumerate(net.raw(words)):
            own = slice(words.first[d], words.first[d + 1])
            rows = [net.p["e"][0][a % X.BUCKETS] + net.p["e"][1][b % X.BUCKETS] for a, b in zip(words.hashes[own].tolist(), words.prefixes[own].tolist())]
            rows += [np.zeros(X.SIZE)] * max(X.WIDTHS)
            z = float(net.p["c"][0])
            for j, w in enumerate(X.WIDTHS):
                for f in range(X.FILTERS):
                    best = max([sum(rows[at + o] @ net.p[f"f{w}"][o][:, f] for o in range(w)) for at in range(len(rows) - max(X.WIDTHS))], default=-9)
                    z += max(0.0, float(best + net.p[f"b{w}"][f])) * float(net.p["v"][j * X.FILTERS + f])
            assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


@pytest.mark.parametrize("page", ["<u><div>" + "<i>" * 100_000 + "</u>" * 100_000, "<b><a '>" * 100_000, "<a \"> <a ' > " * 60_000 + "'\"", "<i>" * 200_000 + "<p>x" * 200_000, "<a \"x'>" * 100_001])
def test_pages_made_to_be_slow(page):
    from docfields.llm.html_main import blocks

    began = time.time()
    blocks(page)
    assert time.time() - began < 15


def test_quotes_count_after_many_broken_ones_and_ends_reach_deep():
    from docfields.llm.html_main import blocks

    broken = "<p><a '>" * 39  # the last one's quote never closes
    assert [b.text for b in blocks(broken + "<p title=\"a>b\">kept")][-1] == "kept"
    deep = "<div><a href='x'>" + "<i>" * 300 + "in" + "</a> out</div>"
    assert [(b.text, b.linked) for b in blocks(deep)] == [("in out", 2)]
