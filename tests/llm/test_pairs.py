"""The operators on pairs against brute force, with nulls, blanks, ties, repeats, long texts and clashing columns."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(4)
    word = lambda: rng.choice(["Alpha", "beta", "gamma,", "é", "delta-x", "Ω", "zeta"]) + str(rng.randrange(400))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(150)]
    out = [None, "", " \n\t ", "one", "one two three four", "ONE two three four", "a\x1cb c\x85d e f g"]
    for _ in range(60):
        near = list(base)
        for _ in range(rng.randrange(8)):
            near[rng.randrange(len(near))] = word()
        out.append(" ".join(near))
    for _ in range(80):
        own = [word() for _ in range(rng.choice([5, 10, 15, 20, 60, 200]))]
        cut = rng.randrange(len(own))
        out.append(" ".join(own[:cut] + passage + own[cut:]) if rng.random() < 0.6 else " ".join(own))
    out += [rng.choice(out[7:]) for _ in range(25)] + ["x " * 5000, "y " * 34, "y " * 35, " ".join(word() for _ in range(9000))]
    long = [word() for _ in range(3000)]
    out += [" ".join(long), " ".join(long[:2800]), " ".join(long[40:] + ["end"])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, "x", 5, "bits") for i, t in enumerate(texts())]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, key string, n int, bits string").repartition(5)


def words_of(text, fold=False):
    return WORD.findall((text or "").translate(FOLD) if fold else text or "")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("frequent", [1 << 17, 40])
def test_ngram_join(spark, docs, monkeypatch, frequent):
    from docfields.llm import ngram_join

    monkeypatch.setattr(ngram_join, "FREQUENT_MOST", frequent)
    rows, df = docs
    sets = {}
    for i, t, *_ in rows:
        w = words_of(t, True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = []
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    part = components(sets, links)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(df).collect()}
    assert found == {i: (len(s), part[i]) for i, s in sets.items()}
    assert len({*part.values()}) < len(part) - 40


def test_ngram_join_odd_rows(spark):
    from docfields.llm.ngram_join import near_copies

    df = spark.createDataFrame([(None, "a b c"), (None, None), (5, "a b c"), (5, "a b c"), (7, None)], "doc_id long, text string")
    found = sorted((tuple(r) for r in near_copies(df).collect()), key=str)
    assert found == sorted([(None, 1, 5), (None, 0, None), (5, 1, 5), (5, 1, 5), (7, 0, 7)], key=str)
    assert near_copies(df.limit(0)).count() == 0


def cut(texts, window):
    words = [words_of(t) for t in texts]
    count = collections.Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_substring_dedup(spark, docs):
    from docfields.llm.substring_dedup import drop_repeats

    rows, df = docs
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in drop_repeats(df, with_text=True).collect()}
    expected = dict(zip([r[0] for r in rows], cut([r[1] for r in rows], 35)))
    assert found == expected
    assert sum(x[1] for x in expected.values()) > 1000


def test_substring_dedup_odd_rows(spark):
    from docfields.llm.substring_dedup import drop_repeats

    long = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, long), (1, long), (None, "x " + long), (None, None), (2, "")], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in drop_repeats(df).collect()), key=str)
    assert found == sorted([(1, 40, 40), (1, 40, 40), (None, 41, 40), (None, 0, 0), (2, 0, 0)], key=str)
    assert drop_repeats(df.limit(0)).count() == 0


def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    x = (base[rng.integers(0, 12, 500)] + rng.normal(size=(500, 16)) * rng.choice([0.02, 0.08, 0.13, 0.4], 500)[:, None]).astype(np.float32)
    x[5] = x[7] = x[9]
    rows = [(int(i), [float(v) for v in r], int(k)) for i, r, k in zip(rng.permutation(500), x, rng.integers(0, 3, 500))]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, [], 1), (1050, rows[3][1], None), (1100, [1.0, 2.0], 1)]
    return rows


def good(row):
    return row[1] and all(v is not None and np.isfinite(v) for v in row[1])


def test_near_vectors(spark, monkeypatch):
    from docfields.llm import near_vectors

    monkeypatch.setattr(near_vectors, "TILE", 40)
    monkeypatch.setattr(near_vectors, "HELD", 300)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("vec_id", "vec_id")
    links = collections.defaultdict(set)
    for a in rows:
        for b in rows:
            if a[0] < b[0] and good(a) and good(b) and a[2] is not None and a[2] == b[2] and len(a[1]) == len(b[1]) and any(a[1]) and any(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    part = components([r[0] for r in rows], [(a, b) for a in links for b in links[a]])
    found = {r["vec_id"]: tuple(r)[1:] for r in near_vectors.near_copies(df).collect()}
    assert found == {i: (len(links[i]), part[i], part[i] == i) for i, *_ in rows}
    assert near_vectors.near_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [64, 8192])
def test_top_k(spark, monkeypatch, shard):
    from docfields.llm import top_k

    monkeypatch.setattr(top_k, "SHARD", shard)
    monkeypatch.setattr(top_k, "SHARD_LEAST", shard)
    monkeypatch.setattr(top_k, "LEAF", 16)
    rows = [r for r in vectors()] + [(2000, vectors()[0][1], 0)]
    df = spark.createDataFrame([(*r[:2], "v", 1) for r in rows], "vec_id long, embedding array<float>, v string, shard int")
    whole = [(r[0], np.floor(256 * np.array(r[1])).astype(np.int64)) for r in rows if good(r)]
    expected = []
    for i, q in whole:
        if i % 50 == 0:
            scored = sorted((-int(q @ v), j) for j, v in whole if j != i and len(v) == len(q))[:5]
            expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    vectors_ = top_k.integers(df)
    found = top_k.top_k(vectors_, vectors_.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert top_k.top_k(vectors_.limit(0), vectors_).count() == 0 and top_k.top_k(vectors_, vectors_.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [20, 8192])
@pytest.mark.parametrize("scale", [1, 1 << 20, 1 << 27])
def test_top_k_of_repeated_rows(spark, monkeypatch, shard, scale):
    """Repeated rows, ids with several vectors, ties, null ids, wide components: one list an id, by a plain loop."""
    from docfields.llm import top_k

    monkeypatch.setattr(top_k, "SHARD", shard)
    monkeypatch.setattr(top_k, "SHARD_LEAST", shard)
    monkeypatch.setattr(top_k, "LEAF", 4)
    rng = random.Random(6)
    rows = [(rng.randrange(60), [rng.randrange(-3, 4) * scale for _ in range(3)], 1, "x") for _ in range(150)]
    rows += rows[:40] + [(None, [scale] * 3, 1, "x"), (50, None, 1, "x"), (50, [], 1, "x"), (0, rows[0][1], 1, "x"), (0, rows[1][1], 2, "y")]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, shard int, score string").repartition(3)
    best = {}
    for q, x, *_ in rows:
        for c, y, *_ in rows:
            if q is not None and q % 50 == 0 and c is not None and c != q and x and y:
                score = sum(a * b for a, b in zip(x, y))
                best[q, c] = max(score, best.get((q, c), score))
    expected = []
    for q in {q for q, _ in best}:
        expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(sorted((-s, c) for (p, c), s in best.items() if p == q)[:5])]
    assert sorted(map(tuple, top_k.top_k(df, df.where("vec_id % 50 = 0")).collect())) == sorted(expected)


def test_near_vectors_odd_rows(spark):
    """Repeated rows, null and repeated ids, columns of the operator's own names."""
    from docfields.llm.near_vectors import near_copies

    a, b = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(1, a, 1), (1, a, 1), (2, [2.0, 4.0, 6.0], 1), (None, a, 1), (None, b, 2), (None, b, 2), (5, b, 3), (6, a, None), (7, [0.0, -0.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "k", 1.5, True) for r in rows], "vec_id long, embedding array<double>, label int, key string, n double, kept boolean")
    found = sorted((tuple(r) for r in near_copies(df).collect()), key=str)
    expected = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, None), (None, 1, None, None), (None, 1, None, None), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True)]
    assert found == sorted(expected, key=str)


def test_components_of_a_hub(spark, monkeypatch):
    """Stars and their centres at either end, with every key hot."""
    from docfields.llm import tables
    from docfields.llm.components import connected_components

    monkeypatch.setattr(tables, "HOT_LEAST", 3)
    monkeypatch.setattr(tables, "HOT_PART", 1 << 30)
    links = [(0, k) for k in range(1, 60)] + [(500, k) for k in range(100, 160)] + [(300, k) for k in [*range(290, 300), *range(301, 310)]] + [(159, 290), (9, 9), (None, 3)]
    part = components({x for l in links for x in l if x is not None}, [l for l in links if None not in l])
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == part


def test_components(spark):
    from docfields.llm.components import connected_components

    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1100)]
    part = components({x for l in links for x in l}, links)
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: c for n, c in part.items() if n in found} and all(part[n] == n for n in part if n not in found)


def test_near_copies_of_many_repeated_rows(spark):
    """Thousands of rows of one doc_id with a text and with a near copy of it: each set is verified once, not each pair of rows."""
    from docfields.llm.ngram_join import near_copies

    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"])]
    rows = [(i, t) for i in (7, None) for t in texts for _ in range(5000)] + [(8, "alone in the world of words")]
    began = time.time()
    found = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).groupBy("doc_id", "component_id").count().collect()
    assert {(r["doc_id"], r["component_id"], r["count"]) for r in found} == {(7, 7, 10_000), (None, 7, 10_000), (8, 8, 1)}
    assert time.time() - began < 90
