"""The prefix trie, importance resampling and quality scores against plain loops, and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from conftest import DATA


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        q = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + t[h:])
        for d in range(len(q) + 1):
            members[q[:d]].add(c)
        ends[q].append(c)
    children = collections.defaultdict(list)
    for q in members:
        if q:
            children[q[:-1]].append(q)
    leaves, saved = {}, {}
    for q in sorted(members, key=len, reverse=True):
        leaves[q] = sum(leaves[k] for k in children[q]) if children[q] else 1
        saved[q] = (len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) + sum(saved[k] for k in children[q])
    digest = lambda q: hashlib.sha256(",".join(map(str, sorted(ends[q]))).encode()).hexdigest()
    return sorted((min(m), len(q), min(members[q[:-1]]) if q else -1, len(m), len(children[q]), leaves[q], saved[q], digest(q)) for q, m in members.items())


def trie(spark, rows):
    from docfields.llm.prefix_trie import prefix_trie

    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, ids string").repartition(5)
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie(df).collect())


def conversations(rng, n):
    rows = []
    for c in rng.sample(range(-40, 10 * n), n):
        for k in range(rng.randint(1, 14)):
            rows.append((c, rng.choice([k, k, None, 3]), rng.choice(["user", "a", None]), rng.choice(["x", "y", "é日", "", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rng = random.Random(seed)
    rows = conversations(rng, 60)
    rows += rows[:20] + [(None, 1, "user", "x"), (10**12, None, None, None), (7, 1, "user", "long " * 30_000), (8, 1, "user", "long " * 30_000)]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_one_huge_conversation_and_one_huge_group(spark):
    """A conversation that lies in several ranges and blocks, one node with more ends than a chunk, chains that hang on chains."""
    rows = [(5, k % 3000, "user", f"t{k % 7}") for k in range(9000)]
    rows += [(5 * k, 0, "user", "same") for k in range(100, 2400)]
    rows += [(10**6 + 5 * c, k, "a", "step") for c in range(60) for k in range(c + 1)]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "a", "b")]) == []


def test_trie_takes_other_fingerprints_when_two_sequences_meet(spark, monkeypatch):
    from docfields.llm import prefix_trie as P

    given, rows = P.bases, [(5 * c, k, "a", f"{c % 3}{k}") for c in range(9) for k in range(10)]
    found, monkey = P._nodes, []

    def once(df):
        monkey.append(1)
        return found(df.withColumns({c: df[c] * 0 for c in ("f_a", "f_b")})) if len(monkey) == 1 else found(df)

    monkeypatch.setattr(P, "_nodes", once)
    assert given(0) != given(1) and trie(spark, rows) == plain_trie(rows) and len(monkey) == 2


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_draw(docs, target, n, percent, least):
    def grams(text):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    s, t = collections.Counter(b for _, x in docs for b in grams(x)[1]), collections.Counter(b for x in target for b in grams(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, x in docs:
        words, own = grams(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(may[: len(may) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("n, percent, least", [(1, 10, 20), (3, 50, 2)])
def test_draw(spark, n, percent, least):
    from docfields.llm.resample import draw

    rng = random.Random(n)
    letters = "aAbBzZ09éÉ日🙂 \t\n.,_-[`{~\x7f\x00  "
    docs = [(k, "".join(rng.choices(letters, k=rng.randint(0, 200)))) for k in range(150)]
    docs += [(None, "a b c d " * 9), (None, None), (3, ""), (4, "\n\n"), (5, "w" * 5000 + " x"), (6, "a b " * 100_000), *docs[:5], *[(9, "a a b " * 8)] * 40]
    target = ["A b a b " * 20, None, "", "é 日 \n x", "zz"]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, n_words int").repartition(4)
    found = draw(df, spark.createDataFrame([(t, t) for t in target], "text string, bucket string"), n, percent, least)
    assert sorted(map(tuple, found.collect()), key=str) == plain_draw(docs, target, n, percent, least)
    assert draw(df.limit(0), df, n).count() == 0


def test_draw_from_an_empty_target(spark):
    from docfields.llm.resample import draw

    df = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    assert sorted(map(tuple, draw(df, df.limit(0), least_words=1, percent=100).collect())) == sorted(plain_draw([(1, "a b"), (2, "b")], [], 1, 100, 1))


def test_numbers_of_equal_rows(spark):
    from pyspark.sql import functions as F

    from docfields.llm.tables import numbered

    rows = [(1,)] * 500 + [(k,) for k in range(200)]
    found = numbered(spark.createDataFrame(rows, "x long").repartition(3), F.desc("x")).collect()
    assert [r["x"] for r in sorted(found, key=lambda r: r["number"])] == sorted((r[0] for r in rows), reverse=True)
    assert sorted(r["number"] for r in found) == list(range(1, 701))


def plain_features(text):
    """The features that are not zero, by plain loops; hashed words as a sorted list of shares."""
    from docfields.llm import quality as Q

    data = (text or "").encode()
    words = re.split(rb"[\x20\x09-\x0D]+", data)
    words = [w for w in words if w]
    kind = lambda b: 4 if b >= 0x80 else 3 if 0x41 <= b <= 0x5A else 2 if 0x61 <= b <= 0x7A else 1 if 0x30 <= b <= 0x39 else 0
    shape = collections.Counter(((kind(w[0]) * 5 + kind(w[-1])) * 5 + kind(w[max(0, len(w) - 2)])) * 2 + (len(w) > Q.LONG) for w in words)
    low = [w.translate(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))) for w in words]
    n = max(1, len(words))
    return (
        {b: k / len(data) for b, k in collections.Counter(data).items()}, {s: k / n for s, k in shape.items()}, sorted(k / n for k in collections.Counter(low).values()),
        [sum(a == b for a, b in zip(low[lag:], low)) / n for lag in range(1, Q.LAGS + 1)],
    )


def test_quality_features():
    import pyarrow as pa

    from docfields.llm import quality as Q

    texts = ["The cat THE cat sat!! 12% é日 x", None, "", " \n ", "a" * 50 + " B", "w x " * 3, "Ü! ,", "to to to be"]
    for x, t in zip(np.concatenate(list(Q._pieces(pa.array(texts)))), texts):
        x = x.astype(float) ** 2
        letters, shapes, words, lags = plain_features(t)
        assert {b: pytest.approx(v) for b, v in letters.items()} == {int(b): x[b] for b in np.flatnonzero(x[:256])}
        own = x[256 : 256 + Q.SHAPES]
        assert {s: pytest.approx(v) for s, v in shapes.items()} == {int(s): own[s] for s in np.flatnonzero(own)}
        own = x[256 + Q.SHAPES : 256 + Q.SHAPES + Q.WORDS]
        assert sorted(own[own > 0]) == pytest.approx(words)  # these few words meet in no bucket
        assert list(x[-1 - Q.LAGS : -1]) == pytest.approx(lags)


def test_preference_pairs_and_quantile():
    from docfields.llm import quality as Q

    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    true = np.array([2, -1, 0.5, 0, 0, 0, 0, 1])
    y = (rng.random(600) < 1 / (1 + np.exp(-4 * (x @ true)))).astype(int)
    w = Q.fit(x[:400], y[:400])
    s, own = x[400:] @ w, y[400:]
    assert np.mean(s[own == 1][:, None] > s[own == 0][None, :]) > 0.93
    assert np.corrcoef(w, true)[0, 1] > 0.95
    # equal weights: a plain quantile; with label 0 as one in ten, the lowest tenth of the weight
    assert Q.threshold(np.array([3.0, 1, 2, 4]), np.array([0, 0, 1, 1]), 0.5) == 2.5
    scores = np.arange(100.0)
    assert Q.threshold(scores, (scores >= 50).astype(int), 0.1) == 49.5


def test_quality_on_held_out_rows(spark):
    from docfields.llm.quality import quality

    folder = DATA.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    odd = spark.createDataFrame([(10**9, "ab " * 300_000), (10**9 + 1, "a b"), (10**9 + 1, "a b"), (None, None), (10**9 + 2, "")], "doc_id long, text string")
    given = docs.select("doc_id", "text").unionByName(odd).selectExpr("*", "'x' as score", "1 as quality", "2 as h")
    found = quality(given, labels.selectExpr("*", "'q' as text")).toPandas()
    assert len(found) == docs.count() + 5 and found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    assert found[found.doc_id == 10**9 + 1].score.nunique() == 1 and not found[found.doc_id.isna()].held_out.any()
    assert found.dropna().held_out.tolist() == [zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in found.dropna().doc_id]
    out = labels.toPandas().dropna(subset=["quality"]).drop_duplicates("doc_id").merge(found[found.held_out.astype(bool)], on="doc_id")
    good = out.quality == 1
    assert out.predicted[good].mean() >= 0.98 and 1 - out.predicted[~good].mean() >= 0.95


def test_quality_learns_nothing_from_held_out_rows_or_without_labels(spark):
    from docfields.llm.quality import quality

    rows = [(k, f"good words here {k % 7}" if k % 2 else f"BAD!! BAD!! {k % 5}", k % 2) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    found = quality(docs, docs).toPandas().sort_values("doc_id")
    assert (found.predicted == [r[2] for r in rows]).all()
    turned = docs.selectExpr("doc_id", "if(pmod(crc32(cast(doc_id as string)), 5) = 0, 1 - quality, quality) as quality")
    again = quality(docs, turned).toPandas().sort_values("doc_id")
    assert (again.score.to_numpy() == found.score.to_numpy()).all()
    assert quality(docs, turned.limit(0)).toPandas().score.eq(0).all() and quality(docs.limit(0), docs).count() == 0


def test_quality_learns_from_every_labelled_row(spark):
    from docfields.llm import quality as Q
    from docfields.llm import shards as S

    # long texts teach as well
    rows = [(k, ("good words here " if k % 2 else "BAD!! BAD!! ") * 5000, k % 2) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    assert [r["predicted"] for r in Q.quality(docs, docs).orderBy("doc_id").collect()] == [r[2] for r in rows]
    # every row is in a shard, and each shard has both labels however rare one is
    rows = spark.range(9000).selectExpr("id", "int(id >= 3) as y", "id as k")
    found = S.dealt(rows, "y", {0: 3, 1: 8997}, 5).toPandas()
    assert found.id.nunique() == 9000 and (found.groupby("shard").y.nunique() == 2).all() and len(found) == 8997 + 3 * 5
    seen = S.averaged(S.dealt(rows.selectExpr("*", "1 as n"), "y", {0: 3, 1: 8997}, 5), 5, lambda t: np.array([1.0, t.column("y").to_numpy().mean()]))
    assert seen[0] == 1 and seen[1] == pytest.approx(8997 / 9012)


def test_toxicity_learns_from_every_labelled_row(spark):
    from docfields.llm import toxicity as X

    # long texts teach as well
    rows = [(k, f"n{k} " + "plain words of peace " * 3000 + ("vile scum " if k % 2 else ""), "en", k % 2) for k in range(48)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    found = [r["predicted"] for r in X.toxicity(docs, docs).orderBy("doc_id").collect()]
    assert sum(a == r[3] for a, r in zip(found, rows)) >= 46
    scores = np.array([0.9, 0.8, 0.7, 0.2])
    assert X.best_threshold(scores, scores, np.ones(4), np.array([1, 1, 0, 0])) == pytest.approx(0.75)
    assert X.best_threshold(np.array([0.2, 0.7]), np.array([0.4, 0.9]), np.array([50, 3]), np.array([1, 3])) == pytest.approx(0.55)


def test_mixing_writes_its_rows_a_few_times(spark, monkeypatch):
    import numpy as np
    from docfields.llm import mixing

    writes = []
    monkeypatch.setattr(mixing, "HELD_STEPS", 2)
    monkeypatch.setattr(mixing, "written", lambda df: writes.append(1) or df.localCheckpoint())
    members = spark.createDataFrame([(1, 5, [0.9, 0.1]), (2, 7, [0.3, 0.7])], "doc_id long, n_tokens long, posterior array<double>")
    sums, rate = mixing._AllRows(members, 2, []), np.ones(2)
    n, p = np.array([5.0, 7.0]), np.array([[0.9, 0.1], [0.3, 0.7]])
    for i in range(13):
        step = (0.1, np.array([0.2, -0.1]) * (i + 1))
        assert np.allclose(sums(step), mixing._sums(n, p, rate, step), rtol=1e-9)
        rate = mixing.taken(p, rate, [step])
    assert len(writes) == 2  # after 2 and 6 steps; before, after every second one
