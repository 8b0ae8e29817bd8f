"""The pipeline's stages on odd rows, each against a plain loop over its input."""

import random
import re
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, own long, component string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(12)
    words = {"en": "the of and to in that is was for with".split(), "de": "der die und ist nicht das ein mit auf sich".split()}
    out = []
    for k in range(120):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choice(words[lang]) + str(rng.randrange(60)) * rng.randrange(2) for _ in range(rng.choice([3, 12, 60, 150])))
        out += [(rng.choice([k, k, k, 5, None]), text, lang, f"s{k % 3}", len(text))] * rng.choice([1, 1, 1, 2, 3])
    out += [(5, out[9][1], "en", "s1", 1), (None, out[9][1], "en", "s2", 1), (None, out[9][1], "en", "s2", 1), (9000, out[9][1], "en", None, None)]
    out += [(7, None, "en", "s", 0), (None, None, None, None, None), (8, "", "en", "s", 0), (8, "", "en", "s", 0), (8, " \n", "en", "s", 2), (3, "12 34", "de", "s", 5)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in rows()], SCHEMA).repartition(4)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_copies(spark, docs):
    import corpus_pipeline as C

    given = rows()
    sets = [shingles(r[1]) for r in given]
    part = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and part[i] != part[j]:
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    found = collected(C.near_copies(spark, docs, ""))
    assert len(found) == len({p for p, s in zip(part, sets) if s}) + sum(not s for s in sets)
    groups = {}
    for p, s, r in zip(part, sets, given):
        if s:
            groups.setdefault(p, []).append(r)
    for members in groups.values():
        ids = [r[0] for r in members if r[0] is not None]
        (stays,) = [r for r in found if r in members]
        assert stays[0] == (min(ids) if ids else None)
    assert [r for r in found if not shingles(r[1])] == sorted((r for r, s in zip(given, sets) if not s), key=str)


def test_language_id(spark, docs):
    import corpus_pipeline as C
    from docfields.llm import language

    profiles = language.learn(language.learned_from(docs))
    judged = [(r, *profiles.judge(r[1])) for r in rows()]
    assert collected(C.language_id(spark, docs, "")) == sorted((r for r, lang, score in judged if lang != "und" and score >= C.LEAST_SCORE), key=str)
    assert not any(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in map(tuple, language.learned_from(docs).collect()))


def test_repeated_passages(spark, docs):
    import collections

    import corpus_pipeline as C

    given = [(*r[:1], r[1], *r[2:4]) for r in rows()]
    words = [WORD.findall(r[1] or "") for r in given]
    count = collections.Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    expected = []
    for r, w in zip(given, words):
        gone = set()
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        if kept:
            expected.append((r[0], kept, r[2], r[3], len(kept)))
    assert collected(C.repeated_passages(spark, docs, "")) == sorted(expected, key=str)


def test_mixing_and_tokens(spark, docs, tmp_path):
    import corpus_pipeline as C
    from docfields.llm.tokens import vocabulary
    from tokenizers import Tokenizer

    labels = [(k, k % 2, int(k % 9 == 0)) for k in range(0, 120, 2)] + [(3, None, None), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mixed = C.mixed(spark, docs, str(tmp_path))
    assert mixed.columns == C.COLUMNS and {tuple(r) for r in mixed.collect()} <= set(rows())
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert collected(C.mixed(spark, docs, f"{tmp_path}/none")) == sorted(rows(), key=str)
    tokenizer = Tokenizer.from_file(vocabulary())
    expected = []
    for r in rows():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        expected.append((r[0], r[2], r[3], len(ids), ids, tokenizer.decode(ids, skip_special_tokens=False)))
    assert collected(C.tokens(spark, docs, "")) == sorted(expected, key=str)


def test_empty_tables(spark, docs, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
