"""Language ID by rank-order profiles (out-of-place distance).

A language's profile is its most frequent character n-grams (1 to 3, words padded by a space) in rank order. A
document's own most frequent n-grams are compared with each profile: each adds the difference of the two ranks, or
the full profile length if the profile lacks it. The least sum names the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.tables import only, with_hot, written

UNKNOWN = "und"
#: Ranks of a language's profile, and of a document.
PROFILE = 800
DOCUMENT = 400
#: Rows of a language that its profile is learned from at most: those with the least hash of doc_id and text.
SAMPLE = 2000
#: Languages whose sizes may be broadcast; beyond it only those of hot ones are.
BROADCAST_LANGUAGES = 1 << 16
#: Rows whose n-grams are held at once.
COUNTED = 512
#: Characters that are worked on at once within one document; counts do not depend on it.
PIECE = 1 << 20
_CHARACTER = np.uint64(21)  # bits


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) of a whole text, sorted by n-gram; digits, marks and other non-letters count as one space.

    An n-gram is the number that its characters make, 21 bits each, so different ones stay different."""
    text, parts = text.lower(), []
    before = np.array([32], np.uint64)
    for k in range(0, max(1, len(text)), PIECE):
        code = np.frombuffer(text[k : k + PIECE].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        code = np.concatenate([before, np.where(_letters(code), code, 32).astype(np.uint64), [] if k + PIECE < len(text) else [32]]).astype(np.uint64)
        one = np.append(True, (code[1:] != 32) | (code[:-1] != 32))  # one space for several
        one[: len(before)] = True
        code, held = code[one], len(before)
        two = code[:-1] << _CHARACTER | code[1:]
        three = two[:-1] << _CHARACTER | code[2:]
        # n-grams that end in this piece
        values = np.concatenate([code[held:][code[held:] != 32], two[held - 1 :], three[max(0, held - 2) :]])
        values.sort()
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        parts.append((values[starts], np.diff(np.append(starts, len(values)))))
        before = code[-2:]
    if len(parts) == 1:
        return parts[0]
    found, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return found, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)


_LETTER = np.zeros(0x110000, bool)


def _letters(code: np.ndarray) -> np.ndarray:
    if not _LETTER.any():
        _LETTER[:] = [chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)]
    return _LETTER[code]


def ranked(found: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by n-gram."""
    apart = counts.max(initial=0) - counts
    if len(apart) and apart.max() < 1 << 16:
        apart = apart.astype(np.uint16)  # sorted by counting
    return found[np.argsort(apart, kind="stable")[:most]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, COUNTED) for b in batches for k in range(0, b.num_rows, COUNTED)):
        by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found, counts = grams(text)
            # a document's share, so that a very long one does not make the profile
            by_lang.setdefault(lang, []).append((found, counts * (2.0**40 / max(1, counts.sum()))))
        for lang, parts in by_lang.items():
            found, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([n for _, n in parts]), len(found))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()), "gram": pa.array(found.view(np.int64)), "n": pa.array(np.round(total).astype(np.int64))})


class Profiles:
    """The languages' n-grams with their ranks, as lists by n-gram."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        """rows: (lang, gram, rank)."""
        self.names = sorted({lang for lang, _, _ in rows})
        number = {lang: k for k, lang in enumerate(self.names)}
        gram = np.array([g for _, g, _ in rows], np.int64).view(np.uint64)
        by = np.argsort(gram, kind="stable")
        self.grams, first = np.unique(gram[by], return_index=True)
        self.starts = np.append(first, len(gram))
        self.langs = np.array([number[lang] for lang, _, _ in rows], np.int64)[by]
        self.ranks = np.array([r for _, _, r in rows], np.int64)[by]

    def judge(self, text: str | None) -> tuple[str, float]:
        """(language, score): 1 less the distance's share of the greatest possible one; (und, 0) without letters."""
        if not text or not self.names:
            return UNKNOWN, 0.0
        best = ranked(*grams(text), DOCUMENT)
        if not len(best):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, best), len(self.grams) - 1)
        place = np.flatnonzero(self.grams[at] == best)
        at = at[place]
        n = self.starts[at + 1] - self.starts[at]
        rows = np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        # an n-gram that a profile lacks adds PROFILE to its distance, another one the difference of the ranks
        near = np.bincount(self.langs[rows], PROFILE - np.abs(self.ranks[rows] - np.repeat(place, n)), len(self.names))
        k = int(near.argmax())
        return self.names[k], float(near[k] / (PROFILE * len(best)))


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """At most so many different rows (lang, text, h) of a language, those of the least h."""
    # a cut that about 2 * most rows pass, so that the exact cut sorts few rows
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("n")))
    share = F.least(F.lit(1.0), F.lit(2.0 * most) / F.col("n")).alias("share")
    if sizes.count() <= BROADCAST_LANGUAGES:
        sized = rows.join(F.broadcast(sizes.select("lang", share)), "lang")
    else:
        sized = with_hot(rows, sizes.select("lang", share, "n"), "lang", sizes.agg(F.sum("n")).head()[0])
    first = written(sized.where(F.pmod("h", F.lit(1 << 30)) <= (1 << 30) * F.col("share")).select("lang", "text", "h"))
    last = first.groupBy("lang").agg(F.get(F.sort_array(F.collect_set("h")), F.lit(most)).alias("last"))
    return first.join(last, "lang").where("last is null or h < last")


def learn(labelled: DataFrame, most: int | None = SAMPLE) -> Profiles:
    """Profiles of the languages of labelled (lang, text; doc_id if there is one).

    Learns from at most ``most`` different rows of a language, those of the least hash, or from all rows; what comes to the driver is at most
    PROFILE n-grams a language. Rows without a language or a text teach nothing; nor do texts without letters."""
    key = [c for c in ("doc_id", "text") if c in labelled.columns]
    rows = labelled.select(labelled["lang"].cast("string").alias("lang"), labelled["text"].cast("string").alias("text"), F.xxhash64(*[labelled[c] for c in key]).alias("h")).where("lang is not null and text is not null")
    sample = (rows if most is None else _drawn(rows, most)).select("lang", "text")
    totals = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = totals.withColumn("rank", rank).where(F.col("rank") <= PROFILE)
    return Profiles([(r["lang"], r["gram"], r["rank"] - 1) for r in top.collect()])


def _predict(learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [learned.value.judge(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), *batch.columns[2:]], ["doc_id", "lang_pred", "score", *batch.schema.names[2:]])

    return run


def predict(docs: DataFrame, profiles: Profiles, *keep: str) -> DataFrame:
    """doc_id, lang_pred, score and the columns ``keep`` of every row of docs (doc_id, text).

    A null text or one without a letter is ``und`` with score 0, as is every text if no language was learned. Ties go to
    the language first in the alphabet. Whole texts count, of any length. Rows come back one for one, also repeated ones and those
    without a doc_id; an empty table gives an empty one. Further columns, whatever their names, are ignored. No shuffle.
    """
    learned = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"), *[docs[c].alias(f"kept_{k}") for k, c in enumerate(keep)])
    schema = "doc_id " + kept.schema["doc_id"].dataType.simpleString() + ", lang_pred string, score double" + "".join(f", kept_{k} {kept.schema[f'kept_{k}'].dataType.simpleString()}" for k in range(len(keep)))
    out = kept.mapInArrow(_predict(learned), schema)
    return out.withColumnsRenamed({f"kept_{k}": c for k, c in enumerate(keep)})


def learned_from(docs: DataFrame) -> DataFrame:
    """The rows that may teach: those with a doc_id that is not held out."""
    return docs.where(docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang), by what the rows that are not held out teach.

    Odd rows are as in ``predict``; a row without a doc_id is not held out, and teaches nothing. A text that comes repeatedly, under one
    doc_id or several, gets one answer each time.
    """
    docs = only(docs, doc_id="long", text="string", lang="string")
    found = predict(docs, learn(learned_from(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
