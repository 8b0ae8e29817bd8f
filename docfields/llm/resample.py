"""Importance resampling towards a target distribution: the documents whose n-grams are likelier under the target are likelier drawn.

Every text is folded, its separators are collapsed to single spaces, and overlapped matches between word boundaries give the n-grams as
spans of the text, which are counted by the CRC of their bytes in a fixed number of buckets. A bucket's gain is the logarithm of its
smoothed frequency in the target over that in the documents. A document's weight is the sum of its gains, and Gumbel noise from a hash of
its id turns the greatest sums into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.tables import numbered, only, written

BUCKETS = 10_000
SEED = 2024
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
PERCENT = 10
#: What is no word: ASCII but for digits and letters, turned into spaces; capitals turn small. Line breaks part the documents.
_SMALL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_SEPARATORS = regex.compile(rb"  +")
#: Bytes of texts that are matched in one go; a longer text is one of its own.
PIECE = 1 << 20
#: Matches that are taken at once.
BLOCK = 1 << 18
#: CRCs of n-grams up to so many bytes are computed side by side, one byte of each at a time.
SHORT = 48
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ 0xEDB88320, _CRC >> 1).astype(np.uint32)


def pattern(n: int) -> regex.Pattern:
    """Matches runs of n words in collapsed text; with overlapped=True one begins at every word that has n - 1 after it."""
    return regex.compile(rb"(?<![^ \n])[^ \n]+(?: [^ \n]+){%d}(?![^ \n])" % (n - 1))


def collapsed(texts: list[bytes | None]) -> bytes:
    """The texts' words with one space between them, each text on a line of its own."""
    return _SEPARATORS.sub(b" ", b"\n".join([(t or b"").translate(_SMALL) for t in texts] + [b""]))


def crcs(data: bytes, spans: np.ndarray) -> np.ndarray:
    """The CRC-32 of every span (start, end) of the data."""
    sizes = spans[:, 1] - spans[:, 0]
    out = np.empty(len(spans), np.uint32)
    by = np.argsort(-sizes, kind="stable")
    longer = int(np.searchsorted(-sizes[by], -SHORT))
    for k in by[:longer]:
        out[k] = zlib.crc32(data[spans[k, 0] : spans[k, 1]])
    by = by[longer:]
    starts, ordered, raw = spans[by, 0], -sizes[by], np.frombuffer(data, np.uint8)
    crc = np.full(len(by), 0xFFFFFFFF, np.uint32)
    for k in range(SHORT):
        n = int(np.searchsorted(ordered, -k))  # longer than k
        if not n:
            break
        crc[:n] = _CRC[(crc[:n] ^ raw[starts[:n] + k]) & 0xFF] ^ crc[:n] >> 8
    out[by] = ~crc
    return out


def buckets(texts: list[bytes | None], patterns: list[regex.Pattern]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's number of words, and its n-grams' buckets, repeats included, sorted; the first pattern's n-grams are the words."""
    data = collapsed(texts)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    words, keys = np.zeros(len(texts), np.int64), []
    for k, own in enumerate(patterns):
        matches = own.finditer(data, overlapped=True)
        while len(spans := np.array([m.span() for m in islice(matches, BLOCK)], np.int64)):
            owner = np.searchsorted(ends, spans[:, 0])
            if k == 0:
                words += np.bincount(owner, minlength=len(texts))
            keys.append(owner * BUCKETS + crcs(data, spans) % BUCKETS)
    key = np.sort(np.concatenate([np.zeros(0, np.int64), *keys]))
    cuts = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
    return words, [(key[a:b] % BUCKETS).astype(np.uint16) for a, b in zip(cuts[:-1], cuts[1:])]


def _pieces(texts: pa.Array) -> Iterator[list[bytes | None]]:
    held, size = [], 0
    for t in texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary()):
        own = t.as_py()
        if held and size + len(own or b"") > PIECE:
            yield held
            held, size = [], 0
        held.append(own)
        size += len(own or b"")
    if held:
        yield held


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [pattern(k) for k in range(1, n + 1)]
        for batch in batches:
            done = 0
            for texts in _pieces(batch.column(1)):
                words, found = buckets(texts, patterns)
                columns = [batch.column(0).slice(done, len(texts)), pa.array(words, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "buckets"])
                done += len(texts)

    return run


def grams(docs: DataFrame, n: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and buckets (16-bit numbers, sorted) of the n-grams of 1 to n words of every row of (doc_id, text)."""
    return only(docs, doc_id="long", text="string").mapInArrow(_grams(n), "doc_id long, n_words long, n_features long, buckets binary")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.bincount(np.frombuffer(x.as_buffer(), np.uint16), minlength=BUCKETS)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(BUCKETS, dtype=np.int32)), "n": pa.array(total)})


def bucket_counts(found: DataFrame) -> np.ndarray:
    """n-grams by bucket over all rows; a task adds up its own, so that BUCKETS numbers reach the driver."""
    out = np.zeros(BUCKETS, np.int64)
    for r in found.select("buckets").mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target frequency / source frequency)) by bucket, each count one more than it is."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def _weights(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(sent.value[np.frombuffer(x.as_buffer(), np.uint16)].sum()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return run


def draw(docs: DataFrame, target: DataFrame, n: int = 1, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text); target: text. Undrawn rows have no rank.

    Drawn are percent hundredths, rounded down, of the rows with at least least_words words: those with the highest scores, ties to the
    smaller doc_id. Null and empty texts have no features, weight 0 and the score of their noise alone. Rows come back one for one: repeated
    ones each have a rank of their own, in either order; those of one doc_id share their noise, and those without one share that of the
    empty text and come last in a tie. An empty table gives an empty one; an empty target has all gains by the documents alone. Texts
    of any length count whole. Further columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    found = written(grams(docs, n))
    gain = gains(bucket_counts(found), bucket_counts(grams(target.select(F.lit(0).alias("doc_id"), target["text"]), n)))
    weighed = found.mapInArrow(_weights(spark.sparkContext.broadcast(gain)), "doc_id long, n_words long, n_features long, weight long")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    scored = written(weighed.select("doc_id", "n_features", "weight", score.alias("score"), (F.col("n_words") >= least_words).alias("may")))
    drawn = scored.where("may").count() * percent // 100
    columns = ("doc_id", "n_features", "weight", "score")
    ranked = numbered(scored.where("may").select(*columns), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features"))
    rank = F.when(F.col("number") <= drawn, F.col("number"))
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.where("not may").select(*columns, F.lit(None).cast("long").alias("rank")))
