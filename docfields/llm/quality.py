"""Quality by Bradley-Terry scores: a document is preferred to another with the chance sigmoid(score - score').

Scores are linear in features of the whole text, so a preference pair is one row of feature differences, and the logistic loss
over pairs fits the weights. The pairs set a document of label 1 before one of label 0. All labelled rows teach: shards of them are
fitted each by a task, and the weights are their mean. The threshold is the quantile of the scores of labelled rows kept apart that
leaves as many below it as label 0 has; it falls on 0.3.

Features, as square roots of shares: of every byte; of words by shape (kinds of the first and the last two bytes, and length); of hashed
words; and of words that repeat one of the words just before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm import language
from docfields.llm import text as T
from docfields.llm.shards import averaged, dealt, with_marks
from docfields.llm.tables import only, written

THRESHOLD = 0.3
#: Buckets of hashed words, kinds of shapes (5 * 5 * 5 kinds of bytes, short or long), and the bytes that a long word has more than.
WORDS = 1 << 12
SHAPES = 250
LONG = 12
#: A word counts as repeated if it is one of so many words before it: one feature a distance.
LAGS = 4
SIZE = 256 + SHAPES + WORDS + LAGS + 1
#: Documents whose features are held at once.
ROWS = 512
#: Labelled rows of a shard, about.
SHARD = 4096
#: Preference pairs an epoch, if rows are few; else each row is in one at least. And epochs.
PAIRS = 1 << 12
EPOCHS = 30
RIDGE = 1e-4
#: The share of the labelled rows that only places the threshold, one in so many by hash of the text.
APART = 4
#: Scores are counted in so many steps for the threshold.
BINS = 1 << 14


def held_out(doc_id: Column) -> Column:
    return language.held_out(doc_id, 5, 0)


#: Classes of bytes for a word's shape: other ASCII marks, digits, small letters, capitals, bytes of other characters.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x30:0x3A], _CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x80:] = 1, 2, 3, 4


def _frequencies(data: np.ndarray) -> np.ndarray:
    """The share of every byte, in pieces of bounded size."""
    total = sum((np.bincount(data[k : k + T.PIECE_BYTES], minlength=256) for k in range(0, len(data), T.PIECE_BYTES)), np.zeros(256))
    return total / max(1, len(data))


def features(words: T.Words, bounds: np.ndarray) -> np.ndarray:
    """(documents, SIZE) of a piece; ``bounds`` are the documents' bounds in its bytes. A document without text has next to none."""
    n, count = words.docs, np.diff(words.first)
    owner = np.repeat(np.arange(n), count)
    x = np.zeros((n, SIZE), np.float32)
    for d in range(n):
        x[d, :256] = _frequencies(words.data[bounds[d] : bounds[d + 1]])
    if len(owner):

        def shares(kind: np.ndarray, kinds: int) -> np.ndarray:
            return np.bincount(owner * kinds + kind, minlength=n * kinds).reshape(n, kinds) / np.maximum(count, 1)[:, None]

        first, last, before = (_CLASS[words.data[k]] for k in (words.starts, words.ends - 1, np.maximum(words.ends - 2, words.starts)))
        shape = ((first * 5 + last) * 5 + before).astype(np.int64) * 2 + (words.ends - words.starts > LONG)
        x[:, 256 : 256 + SHAPES] = shares(shape, SHAPES)
        x[:, 256 + SHAPES : 256 + SHAPES + WORDS] = shares((words.hashes % np.uint64(WORDS)).astype(np.int64), WORDS)
        for lag in range(1, LAGS + 1):
            same = (words.hashes[lag:] == words.hashes[:-lag]) & (owner[lag:] == owner[:-lag])
            x[:, SIZE - LAGS - 2 + lag] = np.bincount(owner[lag:][same], minlength=n) / np.maximum(count, 1)
    x[:, -1] = 1 / np.sqrt(np.maximum(count, 1))
    return np.sqrt(x)


def _pieces(texts: pa.Array) -> Iterator[np.ndarray]:
    """Features of up to ROWS documents at once, in order."""
    for k in range(0, len(texts), ROWS):
        own = texts.slice(k, ROWS)
        lengths = pc.binary_length(own.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)
        for words in T.pieces(own, fold=True):
            yield features(words, np.concatenate([[0], np.cumsum(lengths[words.row : words.row + words.docs])]))


class Model:
    """Weights of the features and the raw score that falls on THRESHOLD; without weights everything scores 0."""

    def __init__(self, weights: np.ndarray | None = None, cut: float = 0.0, scale: float = 1.0):
        self.weights, self.cut, self.scale = weights, cut, scale

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        raw = [x @ self.weights for x in _pieces(texts)]
        z = self.scale * ((np.concatenate(raw) if raw else np.zeros(0)).astype(np.float64) - self.cut)
        return 1 / (1 + np.exp(-np.clip(z + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def fit(x: np.ndarray, labels: np.ndarray, seed: int = 11) -> np.ndarray:
    """Weights by Adam on the logistic loss of pairs' feature differences, preferred minus other; every row is in a pair each epoch."""
    rng = np.random.default_rng(seed)
    good, poor = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    w, first, second, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    pairs = max(PAIRS, len(good), len(poor))
    drawn = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-pairs // len(rows)))])[:pairs]
    for epoch in range(EPOCHS):
        rate = 0.05 * (1 - epoch / EPOCHS)
        for better, worse in zip(np.array_split(drawn(good), pairs // 256), np.array_split(drawn(poor), pairs // 256)):
            difference = x[better] - x[worse]
            chance = 1 / (1 + np.exp(np.clip(difference @ w, -40, 40)))  # of the wrong order
            slope = RIDGE * w - difference.T @ chance / len(better)
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
            w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w


def threshold(scores: np.ndarray, labels: np.ndarray, share: float) -> float:
    """The quantile of the scores that leaves this share below it, in the middle between the two scores at its place.

    The rows of either label are weighed to that label's share, whatever their numbers are."""
    weight = np.where(labels == 0, share / max(1, (labels == 0).sum()), (1 - share) / max(1, (labels == 1).sum()))
    by = np.argsort(scores, kind="stable")
    return _quantile(scores[by], scores[by], weight[by], share)


def _quantile(low: np.ndarray, high: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The quantile of steps in order with their least and greatest score: in the middle between the step at its place and the next."""
    k = int(np.searchsorted(np.cumsum(weight), share * (1 - 1e-9)))
    k = min(k, len(weight) - 1)
    return float((high[k] + (low[k + 1] if k + 1 < len(low) else high[k])) / 2)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features that are not zero, as places and values."""
    for batch in batches:
        done = 0
        for x in _pieces(batch.column(0)):
            rest = [c.slice(done, len(x)) for c in batch.columns[1:]]
            own = [np.flatnonzero(r) for r in x]
            columns = [[i.astype(np.uint16).tobytes() for i in own], [r[i].astype(np.float16).tobytes() for r, i in zip(x, own)]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.binary()) for c in columns], *rest], ["at", "x", *batch.schema.names[1:]])
            done += len(x)


def _dense(at: pa.ChunkedArray | pa.Array, x: pa.ChunkedArray | pa.Array) -> np.ndarray:
    out = np.zeros((len(at), SIZE), np.float32)
    for row, i, v in zip(out, at, x):
        row[np.frombuffer(i.as_py(), np.uint16)] = np.frombuffer(v.as_py(), np.float16)
    return out


def _fitted(table: pa.Table) -> np.ndarray | None:
    y = table.column("quality").to_numpy()
    return fit(_dense(table.column("at"), table.column("x")), y) if 0 < y.sum() < len(y) else None


def _raw(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [_dense(*(c.slice(k, ROWS) for c in batch.columns[:2])) @ weights for k in range(0, batch.num_rows, ROWS)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(np.concatenate(raw) if raw else np.zeros(0))], ["quality", "raw"])

    return run


def train(labelled: DataFrame, share: float) -> Model:
    """Fit on all rows of labelled (doc_id, text, quality); share: of label 0 among all labels.

    What comes to the driver is the weights, and two counts for each of BINS steps of the scores."""
    h = F.xxhash64("text")
    rows = labelled.select("text", "quality", (F.pmod(h, F.lit(APART)) == 0).alias("apart"), F.xxhash64("doc_id", h).alias("k"))
    held = written(rows.mapInArrow(_rows, "at binary, x binary, quality int, apart boolean, k long"))
    sizes = {(r["apart"], r["quality"]): r["n"] for r in held.groupBy("apart", "quality").agg(F.count("*").alias("n")).collect()}
    if {y for _, y in sizes} != {0, 1}:
        return Model()
    if len(sizes) == 4:
        fitted, kept = held.where("not apart"), held.where("apart")
        own = {y: sizes[False, y] for y in (0, 1)}
    else:  # too few for a part of their own
        fitted = kept = held
        own = {y: sizes.get((False, y), 0) + sizes.get((True, y), 0) for y in (0, 1)}
    shards = -(-sum(own.values()) // SHARD)
    w = averaged(dealt(fitted.drop("apart"), "quality", own, shards), shards, _fitted).astype(np.float32)
    raw = written(kept.select("at", "x", "quality").mapInArrow(_raw(w.astype(np.float64)), "quality int, raw double"))
    low, high = raw.agg(F.min("raw"), F.max("raw")).head()
    step = F.floor((F.col("raw") - low) * (BINS / max(high - low, 1e-9)))
    found = raw.groupBy(step.alias("step")).agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("quality") == 1).alias("good")).toPandas().sort_values("step")
    lows, highs, poor, good = (found[c].to_numpy() for c in ("low", "high", "poor", "good"))
    spread = max(1e-6, _quantile(lows, highs, good / good.sum(), 0.5) - _quantile(lows, highs, poor / poor.sum(), 0.5))
    return Model(w, _quantile(lows, highs, share * poor / poor.sum() + (1 - share) * good / good.sum(), share), 12 / spread)


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1)))], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.3) of every row of docs (doc_id, text).

    labels (doc_id, quality): learned from where not held out; of several rows of a document the greatest label counts, null labels and
    labels without a doc_id teach nothing. Null and empty texts have a score too, and texts of any length are scored whole. Rows come
    back one for one, also repeated ones, and alike for equal texts; a row without a doc_id is not held out. An empty table gives an empty
    one; without both labels every score is 0. Further columns, whatever their names, are ignored. Scoring does not shuffle.
    """
    docs = only(docs, doc_id="long", text="string")
    marks = only(labels, doc_id="long", quality="int").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = with_marks(docs, marks)
    share = 1 - (marks.agg(F.avg("quality")).head()[0] or 0.0)
    sent = docs.sparkSession.sparkContext.broadcast(train(labelled, share))
    found = docs.mapInArrow(_score(sent), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
