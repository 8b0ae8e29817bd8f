"""Toxicity by a convolutional text classifier in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first bytes. Filters of several widths run
over the whole text, the greatest response of each is kept, and a logistic layer weighs them. All labelled rows teach: each round
shards of them are fitted by a task each, from the same start, and the nets are averaged. Score thresholds
are calibrated by language (as language ID predicts it from the text): scores are rescaled in each so that its best
threshold falls on 0.3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm import language
from docfields.llm import text as T
from docfields.llm.shards import averaged, dealt, with_marks
from docfields.llm.tables import only, written

THRESHOLD = 0.3
BUCKETS = 1 << 14
PREFIX = 5
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 4
#: Labelled rows of a shard and their words, about.
SHARD = 4096
SHARD_WORDS = 1 << 21
#: Rounds, after each of which the shards' nets are averaged, and passes over a shard in each.
ROUNDS = 2
EPOCHS = 4
#: A label's rows count so much more than the other's at most, however rare they are.
MOST_WEIGHT = 8
#: Steps of the log odds that scores are counted in for the thresholds, by unit.
BINS = 64
#: Positive rows of a language that a threshold of its own needs.
OWN_THRESHOLD = 8


def held_out(doc_id: Column) -> Column:
    return language.held_out(doc_id, 4, 2)


def _padded(words: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and prefix buckets with max(WIDTHS) pads (bucket BUCKETS) after each document, and where each begins."""
    pads = max(WIDTHS)
    counts = np.diff(words.first)
    starts = words.first[:-1] + pads * np.arange(words.docs)
    at = np.arange(int(words.first[-1])) + pads * np.repeat(np.arange(words.docs), counts)
    out = np.full((2, int(words.first[-1]) + pads * words.docs), BUCKETS, np.int32)
    out[0, at] = words.hashes % np.uint64(BUCKETS)
    out[1, at] = words.prefixes % np.uint64(BUCKETS)
    return out[0], out[1], starts


class Net:
    """Embeddings (2, BUCKETS + 1, SIZE), filters by width (width, SIZE, FILTERS) with bias, and a logistic layer."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.1, (2, BUCKETS + 1, SIZE)).astype(np.float32), "v": np.full(FILTERS * len(WIDTHS), 0.5, np.float32), "c": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["e"][:, BUCKETS] = 0

    def tables(self) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For every width and place: what a word and a prefix add to the filters' responses."""
        return [[tuple(self.p["e"][k] @ self.p[f"f{w}"][o] for k in range(2)) for o in range(w)] for w in WIDTHS]

    def pooled(self, tables, words: np.ndarray, prefixes: np.ndarray, starts: np.ndarray, where: bool = False):
        """The filters' greatest responses by document and, with ``where``, their places."""
        pads = max(WIDTHS) - 1  # so many places fewer begin a window that lies within the array
        tops, places = [], []
        for w, own in zip(WIDTHS, tables):
            n = len(words) - pads
            x = own[0][0][words[:n]] + own[0][1][prefixes[:n]]
            for o in range(1, w):
                x += own[o][0][words[o : o + n]]
                x += own[o][1][prefixes[o : o + n]]
            x[words[:n] == BUCKETS] = -9
            top = np.maximum.reduceat(x, starts) if len(starts) else np.zeros((0, FILTERS), np.float32)
            tops.append(top)
            if where:
                owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
                rows, columns = np.nonzero(x == top[owner])
                place = np.zeros(top.shape, np.int64)
                place[owner[rows[::-1]], columns[::-1]] = rows[::-1]
                places.append(place)
        x = np.concatenate([t + self.p[f"b{w}"] for w, t in zip(WIDTHS, tops)], 1)
        return np.maximum(x, 0), x > 0, places

    def raw(self, words: T.Words, tables=None) -> np.ndarray:
        """Probabilities by document."""
        if not words.docs:
            return np.zeros(0)
        a, b, starts = _padded(words)
        x, _, _ = self.pooled(tables or self.tables(), a, b, starts)
        return 1 / (1 + np.exp(-np.clip(x @ self.p["v"] + self.p["c"], -30, 30).astype(np.float64)))

    def prime(self, counts: np.ndarray, total: np.ndarray) -> None:
        """Start the first dimension from each bucket's smoothed log odds, and the filters from that dimension.

        counts: (2, 2, BUCKETS), documents with the bucket by word or prefix and by label; total: documents by label."""
        total = np.maximum(1, total)
        for k in range(2):
            odds = np.log((counts[k, 1] + 1) / (total[1] + 2)) - np.log((counts[k, 0] + 1) / (total[0] + 2))
            self.p["e"][k, :BUCKETS, 0] += 0.3 * np.clip(odds, -3, 6)
        for w in WIDTHS:
            self.p[f"f{w}"][0, 0] += 0.5

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def put(self, flat: np.ndarray) -> Net:
        at = 0
        for k in sorted(self.p):
            self.p[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size
        return self

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, number: int = 0) -> None:
        """One round (by number) of Adam on the log loss, both labels weighed alike, in batches of 32 documents; the gradient runs through the places of the maxima."""
        rng = np.random.default_rng(7 + number)
        share = np.maximum(1, np.bincount(labels.astype(int), minlength=2)) / len(labels)
        weight = np.minimum(1 / share, MOST_WEIGHT / share.max())[labels.astype(int)] / 2
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        pad = np.full(max(WIDTHS), BUCKETS, np.int32)
        step = 0
        for epoch in range(number * EPOCHS, (number + 1) * EPOCHS):
            rate = 0.01 * (1 - epoch / (ROUNDS * EPOCHS))
            for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 32)):
                a, b = (np.concatenate([x for d in batch for x in (docs[d][k], pad)]).astype(np.int32) for k in range(2))
                starts = np.concatenate([[0], np.cumsum([len(docs[d][0]) + len(pad) for d in batch])])[:-1]
                drop = rng.random(len(a)) < 0.1
                a, b = np.where(drop & (a != BUCKETS), 0, a), np.where(drop & (b != BUCKETS), 0, b)
                x, active, places = self.pooled(self.tables(), a, b, starts, where=True)
                guess = 1 / (1 + np.exp(-np.clip(x @ self.p["v"] + self.p["c"], -30, 30)))
                error = ((guess - labels[batch]) * weight[batch] / len(batch)).astype(np.float32)
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                grads["v"] = x.T @ error
                grads["c"][0] = error.sum()
                back = np.where(active, error[:, None] * self.p["v"], 0)
                for i, w in enumerate(WIDTHS):
                    own, place = back[:, i * FILTERS : (i + 1) * FILTERS], places[i]
                    grads[f"b{w}"] = own.sum(0)
                    for o in range(w):
                        at = np.minimum(place + o, len(a) - 1)
                        for k, ids in enumerate((a[at], b[at])):
                            grads[f"f{w}"][o] += np.einsum("dfs,df->sf", self.p["e"][k][ids], own)
                            np.add.at(grads["e"][k], ids, own[:, :, None] * self.p[f"f{w}"][o].T[None])
                grads["e"][:, BUCKETS] = 0
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                self.p["e"][:, BUCKETS] = 0


def best_threshold(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The middle of the gap in which F1 is best, between steps of scores: each with its least and greatest score, its rows and the positive ones of them."""
    by = np.argsort(-low, kind="stable")
    low, high = low[by], high[by]
    k = int(np.argmax(2 * np.cumsum(hits[by]) / (np.cumsum(n[by]) + max(1, hits.sum()))))
    return float((low[k] + (high[k + 1] if k + 1 < len(low) else 0)) / 2)


def rescale(scores: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Monotone on [0, 1], with the cut at THRESHOLD."""
    cut = np.clip(cut, 1e-6, 1 - 1e-6)
    return np.where(scores < cut, THRESHOLD * scores / cut, THRESHOLD + (1 - THRESHOLD) * (scores - cut) / (1 - cut))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in T.pieces(batch.column(0), prefix=PREFIX):
            a, b = ((h % np.uint64(BUCKETS)).astype(np.uint16) for h in (words.hashes, words.prefixes))
            cuts = list(zip(words.first[:-1], words.first[1:]))
            rest = [c.slice(words.row, words.docs) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i:j].tobytes() for i, j in cuts], pa.binary()) for x in (a, b)] + rest, ["words", "prefixes", *batch.schema.names[1:]])


class Model:
    """A net, thresholds by language and the language profiles."""

    def __init__(self, net: Net, cuts: dict[str, float], cut: float, profiles: language.Profiles):
        self.net, self.cuts, self.cut, self.profiles = net, cuts, cut, profiles

    def score(self, texts: pa.Array) -> np.ndarray:
        tables, out = self.net.tables(), []
        for words in T.pieces(texts, prefix=PREFIX):
            raw = self.net.raw(words, tables)
            near = np.flatnonzero(raw >= 1e-3)  # a language's cut is above it; below, the order of scores is all
            cut = np.full(len(raw), max(1e-3, self.cut))
            for d in near.tolist():
                cut[d] = self.cuts.get(self.profiles.judge(texts[words.row + d].as_py())[0], self.cut)
            out.append(rescale(raw, cut))
        return np.concatenate(out) if out else np.zeros(0)


def _docs(columns: list[pa.ChunkedArray] | list[pa.Array]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(a.as_py(), np.uint16), np.frombuffer(b.as_py(), np.uint16)) for a, b in zip(*columns)]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task that have a bucket, by (word or prefix, label, bucket) as one number."""
    counts = np.zeros((2, 2, BUCKETS), np.int64)
    for batch in batches:
        for doc, y in zip(_docs(batch.columns[:2]), batch.column(2).to_pylist()):
            for k in range(2):
                counts[k, y, np.unique(doc[k])] += 1
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(slots.astype(np.int32)), "n": pa.array(counts.ravel()[slots])})


def _fitted(sent, number: int):
    def run(table: pa.Table) -> np.ndarray:
        net = Net().put(sent.value)
        net.fit(_docs([table.column("words"), table.column("prefixes")]), table.column("toxic").to_numpy().astype(np.float64), number)
        return net.flat()

    return run


def train(labelled: DataFrame) -> Model:
    """Fit on all rows of labelled (doc_id, text, toxic, lang) but those that ``calibrate`` takes; lang only names the languages that thresholds are calibrated for.

    Without both labels the model scores 0 everywhere. What comes to the driver is counts by bucket and GROUPS nets a round."""
    rows = only(labelled, doc_id="long", text="string", toxic="int", lang="string").where("toxic in (0, 1)").withColumn("h", F.xxhash64("text")).where("pmod(h, 4) != 3")
    held = written(rows.select("text", "toxic", F.xxhash64("doc_id", "h").alias("k")).mapInArrow(_features, "words binary, prefixes binary, toxic int, k long"))
    profiles = language.learn(labelled, None)
    sizes = {r["toxic"]: r for r in held.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("words") / 2).alias("words")).collect()}
    net = Net()
    if set(sizes) != {0, 1}:
        net.p["c"][0] = -9
        return Model(net, {}, 0.5, profiles)
    counts = np.zeros(4 * BUCKETS)
    for r in held.select("words", "prefixes", "toxic").mapInArrow(_met, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    net.prime(counts.reshape(2, 2, BUCKETS), np.array([sizes[y]["n"] for y in (0, 1)]))
    shards = int(max(-(-sum(r["n"] for r in sizes.values()) // SHARD), sum(r["words"] for r in sizes.values()) // SHARD_WORDS))
    rows = dealt(held, "toxic", {y: r["n"] for y, r in sizes.items()}, shards)
    for number in range(ROUNDS):
        net.put(averaged(rows, shards, _fitted(held.sparkSession.sparkContext.broadcast(net.flat()), number)))
    return Model(net, {}, 0.5, profiles)


def calibrate(model: Model, labelled: DataFrame) -> Model:
    """Thresholds by predicted language, from the rows that ``train`` leaves out; their scores are counted in steps of the log odds."""
    rows = only(labelled, text="string", toxic="int").where("toxic in (0, 1)").withColumn("h", F.xxhash64("text")).where("pmod(h, 4) = 3")
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts, tables = batch.column(0).fill_null(""), own.net.tables()
            raw = np.concatenate([own.net.raw(w, tables) for w in T.pieces(texts, prefix=PREFIX)]) if len(texts) else np.zeros(0)
            langs = [own.profiles.judge(t.as_py())[0] for t in texts]
            step = np.floor(BINS * (np.log(raw) - np.log1p(-raw))).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"raw": pa.array(raw), "step": pa.array(step), "lang": pa.array(langs, pa.string()), "toxic": batch.column(1)})

    scores = rows.select("text", "toxic").mapInArrow(judged, "raw double, step int, lang string, toxic int")
    found = scores.groupBy("lang", "step").agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.count("*").alias("n"), F.sum("toxic").alias("hits")).toPandas()
    if not 0 < found["hits"].sum() < found["n"].sum():
        return model
    cut = lambda steps: max(2e-3, best_threshold(*(steps[c].to_numpy() for c in ("low", "high", "n", "hits"))))
    model.cut = cut(found.groupby("step", as_index=False).agg({"low": "min", "high": "max", "n": "sum", "hits": "sum"}))
    for lang, own in found.groupby("lang"):
        if OWN_THRESHOLD <= own["hits"].sum() < own["n"].sum():
            model.cuts[lang] = cut(own)
    return model


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1)))], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.3) of every row of docs (doc_id, text, lang).

    labels (doc_id, toxic): learned from where not held out; of several rows of a document the greatest label counts, null labels and
    labels without a doc_id teach nothing. Null and empty texts have a score too, and texts of any length are scored whole. Rows come back
    one for one, also repeated ones, and alike for equal texts; a row without a doc_id is not held out. An empty table gives an empty one;
    without both labels every score is near 0. Further columns, whatever their names, are ignored. Scoring does not shuffle.
    """
    docs = only(docs, doc_id="long", text="string", lang="string")
    marks = only(labels, doc_id="long", toxic="int").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = with_marks(docs, marks)
    sent = docs.sparkSession.sparkContext.broadcast(calibrate(train(labelled), labelled))
    found = docs.select("doc_id", "text").mapInArrow(_score(sent), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
