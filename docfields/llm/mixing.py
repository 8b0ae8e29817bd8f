"""Mixing to target weights with soft membership.

A classifier learned from a labelled table gives each document a posterior over domains. Nonnegative document rates are
then fitted so that the expected tokens of each domain, S_k = sum of rate * tokens * posterior, match the targets b, as near to
one as that allows. A domain's miss counts relative to the tokens w_k that it holds, so rare domains are met like large ones:

    minimise  1/2 sum_k (S_k - b_k)^2 / w_k  +  ridge / 2 sum_d tokens_d (rate_d - 1)^2,   rate_d >= 0

The rates go down the gradient, preconditioned by tokens, and back to zero where they fall below it; two spectral step lengths
alternate (Barzilai and Borwein's, over the rates above zero). All a document needs for a step are the domains' misses, so its rate
follows from its posterior and the list of steps, and a step is one aggregation over the small table of posteriors. The first steps
are found on a bounded sample; all documents take them, and the steps go on over all of them until the gradient vanishes.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docfields.llm import text as T
from docfields.llm.tables import only, written

BUCKETS = 1 << 12
#: Labelled rows that the classifier is fitted on at most, those with the least hash of the id, and their greatest length.
SAMPLE = 3000
SAMPLE_CHARS = 50_000
#: Steps over all documents at most, and over the sample of documents that the first ones are found on.
STEPS = 400
START = 20_000
#: Weight of rates near one. A document purely of a domain with target 0 keeps RIDGE / (1 + RIDGE), whatever the domain's size.
RIDGE = 1e-4
#: Steps end when a projected step of length one would move no rate by more than this.
CLOSE = 1e-6
#: After so many steps the rates that they lead to are written, then after twice as many each time; before, they are taken again.
HELD_STEPS = 64


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in T.pieces(batch.column(0), fold=True):
            at = (words.hashes % np.uint64(BUCKETS)).astype(np.uint16)
            cut = [at[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), batch.column(1).slice(words.row, words.docs)], ["words", "domain"])


class Classifier:
    """Multinomial logistic regression on hashed words; the features are counts over the root of the length."""

    def __init__(self, domains: list[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.weights, self.bias = domains, weights, bias

    @classmethod
    def fit(cls, domains: list[str], docs: list[np.ndarray], labels: np.ndarray, steps: int = 200) -> Classifier:
        x = np.zeros((len(docs), BUCKETS), np.float32)
        for row, d in zip(x, docs):
            row += np.bincount(d, minlength=BUCKETS) / np.sqrt(max(1, len(d)))
        y = np.eye(len(domains), dtype=np.float32)[labels]
        w, b = np.zeros((BUCKETS, len(domains)), np.float32), np.log(np.maximum(y.mean(0), 1e-6))
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            guess = x @ w + b
            guess = np.exp(guess - guess.max(1, keepdims=True))
            guess /= guess.sum(1, keepdims=True)
            g = x.T @ (guess - y) / len(docs) + 1e-5 * w
            b = b - 0.1 * (guess - y).mean(0)
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            w = w - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        return cls(domains, w.astype(np.float32), b.astype(np.float64))

    def posteriors(self, words: T.Words) -> np.ndarray:
        """(documents, domains) of a piece; a document without words gets the bias alone."""
        total = np.zeros((len(words.hashes) + 1, len(self.domains)))
        np.cumsum(self.weights[words.hashes % np.uint64(BUCKETS)], axis=0, dtype=np.float64, out=total[1:])
        n = np.diff(words.first)
        logits = (total[words.first[1:]] - total[words.first[:-1]]) / np.sqrt(np.maximum(n, 1))[:, None] + self.bias
        out = np.exp(logits - logits.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)


def learn(docs: DataFrame, labelled: DataFrame) -> Classifier:
    """Fit on the texts of labelled (doc_id, domain); rows without a domain are left out. One domain alone is certain."""
    marks = only(labelled, doc_id="long", domain="string").where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = written(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    texts = docs.join(F.broadcast(chosen), "doc_id").where(f"length(coalesce(text, '')) <= {SAMPLE_CHARS}")
    ordered = texts.select("text", "domain", "doc_id").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(SAMPLE)
    rows = ordered.select("text", "domain").mapInArrow(_counts, "words binary, domain string").toPandas().sort_values(["domain", "words"])
    domains = sorted(rows["domain"].unique()) or ["all"]
    if len(domains) == 1:
        return Classifier(domains, np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    return Classifier.fit(domains, [np.frombuffer(w, np.uint16) for w in rows["words"]], rows["domain"].map(domains.index).to_numpy())


def _posteriors(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in T.pieces(batch.column(1), fold=True):
                p = sent.value.posteriors(words)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.row, words.docs), pa.array(np.diff(words.first)), column], ["doc_id", "n_tokens", "posterior"])

    return run


def posteriors(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_tokens (words) and posterior (array in the order of classifier.domains) of every row of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    return only(docs, doc_id="long", text="string").mapInArrow(_posteriors(sent), "doc_id long, n_tokens long, posterior array<double>")


#: A step: its length, and each domain's miss as a share of its own tokens.
Step = tuple[float, np.ndarray]


def _slope(posterior: np.ndarray, rate: np.ndarray, misses: np.ndarray) -> np.ndarray:
    return posterior @ misses + RIDGE * (rate - 1)


def taken(posterior: np.ndarray, rate: np.ndarray, steps: list[Step]) -> np.ndarray:
    """The rates after these steps."""
    for length, misses in steps:
        rate = np.maximum(0, rate - length * _slope(posterior, rate, misses))
    return rate


def rates_of(posterior: np.ndarray, steps: list[Step]) -> np.ndarray:
    return taken(posterior, np.ones(len(posterior)), steps)


def _sums(tokens: np.ndarray, posterior: np.ndarray, rate: np.ndarray, step: Step) -> np.ndarray:
    """What one step from ``rate`` brings: the domains' totals after it; over the rates that it leaves above zero, the tokens' moves by domain,
    tokens * posterior * posterior' and squared moves; and the greatest move of a projected step of length one."""
    new = taken(posterior, rate, [step])
    moves, free = new - rate, tokens * (new > 0)
    unit = np.abs(rate - taken(posterior, rate, [(1.0, step[1])]))[tokens > 0]
    return np.concatenate([(tokens * new) @ posterior, (free * moves) @ posterior, ((posterior * free[:, None]).T @ posterior).ravel(), [free @ moves**2, unit.max(initial=0)]])


def _descend(sums, targets: np.ndarray, weights: np.ndarray) -> tuple[list[Step], float]:
    """Steps until the gradient is CLOSE to nothing, and how close it is. ``sums(step)`` takes the step and returns its ``_sums``."""
    k, steps, length, off = len(targets), [], 1.0, np.inf
    now = sums((0.0, np.zeros(k)))[:k]
    for n in range(STEPS):
        misses = (now - targets) / weights
        found = sums((length, misses))
        after, moved, pairs, square = found[:k], found[k : 2 * k], found[2 * k : -2].reshape(k, k), found[-2]
        off = found[-1]
        if off <= CLOSE:
            break
        steps.append((length, misses))
        turn = (after - now) / weights
        along = turn @ moved + RIDGE * square
        across = turn @ pairs @ turn + 2 * RIDGE * (turn @ moved) + RIDGE**2 * square
        length = 1.0 if along <= 0 or across <= 0 else float(square / along if n % 2 else along / across)
        now = after
    return steps, float(off)


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _task_sums(steps: list[Step]):
    k = len(steps[-1][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * k + k * k + 2)
        for batch in batches:
            p, n = _matrix(batch.column(1), k), batch.column(0).to_numpy().astype(float)
            own = _sums(n, p, taken(p, batch.column(2).to_numpy(), steps[:-1]), steps[-1])
            total = np.append(total[:-1] + own[:-1], max(total[-1], own[-1]))
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(total.size, dtype=np.int32)), "part": pa.array(total)})

    return run


def _advanced(steps: list[Step], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = taken(_matrix(batch.column(1), k), batch.column(2).to_numpy(), steps)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rate)], ["n_tokens", "posterior", "rate"])

    return run


class _AllRows:
    """Steps over a table of members. From the rates that lie in a table, the steps since then are taken again; they are written after HELD_STEPS
    steps, then after twice as many as last time, so all rows are written a few times only, however many steps it takes."""

    def __init__(self, members: DataFrame, k: int, before: list[Step]):
        self.k, self.steps, self.until = k, [], HELD_STEPS
        self.held = members.select("n_tokens", "posterior", F.lit(1.0).alias("rate"))
        self._hold(before)

    def _hold(self, steps: list[Step]) -> None:
        if steps:
            self.held = written(self.held.mapInArrow(_advanced(steps, self.k), "n_tokens long, posterior array<double>, rate double"))

    def __call__(self, step: Step) -> np.ndarray:
        if len(self.steps) == self.until:
            self._hold(self.steps)
            self.steps, self.until = [], 2 * self.until
        self.steps.append(step)
        out = np.zeros(2 * self.k + self.k**2 + 2)
        for r in self.held.mapInArrow(_task_sums(self.steps), "place int, part double").groupBy("place").agg(F.sum("part").alias("sum"), F.max("part").alias("most")).collect():
            # the order in which tasks come in shows in later digits only
            out[r["place"]] = float(f"{r['sum' if r['place'] < len(out) - 1 else 'most']:.11e}")
        return out


def _first_steps(members: DataFrame, factors: np.ndarray) -> list[Step]:
    """Steps found on at most START members, those with the least hash of their row, to the same factors of what these hold."""
    keyed = members.where("n_tokens > 0").select("n_tokens", "posterior", F.xxhash64("doc_id", "n_tokens", "posterior").alias("h"))
    # a first cut that many more than START pass, so that few rows of each task go on
    share = min(1.0, 4 * START / max(1, keyed.count()))
    rows = keyed.where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy("h", "n_tokens").limit(START).toPandas().sort_values(["h", "n_tokens"])
    if rows.empty:
        return []
    n, p = rows["n_tokens"].to_numpy().astype(float), np.stack(rows["posterior"].to_numpy())
    held, rate = np.maximum(n @ p, 1.0), np.ones(len(n))

    def sums(step: Step) -> np.ndarray:
        nonlocal rate
        out = _sums(n, p, rate, step)
        rate = taken(p, rate, [step])
        return out

    return _descend(sums, factors * held, held)[0]


def fit_rates(members: DataFrame, factors: np.ndarray) -> list[Step]:
    """The steps to the fitted rates, for ``rates_of``; factors: the target of each domain as a multiple of the tokens it holds.

    members: doc_id, n_tokens and posterior. A step brings k * k + 2 * k + 2 sums for k domains to the driver. Warns if the projected gradient
    is not CLOSE to nothing after STEPS steps."""
    k = len(factors)
    first = _first_steps(members, factors)
    held = members.agg(*[F.sum(F.col("n_tokens") * F.col("posterior")[i]) for i in range(k)]).head()
    totals = np.array([x or 0.0 for x in held])
    steps, off = _descend(_AllRows(members, k, first), factors * totals, np.maximum(totals, 1.0))
    if off > CLOSE:
        warnings.warn(f"mixing: after {STEPS} steps another one of length one would still move the rates by {off:.2g}", stacklevel=2)
    return first + steps


def _rates(steps: list[Step], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = rates_of(_matrix(batch.column(2), k), steps)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], ["doc_id", "n_tokens", "posterior", "rate"])

    return run


@dataclass
class Mix:
    """What was fitted: a rate follows from a document's posterior."""

    classifier: Classifier
    steps: list[Step]

    @property
    def domains(self) -> list[str]:
        return self.classifier.domains


def _fitted(docs: DataFrame, labelled: DataFrame, factors: dict[str, float]) -> tuple[Mix, DataFrame]:
    docs = only(docs, doc_id="long", text="string")
    classifier = learn(docs, labelled)
    members = written(posteriors(docs, classifier))
    return Mix(classifier, fit_rates(members, np.array([factors.get(d, 1.0) for d in classifier.domains]))), members


def mix(docs: DataFrame, labelled: DataFrame, factors: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """Fit rates whose expected tokens by domain are ``factors`` times what the documents hold (1 where not named).

    docs: doc_id, text; labelled: doc_id, domain. Returns (doc_id, n_tokens, posterior, rate) for every row, and the domains in the
    posterior's order. Null and empty texts have no tokens and the rate that their posterior gives. Rows come back one
    for one, also repeated ones and those without a doc_id; further columns are ignored. Empty tables give an empty one;
    without labelled rows there is one domain, all.
    """
    found, members = _fitted(docs, labelled, factors)
    return members.mapInArrow(_rates(found.steps, len(found.domains)), "doc_id long, n_tokens long, posterior array<double>, rate double"), found.domains


def _with_rates(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for batch in batches:
            rates = [rates_of(found.classifier.posteriors(words), found.steps) for words in T.pieces(batch.column(batch.schema.names.index("text")), fold=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(rates) if rates else np.zeros(0))], [*batch.schema.names, "rate"])

    return run


def resample(docs: DataFrame, labelled: DataFrame, factors: dict[str, float]) -> DataFrame:
    """docs with each row as often as its rate says: the whole part, and once more with the chance of the rest.

    The chance is a hash of doc_id and text, so the result is the same each time. Keeps docs' columns and no others."""
    found, _ = _fitted(docs, labelled, factors)
    sent = docs.sparkSession.sparkContext.broadcast(found)
    names = docs.columns
    rated = docs.mapInArrow(_with_rates(sent), StructType([*docs.schema.fields, StructField("rate", DoubleType())]))
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.col("rate") + chance).cast("int")
    return rated.withColumn("times", times).where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*names)


def label_domains(labels: DataFrame) -> DataFrame:
    """The domains of a table of labels: toxic, else good or poor by quality; no domain if a label it needs is null."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))
