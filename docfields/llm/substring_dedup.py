"""Substring dedup by seed and extend.

Seeds: winnowing keeps, of every window of 35 words, its least 12-word hash as an anchor, so equal windows share
an anchor at the same place. Documents are joined on the anchors that occur more than once. Extension: around each
shared anchor, every window that rests on it is followed to the left and right and kept if the same 35 words start
anywhere else; what is kept adds up to the maximal repeats of at least 35 words.

A task settles what repeats among its own rows and sends one entry for each different hash on, so a passage that a
third of all documents share is a few entries, not a group of their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm import text as T
from docfields.llm.tables import buckets_for, parallelism, written

ANCHOR_WORDS = 12
#: Entries that a task holds before it sends them on.
FLUSH = 1 << 21
#: Slots of the filter that spares documents a shuffle; 16 bytes each, so the broadcast is bounded whatever the input.
FILTER_SLOTS = 1 << 20
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """The pick (np.minimum or np.maximum) of every n neighbours: out[i] of x[i:i+n]."""
    width, out = 1, x
    while 2 * width <= n:
        out = pick(out[:-width], out[width:]) if len(out) > width else out[:0]
        width *= 2
    rest = n - width
    if rest and len(out):
        out = pick(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out


class _Seeds:
    """The anchors of a piece's words and the windows that rest on them."""

    def __init__(self, words: T.Words, window: int):
        self.span = window - ANCHOR_WORDS + 1
        grams = T.sequence_hashes(words.hashes, ANCHOR_WORDS)
        self.grams = np.where(T.inside(words.first, ANCHOR_WORDS), grams, _MOST)
        self.valid = T.inside(words.first, window)
        self.least = _slide(self.grams, self.span, np.minimum)[: len(self.valid)]

    def anchors(self) -> np.ndarray:
        if not len(self.least):
            return np.zeros(0, np.int64)
        held = np.where(self.valid, self.least, np.uint64(0))
        edge = np.zeros(self.span - 1, np.uint64)
        top = _slide(np.concatenate([edge, held, edge]), self.span, np.maximum)
        return np.flatnonzero((top[: len(self.grams)] == self.grams[: len(top)]) & (self.grams[: len(top)] != _MOST))

    def resting(self, shared: np.ndarray) -> np.ndarray:
        """The windows that have one of these anchors."""
        if not len(self.least) or not len(shared):
            return np.zeros(0, np.int64)
        seeds = np.full(len(self.grams), _MOST)
        seeds[shared] = self.grams[shared]
        return np.flatnonzero(self.valid & (_slide(seeds, self.span, np.minimum)[: len(self.valid)] == self.least) & (self.least != _MOST))


def _entries(find, buckets: int):
    """find(words, extras) -> (hash, place in the piece) of a piece; settles or packs them.

    Out: rows with part, keys, counts and runs (start and length), of entries that repeat within the task, or rows with
    bucket, hashes, keys, counts and places. A place is a word's number in its document; counts say how many entries in a
    row have a key; keys are dealt to as many parts as there are buckets."""

    def settle(hashes, keys, places) -> Iterator[pa.RecordBatch]:
        by = np.argsort(hashes, kind="stable")
        ordered = hashes[by]
        fresh = np.append(True, ordered[1:] != ordered[:-1])
        group = np.cumsum(fresh) - 1
        many = np.bincount(group)[group] > 1
        again = np.sort(by[many])
        for row in _by_part(keys[again], places[again], buckets):
            n = row.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), row.column(0), pa.nulls(n, pa.binary()), *row.columns[1:]], NAMES)
        # one entry for each different hash; that of a settled one only tells others, and has place -1
        kept = by[fresh]
        places = places.copy()
        places[by[many]] = -1
        kept = np.sort(kept)
        bucket = (hashes[kept] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        kept, bucket = kept[order], bucket[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(cuts[1:], len(bucket))
        rows = [(hashes[own].tobytes(), *_counted(keys[own]), places[own].tobytes()) for own in (kept[a:b] for a, b in zip(cuts, ends))]
        packed = [pa.array(x, pa.binary()) for x in zip(*rows)] if rows else [pa.array([], pa.binary())] * 4
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.nulls(len(cuts), pa.int32()), *packed], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            row_keys = np.asarray(batch.column(0))
            for words in T.pieces(batch.column(1)):
                hashes, at = find(words, batch)
                owner = np.searchsorted(words.first, at, "right") - 1
                held.append((hashes, row_keys[words.row + owner], (at - words.first[owner]).astype(np.int32)))
                size += len(at)
                if size >= FLUSH:
                    yield from settle(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if size:
            yield from settle(*(np.concatenate(x) for x in zip(*held)))

    return run


NAMES = ["bucket", "part", "hashes", "keys", "counts", "places"]
ENTRY = "bucket int, part int, hashes binary, keys binary, counts binary, places binary"
PART = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])


def _counted(keys: np.ndarray) -> tuple[bytes, bytes]:
    """The keys that stand in a row, each once, and how often each does."""
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[cuts].tobytes(), np.diff(np.append(cuts, len(keys))).astype(np.int32).tobytes()


def _by_part(keys: np.ndarray, places: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring places by key, packed by part."""
    if not len(keys):
        return
    part = (T.mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((places, keys, part))
    keys, places, part = keys[order], places[order], part[order]
    begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (places[1:] != places[:-1] + 1)))
    lengths = np.diff(np.append(begins, len(keys))).astype(np.int32)
    keys, runs, part = keys[begins], np.stack([places[begins], lengths]), part[begins]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ends = np.append(cuts[1:], len(part))
    rows = [(*_counted(keys[a:b]), runs[:, a:b].tobytes()) for a, b in zip(cuts, ends)]
    yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), *[pa.array(x, pa.binary()) for x in zip(*rows)]], schema=PART)


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _meet(parts: int):
    """One bucket: the places of hashes that several tasks sent."""

    def meet(table: pa.Table) -> pa.Table:
        hashes, places = _column(table, "hashes", np.uint64), _column(table, "places", np.int32)
        keys = np.repeat(_column(table, "keys", np.int64), _column(table, "counts", np.int32))
        by = np.argsort(hashes, kind="stable")
        ordered = hashes[by]
        group = np.cumsum(np.append(True, ordered[1:] != ordered[:-1])) - 1
        found = by[np.bincount(group)[group] > 1]
        found = found[places[found] >= 0]
        return pa.Table.from_batches(_by_part(keys[found], places[found], parts), PART)

    return meet


def _gather(table: pa.Table) -> pa.Table:
    """One part: a row for each key with its runs in order, as pairs of start and length."""
    keys = np.repeat(_column(table, "keys", np.int64), _column(table, "counts", np.int32))
    runs = np.concatenate([np.frombuffer(x, np.int32).reshape(2, -1) for x in table.column("places").to_pylist()], axis=1)
    by = np.lexsort((runs[0], keys))
    keys, runs = keys[by], runs[:, by]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(cuts[1:], len(keys))
    return pa.table({"key": pa.array(keys[cuts]), "runs": pa.array([np.ascontiguousarray(runs[:, a:b].T).tobytes() for a, b in zip(cuts, ends)], pa.binary())})


def _expand(runs: bytes) -> np.ndarray:
    """The places of runs."""
    starts, lengths = np.frombuffer(runs, np.int32).reshape(-1, 2).T
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def _repeated(docs: DataFrame, find, buckets: int) -> DataFrame:
    """(key, runs of places of what repeats) of the hashes that find() gives for each row (key, text, ...)."""
    entries = written(docs.mapInArrow(_entries(find, buckets), ENTRY))
    kind = "part int, keys binary, counts binary, places binary"
    met = entries.where("bucket is not null").groupBy("bucket").applyInArrow(_meet(buckets), kind)
    found = entries.where("bucket is null").select("part", "keys", "counts", "places").unionByName(met)
    return written(found.groupBy("part").applyInArrow(_gather, "key long, runs binary"))


def _marked(docs: DataFrame, side: DataFrame) -> DataFrame:
    """docs with maybe: false only if its key is not in the side. A bitmap of bounded size; the fuller it is, the more pass."""
    slot, bit = F.pmod(F.xxhash64("key"), F.lit(FILTER_SLOTS)), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(64)).cast("int")
    slots = side.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("slot").agg(F.bit_or("b").alias("bits"))
    marked = docs.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left")
    return marked.withColumn("maybe", F.coalesce(F.call_function("bit_get", "bits", bit) == 1, F.lit(False))).drop("slot", "bits")


def _spans(window: int):
    """Starts of repeated windows -> merged spans of words, as pairs of int32."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column(1).to_pylist():
                starts, lengths = np.frombuffer(runs, np.int32).reshape(-1, 2).T
                ends = np.maximum.accumulate(starts + lengths - 1 + window)
                new = np.append(True, starts[1:] > ends[:-1])
                last = np.append(np.flatnonzero(new)[1:], len(starts)) - 1
                out.append(np.stack([starts[new], ends[last]], 1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "spans"])

    return spans


def _cut(with_text: bool):
    """Remove the spans' words of each row (doc_id, text, spans)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in T.pieces(batch.column(1)):
                spans = batch.column(2).slice(words.row, words.docs).to_pylist()
                gone = np.zeros(len(words.starts) + 1, np.int32)
                for d in [d for d, s in enumerate(spans) if s]:
                    own = np.frombuffer(spans[d], np.int32).reshape(-1, 2) + words.first[d]
                    np.add.at(gone, own[:, 0], 1)
                    np.add.at(gone, np.minimum(own[:, 1], words.first[d + 1]), -1)
                kept = np.cumsum(gone[:-1]) == 0
                owner = np.repeat(np.arange(words.docs), np.diff(words.first))
                starts, ends, of = words.starts[kept], words.ends[kept], owner[kept]
                follows = np.append(of[1:] == of[:-1], False)[: len(of)]
                data = words.data.copy()
                marks = np.zeros(len(data) + 1, np.int8)
                marks[starts] += 1
                marks[ends] -= 1
                keep = np.cumsum(marks[:-1]).astype(bool)
                keep[ends[follows]] = True
                data[ends[follows]] = 0x20
                data = data[keep].tobytes()
                lengths = np.bincount(of, (ends - starts) + follows, words.docs).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                texts = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                n = np.diff(words.first)
                removed = n - np.bincount(of, minlength=words.docs)
                columns = {
                    "doc_id": batch.column(0).slice(words.row, words.docs), "n_words": pa.array(n), "n_removed": pa.array(removed.astype(np.int64)),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                }
                if with_text:
                    columns["kept"] = pa.array([x.decode() for x in texts], pa.string())
                for k, name in enumerate(batch.schema.names[3:], 3):
                    columns[name] = batch.column(k).slice(words.row, words.docs)
                yield pa.RecordBatch.from_pydict(columns)

    return cut


def repeated_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """(key, spans) of rows (key, text): the merged word spans of windows that start anywhere else too."""
    # an anchor in every twelve words or so, 16 bytes each, before equal ones of a task are one
    buckets = buckets_for(docs, 0.25, 2 * parallelism(docs.sparkSession))

    def seeds(words: T.Words, _) -> tuple[np.ndarray, np.ndarray]:
        found = _Seeds(words, window)
        at = found.anchors()
        return found.grams[at], at

    def windows(words: T.Words, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        shared = [_expand(p) + words.first[d] for d, p in enumerate(batch.column(2).slice(words.row, words.docs).to_pylist())]
        found = _Seeds(words, window)
        at = found.resting(np.concatenate(shared)) if shared else np.zeros(0, np.int64)
        return T.sequence_hashes(words.hashes, window)[at], at

    shared = _repeated(docs, seeds, buckets)
    seeded = _marked(docs, shared).where("maybe").select("key", "text").join(shared.hint("merge"), "key").select("key", "text", "runs")
    return written(_repeated(seeded, windows, buckets).mapInArrow(_spans(window), "key long, spans binary"))


def drop_repeats(docs: DataFrame, window: int = 35, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word that a repeated window of ``window`` words covers.

    docs: doc_id and text; further columns are ignored. Returns doc_id, n_words, n_removed, kept_sha256, and with
    ``with_text`` kept, the words that stay joined by one space, then the columns ``keep``. A null, empty or blank text has no words and
    keeps the empty text. Rows are judged apart even if they share a doc_id or have none; a row that is there twice is a
    repeat of itself. An empty table gives an empty one.
    """
    kept = {f"keep_{k}": docs[c] for k, c in enumerate(keep)}
    columns = ["doc_id", "text", *kept]
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[c.alias(k) for k, c in kept.items()]).withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed.select("key", "text"), window)
    marked = _marked(keyed, spans)
    cut = marked.where("maybe").drop("maybe").join(spans.hint("merge"), "key", "left")
    joined = cut.select("doc_id", "text", "spans", *kept).unionByName(marked.where("not maybe").select(*columns, F.lit(None).cast("binary").alias("spans")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text + "".join(f", {k} {keyed.schema[k].dataType.simpleString()}" for k in kept)
    return joined.mapInArrow(_cut(with_text), schema).withColumnsRenamed(dict(zip(kept, keep)))
