"""Token ids as directly addressable codes.

An id is split into chunks of 8 bits from the low end. Level k holds the k-th chunk of the ids that reach it, one bit a
chunk that says whether the id goes on to level k + 1, and a rank directory: the count of such bits before every
block of 512. The next chunk of the i-th chunk of a level is number rank(i) of the next level, so any token is read
by one look at each of its levels, and no block is decoded.

A file is a Parquet table of segments in ascending doc_id order; a segment holds the documents' bounds and its levels, and
the table is not compressed, so a look-up reads its segment's bytes and decodes none of them. Any store that Spark writes
can hold it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm import text as T
from docfields.llm.tables import only, parallelism, written
from docfields.llm.tokens import library_table

CHUNK_BITS = 8
BLOCK = 512
#: Tokens after which a segment ends (with its document).
SEGMENT = 1 << 18

SCHEMA = "part int, segment int, n_docs long, n_tokens long, doc_ids array<long>, bounds binary, chunks array<binary>, going_on array<binary>, ranks array<binary>"
_BITS_IN = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """The chunks, continuation bitmaps and rank directories of each level."""
    chunks, bitmaps, directories = [], [], []
    left = np.asarray(ids).astype(np.uint64)
    while True:
        on = left >> np.uint64(CHUNK_BITS) > 0
        chunks.append((left & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes())
        bitmap = np.packbits(on, bitorder="little")
        bitmaps.append(bitmap.tobytes())
        blocks = np.add.reduceat(_BITS_IN[bitmap], np.arange(0, len(bitmap), BLOCK // 8), dtype=np.int64) if len(bitmap) else np.zeros(0, np.int64)
        directories.append(np.concatenate([[0], np.cumsum(blocks)])[:-1].astype(np.uint32).tobytes())
        if not on.any():
            return chunks, bitmaps, directories
        left = left[on] >> np.uint64(CHUNK_BITS)


class Codes:
    """Random access to packed ids."""

    def __init__(self, chunks: list[bytes], bitmaps: list[bytes], directories: list[bytes]):
        self.chunks = [np.frombuffer(x, np.uint8) for x in chunks]
        self.bitmaps = [np.frombuffer(x, np.uint8) for x in bitmaps]
        self.directories = [np.frombuffer(x, np.uint32) for x in directories]

    def __len__(self) -> int:
        return len(self.chunks[0])

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """The number of set bits before each place."""
        bitmap, byte = self.bitmaps[level], at // 8
        block = at // BLOCK
        out = self.directories[level][block].astype(np.int64)
        for k in range(BLOCK // 8 - 1):
            inner = block * (BLOCK // 8) + k
            out += np.where(inner < byte, _BITS_IN[bitmap[np.minimum(inner, len(bitmap) - 1)]], 0)
        return out + _BITS_IN[bitmap[byte] & ((1 << (at % 8)) - 1).astype(np.uint8)]

    def get(self, places) -> np.ndarray:
        """The ids at any places, in any order."""
        at = np.asarray(places, np.int64)
        out = np.zeros(len(at), np.uint64)
        here = np.arange(len(at))
        for level in range(len(self.chunks)):
            out[here] |= self.chunks[level][at].astype(np.uint64) << np.uint64(CHUNK_BITS * level)
            on = (self.bitmaps[level][at // 8] >> (at % 8).astype(np.uint8)) & 1 > 0
            if not on.any():
                break
            here, at = here[on], self._rank(level, at[on])
        return out

    def all(self) -> np.ndarray:
        """All ids in order: a level's chunks follow the bits of the one before."""
        out = np.zeros(len(self), np.uint64)
        here = np.arange(len(self))
        for level, chunks in enumerate(self.chunks):
            out[here] |= chunks.astype(np.uint64) << np.uint64(CHUNK_BITS * level)
            here = here[np.unpackbits(self.bitmaps[level], bitorder="little")[: len(here)].astype(bool)]
        return out


def _encode(path: str, end: int, bounds: np.ndarray):
    """Every document's ids, the part it belongs to, and the hash by which rows of one doc_id are ordered.

    Ids travel as their low 16 bits; the high ones come along only where some id has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = library_table(path)
        for batch in batches:
            for words in T.pieces(batch.column(1)):
                ids, stops = table.ids(words)
                with_end = np.insert(ids, stops[1:], end).astype(np.uint32)
                own = batch.slice(words.row, words.docs)
                offsets = 2 * (stops + np.arange(len(stops)))
                low, high = (_packed(x.astype("<u2"), offsets) for x in (with_end & 0xFFFF, with_end >> 16))
                if with_end.max() < 1 << 16:
                    high = pa.nulls(words.docs, pa.binary())
                doc_id, tie = own.column(0), own.column(2)
                yield pa.RecordBatch.from_arrays([pa.array(part_of(doc_id, tie, bounds)), doc_id, tie, low, high], ["part", "doc_id", "tie", "low", "high"])

    return run


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def part_of(doc_id: pa.Array, tie: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The part of every row: by doc_id between the bounds; an id that fills several parts is dealt to them by ``tie``.

    So (doc_id, tie) never falls from one part to the next. Rows without a doc_id count as the least id."""
    own = doc_id.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(bounds, own, "left"), np.searchsorted(bounds, own, "right")
    share = (tie.to_numpy(zero_copy_only=False).astype(np.float64) / 2.0**64 + 0.5).clip(0, 1 - 2.0**-53)
    return np.where(high > low, low + np.floor(share * (high - low + 1)).astype(np.int64), low).astype(np.int32)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's documents in order -> its segments, each of SEGMENT ids or as many as its last document brings it to."""
    held: list[pa.RecordBatch] = []
    number = size = 0

    def segment() -> pa.RecordBatch:
        docs = pa.concat_arrays([b.column(1) for b in held])
        bounds = [_bounds(b.column(2)) for b in held]
        ids = np.concatenate([np.frombuffer(b.column(2).buffers()[2], "<u2")[o[0] : o[-1]] for b, o in zip(held, bounds)])
        if any(b.column(3).null_count < b.num_rows for b in held):
            high = [x or bytes(2 * int(n)) for b, o in zip(held, bounds) for x, n in zip(b.column(3).to_pylist(), np.diff(o))]
            ids = ids | np.frombuffer(b"".join(high), "<u2").astype(np.uint32) << 16
        counts = np.concatenate([np.diff(o) for o in bounds])
        chunks, bitmaps, directories = pack(ids)
        row = {
            "part": held[0].column(0).slice(0, 1), "segment": pa.array([number], pa.int32()), "n_docs": pa.array([len(counts)]), "n_tokens": pa.array([len(ids)]),
            "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
            "bounds": pa.array([np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tobytes()]),
            "chunks": pa.array([chunks], pa.list_(pa.binary())), "going_on": pa.array([bitmaps], pa.list_(pa.binary())), "ranks": pa.array([directories], pa.list_(pa.binary())),
        }
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            tokens = np.cumsum(np.diff(_bounds(batch.column(2).slice(at))))
            stop = int(np.searchsorted(tokens, SEGMENT - size)) + 1
            own = batch.slice(at, stop)
            held.append(own)
            size += int(tokens[own.num_rows - 1])
            at += own.num_rows
            if size >= SEGMENT:
                yield segment()
                held, size, number = [], 0, number + 1
    if held:
        yield segment()


def _bounds(column: pa.Array) -> np.ndarray:
    """Where each document's ids begin in the column's data, in ids."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 2


def write_ids(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Encode every row of docs (doc_id, text), append ``end`` to each, and write segments in ascending doc_id order.

    Returns the written table of segments. Null and empty texts are the end id alone. Rows without a doc_id come first, with those of id -2^63; rows of one
    doc_id are ordered by xxhash64 of their text, and spread by it where they are more than a part's share. Further columns are ignored. An
    empty table writes no segment.

    Texts are encoded where they are read and only their ids are shuffled, to parts whose bounds come from the doc_id column alone.
    """
    docs = only(docs, doc_id="long", text="string")
    parts = parallelism(docs.sparkSession)
    shares = [k / parts for k in range(1, parts)]
    least = F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min))
    bounds = docs.agg(F.percentile_approx(least, shares, F.lit(max(10_000, 20 * parts))).alias("b")).head()["b"] if shares else []
    encoded = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(_encode(path, end, np.array(bounds or [], np.int64)), "part int, doc_id long, tie long, low binary, high binary")
    dealt = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    return written(dealt.select("part", "doc_id", "low", "high").mapInArrow(_segments, SCHEMA), compression="none")


def with_starts(segments: DataFrame) -> DataFrame:
    """Segments with start, the number of ids in all segments before.

    One small row a segment, in two steps: sums by part, running sums over the parts, then over a part's segments."""
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = segments.select("part", "segment", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inner"))
    starts = inner.join(before, "part").select("part", "segment", (F.col("inner") + F.col("before")).alias("start"))
    return segments.join(F.broadcast(starts) if starts.limit(1 << 20).count() < 1 << 20 else starts, ["part", "segment"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            bounds = np.frombuffer(row["bounds"], np.int64)
            ids = Codes(row["chunks"], row["going_on"], row["ranks"]).all().astype("<u4")
            for k in range(0, row["n_docs"], 4096):
                cut = bounds[k : k + 4097]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"][k : k + 4096], pa.int64()),
                        "start": pa.array(cut[:-1] + row["start"]),
                        "n_tokens": pa.array(np.diff(cut)),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])], pa.int64()),
                    }
                )


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of written segments."""
    return with_starts(segments).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            places = np.array(row["places"], np.int64)
            ids = Codes(row["chunks"], row["going_on"], row["ranks"]).get(places - row["start"])
            yield pa.RecordBatch.from_pydict({"place": pa.array(places), "id": pa.array(ids.astype(np.int64))})


def tokens_at(segments: DataFrame, places: DataFrame) -> DataFrame:
    """The ids at any global places (place long): a look-up in the segment that holds each, without decoding it."""
    segments = with_starts(segments)
    covered = F.explode(F.expr(f"sequence(start div {SEGMENT}, (start + n_tokens - 1) div {SEGMENT})"))
    held = segments.select("part", "segment", "start", "n_tokens", covered.alias("stretch"))
    asked = places.withColumn("stretch", F.expr(f"place div {SEGMENT}")).join(held, "stretch").where("place >= start and place < start + n_tokens")
    lists = asked.groupBy("part", "segment").agg(F.collect_set("place").alias("places"))
    return segments.join(lists, ["part", "segment"]).mapInArrow(_tokens, "place long, id long")
