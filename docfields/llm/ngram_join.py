"""N-gram Jaccard join by token-combination prefixes.

Documents are sets of word shingles ("tokens"). One global order puts rare tokens first and the corpus' frequent
tokens last. In a set of n tokens the k-extended prefix is the first ``n - ceil(t n) + k`` tokens; two linked
sets share at least k tokens inside both k-extended prefixes. So a link shows in one of two indexes:

* a single rare token of the prefix, or
* if all that they share there is frequent, a combination of k = 2 frequent tokens.

Combinations are indexed for sets below ``COMBINE_BELOW`` tokens, which bounds them by C(34, 2) a document.
Larger sets, and sets of at least t times that size (which may link with larger ones), index their frequent
prefix tokens singly.

Each list of the index links its members with one pivot, the member with the fewest rare tokens in its prefix, which is
nearest to the middle of a group of near copies. A candidate must pass a rigorous bound first: the xor bitmaps of
two sets (a token flips one bit) differ in at most as many bits as the sets have unshared tokens. What passes is
verified on the whole sets. The
lists of one pivot are one cluster. If a cluster's members are not all connected after that, they are compared once more in
a second round, in chunks of bounded size and between different components only; the same bound leaves few pairs. So a hot
list of n members costs n candidates when they really are near copies, and otherwise no rows but those of its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm import text as T
from docfields.llm.components import connected_components
from docfields.llm.tables import buckets_for, parallelism, with_hot, written

#: Sets below this size index pairs of frequent tokens, others single ones.
COMBINE_BELOW = 128
#: A token that some stretch of COUNTED tokens holds at least so often is counted as possibly frequent.
LOCAL_LEAST = 2
COUNTED = 1 << 22
#: Index entries that a task holds before it sends them on.
FLUSH = 1 << 20
#: At most so many tokens form the frequent classes; only the order's quality depends on it, never the result.
FREQUENT_MOST = 1 << 18
SIGN = np.uint64(1 << 63)


def _long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def bitmap(own: np.ndarray) -> bytes:
    """A set's xor bitmap: at least one bit a token, a power of two, 64 at least."""
    width = max(64, 1 << int(max(1, len(own)) - 1).bit_length())
    odd = np.bincount((own >> np.uint64(7)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(x: bytes, y: bytes, nx: int, ny: int, percent: int) -> bool:
    """False only if sets of these sizes and bitmaps cannot reach the similarity."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    apart = int(np.bitwise_count(x ^ y).sum())
    # the overlap is at most (nx + ny - apart) / 2
    return (100 + percent) * (nx + ny - apart) >= 2 * percent * (nx + ny)


def _bound(percent: int):
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)))
            passed = [may_link(x, y, nx, ny, percent) for x, y, nx, ny in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(passed, pa.bool_()))

    return bound


def _across(percent: int):
    """Two chunks of a cluster -> the pairs of different components that sizes and bitmaps allow."""

    def rows(column: pa.Array, k: int) -> dict[int, tuple]:
        """A chunk's nodes, components, sizes and bitmaps by the bitmaps' width in words."""
        part = column.slice(k, 1).flatten()
        node, component, n = (part.field(c).to_numpy() for c in range(3))
        bits = part.field(3).to_pylist()
        width = np.array([len(x) // 8 for x in bits])
        out = {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            out[w] = node[at], component[at], n[at], np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), w)
        return out

    def compare(narrow: tuple, wide: tuple) -> np.ndarray:
        (node_a, part_a, n_a, bits_a), (node_b, part_b, n_b, bits_b) = narrow, wide
        if bits_b.shape[1] > bits_a.shape[1]:
            half = bits_b.shape[1] // 2
            bits_b = bits_b[:, :half] ^ bits_b[:, half:]
        found = []
        for i in range(len(node_a)):
            at = np.flatnonzero((part_b != part_a[i]) & (100 * np.minimum(n_b, n_a[i]) >= percent * np.maximum(n_b, n_a[i])))
            both = n_b[at] + n_a[i]
            apart = np.bitwise_count(bits_b[at] ^ bits_a[i]).sum(1, dtype=np.int64)
            at = at[(100 + percent) * (both - apart) >= 2 * percent * both]
            found.append(np.stack([np.minimum(node_b[at], node_a[i]), np.maximum(node_b[at], node_a[i])]))
        return np.concatenate(found, 1)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((2, 0), np.int64)]
            for k in range(batch.num_rows):
                a, b = (rows(c, k) for c in batch.columns)
                # sizes of links differ by less than two, so widths are equal or one is twice the other
                for w, own in a.items():
                    found += [compare(own, b[v]) for v in (w, 2 * w) if v in b]
                    found += [compare(b[w // 2], own)] if w // 2 in b else []
            pairs = np.unique(np.concatenate(found, 1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return across


def _scan(n: int):
    """Of each document its set's size, hash and bitmap; beside them (row = false) the tokens that repeat in the task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, kept = 0, []

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= LOCAL_LEAST
            k = int(many.sum())
            own = {"row": pa.array(np.zeros(k, bool)), "doc_id": pa.nulls(k, pa.int64()), "n": pa.array(counts[many].astype(np.int64)), "key": pa.array(_long(tokens[many])), "bits": pa.nulls(k, pa.binary())}
            return pa.RecordBatch.from_pydict(own | {f.name: pa.nulls(k, f.type) for f in kept})

        for batch in batches:
            ids, kept = batch.column(0), list(batch.schema)[2:]
            for piece in T.pieces(batch.column(1), fold=True):
                sets = T.shingle_sets(piece, n)
                sizes = np.array([len(s) for s in sets], np.int64)
                own = _long(np.array([T.whole_hash(s) for s in sets], np.uint64))
                columns = {"row": pa.array(np.ones(len(sets), bool)), "doc_id": ids.slice(piece.row, piece.docs), "n": pa.array(sizes), "key": pa.array(own), "bits": pa.array([bitmap(s) for s in sets], pa.binary())}
                yield pa.RecordBatch.from_pydict(columns | {f.name: batch.column(k).slice(piece.row, piece.docs) for k, f in enumerate(kept, 2)})
                held += sets
                size += int(sizes.sum())
                if size >= COUNTED:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return scan


def _needed(n: np.ndarray | int, percent: int):
    """The least overlap of a set of n tokens with any set that it links with."""
    return -(-percent * n // 100)


class _Order:
    """The global order: tokens outside the frequent classes by hash, then the frequent ones by count."""

    def __init__(self, tokens: np.ndarray, ranks: np.ndarray):
        self.tokens, self.ranks = tokens, ranks

    def rank(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.ranks[at], 0)

    def keys(self, own: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
        """The index keys of one set, and the share of rare tokens in its prefix, 0 to 255."""
        n = len(own)
        ranks = self.rank(own)
        spread = T.mix(own)
        extra = 2 if n < COMBINE_BELOW else 1
        most = min(n, n - int(_needed(n, percent)) + extra)
        if (ranks == 0).all():
            first = np.argpartition(spread, most - 1)[:most] if most < n else np.arange(n)
        else:
            first = np.lexsort((spread, ranks))[:most]
        rare = own[first[ranks[first] == 0]]
        frequent = own[first[ranks[first] > 0]]
        share = 255 * len(rare) // len(first)
        if not len(frequent):
            return rare, share
        if n >= COMBINE_BELOW:
            return np.concatenate([rare, frequent]), share
        a, b = np.triu_indices(len(frequent), 1)
        low, high = np.minimum(frequent[a], frequent[b]), np.maximum(frequent[a], frequent[b])
        out = [rare, T.mix(T.mix(low) * np.uint64(3) + high)]
        if 100 * n >= percent * COMBINE_BELOW:
            out.append(frequent)
        return np.concatenate(out), share


def _post(order, buckets: int, n: int, percent: int):
    """The index entries of a task, packed by bucket of the key: arrays of keys, sets' hashes and shares of rare tokens."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = _Order(*order.value)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _, _ in held])
            counts = [len(k) for k, _, _ in held]
            own = np.repeat(np.array([o for _, o, _ in held], np.uint64), counts)
            shares = np.repeat(np.array([s for _, _, s in held], np.uint8), counts)
            place = (keys % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(place, kind="stable")
            keys, own, shares, place = keys[by], own[by], shares[by], place[by]
            cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            ends = np.append(cuts[1:], len(place))
            return pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(place[cuts]),
                    "keys": pa.array([keys[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                    "sets": pa.array([own[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                    "shares": pa.array([shares[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                }
            )

        for batch in batches:
            for piece in T.pieces(batch.column(0), fold=True):
                for s in T.shingle_sets(piece, n):
                    if len(s) and (own := int(T.whole_hash(s))) not in seen:
                        if len(seen) < 1 << 18:
                            seen.add(own)
                        keys, share = ranking.keys(s, percent)
                        held.append((keys, own, share))
                        size += len(held[-1][0])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return post


def _pairs(table: pa.Table) -> pa.Table:
    """One bucket's entries -> each list's members with its pivot."""
    keys, own, shares = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("keys", np.uint64), ("sets", np.uint64), ("shares", np.uint8)))
    by = np.lexsort((own, shares, keys))
    keys, own = keys[by], own[by]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (own[1:] != own[:-1]))
    keys, own = keys[fresh], own[fresh]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    others = np.diff(np.append(starts, len(keys))) - 1
    pivots = np.repeat(own[starts], others)
    members = np.delete(own, starts)
    pairs = np.unique(np.stack([pivots, members]), axis=1)
    return pa.table({"a": pa.array(_long(pairs[0])), "b": pa.array(_long(pairs[1]))})


def _sets(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch.column(0), fold=True):
                found = T.shingle_sets(piece, n)
                yield pa.RecordBatch.from_pydict({"key": pa.array(_long(np.array([T.whole_hash(s) for s in found], np.uint64))), "tokens": pa.array([s.tobytes() for s in found], pa.binary())})

    return sets


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                links.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(links, pa.bool_()))

    return verify


#: Members of a cluster that are compared as one chunk in the second round.
CHUNK = 512
#: Rows of (id) that may be broadcast as a filter; beyond it the same join shuffles.
FILTER_ROWS = 1 << 20


def _most_frequent(counts: DataFrame) -> DataFrame:
    """At most FREQUENT_MOST tokens (key, n): those from the least count on that leaves so few, found by a histogram of counts."""
    counts = written(counts)
    size = F.floor(F.log2("n") * 8)
    rows = counts.groupBy(size.alias("size")).agg(F.count("*").alias("tokens")).collect()
    least, total = 1 << 30, 0
    for r in sorted(rows, key=lambda r: -r["size"]):
        total += r["tokens"]
        if total > FREQUENT_MOST:
            break
        least = r["size"]
    return counts.where(size >= least)


def near_copies(docs: DataFrame, words: int = 5, percent: int = 75, keep: tuple[str, ...] = ()) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``percent`` hundredths.

    docs: doc_id and text; further columns are ignored. Returns doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links). Null, empty and blank texts have an empty set and link with nothing. Equal sets are one node of
    the join, equal if their 64-bit hashes are. A doc_id that comes repeatedly gives a row each time; a row without
    one is linked like any other but has component_id null if none it reaches has one. An empty table gives an empty one.

    keep: columns of docs that come along, after ``component``, a number that rows of one component alone share (null for empty sets).
    """
    spark = docs.sparkSession
    kept = {f"keep_{k}": c for k, c in enumerate(keep)}
    more = [docs[c].alias(k) for k, c in kept.items()]
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *more)
    schema = "row boolean, doc_id long, n long, key long, bits binary" + "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in kept)
    scanned = written(docs.mapInArrow(_scan(words), schema))
    docs = docs.select("doc_id", "text")
    owners = scanned.where("row").select("doc_id", "n", "key", *kept)
    frequent = _most_frequent(scanned.where("not row").groupBy("key").agg(F.sum("n").alias("n"))).toPandas().sort_values(["n", "key"], ascending=[False, True])
    tokens = frequent["key"].to_numpy(np.int64).view(np.uint64)
    ranks = np.arange(len(tokens), 0, -1, dtype=np.int64)
    by = np.argsort(tokens)
    order = spark.sparkContext.broadcast((tokens[by], ranks[by]))

    # a quarter of the words, 17 bytes each
    buckets = buckets_for(docs, 0.75, 4 * parallelism(spark))
    posted = docs.select("text").mapInArrow(_post(order, buckets, words, percent), "bucket int, keys binary, sets binary, shares binary")
    pairs = written(posted.groupBy("bucket").applyInArrow(_pairs, "a long, b long").distinct())

    classes = written(scanned.where("row and n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("bits").alias("bits")))
    first = _linked(docs, classes, pairs, words, percent)
    parts = connected_components(first)

    clusters = pairs.join(parts.withColumnRenamed("node", "b"), "b", "left").select("a", "b", F.coalesce("component", "b").alias("component"))
    members = clusters.groupBy("a").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
    open_clusters = written(members.where("x != y").select("a", F.ceil(F.col("n") / CHUNK).alias("chunks"), "n"))
    left = with_hot(clusters, open_clusters, "a", pairs.count()).join(classes.select(F.col("key").alias("b"), "n", "bits"), "b")
    held = left.groupBy("a", "chunks", F.pmod(F.xxhash64("b"), "chunks").alias("chunk")).agg(F.collect_list(F.struct(F.col("b").alias("node"), "component", "n", "bits")).alias("rows"))
    held = written(held)
    alone = held.where("chunks = 1").select(F.col("rows").alias("rows_a"), F.col("rows").alias("rows_b"))
    # two chunks of a cluster meet in a group of their own, so that a large cluster is no task
    x = held.where("chunks > 1").select("a", F.col("chunk").alias("i"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("j"), F.col("rows").alias("rows_a"))
    y = held.where("chunks > 1").select("a", F.explode(F.sequence(F.lit(0).cast("long"), "chunk")).alias("i"), F.col("chunk").alias("j"), F.col("rows").alias("rows_b"))
    several = x.join(y, ["a", "i", "j"]).select("rows_a", "rows_b")
    more = alone.unionByName(several).mapInArrow(_across(percent), "a long, b long").distinct()
    second = _linked(docs, classes, more.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), words, percent)
    parts = connected_components(first.unionByName(second))

    reps = written(classes.select("key", "rep").join(parts, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "key").alias("component")))
    lowest = written(reps.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    named = with_hot(reps, lowest, "component", reps.count()).select("key", "component_id", "component")
    out = owners.where("n > 0").join(named, "key").unionByName(owners.where("n = 0").withColumn("component_id", F.col("doc_id")), allowMissingColumns=True)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", *(["component"] if keep else []), *[F.col(k).alias(c) for k, c in kept.items()])


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set hashes that are links: those within the bitmaps' bound, judged on the whole sets."""
    total = pairs.count()
    of = lambda k: classes.select(F.col("key").alias(k), F.col("bits").alias(f"bits_{k}"), F.col("n").alias(f"n_{k}"))
    bounded = _by_pivot(pairs.select("a", "b").join(of("b"), "b"), pairs, of("a"), total).where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    pairs = written(bounded.select("a", "b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(_bound(percent), "a long, b long"))
    nodes = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    ids = written(nodes.join(classes, "key").select(F.col("rep").alias("doc_id")))
    few = ids.limit(FILTER_ROWS + 1).count() <= FILTER_ROWS
    texts = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    # rows that share a doc_id give the same sets again, or others: one row a set, or each pair would meet as often as its rows do
    sets = written(texts.select("text").mapInArrow(_sets(words), "key long, tokens binary").dropDuplicates(["key"]))
    a, b = (sets.select(F.col("key").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
    return written(_by_pivot(pairs.join(b, "b"), pairs, a, pairs.count()).select("a", "b", "ta", "tb").mapInArrow(_verify(percent), "a long, b long"))


def _by_pivot(rows: DataFrame, pairs: DataFrame, of_a: DataFrame, total: int) -> DataFrame:
    """rows joined with the pivots' columns; a pivot of many pairs is no task."""
    counted = written(pairs.groupBy("a").agg(F.count("*").alias("n")))
    return with_hot(rows, of_a.join(counted, "a"), "a", total)
