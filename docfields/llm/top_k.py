"""Exact top-k search by inner product: a ball tree per shard with branch and bound.

A node's ball gives every query an upper bound, q.c + |q| r. Nodes are visited in the order of that bound, each query
its better child first, and left out once the bound is below the query's k-th score so far. That score is shared: a first
pass over one shard gives each query a k-th score that all other shards start from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.tables import parallelism, written

#: Vectors of a shard and queries of a group at most, about: a task holds one of each. Both large, as what is shuffled falls with them.
SHARD = 1 << 16
GROUP = 1 << 16
#: A shard has no fewer vectors than this for the sake of more tasks.
SHARD_LEAST = 1 << 12
#: Vectors of a leaf: a product of matrices costs less than the nodes that might spare some of it.
LEAF = 512
#: Queries that go through a tree together.
TOGETHER = 1024
_LOW = -int(np.iinfo(np.int64).max)


class BallTree:
    """Integer vectors in balls; leaves hold up to LEAF of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.largest = float(np.abs(vectors).max(initial=0))
        self.distinct = len(np.unique(ids)) == len(ids)
        self.nodes: list[tuple] = []  # (center, radius, rows or None, left, right)
        if len(ids):
            self._grow(np.arange(len(ids)))

    def _grow(self, rows: np.ndarray) -> int:
        own = self.vectors[rows].astype(np.float64)
        center = own.mean(0)
        radius = float(np.sqrt(((own - center) ** 2).sum(1).max()))
        at = len(self.nodes)
        if len(rows) <= LEAF or radius == 0:
            self.nodes.append((center, radius, rows, -1, -1))
            return at
        self.nodes.append(())
        spread = own[:, int(np.argmax(own.max(0) - own.min(0)))]
        half = np.argsort(spread, kind="stable")
        left, right = self._grow(rows[half[: len(rows) // 2]]), self._grow(rows[half[len(rows) // 2 :]])
        self.nodes[at] = (center, radius, None, left, right)
        return at

    def _bound(self, node: int, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
        center, radius = self.nodes[node][:2]
        bound = q @ center + norms * radius
        return bound + 1e-9 * (np.abs(bound) + norms * (np.sqrt(center @ center) + radius)) + 1e-6

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score) of each query's k best at least; least: scores below it don't matter."""
        self.k = k
        self.found = np.zeros((3, 0), np.int64)
        self.query_ids, self.queries, self.least = query_ids, queries, least.copy()
        largest = float(np.abs(queries).max(initial=0)) * self.largest * max(1, queries.shape[1])
        # sums of whole numbers below these limits are exact
        self.kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
        self.as_float = queries.astype(np.float64)
        self.as_kind = queries.astype(self.kind)
        self.norms = np.sqrt((self.as_float**2).sum(1))
        if self.nodes and len(queries):
            everyone = np.arange(len(queries))
            self._visit(0, everyone, self._bound(0, self.as_float, self.norms))
        return self.found[0], self.found[1], self.found[2]

    def _visit(self, node: int, who: np.ndarray, bound: np.ndarray) -> None:
        who = who[bound >= self.least[who]]
        if not len(who):
            return
        _, _, rows, left, right = self.nodes[node]
        if rows is not None:
            self._score(rows, who)
            return
        q, norms = self.as_float[who], self.norms[who]
        a, b = self._bound(left, q, norms), self._bound(right, q, norms)
        first = a >= b  # each query its better child first
        for mask, order in ((first, ((left, a), (right, b))), (~first, ((right, b), (left, a)))):
            if mask.any():
                for child, limit in order:
                    self._visit(child, who[mask], limit[mask])

    def _score(self, rows: np.ndarray, who: np.ndarray) -> None:
        new = self.as_kind[who] @ self.vectors[rows].astype(self.kind).T
        hits = new >= self.least[who][:, None]
        if self.distinct and len(rows) > 4 * self.k and hits.sum() > 8 * self.k * len(who):
            # a k-th score of this leaf; the query's own row may be among the k best, so one more
            hits &= new >= np.partition(new, len(rows) - self.k - 1, axis=1)[:, len(rows) - self.k - 1][:, None]
        q, v = np.nonzero(hits)
        score = new[q, v].astype(np.int64)
        q, v = who[q], self.ids[rows[v]]
        other = v != self.query_ids[q]
        if not other.any():
            return
        mine = np.isin(self.found[0], q[other])
        merged = np.concatenate([self.found[:, mine], np.stack([q[other], v[other], score[other]])], 1)
        merged, place = _k_best(merged, self.k)
        self.found = np.concatenate([self.found[:, ~mine], merged], 1)
        last = place == self.k - 1
        self.least[merged[0, last]] = np.maximum(self.least[merged[0, last]], merged[2, last])


def _k_best(found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (query, id, score) columns each query's k best different ids, ties to the smaller id, in order, and their places."""
    found = found[:, np.lexsort((-found[2], found[1], found[0]))]
    found = found[:, np.append(True, (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1]))]
    found = found[:, np.lexsort((found[1], -found[2], found[0]))]
    starts = np.flatnonzero(np.append(True, found[0, 1:] != found[0, :-1]))
    place = np.arange(found.shape[1]) - np.repeat(starts, np.diff(np.append(starts, found.shape[1])))
    return found[:, place < k], place[place < k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _search(k: int):
    """One shard and one group of queries; rows with is_query are queries."""

    def search(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy()
        ids, vectors = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
        least = table.column("least").to_numpy()
        tree = BallTree(ids[~is_query], vectors[~is_query])
        out = [np.zeros((3, 0), np.int64)]
        at = np.flatnonzero(is_query)
        for part in np.array_split(at, max(1, -(-len(at) // TOGETHER))):
            q, v, score = tree.search(ids[part], vectors[part], least[part], k)
            out.append(np.stack([ids[part][q], v, score]))
        found = np.concatenate(out, 1)
        return pa.table({c: pa.array(x) for c, x in zip(("query_id", "vec_id", "score"), found)})

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _numbers(n: int) -> Column:
    """A row for each of 0 to n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null, empty or hold null or non-finite components are left out."""
    x = F.transform(vectors["embedding"], lambda c: c.cast("double"))
    kept = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite("x"))
    return kept.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).cast("array<long>").alias("v"))


def finite(name: str) -> Column:
    """Whether an array of double has no null and no non-finite component."""
    return F.forall(name, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k greatest integer inner products, ties to the smaller vec_id.

    vectors, queries: (vec_id, v array of long) as ``integers`` gives; a row is no candidate of a query with its vec_id, and vectors
    of another length are none. A query with fewer candidates has fewer rows. Scores must be below 2^63. Rows without a vec_id or a v take no
    part. Equal rows count once; if a vec_id has several vectors, it is one query and one candidate with the greatest score of any two. Empty
    tables give an empty one.

    Each (shard, group of queries) is one task of bounded size. All vectors are compared with all queries in the end if no bound helps, as with
    vectors that point everywhere, so the work is a product; what is shuffled is that product over SHARD and GROUP.
    """
    spark = vectors.sparkSession
    vectors, queries = (df.select("vec_id", "v").where("vec_id is not null and v is not null").distinct() for df in (vectors, queries))
    vectors, queries = written(vectors), written(queries)
    # the narrowest integers that hold all components travel
    size = vectors.unionByName(queries).agg(F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")).head()
    most = max(size["high"] or 0, -(size["low"] or 0))
    kind = "array<smallint>" if most < 1 << 15 else "array<int>" if most < 1 << 31 else "array<bigint>"
    n = vectors.count()
    shards, groups = max(1, -(-n // SHARD), min(parallelism(spark), -(-n // SHARD_LEAST))), max(1, -(-queries.count() // GROUP))
    dealt = vectors.select("vec_id", F.col("v").cast(kind).alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"))
    asked = queries.select("vec_id", F.col("v").cast(kind).alias("v"), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(groups)).alias("group"))

    def pass_over(members: DataFrame, asking: DataFrame) -> DataFrame:
        rows = members.withColumn("group", _numbers(groups)).select("vec_id", "v", "shard", "group", F.lit(_LOW).alias("least"), F.lit(False).alias("is_query"))
        sides = asking.select("vec_id", "v", "shard", "group", "least", F.lit(True).alias("is_query"))
        return rows.unionByName(sides).withColumn("size", F.size("v")).groupBy("shard", "group", "size").applyInArrow(_search(k), "query_id long, vec_id long, score long")

    pilot = written(pass_over(dealt.where("shard = 0"), asked.withColumn("least", F.lit(_LOW)).withColumn("shard", F.lit(0).cast("long"))))
    if shards == 1:
        return _best(pilot, k).select("query_id", "rank", "vec_id", "score")
    first = _best(pilot, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(f"n = {k}")
    bounded = asked.join(first.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(_LOW)))
    rest = pass_over(dealt.where("shard > 0"), written(bounded).withColumn("shard", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(shards - 1).cast("long")))))
    return _best(pilot.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
