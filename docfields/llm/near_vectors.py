"""Near-dedup of embeddings by int8 tile products with rigorous error bounds.

Unit vectors of one label are cut into tiles and quantised once; codes, scales and errors travel to the tiles that meet, the
vectors do not. A tile product of int8 codes approximates all cosines of two tiles at once; each vector's exact quantisation
error bounds what the product can be off by. Pairs surely above the threshold are links, and only those of the rest that may
reach it are computed in double precision: the vectors in such pairs follow to their tiles. Vectors whose projections on a
fixed direction differ by more than two linked ones can are in tiles that do not meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.components import connected_components
from docfields.llm.tables import parallelism, with_hot, written
from docfields.llm.top_k import _matrix, finite

#: Vectors of a tile at most, about, and of one that is smaller for the sake of more tasks at least.
TILE, TILE_LEAST = 4096, 512
#: Entries of a product that are held at once.
HELD = 1 << 22


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes in -127..127, scale, error) of unit vectors: |unit - scale * code| <= error, by row."""
    scale = np.maximum(np.abs(unit).max(1), 1e-300) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - scale[:, None] * codes) ** 2).sum(1)) * (1 + 1e-12) + 1e-15
    return codes, scale, error


def judged(cx: np.ndarray, sx: np.ndarray, ex: np.ndarray, cy: np.ndarray, sy: np.ndarray, ey: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of x, rows of y, whether sure) of all pairs of quantised vectors whose cosine may be ``least`` or more."""
    kind = np.float32 if 127 * 127 * cx.shape[1] < 1 << 24 else np.float64  # sums of code products stay exact
    y, found = cy.astype(kind).T, []
    for k in range(0, len(cx), max(1, HELD // max(1, len(cy)))):
        part = slice(k, k + max(1, HELD // max(1, len(cy))))
        product = cx[part].astype(kind) @ y
        # x.y - (x - dx).(y - dy) is at most |dx| |y| + |dy| |x| + |dx| |dy|; a first cut by the largest errors
        reach = ex[part].max() + ey.max() + ex[part].max() * ey.max() + 1e-6
        i, j = np.nonzero(product >= ((least - reach) / sx[part])[:, None].astype(kind) / sy[None].astype(kind) * (1 - np.sign(least - reach) * 1e-6))
        about = product[i, j].astype(np.float64) * (sx[part][i] * sy[j])  # the same for (x, y) and (y, x)
        off = ex[part][i] + ey[j] + ex[part][i] * ey[j] + 1e-12
        keep = about + off >= least
        found.append((i[keep] + k, j[keep], (about - off >= least)[keep]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


def cosines_reach(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether rows a of x and b of y have a cosine of at least ``least``, in double precision."""
    nx, ny = (np.sqrt((v * v).sum(1)) for v in (x, y))
    keep = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 15):
        i, j = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
        keep[k : k + (1 << 15)] = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= least
    return keep


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component under the edges a-b."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, x) -> (key, codes, scale, error)."""
    for batch in batches:
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        codes: list[bytes] = [b""] * len(sizes)
        scale, error = np.zeros(len(sizes)), np.zeros(len(sizes))
        flat, starts = lists.flatten().to_numpy(), np.cumsum(sizes) - sizes
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            x = flat[starts[at][:, None] + np.arange(n)]
            c, scale[at], error[at] = quantise(x / np.sqrt((x * x).sum(1))[:, None])
            for i, row in zip(at.tolist(), c):
                codes[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(scale), pa.array(error)], ["key", "codes", "scale", "error"])


def _links(keys: np.ndarray, times: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row in the pairs a-b: its key, the key of its component's root, and the number of vectors that it links with."""
    links = np.bincount(a, times[b], len(keys)) + np.bincount(b, times[a], len(keys))
    root, at = _forest(len(keys), a, b), np.flatnonzero(links)
    return keys[at], keys[root[at]], links[at].astype(np.int64)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the left and of the right tile, and whether both are the same tile."""
    side, own = table.column("side").to_numpy(), table.column("same")[0].as_py()
    left = np.flatnonzero(side == 0)
    return left, left if own else np.flatnonzero(side == 1), own


def _tile_pair(least: float):
    """Codes of two tiles (or of one with itself) -> by key: links that are sure (n > 0), or that its vector is needed (n = 0)."""

    def run(table: pa.Table) -> pa.Table:
        keys, times, scale, error = (table.column(c).to_numpy() for c in ("key", "times", "scale", "error"))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(len(keys), -1)
        left, right, own = _sides(table)
        a, b, sure = judged(codes[left], scale[left], error[left], codes[right], scale[right], error[right], least) if len(left) and len(right) else (left[:0], right[:0], np.zeros(0, bool))
        a, b = left[a], right[b]
        keep = a < b if own else np.ones(len(a), bool)
        a, b, sure = a[keep], b[keep], sure[keep]
        found, root, n = _links(keys, times, a[sure], b[sure])
        needed = np.unique(np.concatenate([a[~sure], b[~sure]]))
        out = {"a": np.append(found, keys[needed]), "b": np.append(root, keys[needed]), "n": np.append(n, np.zeros(len(needed), np.int64)), "side": np.append(np.zeros(len(found), np.int32), table.column("side").to_numpy()[needed])}
        head = {c: pa.array([table.column(c)[0].as_py()] * len(out["a"]), kind) for c, kind in (("pair", pa.int64()), ("same", pa.bool_()))}
        return pa.table({c: pa.array(x) for c, x in out.items()} | head)

    return run


def _needed_pair(least: float):
    """The vectors of two tiles that are in pairs not sure: the links among these."""

    def run(table: pa.Table) -> pa.Table:
        keys, times, scale, error = (table.column(c).to_numpy() for c in ("key", "times", "scale", "error"))
        x = _matrix(table.column("x"))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(len(keys), -1)
        left, right, own = _sides(table)
        a, b, sure = judged(codes[left], scale[left], error[left], codes[right], scale[right], error[right], least)
        a, b = left[a[~sure]], right[b[~sure]]
        keep = a < b if own else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        linked = cosines_reach(x, x, a, b, least)
        return pa.table({c: pa.array(v) for c, v in zip("abn", _links(keys, times, a[linked], b[linked]))})

    return run


def near_copies(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Rows link if their labels are equal and the cosine is at least ``least``. Rows with a null label, or a vector that is null,
    empty, zero or holds null or non-finite components, link with nothing; nor do vectors of different length. Equal vectors of one label are one
    node with a multiplicity. Rows come back one for one; component_id is null only if no member has a vec_id, and then kept is too.
    An empty table gives an empty one.
    """
    x = F.transform(vectors["embedding"], lambda c: c.cast("double"))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].alias("label"), x.alias("x"))
    good = F.coalesce(F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite("x") & F.exists("x", lambda c: c != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("good", good).withColumn("x", F.transform("x", lambda c: c + 0.0))
    rows = written(rows.select("vec_id", "label", "x", "good", F.xxhash64("label", "x").alias("key")))
    classes = rows.where("good").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("x").alias("x"))

    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
    # any fixed unit direction will do: |u.a - u.b| <= |a - b| <= sqrt(2 - 2 least) for linked unit vectors
    along = F.aggregate(F.transform("x", lambda c, k: c * F.sin(k * 12.9898 + 1.0)), F.lit(0.0), lambda s, c: s + c)
    length = F.sqrt(F.aggregate(F.transform("x", lambda c, k: F.pow(F.sin(k * 12.9898 + 1.0), 2)), F.lit(0.0), lambda s, c: s + c))
    width = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    binned = written(classes.where(norm > 0).withColumn("bin", F.floor(along / length / norm / width)).withColumn("size", F.size("x")))
    place = ["label", "size", "bin"]
    tile = max(min(TILE, TILE_LEAST), min(TILE, binned.count() // parallelism(vectors.sparkSession)))
    counts = binned.groupBy(*place).agg(F.count("*").alias("n")).withColumn("tiles", F.ceil(F.col("n") / tile))
    after = counts.select("label", "size", (F.col("bin") - 1).alias("bin"), F.col("tiles").alias("tiles_after"))
    before = counts.select("label", "size", (F.col("bin") + 1).alias("bin"), F.col("tiles").alias("tiles_before"))
    sizes = written(counts.join(after, place, "left").join(before, place, "left"))
    sized = with_hot(binned, sizes, place, sizes.agg(F.sum("n")).head()[0] or 0).withColumn("tile", F.pmod("key", F.col("tiles")))
    meets = F.expr(
        "concat(transform(sequence(0L, tiles - 1), t -> struct(bin as low, least(t, tile) as i, bin as high, greatest(t, tile) as j, if(tile <= t, 0, 1) as side)),"
        " if(tiles_after is null, array(), transform(sequence(0L, tiles_after - 1), t -> struct(bin as low, tile as i, bin + 1 as high, t as j, 0 as side))),"
        " if(tiles_before is null, array(), transform(sequence(0L, tiles_before - 1), t -> struct(bin - 1 as low, t as i, bin as high, tile as j, 1 as side))))"
    )
    codes = written(binned.select("key", "x").mapInArrow(_codes, "key long, codes binary, scale double, error double"))
    place = ["label", "size", "low", "i", "high", "j"]
    pairs = sized.select("label", "size", "key", "times", F.explode(meets).alias("m")).select("label", "size", "key", "times", "m.*")
    pairs = pairs.join(codes, "key").withColumn("same", F.expr("low = high and i = j")).withColumn("pair", F.xxhash64(*place))
    judged_ = written(pairs.groupBy(*place).applyInArrow(_tile_pair(least), "a long, b long, n long, side int, pair long, same boolean"))
    needed = judged_.where("n = 0").select(F.col("a").alias("key"), "side", "pair", "same").join(binned.select("key", "times", "x").join(codes, "key"), "key")
    more = needed.groupBy("pair").applyInArrow(_needed_pair(least), "a long, b long, n long")
    found = written(judged_.where("n > 0").select("a", "b", "n").unionByName(more))

    parts = connected_components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    named = classes.select("key", "rep", "times").join(parts, F.col("key") == F.col("node"), "left").select("key", "rep", "times", F.coalesce("component", "key").alias("component"))
    named = written(named)
    lowest = written(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    whole = with_hot(named, lowest, "component", named.count()).join(links, "key", "left").select("key", "component_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.lit(True).alias("good"))
    out = rows.select("vec_id", "key", "good").join(whole, ["key", "good"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
