"""The prefix trie of rebuilt conversations, by composable fingerprints.

A rebuilt conversation is the head of its base conversation and its own later turns. A sequence of turns has a fingerprint in a
monoid: (n, v) with v = sum of turn_i * base^i modulo a prime, in four lanes, and (m, u)(n, v) = (m + n, u + base^m v). One pass over the
turns in order gives the products of all prefixes of the stored conversations; the prefixes of rebuilt ones are combined from those of the
head and of the suffix by arithmetic alone, so no text is copied or moved for them. Prefixes of one length and fingerprint are one node.
Every turn keeps a reference, its content's digest, and each node checks that its members have one last reference and one parent;
should they not, everything is done again with other fingerprints.

The nodes that have one smallest member make a chain of depths. Sums over subtrees are sums over chains: what hangs on a chain is added
up by pointer doubling, in as many rounds as the logarithm of the chains' nesting, and then along the chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.llm.tables import in_ranges, only, parallelism, with_hot, written

PRIME = (1 << 31) - 1
LANES = 4
#: Conversations that share a base, and one more than the longest head.
GROUP = 5
HEADS = 9
#: Attempts with different fingerprints; a second one is needed about never.
ATTEMPTS = 4
#: Ids of one node that are joined to one text, and depths of a chain that are added up at once.
CHUNK = 1 << 10
BLOCK = 1 << 12
KEY = ["depth", "f_a", "f_b"]


def bases(salt: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{salt}:{k}".encode()).digest()[:8], "big") % (PRIME - 2) + 2 for k in range(LANES)]


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    out, square, rest = np.ones(len(exponents), np.int64), base, exponents.copy()
    while rest.any():
        out = np.where(rest & 1, out * square % PRIME, out)
        square, rest = square * square % PRIME, rest >> 1
    return out


def _packed(lanes: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(lanes[k] | lanes[k + 1] << 31) for k in (0, 2)]


def _products(salt: int):
    """Sorted rows (part, conv_id, role, text) -> the place of every turn among those of its conversation in its part, and products up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, start = bases(salt), salt.to_bytes(4, "big")
        last, seen, carried = None, 0, [0] * LANES
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(1).to_numpy()
            raw, sizes = bytearray(), np.zeros(n, np.int64)
            for k, (role, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                role, text = role.encode(), text.encode()
                sizes[k] = len(text)
                raw += hashlib.sha256(b"".join((start, len(role).to_bytes(8, "big"), role, text))).digest()
            digest = np.frombuffer(bytes(raw), np.uint32).reshape(n, 8)
            begins = np.append(conv[0] != last, conv[1:] != conv[:-1])
            segment = np.cumsum(begins)
            starts = np.flatnonzero(begins)
            first = np.append(0, starts)[segment] if starts.size else np.zeros(n, np.int64)
            before = np.where(segment == 0, seen, 0)
            place = np.arange(n) - first + before  # from 0
            up_to, without = [], []
            for k in range(LANES):
                term = (digest[:, k] & 0x7FFFFFFF).astype(np.int64) % PRIME * powers(base[k], place) % PRIME
                total = np.cumsum(term)
                value = (total - np.append(0, total)[first] + np.where(segment == 0, carried[k], 0)) % PRIME
                up_to.append(value)
                without.append((value - term) % PRIME)
            references = digest[:, 4:].copy().view(np.int64)
            last, seen, carried = conv[-1], int(place[-1]) + 1, [int(v[-1]) for v in up_to]
            columns = [batch.column(0), batch.column(1), pa.array(place + 1), *_packed(up_to), *_packed(without), pa.array(references[:, 0]), pa.array(references[:, 1]), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "conv_id", "i", "v_a", "v_b", "u_a", "u_b", "r_a", "r_b", "bytes"])

    return run


def _lanes(a: Column, b: Column) -> list[Column]:
    low = F.lit(PRIME).cast("long")
    return [a.bitwiseAND(low), F.shiftright(a, 31), b.bitwiseAND(low), F.shiftright(b, 31)]


def _pack(lanes: list[Column]) -> tuple[Column, Column]:
    return tuple(lanes[k].bitwiseOR(F.shiftleft(lanes[k + 1], 31)) for k in (0, 2))


def _whole(local: DataFrame, salt: int) -> DataFrame:
    """Places and products within parts -> those within conversations. A conversation that crosses parts is the last of one and
    the first of the next, so at most two rows a part go through the driver."""
    spark = local.sparkSession
    bounds = local.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).orderBy("part").collect()
    crossing = sorted({x["high"] for x, y in zip(bounds, bounds[1:]) if x["high"] == y["low"]})
    offsets = []
    if crossing:
        ids = F.broadcast(spark.createDataFrame([(c,) for c in crossing], "conv_id long"))
        sums = local.join(ids, "conv_id").groupBy("conv_id", "part").agg(F.max("i").alias("n"), F.max_by("v_a", "i").alias("a"), F.max_by("v_b", "i").alias("b"))
        base, at = bases(salt), {}
        for r in sums.orderBy("conv_id", "part").collect():
            n, value = at.get(r["conv_id"], (0, [0] * LANES))
            factor = [pow(x, n, PRIME) for x in base]
            offsets.append((r["part"], r["conv_id"], n, factor, value))
            own = [r["a"] & PRIME, r["a"] >> 31, r["b"] & PRIME, r["b"] >> 31]
            at[r["conv_id"]] = (n + r["n"], [(v + f * x) % PRIME for v, f, x in zip(value, factor, own)])
    if not offsets:
        return local.drop("part")
    before = spark.createDataFrame(offsets, "part int, conv_id long, n_before long, factor array<long>, value array<long>")
    joined = local.join(F.broadcast(before), ["part", "conv_id"], "left")

    def moved(a: str, b: str) -> list[Column]:
        lanes = [F.pmod(F.col("value")[k] + F.col("factor")[k] * x, F.lit(PRIME)) for k, x in enumerate(_lanes(F.col(a), F.col(b)))]
        return [F.when(F.col("n_before").isNull(), F.col(c)).otherwise(x).alias(c) for c, x in zip((a, b), _pack(lanes))]

    return joined.select("conv_id", (F.col("i") + F.coalesce("n_before", F.lit(0))).alias("i"), *moved("v_a", "v_b"), *moved("u_a", "u_b"), "r_a", "r_b", "bytes")


def _after(head: list[Column], own: list[Column], cut: list[Column], shift: Column, salt: int) -> tuple[Column, Column]:
    """The product of a head of k turns and of an own prefix without its first h turns: head + base^(k - h) (own - cut); shift is h - k."""
    tables = [F.array(*[F.lit(pow(b, -s, PRIME)).cast("long") for s in range(HEADS)]) for b in bases(salt)]
    return _pack([F.pmod(x + F.element_at(t, shift.cast("int") + 1) * F.pmod(y - z, F.lit(PRIME)), F.lit(PRIME)) for x, y, z, t in zip(head, own, cut, tables)])


def _rebuilt(turns: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, KEY, parent's p_a, p_b, reference r_a, r_b, bytes), one a member and depth, and each conversation's last node (conv_id, KEY)."""
    zero = F.lit(0).cast("long")
    turn = F.struct("i", "v_a", "v_b", "u_a", "u_b", "r_a", "r_b", "bytes")
    convs = turns.groupBy("conv_id").agg(
        F.max("i").alias("n"), F.max_by("v_a", "i").alias("all_a"), F.max_by("v_b", "i").alias("all_b"),
        F.sort_array(F.collect_list(F.when(F.col("i") < HEADS, turn))).alias("heads"),
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    convs = written(convs.withColumn("h", h))
    donors = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"), F.col("heads").alias("base_heads"))
    k = F.least("h", F.coalesce("n_base", zero)).cast("int")
    joined = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(donors, "base", "left").withColumn("k", k)
    of = lambda column, at, name: F.when((at > 0) & (at <= F.size(column)), F.get(column, at - 1)[name]).otherwise(zero)
    info = joined.select(
        "conv_id", "n", "h", "k", "all_a", "all_b", F.slice(F.coalesce("base_heads", F.array().cast(convs.schema["heads"].dataType)), 1, F.col("k")).alias("head"),
        *[of("base_heads", F.col("k"), f"v_{x}").alias(f"k_{x}") for x in "ab"], *[of("heads", F.col("h"), f"v_{x}").alias(f"h_{x}") for x in "ab"],
    )
    info = written(info)
    lanes = lambda name: _lanes(F.col(f"{name}_a"), F.col(f"{name}_b"))
    shift = F.col("h") - F.col("k")
    root = info.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("f_a", "f_b", "p_a", "p_b", "r_a", "r_b", "bytes")])
    heads = info.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.i").alias("depth"), F.col("t.v_a").alias("f_a"), F.col("t.v_b").alias("f_b"), F.col("t.u_a").alias("p_a"), F.col("t.u_b").alias("p_b"), "t.r_a", "t.r_b", "t.bytes"
    )
    later = info.where("n > h").select("conv_id", "n", F.col("n").alias("length"), "h", "k", "k_a", "k_b", "h_a", "h_b")
    suffix = with_hot(turns, later, "conv_id", turns.count()).where("i > h")
    f, p = (_after(lanes("k"), lanes(x), lanes("h"), shift, salt) for x in "vu")
    own = suffix.select("conv_id", (F.col("k") + F.col("i") - F.col("h")).alias("depth"), f[0].alias("f_a"), f[1].alias("f_b"), p[0].alias("p_a"), p[1].alias("p_b"), "r_a", "r_b", "bytes")
    last = _after(lanes("k"), lanes("all"), lanes("h"), shift, salt)
    ends = info.select(
        "conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), zero)).alias("depth"),
        *[F.when(F.col("n") > F.col("h"), x).otherwise(F.col(f"k_{c}")).alias(f"f_{c}") for c, x in zip("ab", last)],
    )
    return root.unionByName(heads).unionByName(own), ends


def _nodes(rows: DataFrame) -> DataFrame | None:
    """One row a node: KEY, p_a, p_b, conv_id, n_convs, saved; None if two different sequences share a fingerprint."""
    same = ["p_a", "p_b", "r_a", "r_b"]
    found = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"{c}_most") for c in same]
    )
    found = written(found)
    if found.where(" or ".join(f"{c} != {c}_most" for c in same)).head(1):
        return None
    return found.select(*KEY, "p_a", "p_b", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (KEY, conv_id) -> (KEY, first id, ids as text), at most CHUNK ids each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        cuts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
        starts = [k for a, b in zip(cuts, np.append(cuts[1:], batch.num_rows)) for k in range(a, b, CHUNK)]
        ids = batch.column(3).to_pylist()
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], batch.num_rows])]
        at = pa.array(starts, pa.int64())
        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(4)], pa.array(texts, pa.string())], [*KEY, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks, sorted by KEY and first id -> each key's digest of the ids joined by commas."""
    last, running = None, None
    for batch in batches:
        out = []
        for *key, ids in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 4)]):
            if key == last:
                running.update(b"," + ids.encode())
                continue
            if last is not None:
                out.append((*last, running.hexdigest()))
            last, running = key, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_pydict({c: list(x) for c, x in zip([*KEY, "ends_sha256"], zip(*out))})
    if last is not None:
        yield pa.RecordBatch.from_pydict({c: [x] for c, x in zip([*KEY, "ends_sha256"], (*last, running.hexdigest()))})


def _end_digests(ends: DataFrame) -> DataFrame:
    """KEY and the digest of the ids that end there. Ids become texts of bounded size in ranges, so that a node of very many is few rows."""
    order = [F.col(c) for c in (*KEY, "conv_id")]
    kinds = "depth long, f_a long, f_b long"
    chunks = in_ranges(ends.select(*order), *order).mapInArrow(_chunks, f"{kinds}, first long, ids string")
    sorted_chunks = chunks.repartition(parallelism(ends.sparkSession), *KEY).sortWithinPartitions(*KEY, "first")
    return sorted_chunks.mapInArrow(_digests, f"{kinds}, ends_sha256 string")


def _chain_sums(nodes: DataFrame) -> DataFrame:
    """What hangs on each node by other chains: conv_id, depth, more_leaves, more_saved.

    A chain is the run of nodes with one smallest member. In round j a chain's sums reach what hangs up to 2^j chains below it."""
    own = nodes.groupBy("conv_id").agg(F.sum(F.col("leaf").cast("long")).alias("leaves"), F.sum("saved").alias("saved"), F.min_by("parent_conv_id", "depth").alias("parent"), (F.min("depth") - 1).alias("at"))
    state = written(own.withColumn("above", F.col("parent")))
    while (rising := state.where("above is not null").count()) > 0:
        added = state.where("above is not null").groupBy("above").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("n"))
        grown = written(state.join(added.withColumnRenamed("above", "conv_id"), "conv_id", "left"))
        lookup = grown.where("n is not null").select(F.col("conv_id").alias("above"), F.col("above").alias("next"), "n")
        sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        moved = with_hot(grown.where("above is not null"), lookup, "above", rising).select("conv_id", *sums, "parent", "at", F.col("next").alias("above"))
        state = written(moved.unionByName(grown.where("above is null").select("conv_id", *sums, "parent", "at", "above")))
    return state.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


def _subtrees(nodes: DataFrame) -> DataFrame:
    """nodes with n_leaves and saved_tokens over their subtrees: sums along each chain from its deepest node, in blocks of depths."""
    joined = nodes.join(_chain_sums(nodes), ["conv_id", "depth"], "left")
    held = joined.withColumns({
        "leaves": F.col("leaf").cast("long") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)), "block": F.floor(F.col("depth") / BLOCK),
    }).drop("more_leaves", "more_saved")
    held = written(held)
    down = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = held.where("block > 0").groupBy("conv_id", "block").agg(F.sum("leaves").alias("b_leaves"), F.sum("saved").alias("b_saved"))
    # a chain has no gaps, so all that lies below a block's nodes lies from the next block on
    below = blocks.select("conv_id", (F.col("block") - 1).alias("block"), F.sum("b_leaves").over(down).alias("b_leaves"), F.sum("b_saved").over(down).alias("b_saved"))
    along = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = held.withColumns({"n_leaves": F.sum("leaves").over(along), "saved_tokens": F.sum("saved").over(along)}).join(below, ["conv_id", "block"], "left")
    return summed.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("b_leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("b_saved", F.lit(0))})


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    conversations: conv_id, turn, role, text. Turns of one number are ordered by role and text, null and missing numbers first; null roles
    and texts are empty. Rows without a conv_id belong to no conversation. Repeated rows are turns of their own. An empty
    table gives no node, not even the root. Texts of any length count whole; a conversation of very many turns, one that very many share and a
    node of very many children are dealt over all tasks. Further columns, whatever their names, are ignored.
    """
    given = only(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null")
    given = given.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    ordered = in_ranges(given, F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")).select(F.spark_partition_id().alias("part"), "conv_id", "role", "text")
    for salt in range(ATTEMPTS):
        longs = ("v_a", "v_b", "u_a", "u_b", "r_a", "r_b", "bytes")
        turns = _whole(written(ordered.mapInArrow(_products(salt), "part int, conv_id long, i long, " + ", ".join(f"{c} long" for c in longs))), salt)
        rows, ends = _rebuilt(turns, salt)
        nodes = _nodes(rows)
        if nodes is not None:
            break
    else:
        raise RuntimeError(f"{ATTEMPTS} kinds of fingerprints each took different sequences of turns for equal")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p_a").alias("f_a"), F.col("p_b").alias("f_b")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, KEY, "left").join(_end_digests(ends), KEY, "left")
    known = written(known.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)), "leaf": F.col("n_children").isNull()}))
    parents = known.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("f_a").alias("p_a"), F.col("f_b").alias("p_b"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = with_hot(known.where("depth > 0"), parents, ["depth", "p_a", "p_b"], known.count())
    whole = written(below.unionByName(known.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))).drop("f_a", "f_b", "p_a", "p_b"))
    return _subtrees(whole).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
