"""Models fitted on all labelled rows: each shard of them is fitted by one task, and the shards' parameters are averaged."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.tables import written

#: Rows of each label that a shard has at least, if need be as copies.
LEAST = 64
#: Groups of shards whose means come to the driver, so what comes there does not grow with the rows.
GROUPS = 16
#: Labels up to this number are broadcast to the texts; beyond it Spark decides.
BROADCAST_MARKS = 1 << 20


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of docs that marks (doc_id, ...; one row a document) names, with its columns: written, for several passes."""
    marks = written(marks)
    return written(docs.join(F.broadcast(marks) if marks.count() <= BROADCAST_MARKS else marks, "doc_id"))


def dealt(rows: DataFrame, label: str, sizes: dict[int, int], shards: int) -> DataFrame:
    """rows (with ``k``, a hash) with ``shard``. Every row is in one; those of a label with fewer than LEAST rows a shard are in several."""
    copies = F.lit(1)
    for y, n in sizes.items():
        copies = F.when(F.col(label) == y, min(shards, -(-shards * LEAST // n))).otherwise(copies)
    turned = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), copies - 1)))
    return turned.withColumn("shard", F.pmod(F.pmod(F.xxhash64("k"), F.lit(shards)) + F.col("turn"), F.lit(shards)).cast("int")).drop("turn")


def averaged(rows: DataFrame, shards: int, fit: Callable[[pa.Table], np.ndarray | None]) -> np.ndarray | None:
    """The mean of fit(shard's rows, sorted by k) over the shards of ``dealt``, weighed by their rows; shards without a fit are left out."""

    def one(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        found = fit(table.sort_by("k"))
        held = [] if found is None else [np.asarray(found, np.float64).tobytes()]
        return pa.table({"shard": pa.array([shard] * len(held), pa.int32()), "n": pa.array([table.num_rows] * len(held), pa.int64()), "p": pa.array(held, pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        total, n = 0.0, 0
        for size, p in zip(table.column("n").to_pylist(), table.column("p")):
            total, n = total + size * np.frombuffer(p.as_py(), np.float64), n + size
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py() % GROUPS], pa.int32()), "n": pa.array([n], pa.int64()), "p": pa.array([total.tobytes()], pa.binary())})

    schema = "shard int, n long, p binary"
    # a number of partitions that is given stays: small shards are not put together in few tasks
    fits = rows.repartition(2 * shards, "shard").groupBy("shard").applyInArrow(one, schema)
    sums = fits.groupBy((F.col("shard") % GROUPS).alias("own")).applyInArrow(summed, schema).collect()
    if not sums:
        return None
    return sum(np.frombuffer(r["p"], np.float64) for r in sorted(sums, key=lambda r: r["shard"])) / sum(r["n"] for r in sums)
