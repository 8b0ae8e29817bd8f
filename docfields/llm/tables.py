"""Tables that outlive a job: lineage is cut by Parquet files in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, on one machine only, a new temporary folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, *by: str, compression: str = "zstd") -> DataFrame:
    """Write a table once to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    out = df.write.option("compression", compression)
    (out.partitionBy(*by) if by else out).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that this process has written and not removed.
_written: list[str] = []


def mark() -> int:
    """A place in the order of writing, for ``clear``."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Remove what ``written`` made between two marks; tables that still read from there can no longer be read."""
    for path in _written[since:until]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    del _written[since:until]


#: A key that holds more than this part of a table's rows is hot, so there are fewer hot keys than this.
HOT_PART = 1024
#: Rows that no key is hot with.
HOT_LEAST = 256


def with_hot(rows: DataFrame, lookup: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """rows joined with lookup (key, n, ...) that has one row a key, n being its rows: no task takes all rows of one key.

    Keys that hold more than a HOT_PART-th of the total are fewer than HOT_PART, so these are broadcast; the others shuffle."""
    most = max(HOT_LEAST, total // HOT_PART)
    hot, others = lookup.where(F.col("n") > most).drop("n"), lookup.where(F.col("n") <= most).drop("n")
    if not hot.head(1):
        return rows.join(others, key)
    hot, keys = F.broadcast(hot), [key] if isinstance(key, str) else key
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(others, keys))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes that one bucket of index entries holds, about; a task takes a bucket whole.
BUCKET_BYTES = 32 << 20


def buckets_for(docs: DataFrame, share: float, least: int) -> int:
    """Buckets for entries that are ``share`` of the texts' bytes, counted, so that one stays about BUCKET_BYTES whatever the input."""
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return max(least, -(-int(size * share) // BUCKET_BYTES))


def only(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns, cast; further columns, whatever their names, do not go along."""
    return docs.select(*[docs[c].cast(kind).alias(c) for c, kind in columns.items()])


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """df sorted within partitions that follow each other in this order; equal rows are spread by their place in df."""
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    return placed.repartitionByRange(parallelism(df.sparkSession), *order, "_place").sortWithinPartitions(*order, "_place").drop("_place")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with ``number``, each row's place (from 1) in this order of all rows; rows alike in it come in either order.

    Only the ranges' sizes, one number each, go through the driver."""
    # within a partition the ids rise by one; the partition's own number stands above these bits
    ids = in_ranges(df, *order).withColumn("_id", F.monotonically_increasing_id())
    held = written(ids.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"))
    before, total = [], 0
    for r in held.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        before.append((r["_part"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    return held.join(F.broadcast(offsets), "_part").withColumn("number", F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")
