"""Streams of documents, job events and corrections, and the batch forms they must agree with.

Every function takes a DataFrame that may be a stream unless its docstring says batch. Streams run with a checkpoint in the cluster's
shared folder, and what they keep between batches is there as well, by batch id, so that a stream goes on after a restart.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docfields.functions import scalars as S
from docfields.operators import status as St


def shared_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset, on one machine only, a temporary folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Batches after which a stream's parts are merged into one.
MERGED_EVERY = 16


class BatchState:
    """A table that a stream keeps in a folder: what each batch adds, and now and then all of it merged.

    combine: rows -> rows, the same for rows that it has combined before. A batch writes its own rows alone, as part=<id>; every MERGED_EVERY-th
    writes base=<id> with all so far and removes what that holds. A batch that is run again after a crash writes the same folders again."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, combine: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.schema, self.combine = spark, folder, schema, combine

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _ids(self, kind: str) -> list[int]:
        """Batches with a whole folder of a kind."""
        root, fs = self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and fs.exists(self._path(f"{n}/_SUCCESS")[0]))

    def _folders(self, before: int | None = None) -> list[str]:
        """The last base and the parts after it, of batches before one."""
        bases, parts = ([i for i in self._ids(kind) if before is None or i < before] for kind in ("base", "part"))
        last = bases[-1] if bases else -1
        return [f"base={last}"] * (last >= 0) + [f"part={i}" for i in parts if i > last]

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{f}" for f in folders])

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        names = [x.split(" ")[0] for x in self.schema.split(", ")]
        rows = self.combine(batch.select(*[F.col(x.split(" ")[0]).cast(x.split(" ")[1]) for x in self.schema.split(", ")])).select(*names)
        held = self._folders(batch_id)
        if len(held) < MERGED_EVERY:
            rows.write.mode("overwrite").parquet(f"{self.folder}/part={batch_id}")
            return
        self.combine(self._read(held).unionByName(rows)).select(*names).write.mode("overwrite").parquet(f"{self.folder}/base={batch_id}")
        for f in held:
            path, fs = self._path(f)
            fs.delete(path, True)

    def table(self) -> DataFrame:
        folders = self._folders()
        return self.combine(self._read(folders)) if folders else self.spark.createDataFrame([], self.schema)


def job_state(events: DataFrame) -> DataFrame:
    """The last state of each job, its first start, last completion and failures; edits are no state. In a stream: update mode."""
    states = events.where("state != 'edited'")
    when = lambda state: F.when(F.col("state") == state, F.col("ts"))
    return states.groupBy("job_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.min(when("processing")).alias("started"), F.max(when("completed")).alias("completed"), F.count_if(F.col("state") == "failed").alias("failures"))


#: The states that may follow each state; a job begins in one that follows none. Editing is no state.
TRANSITIONS = {None: ("pending",), "pending": ("processing", "failed"), "processing": ("completed", "failed"), "failed": ("pending", "processing"), "completed": ()}
RULED = "job_id bigint, event_id bigint, ts timestamp, before string, state string, legal boolean, reason string"


def _reason(before: Column, state: Column, may: Column) -> Column:
    """Why a state may not follow the one before; null if it may."""
    said = F.when(before.isNull(), F.concat(F.lit("a job does not begin "), state)).otherwise(F.concat(before, F.lit(" does not become "), state))
    return F.when(state.isNull(), "no state").when(state == before, "repeated").when(~F.array_contains(may, state), said)


def transitions(events: DataFrame, table: dict[str | None, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """Every event with the job's state before it, whether it may follow that, and the reason if not: an illegal event changes nothing.

    Batch: a fold over each job's events in the order of (ts, event_id), edits left out. The fold carries one state; a job's events are
    one list, so a job is bounded by what one task holds."""
    known = F.create_map(*[x for s, after in table.items() if s is not None for x in (F.lit(s), F.array(*map(F.lit, after)).cast("array<string>"))])
    first = F.array(*map(F.lit, table[None]))

    def step(done: Column, e: Column) -> Column:
        may = F.when(done["at"].isNull(), first).otherwise(F.coalesce(F.try_element_at(known, done["at"]), F.array().cast("array<string>")))
        reason = _reason(done["at"], e["state"], may)
        return F.struct(F.when(reason.isNull(), e["state"]).otherwise(done["at"]).alias("at"), done["at"].alias("before"), reason.alias("reason"))

    listed = events.where("state is null or state != 'edited'").groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "state"))).alias("e"))
    start = F.struct(F.lit(None).cast("string").alias("at"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("reason"))
    out = F.expr("cast(array() as array<struct<before: string, reason: string>>)")

    def collect(done: Column, e: Column) -> Column:
        now = step(done["s"], e)
        return F.struct(now.alias("s"), F.array_append(done["out"], F.struct(now["before"].alias("before"), now["reason"].alias("reason"))).alias("out"))

    folded = F.aggregate("e", F.struct(start.alias("s"), out.alias("out")), collect)["out"]
    rows = listed.select("job_id", F.explode(F.arrays_zip(F.col("e"), folded.alias("r"))).alias("x"))
    return rows.select("job_id", "x.e.event_id", "x.e.ts", "x.r.before", "x.e.state", F.col("x.r.reason").isNull().alias("legal"), "x.r.reason")


def fresh_events(events: DataFrame, done: DataFrame) -> DataFrame:
    """Batch: the first event of each job and state, without jobs that are done already."""
    first = events.groupBy("job_id", "state").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("job_id", "state", "f.*")
    return first.join(done, "job_id", "left_anti")


def fresh_stream(events: DataFrame, done: DataFrame, within: str = "1 day") -> DataFrame:
    """Stream: events not repeated within the watermark, without jobs that are done already."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["job_id", "state"]).join(done, "job_id", "left_anti")


WAITING = ("pending", "processing")


def stuck_jobs(events: DataFrame, timeout: str) -> DataFrame:
    """Batch: jobs whose last event is pending or processing and older than the timeout, measured from the newest event of all."""
    latest = events.groupBy("job_id").agg(F.max_by(F.struct("state", "ts"), F.struct("ts", "event_id")).alias("b")).select("job_id", "b.*")
    newest = events.agg(F.max("ts").alias("now"))
    return latest.crossJoin(newest).where(F.col("state").isin(*WAITING) & (F.col("ts") < F.col("now") - F.expr(f"interval {timeout}"))).select("job_id", "state", "ts")


STUCK = "job_id bigint, state string, ms bigint"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in schema.split(", ")], dtype=object)


class _Ruled(StatefulProcessor):
    """The state machine of one job: its state in the table, and each event judged by it."""

    def __init__(self, table: dict[str | None, tuple[str, ...]]):
        self.table = table

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "state string")

    def handleInputRows(self, key, rows, timerValues):
        at = self.at.get()[0] if self.at.exists() else None
        begun, out = at, []
        for batch in rows:
            out += batch[["ts", "event_id", "state"]].itertuples(index=False, name=None)
        found = []
        for ts, event, state in sorted(out, key=lambda e: e[:2]):
            state = None if pd.isna(state) else state
            if state == "edited":
                continue
            may = self.table.get(at, ())
            reason = "no state" if state is None else "repeated" if state == at else None if state in may else f"a job does not begin {state}" if at is None else f"{at} does not become {state}"
            found.append((key[0], event, ts, at, state, reason is None, reason))
            at = at if reason else state
        if at != begun:
            self.at.update((at,))
        yield _frame(found, RULED)

    def close(self) -> None:
        pass


def transition_stream(events: DataFrame, table: dict[str | None, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """Stream: ``transitions`` of the events as they come; a micro-batch's events are put in order, later ones follow those before."""
    return events.groupBy("job_id").transformWithStateInPandas(_Ruled(table), RULED, "append", "none")


class _Stuck(StatefulProcessor):
    """A job's newest event, and a timer that fires when its timeout has passed without another."""

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, event_id long, state string, said boolean")

    def handleInputRows(self, key, rows, timerValues):
        held = self.last.get() if self.last.exists() else None
        newest = (held[0], held[1], held[2]) if held else None
        for batch in rows:
            for ms, event, state in batch[["ms", "event_id", "state"]].itertuples(index=False, name=None):
                now = (int(ms), int(event), None if pd.isna(state) else state)
                newest = now if newest is None or now[:2] > newest[:2] else newest
        if held is None or newest[:2] != (held[0], held[1]):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((*newest, False))
            if newest[2] in WAITING:
                # a timer fires once the watermark has passed it, also if that was before
                self.handle.registerTimer(newest[0] + self.timeout)
        yield _frame([], STUCK)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ms, event, state, said = self.last.get()
        self.last.update((ms, event, state, True))
        yield _frame([] if said else [(key[0], state, ms)], STUCK)

    def close(self) -> None:
        pass


def stuck_stream(events: DataFrame, timeout_seconds: int, late: str = "0 seconds") -> DataFrame:
    """Stream: a job whose newest event is pending or processing, once its timeout has passed by the watermark, without input of its own.

    job_id, state and ts (milliseconds) of that event. A newer event puts the timeout off, and after it the job may be reported again; rows later
    than ``late`` may be dropped by the watermark."""
    timed = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    found = timed.groupBy("job_id").transformWithStateInPandas(_Stuck(timeout_seconds * 1000), STUCK, "append", "EventTime")
    return found.select("job_id", "state", F.timestamp_millis("ms").alias("ts"))


def kpi_windows(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events by state in tumbling or sliding windows; in a stream, rows later than the watermark go."""
    kept = events.withWatermark("ts", late) if late else events
    return kept.groupBy("state", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select("state", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Events of a job in sessions that end with a gap."""
    kept = events.withWatermark("ts", late) if late else events
    return kept.groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("job_id", F.col("w.start").alias("start"), "n")


def _streamed(df: DataFrame) -> DataFrame:
    """The rows of a batch as a stream over files in the shared folder."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).parquet(path)


def ingest(documents: DataFrame) -> DataFrame:
    """Documents that arrive as files become candidates (doc_id, field_name, value, quality): what a stream wrote, once all files are in."""
    spark = documents.sparkSession
    source = _streamed(documents.select("doc_id", "text", "lang"))
    candidates = source.select("doc_id", F.lit("title").alias("field_name"), F.regexp_extract("text", r"^\s*([^.\n]{1,80})", 1).alias("value"), S.quality_ratio(F.col("text")).alias("quality")).where("value != ''")
    out = shared_folder(spark)
    candidates.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(candidates.schema).parquet(out)


JOBS = "job_id bigint, state string, ts timestamp, event_id bigint"
CORRECTIONS = "field_key string, anchor_text string, value string, ts bigint, conv_id bigint, conf_pct bigint"


def _latest_jobs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_id").agg(F.max_by(F.struct("state", "ts", "event_id"), F.struct("ts", "event_id")).alias("b")).select("job_id", "b.*")


def _latest_corrections(rows: DataFrame) -> DataFrame:
    latest = Window.partitionBy("field_key", F.substring("anchor_text", 1, 100)).orderBy(F.desc("ts"), F.desc("conv_id"))
    return rows.withColumn("rn", F.row_number().over(latest)).where("rn = 1").drop("rn")


def _kept(source: DataFrame, folder: str, schema: str, combine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over what has arrived, from where the folder's checkpoint stands, and return what it keeps."""
    state = BatchState(source.sparkSession, f"{folder}/state", schema, combine)
    source.writeStream.foreachBatch(state.add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state.table()


def upsert_stream(source: DataFrame, folder: str) -> DataFrame:
    """The latest state of each job of a stream of events, kept in a folder: called again, also by another session, it goes on."""
    return _kept(source.select("job_id", "state", "ts", "event_id"), folder, JOBS, _latest_jobs).select("job_id", "state", "ts")


def correction_stream(source: DataFrame, folder: str, k: int = 5) -> DataFrame:
    """``correction_memory`` of a stream of corrections, kept in a folder: called again, it goes on."""
    return St.correction_memory(_kept(source, folder, CORRECTIONS, _latest_corrections), k)


def run_upsert(events: DataFrame) -> DataFrame:
    """``upsert_stream`` over a batch's rows as files that arrive."""
    return upsert_stream(_streamed(events.select("job_id", "state", "ts", "event_id")), shared_folder(events.sparkSession))


def run_correction_stream(corrections: DataFrame, k: int = 5) -> DataFrame:
    """``correction_stream`` over a batch's rows as files that arrive."""
    return correction_stream(_streamed(corrections), shared_folder(corrections.sparkSession), k)
