"""Structured Streaming counterparts of counting, labelling, latest state and once-only handling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.sinks import exists


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)


def hourly_counts(stream: DataFrame, entity: str, ts: str, late: str = "2 hours") -> DataFrame:
    """(entity, hour, n) of tumbling hours, final once the watermark has passed."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), entity).agg(F.count("*").alias("n"))
    return counted.select(entity, F.col("window.start").alias("hour"), "n")


def trailing_counts(stream: DataFrame, entity: str, ts: str, hours: int = 24, late: str = "2 hours") -> DataFrame:
    """Counts over sliding windows that end at each hour."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, f"{hours} hours", "1 hour"), entity).agg(F.count("*").alias("n"))
    return counted.select(entity, F.col("window.end").alias("until"), "n")


#: Where keyed state lives: on the executors' disks, with changes in the checkpoint.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_LABEL = Row("entity", "us", "state", "next_us", "gap_minutes", "label")


class NextState(StatefulProcessor):
    """Labels each row of an entity by the state of the row after it.

    Held of an entity: rows that the watermark has not passed, as earlier ones may still come; the last row that it has passed,
    which waits for its successor; and one timer, at the time from which any of them can be settled. State that lives by
    event time has no time to live of its own, so the timer is what removes it.
    """

    def __init__(self, tolerance_us: int, tie: str):
        self.tolerance, self.tie = tolerance_us, tie

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", f"us bigint, tie {self.tie}, seq int", "state boolean")
        self.last = handle.getValueState("last", "us bigint, state boolean")
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        for r in rows:
            seq = 0
            while self.open.containsKey((r.us, r.tie, seq)):  # rows that tie in all are all kept
                seq += 1
            self.open.updateValue((r.us, r.tie, seq), (r.state,))
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _settled(self, key, mark: int):
        rows = sorted(((tuple(k), v[0]) for k, v in self.open.iterator()), key=lambda x: (x[0][0], x[0][1] is not None, x[0][1], x[0][2]))
        last = self.last.get()
        for k, state in rows:
            if k[0] > mark:
                break
            if last is not None:
                gap = k[0] - last[0]
                yield _LABEL(key[0], last[0], last[1], k[0], gap / 6e7, state if gap <= self.tolerance else None)
            last = (k[0], state)
            self.open.removeKey(k)
        if last is not None and last[0] + self.tolerance < mark:
            yield _LABEL(key[0], last[0], last[1], None, None, None)
            last = None
        if last is None:
            self.last.clear()
        else:
            self.last.update(last)
        waits = [k[0] for k, _ in rows if k[0] > mark][:1] + ([last[0] + self.tolerance] if last is not None else [])
        if (old := self.timer.get()) is not None:
            self.handle.deleteTimer(old[0])
            self.timer.clear()
        if waits:
            due = max(min(waits), mark) // 1000 + 1
            self.handle.registerTimer(due)
            self.timer.update((due,))


def next_state_labels(stream: DataFrame, entity: str, ts: str, state: str, tolerance_minutes: float = 90.0, late: str = "2 hours", tie: str | None = None) -> DataFrame:
    """(entity, ts, state, next_ts, gap_minutes, label): each row once its successor is certain.

    Rows that come out of order are put in order of event time, then of `tie`, before they are labelled; a row later than the
    watermark allows is dropped by Spark, and `late_rows` counts those. A row whose successor lies past the tolerance gets a null
    label; one whose successor hasn't come when the watermark is past the tolerance gets a null next_ts and gap as well. Rows
    without a time go. Sets the session's state store to RocksDB, which this needs.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = dict(stream.dtypes)[tie] if tie else "int"
    at = F.col(ts).cast("timestamp")
    rows = stream.where(at.isNotNull()).select(F.col(entity).cast("string").alias("entity"), at.alias("ts"), F.unix_micros(at).alias("us"), (F.col(tie) if tie else F.lit(0)).alias("tie"), F.col(state).cast("boolean").alias("state"))
    out = "entity string, us bigint, state boolean, next_us bigint, gap_minutes double, label boolean"
    found = rows.withWatermark("ts", late).groupBy("entity").transformWithState(NextState(round(tolerance_minutes * 6e7), kind), out, "Append", "EventTime")
    return found.select(F.col("entity").alias(entity), F.timestamp_micros("us").alias("ts"), "state", F.timestamp_micros("next_us").alias("next_ts"), "gap_minutes", "label")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators have dropped for coming after the watermark, as far as its kept progress goes back."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def latest_state(stream: DataFrame, entity: str, ts: str, columns: list[str]) -> DataFrame:
    """Each entity's columns at its latest time, for update or complete output."""
    return stream.groupBy(entity).agg(F.max_by(F.struct(ts, *columns), ts).alias("s")).select(entity, "s.*")


def once_only(stream: DataFrame, key: str, ts: str, within: str = "1 day") -> DataFrame:
    """Rows whose key hasn't been seen within the watermark."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def deliver(stream: DataFrame, key: str, ts: str, folder: str, checkpoint: str, within: str = "1 day", then: Callable[[DataFrame, str], None] | None = None) -> StreamingQuery:
    """Starts a query that puts each key's first row into `folder` once, whatever happens to the query, and ends when the input is read.

    Repeats inside `within` are dropped by state. Each batch is written to a part of its own, named by the checkpoint's query id
    and the batch id, in place of what an ended run left of it: a batch that is done again after a restart stands there once. Rows
    whose key another part has are left out, so a lost checkpoint sends nothing twice. `then` gets what a
    batch has put and its part's name, once that is whole; it is called again with the same name and rows if the query ends before the
    batch is recorded, so an effect outside can tell the repeat by the name. The folder holds the stream's columns, run and batch.
    """

    def put(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        part = f"{folder}/run={run}/batch={batch}"
        if exists(spark, folder):
            there = StructType([*rows.schema.fields, StructField("run", StringType()), StructField("batch", LongType())])
            sent = spark.read.schema(there).parquet(folder).where((F.col("run") != run) | (F.col("batch") != batch)).select(key)
            rows = rows.join(sent.distinct(), key, "left_anti").select(rows.columns)
        rows.write.mode("overwrite").parquet(part)
        if then is not None:
            then(spark.read.schema(rows.schema).parquet(part), f"{run}/{batch}")

    return once_only(stream, key, ts, within).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
