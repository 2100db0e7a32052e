"""Incremental ingest, daily counts, attempts per session, alerts and embedding as streams.

These extend the batch operators; event time needs ``timestamp`` columns, as watermarks reject zone-less ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quernlake.functions.rates import no_attempt_signal
from quernlake.operators.corpus_store import Embedder, embed


def daily_counts(events: DataFrame, time: str, kind: str, late: str = "1 day") -> DataFrame:
    """(day, kind, n) by tumbling days of event time; rows later than ``late`` are dropped."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", "1 day"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "kind", "n")


def sessions_of(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user, start, end, n): runs of a user's events with no gap longer than ``gap``."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    grouped = timed.groupBy(F.session_window("__t", gap).alias("w"), F.col(user).alias("user")).agg(F.count("*").alias("n"))
    return grouped.select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sliding_counts(events: DataFrame, time: str, size: str = "1 hour", slide: str = "30 minutes", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def attempts_per_session(tries: DataFrame, idle: str | None = None) -> DataFrame:
    """A keyed-state operator: each session's attempt count and largest sequence so far, told on every change.

    With ``idle``, a pandas time span of processing time, the state of a session without attempts for so long is dropped,
    and attempts after that count anew; such a query runs on as long as it may have state to drop, so it needs a
    processing-time trigger.  Without, state stays.
    """
    wait = idle and int(pd.Timedelta(idle).total_seconds() * 1000)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, largest = state.get if state.exists else (0, -1)
        for frame in frames:
            count += int((frame["try_seq"] >= 1).sum())
            largest = max(largest, int(frame["try_seq"].max()))
        state.update((count, largest))
        if wait:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame({"session_id": [key[0]], "attempt_count": [count], "max_try_seq": [largest]})

    return tries.groupBy("session_id").applyInPandasWithState(fold, "session_id long, attempt_count long, max_try_seq int", "n long, m int", "update", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


class AttemptStates(StatefulProcessor):
    """A session's attempts as map state by sequence, its sums as value state, and an event-time timer that drops both."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "try_seq int", "at long")
        self.sums = handle.getValueState("sums", "attempts long, largest int, latest long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempts, largest, latest = self.sums.get() if self.sums.exists() else (0, -1, 0)
        for frame in rows:
            for seq, at in zip(frame["try_seq"].astype(int).tolist(), (frame["at"].astype("int64") // 1000).tolist(), strict=True):
                latest = max(latest, at)
                if not self.seen.containsKey((seq,)):  # a row that is delivered again counts once
                    self.seen.updateValue((seq,), (at,))
                    attempts, largest = attempts + (seq >= 1), max(largest, seq)
        self.sums.update((attempts, largest, latest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.keep_ms)
        yield pd.DataFrame({"session_id": [key[0]], "attempt_count": [attempts], "max_try_seq": [largest]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        self.sums.clear()
        return iter([])


def attempt_states(tries: DataFrame, time: str = "try_created_at", keep: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(session_id, attempt_count, max_try_seq) on every change, for (session_id, try_seq, time).

    Each attempt of a session counts once, however often it comes.  The state of a session is dropped once event time has
    passed its last attempt by ``keep``; rows later than ``late`` are left out by the watermark.
    """
    timed = tries.select(F.col("session_id").cast("long"), F.col("try_seq").cast("int"), F.col(time).cast("timestamp").alias("t")).withWatermark("t", late)
    timed = timed.withColumn("at", F.unix_micros("t"))
    return timed.groupBy("session_id").transformWithStateInPandas(AttemptStates(int(pd.Timedelta(keep).total_seconds() * 1000)), "session_id long, attempt_count long, max_try_seq int", "update", "eventTime")


def ingest(spark: SparkSession, source: str, schema: StructType, checkpoint: str, load: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """New CSV files through a batch loader; the checkpoint remembers what was read, and a batch number makes retries idempotent."""
    rows = spark.readStream.schema(schema).option("header", True).option("nullValue", "").csv(source)
    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_stream(chunks: DataFrame, embedder: Embedder, dimension: int, time: str = "arrived", late: str = "1 day") -> DataFrame:
    """Vectors of chunks as they arrive, each id once within the watermark."""
    return embed(chunks.withWatermark(time, late).dropDuplicatesWithinWatermark(["id"]), embedder, dimension)


def alert_batches(counts: DataFrame, checkpoint: str, tell: Callable[[Mapping[str, object]], None]) -> StreamingQuery:
    """Compares each batch's sums (no_attempt, total) with those of the batch before and tells the alerts.

    Sums are kept beside the checkpoint, a folder for each batch, so that a restart goes on from the last one and a batch
    that runs again compares with the same sums; the last two stay.
    """
    spark = counts.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(checkpoint).getFileSystem(spark._jsc.hadoopConfiguration())
    sums = lambda n: f"{checkpoint.rstrip('/')}-sums/{n}"

    def compare(batch: DataFrame, n: int) -> None:
        zero = spark.createDataFrame([(0, 0)], "p long, pt long")
        before = spark.read.parquet(sums(n - 1)).select(F.col("c").alias("p"), F.col("t").alias("pt")) if fs.exists(hadoop(sums(n - 1))) else zero
        total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("long")
        batch.agg(total("no_attempt").alias("c"), total("total").alias("t")).coalesce(1).write.mode("overwrite").parquet(sums(n))
        now = spark.read.parquet(sums(n)).withColumn("one", F.lit(1)).join(before.withColumn("one", F.lit(1)), "one")
        row = now.select(no_attempt_signal(F.col("c"), F.col("t"), F.col("p"), F.col("pt")).alias("s")).first()
        if row["s"]["alert"]:
            tell(row["s"].asDict())
        fs.delete(hadoop(sums(n - 2)), True)

    return counts.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is available and gives the memory table it wrote (for small results and tests)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
