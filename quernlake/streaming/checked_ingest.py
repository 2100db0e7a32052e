"""Payment files as a stream with all checks: rules of rows, and uniqueness and invariants across files in keyed state.

Two queries, each restartable by its checkpoint.  ``land`` numbers the rows of one file a batch and writes them as a folder
of the batch's number.  ``check`` reads what landed: rows that break a rule by themselves go by; the others meet the state
of their session (attempts seen, and the session's values) and then of their category (its title).  Accepted and
rejected rows are written as folders of the batch's number, so that a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quernlake.operators.quality import ROW, SESSION_LEVEL, row_rules
from quernlake.schemas import PAYMENT_CSV
from quernlake.sources.payments import _exists, numbered

#: Why a row is rejected for what came before it.
DUPLICATE, VARYING, TITLES = "the attempt is a duplicate", "session values vary between attempts", "the category has several titles"
LANDED = T.StructType([*PAYMENT_CSV.fields, T.StructField(ROW, T.LongType()), T.StructField("file", T.StringType())])
JUDGED = T.StructType([*LANDED.fields, T.StructField("reason", T.StringType())])


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["file", ROW], kind="stable")


class SessionChecks(StatefulProcessor):
    """Rejects an attempt that was accepted before, and one whose session-level values differ from the session's first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.attempts = handle.getMapState("attempts", "try_seq int", "row long")
        self.values = handle.getValueState("values", "first string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, reasons = _in_order(rows), []
        first = self.values.get()[0] if self.values.exists() else None
        for row in batch.to_dict("records"):
            values = json.dumps([row[c] for c in SESSION_LEVEL])
            attempt = (int(row["try_seq"]),)
            if self.attempts.containsKey(attempt):
                reasons.append(DUPLICATE)
            elif first is not None and values != first:
                reasons.append(VARYING)
            else:
                reasons.append(None)
                self.attempts.updateValue(attempt, (int(row[ROW]),))
                if first is None:
                    first = values
                    self.values.update((values,))
        yield batch.assign(reason=pd.Series(reasons, batch.index, dtype=object))


class TitleChecks(StatefulProcessor):
    """Rejects a row whose category has another title already; rows rejected before stay so."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.title = handle.getValueState("title", "title string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, reasons = _in_order(rows), []
        first = self.title.get()[0] if self.title.exists() else None
        for row in batch.to_dict("records"):
            reason = row["reason"]
            if reason is None and first is None:
                first = row["category_title"]
                self.title.update((first,))
            elif reason is None and row["category_title"] != first:
                reason = TITLES
            reasons.append(reason)
        yield batch.assign(reason=pd.Series(reasons, batch.index, dtype=object))


def land(spark: SparkSession, source: str, root: str) -> StreamingQuery:
    """New files under ``source``, one a batch, with their rows numbered from 1, to ``root``/landed."""

    def write(batch: DataFrame, n: int) -> None:
        path = f"{root}/landed/batch={n}"
        if not _exists(spark, f"{path}/_SUCCESS"):  # a batch that runs again has landed
            numbered(batch, ROW).select(*LANDED.names).write.mode("overwrite").parquet(path)

    rows = spark.readStream.schema(PAYMENT_CSV).option("header", True).option("nullValue", "").option("emptyValue", "").option("mode", "FAILFAST").option("maxFilesPerTrigger", 1).csv(source)
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoints/land").trigger(availableNow=True).start()


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (LANDED, a stream) with the reason for which each is rejected, or null."""
    own = F.coalesce(*[F.when(r.broken, F.lit(r.reason)) for r in row_rules()])
    marked = rows.withColumn("reason", own)
    sound = marked.filter(F.col("reason").isNull()).drop("reason")
    by_session = sound.groupBy("session_key").transformWithStateInPandas(SessionChecks(), JUDGED, "append", "none")
    by_category = by_session.groupBy("category_id").transformWithStateInPandas(TitleChecks(), JUDGED, "append", "none")
    return by_category.select(*JUDGED.names).unionByName(marked.filter(F.col("reason").isNotNull()).select(*JUDGED.names))


def check(spark: SparkSession, root: str) -> StreamingQuery:
    """What landed to ``root``/accepted and ``root``/rejected, a folder of each for a batch."""

    def commit(batch: DataFrame, n: int) -> None:
        held = batch.persist()
        held.filter(F.col("reason").isNull()).drop("reason").write.mode("overwrite").parquet(f"{root}/accepted/batch={n}")
        held.filter(F.col("reason").isNotNull()).write.mode("overwrite").parquet(f"{root}/rejected/batch={n}")
        held.unpersist()

    rows = spark.readStream.schema(LANDED).option("recursiveFileLookup", True).parquet(f"{root}/landed")
    return judged(rows).writeStream.foreachBatch(commit).option("checkpointLocation", f"{root}/checkpoints/check").trigger(availableNow=True).start()


def first_rejections(spark: SparkSession, root: str) -> DataFrame:
    """(file, reason, first_row, rows) of what was rejected."""
    rejected = spark.read.schema(JUDGED).option("recursiveFileLookup", True).parquet(f"{root}/rejected")
    return rejected.groupBy("file", "reason").agg(F.min(ROW).alias("first_row"), F.count("*").alias("rows"))
