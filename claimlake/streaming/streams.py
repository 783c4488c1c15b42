"""Incremental forms: collection of new files, bounded-state dedup, event-time counts, annotation states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import text_key
from ..sources.files import normalise_posts, route


def new_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of JSONL files as they arrive in ``folder``."""
    lines = spark.readStream.text(folder).select(F.trim("value").alias("payload")).filter("payload <> ''")
    return normalise_posts(lines)


def collect_into(posts: DataFrame, accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Validate each batch and append it to two Parquet tables."""

    def write(batch: DataFrame, _: int) -> None:
        good, bad = route(batch)
        good.write.mode("append").parquet(accepted)
        bad.write.mode("append").parquet(rejected)

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(events: DataFrame, text: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose text was not seen within the watermark: state is bounded by ``delay``."""
    return events.withColumn("text_key", text_key(text)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_key"])


def windowed_counts(events: DataFrame, time: str, key: str, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """``start, end, key, n`` in tumbling or sliding windows; later rows than ``delay`` are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    counts = events.withWatermark(time, delay).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """``start, end, key, n`` of runs of events no further apart than ``gap``."""
    counts = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


class AnnotationStates(StatefulProcessor):
    """The states of an annotation task by its events, as of ``operators.quality.task_states``; a task left alone goes back to PENDING.

    Rows of one batch are taken by their time.  With ``patience``, a task IN_PROGRESS without an event for so many milliseconds of
    processing time is free again.
    """

    MOVES = {"assign": "IN_PROGRESS", "submit": "SUBMITTED", "accept": "ACCEPTED", "reject": "REJECTED", "flag": "NEEDS_REVIEW"}

    def __init__(self, patience: int | None = None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, submissions long, refused long")

    def _known(self) -> tuple[str, int, int]:
        return tuple(self.state.get()) if self.state.exists() else ("PENDING", 0, 0)

    def _row(self, key) -> pd.DataFrame:  # noqa: ANN001
        status, n, refused = self._known()
        return pd.DataFrame({"task_id": [key[0]], "status": [status], "submissions": [n], "rejected_events": [refused]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        status, n, refused = self._known()
        for kind in pd.concat(list(rows)).sort_values(["ts", "kind"])["kind"]:
            if (kind == "assign" and status not in ("PENDING", "NEEDS_REVIEW")) or (kind == "accept" and n == 0):
                refused += 1
                continue
            status, n = self.MOVES.get(kind, status), n + (kind == "submit")
        self.state.update((status, int(n), int(refused)))
        if self.patience is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if self.patience is not None and status == "IN_PROGRESS":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield self._row(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        status, n, refused = self._known()
        if status == "IN_PROGRESS":
            self.state.update(("PENDING", n, refused))
        yield self._row(key)

    def close(self) -> None:
        pass


def annotation_states(events: DataFrame, task: str, patience: int | None = None) -> DataFrame:
    """The state of each task after each batch that touches it; ``events`` has the task, ``ts`` and ``kind``.

    ``patience`` needs a query that goes on, as timers keep one that takes what is there from ending.
    """
    rows = events.select(F.col(task).cast("string").alias("task_id"), "ts", "kind").groupBy("task_id")
    return rows.transformWithStateInPandas(AnnotationStates(patience), outputStructType="task_id string, status string, submissions long, rejected_events long", outputMode="Update", timeMode="None" if patience is None else "ProcessingTime")


def merge_canonical(posts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Near dedup against what came before: each batch of ``ordinal, text, image_hash`` meets the canonical posts in ``table`` (Parquet, a folder
    for each batch), and what is new and canonical is added.  What is in the table came first, whatever its ordinals, and is not compared
    with itself again, so a batch costs its own texts against all.  A batch that is run again replaces its folder.
    """
    from ..operators.duplicates import canonicalise

    before = 1 << 62  # known posts are put before all ordinals of a batch

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("ordinal", "text", "image_hash", F.lit(True).alias("fresh"))
        try:
            known = spark.read.parquet(table).filter(F.col("batch") < number).select((F.col("ordinal") - before).alias("ordinal"), "text", "image_hash", F.lit(False).alias("fresh"))
        except AnalysisException:  # the first batch
            known = rows.limit(0)
        verdicts = canonicalise(known.unionByName(rows)).filter("duplicate_of is null").select("ordinal")
        rows.drop("fresh").join(verdicts, "ordinal", "left_semi").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(progress: list) -> int:
    """Rows that all progress reports of a query say were dropped behind the watermark."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in progress for s in (p if isinstance(p, dict) else p.jsonValue).get("stateOperators", []))


class ProgressTable(StreamingQueryListener):
    """Appends a row for each batch of each query to a table: rows read, rows dropped behind the watermark, and what ``watched`` observes.

    ``spark.streams.addListener(ProgressTable(spark, path))``; the table (JSON lines) has ``query, batch, rows, late, watermark, observed``.
    """

    SCHEMA = "query string, batch long, rows long, late long, watermark string, observed map<string,string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        observed = {f"{name}.{k}": str(v) for name, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        row = (p.name or str(p.id), p.batchId, p.numInputRows, sum(s.numRowsDroppedByWatermark for s in p.stateOperators), p.eventTime.get("watermark"), observed)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").json(self.path)


def watched(events: DataFrame, name: str, time: str) -> DataFrame:
    """``events``, observed: how many rows each batch has, and their first and last time."""
    return events.observe(name, F.count(F.lit(1)).alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"))


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Of each query: batches, rows and late rows, from the table of a ``ProgressTable``."""
    rows = spark.read.schema(ProgressTable.SCHEMA).json(path)
    return rows.groupBy("query").agg(F.count_distinct("batch").alias("batches"), F.sum("rows").alias("rows"), F.sum("late").alias("late"))


def into_table(counts: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now into an in-memory table, for tests and small reports."""
    return counts.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
