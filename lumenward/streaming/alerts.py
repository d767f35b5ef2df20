"""Messages that keep arriving: alerts at once, digests by the day.

No message gets lost on the way: bad lines, messages from refused sources and
messages without a usable time have streams of their own.  Event time comes from
the given timestamp only; the time filled in for a message without one says when
it was read, and must not move the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lumenward.functions.lexicon import ENTRIES
from lumenward.functions.times import UTC, day_of, undated_reason, usable_event_time
from lumenward.operators.normalize import refused_messages
from lumenward.plans.messages import process_messages
from lumenward.sources.jsonl import bad_lines, messages_of_lines

EVENT_TIME = "event_ts"
UNDATED = "undated_reason"


def read_line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of JSON-lines files as they appear in a folder."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path, lineSep="\n")


def read_message_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Raw messages of the lines that are JSON; :func:`read_bad_line_stream` has the others."""
    return messages_of_lines(read_line_stream(spark, path, max_files))


def read_bad_line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    return bad_lines(read_line_stream(spark, path, max_files))


def process_message_stream(raw: DataFrame, keep=(), strict: bool = False, zone: str = UTC,
                           detector: str | None = None, candidates: DataFrame | None = None, entries=ENTRIES) -> DataFrame:
    """The batch plan over a stream, plus the event time and, without one, the reason.

    A source that is refused would stop the query for good, so such messages
    are left out unless ``strict`` says otherwise; :func:`refused_message_stream`
    has them.  ``zone`` is that of timestamps without offset.  ``candidates`` is a
    static table of language labels, or ``ArrivingLabels``, whose arrival time has
    to be in ``keep``."""
    given = raw.columns
    timed = raw.selectExpr(
        "*", *([] if "timestamp" in given else ["cast(NULL AS string) AS timestamp"])).selectExpr(
        "*", f"{usable_event_time('timestamp', zone)} AS {EVENT_TIME}", f"{undated_reason('timestamp', zone)} AS {UNDATED}")
    results = process_messages(timed, (*keep, EVENT_TIME, UNDATED), strict, detector, candidates, entries)
    return results.withColumn(UNDATED, F.expr(f"if({EVENT_TIME} IS NULL, {UNDATED}, NULL)"))


def refused_message_stream(raw: DataFrame) -> DataFrame:
    """Messages from sources that are not sanctioned, with the reason; keeps no state."""
    return refused_messages(raw)


def undated_stream(results: DataFrame, keep=()) -> DataFrame:
    """One row per message that no window counts: its findings, and what was wrong with its time."""
    return results.where(f"{EVENT_TIME} IS NULL").selectExpr(
        *keep, "message.id AS id", f"{UNDATED} AS reason", "size(immediate) AS immediate", "size(batch) AS batched")


def alert_stream(results: DataFrame, keep=()) -> DataFrame:
    """One row per immediate alert, dated or not; keeps no state."""
    return results.selectExpr(
        *keep, "message.id AS id", EVENT_TIME, "posexplode(alerts) AS (place, alert)")


def digest_item_stream(results: DataFrame, keep=(), zone: str = UTC) -> DataFrame:
    """One row per borderline finding with its day in ``zone``, null if undated; keeps no state.

    Written by day, a closed day's items are the input of its digest
    (``digest_of_findings``), so that no window has to hold its lines in memory."""
    return results.selectExpr(
        *keep, "message.id AS id", EVENT_TIME, f"{day_of(EVENT_TIME, zone)} AS day",
        "posexplode(batch) AS (place, finding)")


def digest_count_stream(results: DataFrame, window: str = "1 day", delay: str = "1 day",
                        start: str = "0 seconds") -> DataFrame:
    """Messages, immediate and batched findings per event-time window.

    The state is three numbers per open window.  A window is emitted once the
    watermark, ``delay`` behind the latest message, has passed its end; later
    messages for it are dropped, and counted by Spark as such.  Messages without
    a usable time are not in it, see :func:`undated_stream`.  Windows begin at
    midnight UTC plus ``start``, such as "-9 hours" for days of Tokyo."""
    return (
        results.where(f"{EVENT_TIME} IS NOT NULL")
        .selectExpr(EVENT_TIME, "size(immediate) AS immediate", "size(batch) AS batched")
        .withWatermark(EVENT_TIME, delay)
        .groupBy(F.window(EVENT_TIME, window, startTime=start).alias("period"))
        .agg(F.count("*").alias("messages"), F.sum("immediate").alias("immediate"), F.sum("batched").alias("batched"))
        .selectExpr("period.start AS window_start", "period.end AS window_end", "messages", "immediate", "batched")
    )


def to_table(stream: DataFrame, path: str, checkpoint: str, partition_by=()) -> DataStreamWriter:
    """An append-only parquet sink; call ``trigger`` and ``start`` on the result."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)
    return writer.partitionBy(*partition_by) if partition_by else writer
