"""A streaming run with all the outputs of a batch run.

Every micro-batch is parsed, matched and written once, each message under what
becomes of it: *counted* in its period, *late* for it, *undated*, *refused*, or a
*bad* line.  Alerts and all other tables are read from there, so nothing is matched
twice and no message is in two of them or in none.

A period, a day or a week, is closed once the watermark has passed its end: the
latest event time of all batches so far, less a delay.  Closing it writes its counts and its
numbered digest, once.  A message whose period was closed by an earlier batch is
late; its alerts go out all the same, and its findings are kept with it.

Tables are written by batch, and a batch that is run again replaces what it
wrote.  What it needs to know of the batches before is one small table, the open
periods and the latest event time, which the batch before wrote.  So a run that
failed at any point goes on without losing or repeating anything.  A folder belongs to
one checkpoint.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lumenward.functions.lexicon import ENTRIES
from lumenward.functions.times import DAILY, UTC, period_end, period_start, undated_reason, usable_event_time
from lumenward.operators.digest import digests_by
from lumenward.operators.normalize import is_sanctioned, refusal_reason
from lumenward.plans.messages import process_messages
from lumenward.schema import RAW_FIELDS
from lumenward.sources.jsonl import LINE, POSITION, tagged_lines
from lumenward.storage import Scratch
from lumenward.streaming.alerts import EVENT_TIME, UNDATED

COUNTED, LATE, UNDATED_FATE, REFUSED, BAD = "counted", "late", "undated", "refused", "bad"
BATCH, FATE, PERIOD = "batch_id", "fate", "period"

_STATE = "period date, ends timestamp, messages bigint, immediate bigint, batched bigint, latest timestamp"
_WINDOWS = "period date, ends timestamp, messages bigint, immediate bigint, batched bigint"
_DIGESTS = "period date, line_no bigint, line string"
_COUNTS = ("messages", "immediate", "batched")


def _sums():
    return [F.sum(c).alias(c) for c in _COUNTS]



def read_placed_line_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of JSON-lines files as they appear in a folder, with their file."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path, lineSep="\n").selectExpr(
        "_metadata.file_path AS file", "_metadata.file_block_start AS block", LINE)


@dataclass
class StreamRun:
    """``stream`` holds raw messages, or lines as :func:`read_placed_line_stream` gives them.

    ``order_by`` names the columns that order the messages and are unique
    together; lines have their place in the input, and come batch after batch.
    ``period`` is "daily" or "weekly", in the days of ``zone``, which is also that
    of times without offset.  ``delay`` is an interval such as "1 hour"."""
    stream: DataFrame
    folder: str
    order_by: tuple[str, ...] = ()
    period: str = DAILY
    delay: str = "1 day"
    zone: str = UTC
    detector: str | None = None
    candidates: DataFrame | None = None
    entries: tuple = ENTRIES
    _schema: object = field(default=None, init=False)

    def __post_init__(self):
        period_start("x", self.zone, self.period)  # an unknown period fails here
        self.of_lines = LINE in self.stream.columns
        if self.of_lines:
            self.order_by = (BATCH, POSITION)
        self.keys = tuple(k for k in self.order_by if k != BATCH)
        empty = self.stream.sparkSession.createDataFrame([], self.stream.schema)
        self._schema = self._results(empty, None).schema

    # ---- one batch ----

    def _results(self, batch: DataFrame, watermark) -> DataFrame:
        """All rows with their fate, the messages among them processed."""
        if self.of_lines:
            place = f"struct(file, block, monotonically_increasing_id() & {(1 << 33) - 1}L AS row) AS {POSITION}"
            raw = tagged_lines(batch.selectExpr(place, LINE))
        else:
            raw = batch.withColumn("bad_line", F.lit(None).cast("string"))
        fields = [f"`{f}`" if f in raw.columns else f"cast(NULL AS string) AS {f}" for f in RAW_FIELDS]
        raw = raw.selectExpr(*[f"`{k}`" for k in self.keys], "bad_line", *fields)
        sanctioned = is_sanctioned("source")
        timed = raw.selectExpr(
            "*", f"{usable_event_time('timestamp', self.zone)} AS {EVENT_TIME}",
            f"if(bad_line IS NULL AND NOT {sanctioned}, struct({', '.join(RAW_FIELDS)}, {refusal_reason('source')} AS reason), NULL) AS refused")
        closed = "false" if watermark is None else f"{period_end(PERIOD, self.zone, self.period)} <= timestamp_micros({watermark}L)"
        kept = "bad_line IS NULL AND refused IS NULL"
        fated = timed.selectExpr(
            "*", f"if({kept}, {period_start(EVENT_TIME, self.zone, self.period)}, NULL) AS {PERIOD}",
            f"if({kept} AND {EVENT_TIME} IS NULL, {undated_reason('timestamp', self.zone)}, NULL) AS {UNDATED}").selectExpr(
            "*", f"CASE WHEN bad_line IS NOT NULL THEN '{BAD}' WHEN refused IS NOT NULL THEN '{REFUSED}'"
                 f" WHEN {PERIOD} IS NULL THEN '{UNDATED_FATE}' WHEN {closed} THEN '{LATE}' ELSE '{COUNTED}' END AS {FATE}")
        # What is refused or bad goes along without its text, for which there is nothing to find.
        blanked = fated.selectExpr(
            *[f"`{c}`" for c in fated.columns if c not in ("text", "content", "source")],
            *[f"if(refused IS NULL, {c}, NULL) AS {c}" for c in ("text", "content", "source")])
        return process_messages(
            blanked, (*self.keys, FATE, PERIOD, EVENT_TIME, UNDATED, "bad_line", "refused"), True, self.detector, self.candidates,
            self.entries)

    def _root(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def _path(self, name: str, batch: int) -> str:
        return f"{self._root(name)}/{BATCH}={batch}"

    def _write(self, df: DataFrame, name: str, batch: int, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(self._path(name, batch))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Write one batch and what it closes; doing it again changes nothing."""
        spark = batch.sparkSession
        before = spark.createDataFrame([], _STATE)
        if batch_id:
            before = spark.read.schema(_STATE).parquet(self._path("state", batch_id - 1))
        self._write(self._results(batch, self._watermark(before)), "messages", batch_id, FATE)
        counted = spark.read.schema(self._schema).parquet(self._path("messages", batch_id)).where(f"{FATE} = '{COUNTED}'")
        items = counted.selectExpr(
            PERIOD, *[f"`{k}`" for k in self.keys], "message.id AS id", EVENT_TIME, "posexplode(batch) AS (_place, finding)").selectExpr(
            "*", "_place + 1 AS rank", f"{int(batch_id)}L AS {BATCH}").drop("_place")
        items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD, BATCH).parquet(self._root("items"))
        with Scratch(spark) as scratch:
            own = counted.groupBy(PERIOD).agg(
                F.count("*").alias("messages"), F.sum(F.size("immediate")).alias("immediate"),
                F.sum(F.size("batch")).alias("batched"), F.max(EVENT_TIME).alias("latest"))
            known = scratch.table(
                before.drop("ends").unionByName(own).groupBy(PERIOD).agg(*_sums(), F.max("latest").alias("latest")).selectExpr(
                    PERIOD, f"{period_end(PERIOD, self.zone, self.period)} AS ends", *_COUNTS, "latest"), "periods")
            watermark = self._watermark(known)
            over = "false" if watermark is None else f"ends <= timestamp_micros({watermark}L)"
            closing = known.where(over)
            if closing.head(1) or not batch_id:  # most batches close nothing; the first one makes the folders
                lines = digests_by(self._item_table(spark), closing, PERIOD, (*self.order_by, "rank"), self.period, scratch)
                self._write(lines, "digests", batch_id)
                self._write(closing.drop("latest"), "windows", batch_id)
            # The latest time outlives its period, in a row without one.
            latest = known.selectExpr("cast(NULL AS date) AS period", "cast(NULL AS timestamp) AS ends", "0L AS messages",
                                      "0L AS immediate", "0L AS batched", "max(latest) AS latest")
            self._write(known.where(f"{PERIOD} IS NOT NULL AND NOT {over}").unionByName(latest).coalesce(1), "state", batch_id)

    def _watermark(self, periods: DataFrame) -> int | None:
        """Microseconds since 1970."""
        return periods.selectExpr(f"unix_micros(max(latest) - INTERVAL {self.delay}) AS w").first().w

    def writer(self, checkpoint: str) -> DataStreamWriter:
        """Call ``trigger`` and ``start`` on the result."""
        return self.stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)

    # ---- what it wrote ----

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.stream.sparkSession.read.schema(f"{schema}, {BATCH} bigint").parquet(self._root(name))

    def _item_table(self, spark: SparkSession) -> DataFrame:
        types = {f.name: f.dataType.simpleString() for f in self._schema.fields}
        finding = types["batch"].removeprefix("array<").removesuffix(">")
        columns = [*[f"`{k}` {types[k]}" for k in self.keys], f"id string, {EVENT_TIME} timestamp, finding {finding}, rank int",
                   f"{PERIOD} date, {BATCH} bigint"]
        return spark.read.schema(", ".join(columns)).parquet(self._root("items"))

    def messages(self, *fates: str) -> DataFrame:
        """The results of the messages with one of the fates, or of all input."""
        found = self._read("messages", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._schema.fields))
        return found.where(F.col(FATE).isin(*fates)) if fates else found

    def _with(self, found: DataFrame, *columns: str) -> DataFrame:
        return found.selectExpr(*[f"`{k}`" for k in self.order_by], *columns)

    def alerts(self) -> DataFrame:
        """One row per immediate alert, whatever its message's time."""
        return self._with(self.messages(COUNTED, LATE, UNDATED_FATE), "message.id AS id", EVENT_TIME, "posexplode(alerts) AS (place, alert)")

    def late(self) -> DataFrame:
        """Messages whose period was closed when they came, with the findings its digest misses."""
        return self._with(self.messages(LATE), "message.id AS id", EVENT_TIME, PERIOD, "size(immediate) AS immediate",
                          "size(batch) AS batched", "batch AS findings")

    def undated(self) -> DataFrame:
        """Messages without a usable time, why, and their findings."""
        return self._with(self.messages(UNDATED_FATE), "message.id AS id", f"{UNDATED} AS reason", "size(immediate) AS immediate",
                          "size(batch) AS batched", "batch AS findings")

    def refused(self) -> DataFrame:
        """Messages from sources that are not sanctioned, as they came, with the reason."""
        return self._with(self.messages(REFUSED), "refused.*")

    def bad_lines(self) -> DataFrame:
        return self._with(self.messages(BAD), "bad_line AS line")

    def windows(self) -> DataFrame:
        """Counts of the closed periods."""
        return self._read("windows", _WINDOWS)

    def digests(self) -> DataFrame:
        """Lines of the closed periods' digests."""
        return self._read("digests", _DIGESTS)
