"""A whole run over a table of messages: results, alerts, digest and counts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.functions.lexicon import ENTRIES
from lumenward.operators.digest import digest_lines
from lumenward.operators.routing import immediate_alerts, stream_counts
from lumenward.plans.messages import process_messages
from lumenward.storage import Scratch


class StreamReport:
    """Results that are a table, and what is made of them when asked for.

    As a context manager it deletes its intermediate tables on leaving; until
    then, or until :meth:`close`, they stay in the shared folder."""

    def __init__(self, results: DataFrame, order_by, period: str = "daily", scratch: Scratch | None = None):
        self.results = results
        self.order_by = tuple(order_by)
        self.period = period
        self._scratch = scratch or Scratch(results.sparkSession)

    @property
    def immediate_alerts(self) -> DataFrame:
        return immediate_alerts(self.results, self.order_by)

    @property
    def counts(self) -> DataFrame:
        return stream_counts(self.results)

    @cached_property
    def summary(self) -> DataFrame:
        """The lines of the digest; the first use numbers them, which writes a table."""
        return digest_lines(self.results, self.order_by, self.period, self._scratch)

    def close(self) -> None:
        self._scratch.drop()

    def __enter__(self) -> StreamReport:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def process_stream(raw: DataFrame, order_by, period: str = "daily", strict: bool = True,
                   detector: str | None = None, candidates: DataFrame | None = None, keep=(), entries=ENTRIES) -> StreamReport:
    """Process all messages once and report on them.

    ``order_by`` names the columns that give the messages their order and are
    unique together; rows of a table have none by themselves.  ``period`` is a
    label.  The results are written to the shared folder first, so that the
    matching runs once for all four outputs; ``keep`` names columns that go with them.
    ``entries`` is the lexicon (``read_lexicon``)."""
    results = process_messages(raw, (*order_by, *keep), strict, detector, candidates, entries)
    scratch = Scratch(raw.sparkSession)
    try:
        return StreamReport(scratch.table(results, "results"), order_by, period, scratch)
    except BaseException:
        scratch.drop()
        raise


def report_lines(report: StreamReport) -> DataFrame:
    """The text report as ``(section, order..., line_no, line)``, to be sorted by
    all but the last."""
    keys = list(report.order_by)
    scanned = ("concat('Scanned ', messages, ' message(s): ', immediate, ' immediate, ', batched, ' batched.')")
    no_keys = [F.lit(None).cast(report.results.schema[k].dataType).alias(k) for k in keys]
    counts = report.counts.select(F.lit(0).alias("section"), *no_keys, F.lit(0).cast("bigint").alias("line_no"),
                                  F.expr(scanned).alias("line"))
    title = report.counts.where("immediate > 0").select(
        F.lit(1).alias("section"), *no_keys, F.lit(0).cast("bigint").alias("line_no"),
        F.lit("\n══ IMMEDIATE ALERTS ══").alias("line"))
    alerts = report.immediate_alerts.select(
        F.lit(2).alias("section"), *keys, F.col("rank").cast("bigint").alias("line_no"),
        F.concat(F.lit("\n"), "alert").alias("line"))
    summary = report.summary.select(
        F.lit(3).alias("section"), *no_keys, "line_no",
        F.expr("if(line_no = 0, concat('\\n', line), line)").alias("line"))
    return counts.unionByName(title).unionByName(alerts).unionByName(summary)
