"""Writing results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenward.plans.stream import StreamReport, report_lines


def write_results(results: DataFrame, path: str, format: str = "json") -> None:
    """Nested results, one row per message."""
    results.write.format(format).save(path)


def write_report_json(report: StreamReport, path: str) -> None:
    """Results, alerts, summary and counts as JSON, a folder each."""
    write_results(report.results, f"{path}/results")
    _sorted(report.immediate_alerts, [*report.order_by, "rank"]).write.json(f"{path}/immediate_alerts")
    _sorted(report.summary, ["line_no"]).write.json(f"{path}/summary")
    report.counts.write.json(f"{path}/counts")


def write_report_text(report: StreamReport, path: str) -> None:
    """The text report; its part files follow one another in name order."""
    keys = ["section", *report.order_by, "line_no"]
    _sorted(report_lines(report), keys).select("line").write.text(path)


def _sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted across files as well as within them, on as many tasks as needed."""
    return df.orderBy(*keys)
