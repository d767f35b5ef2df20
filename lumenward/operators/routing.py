"""Splitting findings into immediate alerts and borderline items."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenward.functions.scoring import is_immediate
from lumenward.functions.wording import alert_text


def with_routes(classified: DataFrame) -> DataFrame:
    """Replace ``findings`` by ``immediate`` and ``batch``, and add ``alerts``."""
    others = [f"`{c}`" for c in classified.columns if c != "findings"]
    return classified.selectExpr(
        *others,
        f"filter(findings, f -> {is_immediate('f.confidence')}) AS immediate",
        f"filter(findings, f -> NOT {is_immediate('f.confidence')}) AS batch",
    ).selectExpr("*", f"transform(immediate, f -> {alert_text('f')}) AS alerts")


def immediate_alerts(results: DataFrame, order_by) -> DataFrame:
    """One row per alert; order columns and ``rank`` give their order."""
    keys = [f"`{c}`" for c in order_by]
    return results.selectExpr(*keys, "posexplode(alerts) AS (_place, alert)").selectExpr(
        *keys, "_place + 1 AS rank", "alert")


def batched_findings(results: DataFrame, order_by) -> DataFrame:
    """One row per borderline finding, in the same manner."""
    keys = [f"`{c}`" for c in order_by]
    return results.selectExpr(*keys, "posexplode(batch) AS (_place, finding)").selectExpr(
        *keys, "_place + 1 AS rank", "finding")


def stream_counts(results: DataFrame) -> DataFrame:
    """One row: messages, immediate and batched findings."""
    return results.selectExpr(
        "count(*) AS messages",
        "coalesce(sum(size(immediate)), 0) AS immediate",
        "coalesce(sum(size(batch)), 0) AS batched")
