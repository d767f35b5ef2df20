"""The digest of borderline findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.functions.text import quote
from lumenward.functions.times import DAILY, UTC, period_start
from lumenward.functions.wording import DIGEST_FOOT, digest_heading, digest_item
from lumenward.operators.numbering import with_group_numbers, with_row_numbers
from lumenward.operators.routing import batched_findings
from lumenward.storage import Scratch

PAGE_LINES = 1000


def digest_of_findings(findings: DataFrame, order_by, period: str = "daily", scratch: Scratch | None = None) -> DataFrame:
    """The whole digest of a table of findings as ``(line_no, line)``, however long.

    Line 0 is the heading, then come the numbered items in the order of the
    ``order_by`` columns, unique together, and the footer; with nothing to
    review the heading is the only line.  ``findings`` should be a table, as it is
    read more than once; the numbered items go to ``scratch``."""
    items = with_row_numbers(findings, order_by, "line_no", scratch).selectExpr(
        "line_no", f"{digest_item('finding', 'line_no')} AS line")
    heading = f"struct(0L AS line_no, {digest_heading(period, 'n')} AS line)"
    foot = f"struct(n + 1 AS line_no, {quote(DIGEST_FOOT)} AS line)"
    frame = items.selectExpr("count(*) AS n").selectExpr(
        f"inline(if(n = 0, array({heading}), array({heading}, {foot})))")
    return items.unionByName(frame)


def digests_by(findings: DataFrame, groups: DataFrame, by: str, order_by, period: str = "daily",
               scratch: Scratch | None = None) -> DataFrame:
    """A digest for each row of ``groups``, all in one table of ``(by, line_no, line)``.

    ``by`` names the column of both tables that tells the groups apart, such as a
    day.  A group without findings has the heading only; findings of other groups,
    and of none, are in no digest.  Numbers run within each group, whose findings
    may fill many partitions."""
    listed = groups.selectExpr(f"`{by}` AS _group").where("_group IS NOT NULL").distinct()
    own = findings.join(listed, F.expr(f"`{by}` = _group"), "left_semi")
    items = with_group_numbers(own, [by], order_by, "line_no", scratch).selectExpr(
        f"`{by}`", "line_no", f"{digest_item('finding', 'line_no')} AS line")
    heading = f"struct(0L AS line_no, {digest_heading(period, 'n')} AS line)"
    foot = f"struct(n + 1 AS line_no, {quote(DIGEST_FOOT)} AS line)"
    sizes = items.groupBy(by).agg(F.count("*").alias("_n")).withColumnRenamed(by, "_sized")
    frame = listed.join(sizes, F.expr("_group = _sized"), "left").selectExpr("_group", "coalesce(_n, 0L) AS n").selectExpr(
        f"_group AS `{by}`", f"inline(if(n = 0, array({heading}), array({heading}, {foot})))")
    return items.unionByName(frame)


def digest_lines(results: DataFrame, order_by, period: str = "daily", scratch: Scratch | None = None) -> DataFrame:
    """The digest of the borderline findings of processed messages that are a table."""
    return digest_of_findings(batched_findings(results, order_by), [*order_by, "rank"], period, scratch)


def findings_by_period(results: DataFrame, order_by, time: str, zone: str = UTC, period: str = DAILY) -> tuple[DataFrame, DataFrame]:
    """The borderline findings of processed messages with the first day of the ``period``, a day or a
    week, that their ``time`` lies in, and the periods that have any message; the input of :func:`digests_by`.

    ``time`` is a column that was kept beside the results, as the results' own
    timestamp is filled in where there was none.  Where it is null there is no period."""
    keys = [f"`{c}`" for c in order_by]
    timed = results.withColumn("period", F.expr(period_start(f"`{time}`", zone, period)))
    findings = timed.selectExpr(*keys, "period", "posexplode(batch) AS (_place, finding)").selectExpr(
        *keys, "period", "_place + 1 AS rank", "finding")
    return findings, timed.select("period").distinct()


def digest_pages(lines: DataFrame, page_lines: int = PAGE_LINES) -> DataFrame:
    """The digest as text, ``page_lines`` lines to a page.

    Pages joined by a line break are the full text.  A page is what one task
    assembles, so its size is bounded whatever the length of the digest."""
    text = "array_join(transform(array_sort(collect_list(struct(line_no, line))), l -> l.line), '\\n')"
    return (
        lines.selectExpr(f"line_no div {page_lines} AS page", "line_no", "line")
        .groupBy("page").agg(F.expr(text).alias("text"))
    )


def message_digest(batch: str, period: str = "daily") -> str:
    """Expression for the digest text of one message's few borderline findings."""
    items = f"transform({batch}, (f, i) -> {digest_item('f', '(i + 1)')})"
    return (
        f"concat_ws('\\n', {digest_heading(period, f'size({batch})')}, {items},"
        f" if(size({batch}) = 0, NULL, {quote(DIGEST_FOOT)}))")
