"""Consecutive numbers over a whole table or within groups, without one task seeing it all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.storage import Scratch

# monotonically_increasing_id() keeps the partition above the lower 33 bits.
_ROW_BITS = 33


def with_row_numbers(df: DataFrame, order_by, name: str = "number", scratch: Scratch | None = None) -> DataFrame:
    """Number the rows from 1 in the order of ``order_by``, unique together.

    The rows are range-partitioned and sorted, and written down with their
    place; the number is that place plus the sizes of the earlier partitions.
    The sizes are one row per partition, so they can be broadcast.  Finding the
    ranges reads ``df`` a second time: it should be a table, or cheap to make."""
    scratch = scratch or Scratch(df.sparkSession)
    placed = scratch.table(
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
        .selectExpr("*", "monotonically_increasing_id() AS _position"), "numbered").selectExpr(
        "*", f"shiftright(_position, {_ROW_BITS}) AS _part", f"_position & {(1 << _ROW_BITS) - 1}L AS _row")
    before = placed.groupBy("_part").count().selectExpr(
        "_part", "sum(count) OVER (ORDER BY _part) - count AS _before")
    others = [f"`{c}`" for c in df.columns]
    return placed.join(F.broadcast(before), "_part").selectExpr(*others, f"_before + _row + 1 AS `{name}`")


def with_group_numbers(df: DataFrame, group_by, order_by, name: str = "number", scratch: Scratch | None = None,
                       keep=("*",)) -> DataFrame:
    """Number the rows of each group from 1 in the order of ``order_by``.

    Rows are range-partitioned by group and order together, so a large group is
    spread over as many tasks as a table of its size would be.  A row's number is
    its place among its group's rows in the partition, plus the group's rows in
    earlier partitions; both come from a table of one row for each group and
    partition that the rows are joined with.  Null is a group.  Rows equal in all
    these columns get their numbers in any order, which is then written down.

    ``keep`` lists expressions to go on with, the group columns among them; what
    they leave out, such as long texts that only order the rows, isn't written."""
    scratch = scratch or Scratch(df.sparkSession)
    keys = [*group_by, *order_by]
    written = scratch.table(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).selectExpr(
            *keep, "monotonically_increasing_id() AS _position"), "numbered")
    placed = written.selectExpr(
        "*", f"shiftright(_position, {_ROW_BITS}) AS _part", f"_position & {(1 << _ROW_BITS) - 1}L AS _row")
    groups = [f"`{g}`" for g in group_by]
    shares = placed.groupBy("_part", *groups).agg(F.min("_row").alias("_first"), F.count("*").alias("_n")).selectExpr(
        "_part AS _p", *[f"{g} AS _g{i}" for i, g in enumerate(groups)],
        f"sum(_n) OVER (PARTITION BY {', '.join(groups)} ORDER BY _part) - _n - _first + 1 AS _offset")
    same = " AND ".join(["_part = _p", *[f"{g} <=> _g{i}" for i, g in enumerate(groups)]])
    kept = [f"`{c}`" for c in written.columns if c != "_position"]
    return placed.join(shares, F.expr(same)).selectExpr(*kept, f"_row + _offset AS `{name}`")
