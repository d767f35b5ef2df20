"""Computing columns once.

Catalyst replaces a computed column by its expression when it moves a filter
below the projection.  For the expressions of this package that would run the
same regexes many times over, or never finish planning.  The output of a
generator is not replaced, so expensive columns are emitted by a one-row
``inline``; filters on all other columns still move down to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def with_columns(df: DataFrame, columns: dict[str, str], pinned: bool = True) -> DataFrame:
    """Add columns, given as name and SQL expression; ones already there are replaced.

    Pinning costs a generator step per row, so steps in a row are pinned once:
    the last one re-emits what the others leave unpinned."""
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    fields = [f"{expression} AS `{name}`" for name, expression in columns.items()]
    if pinned:
        fields = [f"inline(array(struct({', '.join(fields)})))"]
    return df.selectExpr(*kept, *fields)
