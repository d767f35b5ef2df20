"""Messages from any table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenward.schema import RAW_FIELDS


def as_raw_messages(table: DataFrame, fields: dict[str, str], keep=()) -> DataFrame:
    """Project a table to the raw message shape.

    ``fields`` maps message fields to SQL expressions over the table; fields it
    leaves out are null.  ``keep`` names columns carried along."""
    unknown = set(fields) - set(RAW_FIELDS)
    if unknown:
        raise ValueError(f"not message fields: {sorted(unknown)}")
    return table.selectExpr(
        *[f"`{k}`" for k in keep],
        *[f"cast({fields.get(f, 'NULL')} AS string) AS {f}" for f in RAW_FIELDS])

