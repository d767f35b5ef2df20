"""From raw messages to the normalized shape, and the source guard."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenward.functions.text import check_literals, present, quote, quoted_list
from lumenward.schema import RAW_FIELDS

# The integrations messages may come from.
SANCTIONED_SOURCES = (
    "family-link",
    "screen-time",
    "youtube-data-api",
    "comment-moderation-api",
    "android-accessibility",
    "device-notification",
    "manual",
)

# The refusal text, around the source and the sanctioned ones.
REFUSAL = (
    'Refusing to ingest from "',
    '". This system only consumes content via sanctioned integrations (',
    "). Scraping, private/unofficial endpoints, and automated logins are out of scope.",
)


def is_sanctioned(source: str) -> str:
    """True for a listed source and for none at all."""
    return f"({source} IS NULL OR {source} IN ('', {quoted_list(SANCTIONED_SOURCES)}))"


def refusal_reason(source: str) -> str:
    before, middle, after = REFUSAL
    listed = middle + ", ".join(SANCTIONED_SOURCES) + after
    return f"concat({quote(before)}, {source}, {quote(listed)})"


def accepted_messages(raw: DataFrame) -> DataFrame:
    """Only messages from sanctioned sources."""
    return raw.where(is_sanctioned("source"))


def refused_messages(raw: DataFrame) -> DataFrame:
    """The other messages, with the reason for refusing them."""
    return raw.where(f"NOT {is_sanctioned('source')}").selectExpr("*", f"{refusal_reason('source')} AS reason")


def require_sanctioned(raw: DataFrame) -> DataFrame:
    """All messages; running it fails at the first one from elsewhere."""
    refuse = f"cast(raise_error({refusal_reason('source')}) AS boolean)"
    return raw.where(f"if({is_sanctioned('source')}, true, {refuse})")


def normalize_messages(raw: DataFrame, keep=(), strict: bool = True) -> DataFrame:
    """Fill in defaults, one row per message.

    ``keep`` names columns carried along, such as an ordering key.  ``strict``
    makes an unsanctioned source fail the job; otherwise such rows are left out
    (:func:`refused_messages` lists them)."""
    check_literals(raw.sparkSession)
    kept = [f"`{k}`" for k in keep if k not in RAW_FIELDS]
    known = [f"cast({f'`{f}`' if f in raw.columns else 'NULL'} AS string) AS {f}" for f in RAW_FIELDS]
    rows = raw.selectExpr(*kept, *known)
    rows = require_sanctioned(rows) if strict else accepted_messages(rows)
    now = ("date_format(to_utc_timestamp(current_timestamp(), current_timezone()),"
           """ "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")""")
    return rows.selectExpr(
        *kept,
        f"{present('id')} AS id",
        f"coalesce({present('text')}, {present('content')}, '') AS text",
        "if(direction = 'outgoing', 'outgoing', 'incoming') AS direction",
        "if(senderRelationship IN ('mutual', 'not-mutual'), senderRelationship, 'unknown') AS senderRelationship",
        f"coalesce({present('platform')}, 'unknown') AS platform",
        f"coalesce({present('source')}, 'manual') AS source",
        f"coalesce({present('timestamp')}, {now}) AS timestamp",
    )
