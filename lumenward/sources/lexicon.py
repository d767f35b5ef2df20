"""A lexicon from a table, in place of the built-in one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenward.functions.dialect import entry_regex
from lumenward.functions.lexicon import CATEGORIES, ENTRIES, Entry
from lumenward.functions.triggers import triggers

SCHEMA = "ord bigint, category string, signal string, lang string, weight double, pattern string, ignore_case boolean"
#: The lexicon is dimension data and becomes part of the plan.
MOST_ENTRIES = 620


def read_lexicon(table: DataFrame) -> tuple[Entry, ...]:
    """Entries of a table with the columns of :data:`SCHEMA`, in the order of ``ord``.

    What a text must hold for a pattern to be tried is derived from the pattern; one
    that gives nothing to look for is tried on every text.  A null signal is none, a
    null language any, and case is ignored unless the table says otherwise.  An
    entry with an unknown category, a weight outside 0 to 1, without pattern, or with
    one outside the dialect, fails here, as does a place given twice."""
    rows = table.selectExpr(
        "cast(ord AS bigint) AS ord", "category", "signal", "coalesce(lang, 'any') AS lang", "cast(weight AS double) AS weight", "pattern",
        "coalesce(ignore_case, true) AS ignore_case").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a lexicon of more than {MOST_ENTRIES} entries")
    if len({r.ord for r in rows}) < len(rows) or any(r.ord is None for r in rows):
        raise ValueError("every entry needs a place of its own")
    known, entries = {code for code, _ in CATEGORIES}, []
    for place, row in enumerate(sorted(rows, key=lambda r: r.ord)):
        if row.category not in known:
            raise ValueError(f"unknown category: {row.category}")
        if row.weight is None or not 0 <= row.weight <= 1:
            raise ValueError(f"a weight outside 0 to 1: {row.pattern}")
        if not row.pattern:
            raise ValueError("an entry without pattern")
        words, parts = triggers(row.pattern)
        entry = Entry(place, row.category, row.signal, row.lang, row.weight, row.pattern, row.ignore_case, " ".join(words), parts)
        entry_regex(entry)
        entries.append(entry)
    return tuple(entries)


def lexicon_table(spark: SparkSession, entries=ENTRIES) -> DataFrame:
    """A lexicon as such a table, to be changed and read back."""
    return spark.createDataFrame([tuple(e)[:7] for e in entries], SCHEMA)
