"""The fixed tables are what they were, and tables that would not work are refused."""

import hashlib

import pytest

from lumenward.functions import wording
from lumenward.functions.dialect import check_entry, entry_regex
from lumenward.functions.languages import NAMES, SCRIPTS, STOPWORDS
from lumenward.functions.lexicon import CATEGORIES, ENTRIES
from lumenward.functions.redaction import CONTEXT_CHARS, CUT, MASK, MAX_CHARS
from lumenward.operators.normalize import REFUSAL, SANCTIONED_SOURCES, normalize_messages

# The engine and its SQL twins share these tables, so a slip in one would show in neither.
PINNED = {
    "lexicon": "472e4a92e153f5ad",
    "languages": "229d39c124c02005",
    "wording": "9f53257702504b1d",
    "sources": "9e22ba9ac8da8bc2",
}
TABLES = {
    "lexicon": [[tuple(e)[:7] for e in ENTRIES], CATEGORIES],
    "languages": [{lang: tuple(words) for lang, words in STOPWORDS.items()}, SCRIPTS, NAMES],
    "wording": [wording.ACTIONS, wording.DEFAULT_ACTION, wording.DIGEST_EMPTY, wording.DIGEST_FOOT, wording.DIGEST_HEAD,
                wording.SENDERS, MASK, CONTEXT_CHARS, MAX_CHARS, CUT],
    "sources": [SANCTIONED_SOURCES, REFUSAL],
}


def digest(table) -> str:
    return hashlib.sha256(repr(table).encode()).hexdigest()[:16]


@pytest.mark.parametrize("name", list(PINNED))
def test_fixed_values(name):
    assert digest(TABLES[name]) == PINNED[name]


@pytest.mark.parametrize("pattern", [r"\b(a)?b\b", r"\ba?b\b", r"[ab]c", r"\b(a|[bc]d)\b", r"ab|*c", r"\b((x)*y|z)\b"])
def test_patterns_that_may_start_in_other_ways_are_refused(pattern):
    with pytest.raises(ValueError):
        entry_regex(ENTRIES[0]._replace(pattern=pattern))


def test_all_entries_are_in_the_dialect():
    for entry in ENTRIES:
        check_entry(entry)
        assert entry.words or entry.parts


def test_sessions_that_read_literals_otherwise_are_refused(spark, raw):
    spark.conf.set("spark.sql.parser.escapedStringLiterals", "true")
    try:
        with pytest.raises(RuntimeError, match="escapedStringLiterals"):
            normalize_messages(raw({"text": "x"}))
    finally:
        spark.conf.unset("spark.sql.parser.escapedStringLiterals")
