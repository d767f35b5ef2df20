"""The message plan: detect the language, match, score, route.

With local detection nothing is shuffled; a message is one row from scan to
result.  With remote labels the only shuffle is the join on the message id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenward.functions.languages import LOCAL_DETECTOR, LOCAL_SOURCE
from lumenward.functions.lexicon import ENTRIES
from lumenward.functions.text import is_blank
from lumenward.operators.findings import exploded_findings, with_findings
from lumenward.operators.language import check_detector, with_language, with_remote_language
from lumenward.operators.matching import gated_hits, triggered_messages, with_hits
from lumenward.operators.normalize import normalize_messages
from lumenward.operators.pinning import with_columns
from lumenward.operators.routing import with_routes
from lumenward.schema import CANDIDATES_SCHEMA, LANGUAGE_COLUMNS


def label_messages(messages: DataFrame, detector: str | None = None,
                   candidates: DataFrame | None = None) -> DataFrame:
    """Only the language columns, and where the language came from, of normalized
    messages; nothing is matched, and no text goes through the join."""
    if detector is None:
        return with_language(messages)
    if check_detector(detector) == LOCAL_DETECTOR:
        return with_language(messages).selectExpr(
            "*", f"'{LOCAL_SOURCE}' AS languageSource", "cast(NULL AS string) AS fallback")
    local = with_columns(with_language(messages, pinned=False), {
        **{c: c for c in LANGUAGE_COLUMNS}, "_blank": is_blank("text")}).drop("text")
    return with_remote_language(local, _or_none(candidates, messages))


def _or_none(candidates: DataFrame | None, messages: DataFrame) -> DataFrame:
    return messages.sparkSession.createDataFrame([], CANDIDATES_SCHEMA) if candidates is None else candidates


def match_messages(messages: DataFrame, detector: str | None = None,
                   candidates: DataFrame | None = None, pinned: bool = True, entries=ENTRIES) -> DataFrame:
    """Add the language columns and ``hits`` to normalized messages.

    ``candidates`` is a table of labels, or labels that arrive beside a stream of
    messages (``ArrivingLabels``)."""
    if detector is None:
        return with_hits(with_language(messages, pinned=False), pinned=pinned, entries=entries)
    if check_detector(detector) == LOCAL_DETECTOR:
        return match_messages(messages, pinned=pinned, entries=entries).selectExpr(
            "*", f"'{LOCAL_SOURCE}' AS languageSource", "cast(NULL AS string) AS fallback")
    candidates = _or_none(candidates, messages)
    narrow = tried_messages(messages, entries)
    arriving = getattr(candidates, "language_of", None)
    labelled = arriving(narrow) if arriving else with_remote_language(narrow, candidates)
    return decided_messages(labelled, pinned)


def tried_messages(messages: DataFrame, entries=ENTRIES) -> DataFrame:
    """Normalized messages with the local language and the hits of all entries, before their label is known.

    Only messages with a hit keep their text."""
    tried = with_hits(with_language(messages, pinned=False), any_language=True, pinned=False, entries=entries)
    others = [f"`{c}`" for c in tried.columns if c not in ("text", "hits", *LANGUAGE_COLUMNS)]
    return with_columns(tried.selectExpr(*others, "text AS _text", "hits AS _hits", *LANGUAGE_COLUMNS), {
        **{c: c for c in LANGUAGE_COLUMNS}, "hits": "_hits", "_blank": is_blank("_text"),
        "text": "if(size(_hits) > 0, _text, NULL)"}).drop("_text", "_hits")


def decided_messages(labelled: DataFrame, pinned: bool = True) -> DataFrame:
    """Such messages once their language is known, with the hits that apply to it."""
    return with_columns(labelled, {
        **{c: c for c in LANGUAGE_COLUMNS}, "hits": gated_hits("hits", "language", "languageConfidence"),
    }, pinned)


def classify_messages(messages: DataFrame, detector: str | None = None,
                      candidates: DataFrame | None = None, entries=ENTRIES) -> DataFrame:
    """Normalized messages with their language and ``findings``, without the text.

    ``detector`` is "local" or the remote labels' name, which then come from
    ``candidates``; both add where the language came from.  None is local too,
    without the extra columns.  ``entries`` is the lexicon (``read_lexicon``)."""
    return with_findings(match_messages(messages, detector, candidates, False, entries)).drop("text")


def find_risks(messages: DataFrame, detector: str | None = None,
               candidates: DataFrame | None = None, entries=ENTRIES) -> DataFrame:
    """One row per finding of normalized messages, best first within a message.

    Messages without any trigger word are dropped before their language is
    looked at."""
    return exploded_findings(classify_messages(triggered_messages(messages, entries), detector, candidates, entries))


def process_messages(raw: DataFrame, keep=(), strict: bool = True, detector: str | None = None,
                     candidates: DataFrame | None = None, entries=ENTRIES) -> DataFrame:
    """One nested result row per raw message."""
    return routed_messages(classify_messages(normalize_messages(raw, keep, strict), detector, candidates, entries), keep, detector)


def routed_messages(classified: DataFrame, keep=(), detector: str | None = None) -> DataFrame:
    """The nested result rows of classified messages."""
    source = [] if detector is None else ["languageSource", "fallback"]
    return with_routes(classified).selectExpr(
        *[f"`{k}`" for k in keep],
        "struct(id, platform, direction, timestamp) AS message",
        "language", "languageName", *source, "immediate", "batch", "alerts")
