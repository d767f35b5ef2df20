"""Language of each message: local detection, or labels made elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.functions.languages import (
    COUNTED_WORDS, DEFAULT_CONFIDENCE, DEFAULT_LANGUAGE, LOCAL_DETECTOR, LOCAL_SOURCE,
    REMOTE_DETECTOR, SCRIPT_CONFIDENCE, SCRIPTS, UNDETERMINED, language_name, listed_words,
    script_language, stopword_confidence, stopword_counts, words_of,
)
from lumenward.functions.text import empty_array, is_blank, lookup, round2, trim_all
from lumenward.operators.pinning import with_columns
from lumenward.schema import LANGUAGE_COLUMNS

def with_words(messages: DataFrame) -> DataFrame:
    """Add ``_script``, the language by script, and ``_words`` of other text."""
    return messages.selectExpr("*", f"{script_language('text')} AS _script").selectExpr(
        "*", f"if(_script IS NULL, {words_of('lower(text)')}, {empty_array('array<string>')}) AS _words")


def with_stopword_counts(messages: DataFrame) -> DataFrame:
    """Add ``_n_words`` and ``_counts``, the function words per language.

    The words are narrowed to listed ones first, so that each language counts
    over a short array."""
    return (
        with_words(messages)
        .selectExpr("*", "size(_words) AS _n_words", f"{listed_words('_words')} AS _listed")
        .selectExpr("*", f"{stopword_counts('_listed')} AS _counts")
    )


def with_language(messages: DataFrame, pinned: bool = True) -> DataFrame:
    """Detect each message's language from its own text."""
    counts = [f"_counts.{lang}" for lang in COUNTED_WORDS]
    counted = with_stopword_counts(messages).selectExpr(
        "*", f"greatest({', '.join(counts)}) AS _best", f"{' + '.join(counts)} AS _total")
    by_count = " ".join(f"WHEN _counts.{lang} = _best THEN '{lang}'" for lang in COUNTED_WORDS)
    decided = counted.selectExpr(
        "*",
        f"CASE WHEN _script IS NOT NULL THEN _script WHEN _n_words = 0 THEN '{UNDETERMINED}'"
        f" WHEN _best = 0 THEN '{DEFAULT_LANGUAGE}' {by_count} END AS _code")
    names = lookup([(code, name) for code, name, *_ in SCRIPTS], "_script")
    by_words = stopword_confidence("_best", "_total", "_n_words")
    return with_columns(decided, {
        "language": "_code",
        "languageName": f"coalesce({names}, {language_name('_code')})",
        "languageConfidence":
            f"CASE WHEN _script IS NOT NULL THEN {SCRIPT_CONFIDENCE}D WHEN _n_words = 0 THEN 0D"
            f" WHEN _best = 0 THEN {DEFAULT_CONFIDENCE}D ELSE {by_words} END",
    }, pinned).select(*messages.columns, *LANGUAGE_COLUMNS)


def check_detector(detector: str) -> str:
    if detector not in (LOCAL_DETECTOR, REMOTE_DETECTOR):
        raise ValueError(
            f'Unknown language backend "{detector}". Use "{LOCAL_DETECTOR}" or "{REMOTE_DETECTOR}".')
    return detector


def remote_requests(messages: DataFrame, max_chars: int | None = None, keep=()) -> DataFrame:
    """What the labelling service is sent: id and text, the whole text by default.

    ``max_chars`` is the longest text the service accepts, if it has a limit;
    the one whose labels this package can read takes 5,000 characters."""
    text = trim_all("text")
    sent = text if max_chars is None else f"substring({text}, 1, {int(max_chars)})"
    return messages.where(f"NOT ({is_blank('text')})").selectExpr(
        *[f"`{k}`" for k in keep], "id", f"{sent} AS text")


def best_candidate(candidates: str) -> str:
    """Highest-scored candidate, the earlier one on a tie; null if there is none."""
    ranked = f"transform({candidates}, (c, i) -> struct(c.score AS score, -i AS place, c.code AS code))"
    return f"array_max({ranked})"


def label_of(best: str) -> str:
    """A label that is there, though its candidates may be none."""
    return f"coalesce({best}, named_struct('score', 0D, 'place', 0, 'code', '{UNDETERMINED}'))"


def merged_labels(candidates: DataFrame) -> DataFrame:
    """One row per id, (_label_id, _label), from any table of candidates; none without id."""
    return (
        candidates.where("id IS NOT NULL").selectExpr("id AS _label_id", f"{best_candidate('candidates')} AS _best")
        .groupBy("_label_id").agg(F.max("_best").alias("_best"))
        .selectExpr("_label_id", f"{label_of('_best')} AS _label"))


def with_remote_language(messages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Replace the local language by the labels of ``candidates``, joined on id.

    ``messages`` holds the local result, used where the id has no row there,
    and ``_blank``, whether the text is.  Callers drop the text before this join
    wherever they no longer need it: it is the only shuffle of the message
    path.  Messages without an id cannot match; each gets a key of its own, so
    that they spread over all partitions.  A hot id of the messages is left to
    AQE's skew join, which splits it once it is larger than its thresholds.

    ``candidates`` may hold several rows for an id, whose best candidates count:
    the highest score, then the earlier place in its row, then the later code in
    alphabetical order.  They are merged before the join, so a message stays one
    row whatever the table holds.  The keys of the join are made after that, so
    that the merged labels, which are narrow, are shuffled for it by themselves: a
    join right on top of an aggregate could not be split at a hot id."""
    labels = merged_labels(candidates).selectExpr("concat('id ', _label_id) AS _label_id", "_label")
    # Row numbers are not to be had on streams; there the row's content spreads those without an id.
    others = ", ".join(f"`{c}`" for c in messages.columns)
    number = f"xxhash64({others})" if messages.isStreaming else "monotonically_increasing_id()"
    keyed = messages.selectExpr("*", f"coalesce(concat('id ', id), concat('no id ', {number})) AS _key")
    joined = keyed.join(labels, (F.col("_key") == F.col("_label_id")) & F.col("id").isNotNull(), "left")
    return labelled_language(joined).drop("_key")


def labelled_language(joined: DataFrame) -> DataFrame:
    """The language columns of messages that were joined with (_label_id, _label), null where there is none."""
    code = f"split_part(coalesce(nullif(_label.code, ''), '{UNDETERMINED}'), '-', 1)"
    decided = joined.selectExpr(
        "*", f"if(_blank, '{UNDETERMINED}', {code}) AS _code", "_label IS NULL AND NOT _blank AS _is_local",
        f"if(_blank, 0D, {round2('_label.score')}) AS _score")
    return with_columns(decided, {
        "language": "if(_is_local, language, _code)",
        "languageName": f"if(_is_local, languageName, {language_name('_code')})",
        "languageConfidence": "if(_is_local, languageConfidence, _score)",
        "languageSource": f"if(_is_local, '{LOCAL_SOURCE}', '{REMOTE_DETECTOR}')",
        "fallback": f"if(_is_local, '{REMOTE_DETECTOR} unavailable: no label for this message', NULL)",
    }).drop("_blank", "_label_id", "_label", "_code", "_is_local", "_score")
