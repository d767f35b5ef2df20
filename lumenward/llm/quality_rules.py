"""Rule bitmask ledger: quality rules evaluated once, judged by policies later.

One pass over the texts (:func:`ledger`) stores, for each document, its
measurements and one failure bit for every rule of :data:`RULES`.  A *policy* is
a versioned set of rule names; judging (:func:`judge`) and counting what each
rule of a policy costs (:func:`ablation`) only touch the stored bits, so a new
policy never reads a text again.

Defined results: null and empty texts have no words, so every count is 0 and
the rules on length fail; very long texts are measured whole; repeated rows
give repeated rows; an empty table gives an empty ledger.  Columns other than
those named by ``keep`` are ignored, clashing ones too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.llm.words import slices, text_buffer, window_hashes, word_hashes, word_spans

WINDOW_WORDS = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
_LEDGER = f"{', '.join(f'{m} long' for m in MEASURES)}"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_START = (np.arange(256) & 0xC0) != 0x80  # the first byte of a character
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True


@dataclass(frozen=True)
class Rule:
    """``fails`` is an expression over the measurements."""
    name: str
    fails: str


#: The order gives the bits; new rules go to the end, so that stored bits keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule("long_words", "n_words > 0 AND word_chars > 25 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("shouting", "n_letters > 0 AND 100 * n_upper > 60 * n_letters"),
)
BIT = {rule.name: 1 << at for at, rule in enumerate(RULES)}

#: Rules of a document that cannot pass whatever the policy adds.
BASE_RULES = ("few_words", "repeated_windows")
POLICIES = {
    1: BASE_RULES,
    2: (*BASE_RULES, "symbols", "duplicate_lines"),
    3: (*BASE_RULES, "symbols", "short_words", "long_words", "duplicate_lines", "shouting"),
}
LATEST = 3


def mask(names) -> int:
    return sum(BIT[name] for name in names)


def _line_counts(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, solid_row: np.ndarray) -> tuple:
    """By row: lines with a word, and those among them equal to an earlier one."""
    n_rows = len(bounds) - 1
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.concatenate([bounds[:-1], breaks + 1])
    row = np.concatenate([np.arange(n_rows), np.searchsorted(bounds, breaks, "right") - 1])
    order = np.lexsort((line_start, row))
    line_start, row = line_start[order], row[order]
    line_end = np.empty(len(line_start), np.int64)
    line_end[:-1] = np.where(row[1:] == row[:-1], line_start[1:] - 1, bounds[row[:-1] + 1])
    if len(line_end):
        line_end[-1] = bounds[-1]
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, row = line_start[worded], line_end[worded], row[worded]
    if not len(row):
        return np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    value = word_hashes(data, line_start, line_end)
    order = np.lexsort((value, row))
    again = np.zeros(len(row), bool)
    again[1:] = (value[order][1:] == value[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row, minlength=n_rows), np.bincount(row[order][again], minlength=n_rows)


def _repeated_words(windows: np.ndarray, n_windows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By row: words that lie in a window found at least twice in the row."""
    n_rows, n = len(counts), int(counts.sum())
    if not n:
        return np.zeros(n_rows, np.int64)
    full = np.where(counts >= WINDOW_WORDS, n_windows, 0)
    use = np.repeat(counts >= WINDOW_WORDS, n_windows)
    windows = windows[use]
    row = np.repeat(np.arange(n_rows), full)
    if not len(row):
        return np.zeros(n_rows, np.int64)
    order = np.lexsort((windows, row))
    same = (windows[order][1:] == windows[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(row), bool)
    twice[1:] |= same
    twice[:-1] |= same
    repeated = np.zeros(len(row), bool)
    repeated[order] = twice
    first_word, first_window = np.cumsum(counts) - counts, np.cumsum(full) - full
    at = (np.arange(len(row)) - first_window[row] + first_word[row])[repeated]
    inside = np.zeros(n, bool)
    for j in range(WINDOW_WORDS):
        inside[at + j] = True
    return np.bincount(np.repeat(np.arange(n_rows), counts)[inside], minlength=n_rows)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of a column of texts."""
    data, bounds = text_buffer(column)
    starts, ends, counts = word_spans(data, bounds)
    windows, n_windows = window_hashes(word_hashes(data, starts, ends), counts, WINDOW_WORDS)
    lines, dup_lines = _line_counts(data, bounds, starts, counts)

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(flags), bounds))

    words = np.zeros(len(data) + 1, np.int32)
    np.add.at(words, starts, 1)
    np.add.at(words, ends, -1)
    solid = np.cumsum(words[:-1]) > 0
    return {
        "n_words": counts, "word_chars": per_row(solid & _START[data]), "n_symbols": per_row(_SYMBOL[data]),
        "n_dup_lines": dup_lines, "n_repeat_words": _repeated_words(windows, n_windows, counts), "n_lines": lines,
        "n_upper": per_row(_UPPER[data]), "n_letters": per_row(_LETTER[data]),
    }


def _measured(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_rule_text"):
            kept = [part.column(part.schema.get_field_index(k)) for k in keep]
            found = measure(part.column(part.schema.get_field_index("_rule_text")))
            yield pa.RecordBatch.from_arrays(
                [*kept, *[pa.array(found[m].astype(np.int64)) for m in MEASURES]], names=[*keep, *MEASURES])
    return run


def ledger(docs: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep``, the measurements, and ``failed``: a bit for each rule that fails.

    ``keep`` must not hold a name of :data:`MEASURES`, or ``failed``; callers that
    carry such columns rename them."""
    clash = {*MEASURES, "failed"} & {k.lower() for k in keep}
    if clash:
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")
    kept = [f"`{k}`" for k in keep]
    rows = docs.selectExpr(*kept, f"cast(`{text}` AS string) AS _rule_text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{fields}, {_LEDGER}" if fields else _LEDGER
    bits = " + ".join(f"if({rule.fails}, {BIT[rule.name]}L, 0L)" for rule in RULES)
    return rows.mapInArrow(_measured(list(keep)), schema).selectExpr("*", f"{bits} AS failed")


def judge(entries: DataFrame, policy: int = LATEST, name: str = "kept") -> DataFrame:
    """Add whether a document passes a policy; only its bits are looked at."""
    return entries.selectExpr("*", f"(failed & {mask(POLICIES[policy])}L) = 0 AS `{name}`")


def ablation(entries: DataFrame, policy: int = LATEST) -> DataFrame:
    """For each rule of a policy: documents failing it, failing nothing else of
    the policy (so kept again without it), and documents the policy keeps.

    Bitwise counts over the ledger: one partial aggregate for each task, no text."""
    of = mask(POLICIES[policy])
    sums = [F.expr("count(*)").alias("documents"), F.expr(f"count_if(failed & {of}L = 0)").alias("kept")]
    for rule in POLICIES[policy]:
        sums += [F.expr(f"count_if(failed & {BIT[rule]}L <> 0)").alias(f"fail_{rule}"),
                 F.expr(f"count_if(failed & {of}L = {BIT[rule]}L)").alias(f"only_{rule}")]
    rows = ", ".join(f"struct('{r}' AS rule, fail_{r} AS failing, only_{r} AS kept_without)" for r in POLICIES[policy])
    return entries.agg(*sums).selectExpr(f"{policy} AS policy", "documents", "kept", f"inline(array({rows}))")


def reject_low_quality(docs: DataFrame, policy: int = LATEST) -> DataFrame:
    """The documents that pass a policy, as they were."""
    columns = docs.columns
    packed = docs.selectExpr("text AS _text", f"struct({', '.join(f'`{c}`' for c in columns)}) AS _document")
    judged = judge(ledger(packed, "_text", ("_document",)), policy, "_passes")
    return judged.where("_passes").selectExpr(*[f"_document.`{c}` AS `{c}`" for c in columns])
