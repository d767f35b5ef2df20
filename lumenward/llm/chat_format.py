"""Chat formatting checked by its own grammar.

A conversation is rendered as a run of turns and the rendered text is parsed again
by a deterministic parser, which takes no control string inside a turn.  Where it
refuses the text, or the turns read back are not the source's, the control strings
in the texts concerned are escaped and the piece is rendered anew, until both are
the same; other texts are never touched.

The grammar::

    conversation := turn*
    turn         := "[INST] " role NEWLINE text "</s>" NEWLINE

Role and text hold no ``<s>``, ``</s>``, ``[INST]`` or ``[/INST]``.  Escaping puts a backslash after the first character of a control string; a
control string that has backslashes there already gets one more, so that reading
back, which takes one away, is exact.  In roles backslash and newline are also
written as two characters.

A conversation is rendered in order of turn, in pieces of a bounded number of
turns, so that neither a task nor a row grows with the longest conversation; the
pieces one after the other are the formatted text.

Defined results: a null text or role is empty; null turns come first, equal turns
in order of role and text, so repeated rows are repeated turns; rows without a
conversation id are one conversation whose id is null; very long texts are
rendered whole; an empty table gives an empty one.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LOSS_ROLE = "assistant"
PIECE_TURNS = 256
PIECE_CHARS = 1 << 20

# Fixed values of the template.
OPEN, CLOSE = "[INST] ", "</s>\n"
_CONTROL = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")
_BARE = re.compile(r"</?s>|\[/?INST\]")
_ESCAPED = re.compile(r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\])")

Turn = tuple[str, str]


def _put(match: re.Match, more: str) -> str:
    first, slashes, rest = match.group(1, 2, 3) if match[1] else match.group(4, 5, 6)
    return f"{first}{more}{slashes}{rest}"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _put(m, "\\"), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _put(m, ""), text)


def _write_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _read_role(written: str) -> str:
    return unescape(re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", written))


class GrammarError(ValueError):
    """The text is no conversation."""


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role and text of each turn, and where its text, as written, begins and ends."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise GrammarError(f"no turn at {at}")
        line = formatted.find("\n", at)
        end = formatted.find(CLOSE[:-1], line + 1) if line >= 0 else -1
        if end < 0 or not formatted.startswith(CLOSE, end):
            raise GrammarError(f"no end of the turn at {at}")
        if _BARE.search(formatted, at + len(OPEN), end):
            raise GrammarError(f"a control string inside the turn at {at}")
        turns.append((_read_role(formatted[at + len(OPEN):line]), unescape(formatted[line + 1:end]), line + 1, end))
        at = end + len(CLOSE)
    return turns


def _written(role: str, text: str) -> str:
    return f"{OPEN}{_write_role(role)}\n{text}{CLOSE}"


def render(turns: list[Turn]) -> str:
    """The turns as one text that reads back as exactly these turns.

    A turn's text is first written as it is; the grammar is such that turns are
    read one by one, so each is tried by itself and only then all together."""
    parts = []
    for role, text in turns:
        part = _written(role, text)
        if not _reads_as(part, [(role, text)]):
            part = _written(role, escape(text))
        parts.append(part)
    formatted = "".join(parts)
    if not _reads_as(formatted, turns):
        raise GrammarError("a conversation did not survive the round trip")
    return formatted


def _reads_as(formatted: str, turns: list[Turn]) -> bool:
    try:
        return [(role, text) for role, text, _, _ in parse(formatted)] == list(turns)
    except GrammarError:
        return False


def loss_spans(formatted: str, role: str = LOSS_ROLE) -> list[tuple[int, int]]:
    """Where the texts to be learned stand, in code points."""
    return [(start, end) for who, _, start, end in parse(formatted) if who == role]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class _Rows:
    """Rows gathered to batches of a bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 1000, most_chars: int = 4 << 20):
        self.schema, self.most, self.most_chars = schema, most, most_chars
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, row: tuple, chars: int = 0) -> bool:
        """Whether the batch is full."""
        self.rows.append(row)
        self.chars += chars
        return len(self.rows) >= self.most or self.chars >= self.most_chars

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(values, field.type) for values, field in zip(zip(*self.rows), self.schema)]
        self.rows, self.chars = [], 0
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


_PIECE = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()), ("loss_spans", _SPANS)])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = _Rows(_PIECE), []
    size, piece, current, seen = 0, 0, None, False

    def row() -> tuple:
        formatted = render(held)
        return current, piece, formatted, [{"start": a, "end": b} for a, b in loss_spans(formatted)]

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if seen and (conv != current or len(held) >= PIECE_TURNS or size >= PIECE_CHARS):
                if rows.add(row(), size):
                    yield rows.batch()
                piece = piece + 1 if conv == current else 0
                held, size = [], 0
            current, seen = conv, True
            held.append((role, text))
            size += len(text)
    if held:
        rows.add(row())
        yield rows.batch()


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, piece, formatted, loss_spans``; spans are code points within the piece.

    The rows of a conversation meet in one partition, in order, and pass through
    it piece by piece.  Its pieces follow one another there."""
    rows = turns.selectExpr(
        "cast(conv_id AS bigint) AS conv_id", "cast(turn AS bigint) AS turn", "coalesce(cast(role AS string), '') AS role",
        "coalesce(cast(text AS string), '') AS text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(
        _pieces, "conv_id bigint, piece bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, state = _Rows(_DIGEST), None

    def row() -> tuple:
        conv, n, turns, chars, loss, total = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

    for batch in batches:
        for conv, piece, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if piece == 0:
                if state and rows.add(row()):
                    yield rows.batch()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for span in spans:
                text = unescape(formatted[span["start"]:span["end"]])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(formatted)
    if state:
        rows.add(row())
        yield rows.batch()


def read_back_digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation, made from the formatted text and its spans alone.

    To be used on :func:`format_conversations` as it comes, whose pieces are in order."""
    return pieces.select("conv_id", "piece", "formatted", "loss_spans").mapInArrow(
        _digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
                  " formatted_chars bigint")
