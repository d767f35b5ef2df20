"""Secret scans: known forms, and random strings told by their tokens.

Two kinds of findings come out of one pass over the texts:

* the *base* forms: an assignment to a secret's name, an access key, a long
  hexadecimal run;
* the *token-efficiency test*: a run of key characters that a public vocabulary
  needs unusually many tokens for is no word of any language.  Runs that are a
  digest of a known length, a UUID, a number or an identifier made of words are
  left alone by the test.  What lies between plain words of a run, and each part
  between separators, is tested too, so words do not hide a key beside them; a
  long part is taken for a word only if it is as few tokens as words are.

Spans are (kind, start, end) in code points, the end exclusive.

Defined results: null and empty texts have no spans; very long texts are scanned
whole; repeated rows give repeated rows; an empty table gives an empty one.
Columns that are not kept play no part; kept ones must not have the names of the
results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lumenward.llm.byte_bpe import codec

ASSIGN, ACCESS, HEX, RANDOM = KINDS = ("assign", "access", "hex", "random")

MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")
#: Words an assignment needs one of; looking for them first is cheap.
_NAMES = re.compile(r"passw|secret|token|api_?key", re.A | re.I)

#: The token test looks at runs, and stretches of them, of this length or more with a letter in them...
MIN_RANDOM = 16
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: ...which the vocabulary needs a token for fewer characters than this.
MAX_CHARS_PER_TOKEN = 2.0
#: Letters with a capital among them, as in names of classes, take more tokens than words do:
#: for these the limit is this share of it.
CAPITALS_SHARE = 0.9
#: Letters that repeat with a period of at most this are not random.
MAX_PERIOD = 16
#: A word that divides a run: letters only, this many or more, and this many to a token.
MIN_PLAIN, MIN_PLAIN_PER_TOKEN = 4, 3.0
_SEPARATORS = "_/=+-"
_PART = re.compile(rf"[^{_SEPARATORS}]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Lengths of the hexadecimal forms of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Fewer different characters than this are a code of its own, such as bases of DNA.
MIN_DIFFERENT = 6
#: What names, dates and versions have between separators: numbers, a few letters, a few of both, words with a number.
_SMALL = re.compile(
    r"[0-9]{1,8}|[A-Za-z]{1,3}|(?:[A-Za-z]{1,3}[0-9]{1,4}){1,2}|[0-9]{1,4}[A-Za-z]{1,2}(?:[0-9]{1,2})?|[0-9a-f]{1,4}|[0-9A-F]{1,4}")
_NUMBERED = re.compile(r"([A-Za-z]{3,})[0-9]{0,8}")
#: Characters to a token of a word there, which is short and among others.
MIN_NAMED_PER_TOKEN = 2.0
#: Letters of one case need more of them, as words are such.
MIN_ONE_CASE = 20
#: Words, numbers and capitalised words between separators, such as names of files or functions.
_IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_/=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each known form, those that are too short dropped."""
    found: list[Span] = []
    if _NAMES.search(text):
        found += [(ASSIGN, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(ACCESS, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(HEX, m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def is_known(run: str) -> bool:
    """A digest, a UUID, a number, or an identifier made of words."""
    if _ALL_HEX.fullmatch(run) and len(run) in _DIGEST_LENGTHS:
        return True
    return bool(_UUID.fullmatch(run) or _IDENTIFIER.fullmatch(run)) or not any(c.isalpha() for c in run)


def _has_digit(run: str) -> bool:
    return any(c.isdigit() for c in run)


def _is_identifier(run: str) -> bool:
    """Words between separators, which may also stand around them if there is no digit."""
    return bool(_IDENTIFIER.fullmatch(run if _has_digit(run) else run.strip(_SEPARATORS)))


def _is_name(run: str, count_tokens: Callable[[str], int]) -> bool:
    """Two or more parts between separators, none of them more than a word, a number or a little of both."""
    parts = _PART.findall(run)
    if len(parts) < 2:
        return False
    for part in parts:
        if not _SMALL.fullmatch(part):
            numbered = _NUMBERED.fullmatch(part)
            if not numbered or len(numbered[1]) < MIN_NAMED_PER_TOKEN * count_tokens(numbered[1]):
                return False
    return True


def _is_random(run: str, count_tokens: Callable[[str], int], limit: float) -> bool:
    if len(set(run.lower())) < MIN_DIFFERENT or _is_name(run, count_tokens):
        return False
    if sum(ord(b) - ord(a) == 1 for a, b in zip(run, run[1:])) > len(run) // 2:  # a stretch of the alphabet
        return False
    if len(run) < MIN_ONE_CASE and run.isalpha() and (run.islower() or run.isupper()):
        return False
    if not _has_digit(run):
        if any(run[period:] == run[:-period] for period in range(1, min(MAX_PERIOD, len(run) // 3) + 1)):
            return False
        if not run.islower():
            limit *= CAPITALS_SHARE
    return len(run) < limit * count_tokens(run)


def _stretches(run: str, count_tokens: Callable[[str], int]) -> Iterator[tuple[int, int]]:
    """What lies between plain words, without the separator next to each."""
    start, held = 0, False
    for m in _PART.finditer(run):
        part = m[0]
        if len(part) >= MIN_PLAIN and part.isalpha() and len(part) >= MIN_PLAIN_PER_TOKEN * count_tokens(part):
            if held:
                yield start, m.start() - 1
            start, held = m.end() + 1, False
        else:
            held = True
    if held:
        yield start, len(run)


def _random_in(run: str, count_tokens: Callable[[str], int], limit: float, least: int) -> Iterator[tuple[int, int]]:
    """The run if it is random as a whole, else the stretches of it that are, else their parts."""
    if not _is_identifier(run):
        if is_known(run):
            return
        if _is_random(run, count_tokens, limit):
            yield 0, len(run)
            return
    for start, end in _stretches(run, count_tokens):
        stretch = run[start:end]
        if end - start < least:
            continue
        if not _is_identifier(stretch) and not is_known(stretch) and _is_random(stretch, count_tokens, limit):
            yield start, end
            continue
        for m in _PART.finditer(stretch):
            part = m[0]
            if len(part) >= least and (part.isalpha() or not is_known(part)) and _is_random(part, count_tokens, limit):
                yield start + m.start(), start + m.end()


def random_spans(text: str, count_tokens: Callable[[str], int], limit: float = MAX_CHARS_PER_TOKEN,
                 least: int = MIN_RANDOM) -> list[Span]:
    """Runs of ``least`` characters or more, or stretches of them, with few characters to a token."""
    return [
        (RANDOM, m.start() + start, m.start() + end) for m in _RUN.finditer(text) if m.end() - m.start() >= least
        for start, end in _random_in(m[0], count_tokens, limit, least)]


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def all_spans(text: str, count_tokens: Callable[[str], int], least: int = MIN_RANDOM) -> list[Span]:
    return sorted(base_spans(text) + random_spans(text, count_tokens, least=least), key=_order)


def redacted(text: str, spans: list[Span], mark: str = "[REDACTED]") -> str:
    """The text with each stretch covered by spans replaced by a mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame, path: str, pattern: str, text: str = "text", keep=("doc_id",), least: int = MIN_RANDOM) -> DataFrame:
    """``keep``, ``spans`` and ``clean_text``, the text without them.

    ``least`` is the floor of the token test: a lower one finds shorter keys and takes more
    names for keys."""
    clash = {"spans", "clean_text", "_scan_text"} & {k.lower() for k in keep}
    if clash:
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")
    rows = docs.selectExpr(*[f"`{k}`" for k in keep], f"`{text}` AS _scan_text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path, pattern).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(part.num_columns - 1).to_pylist()
                spans = [all_spans(t, lambda run: len(encode(run)), least) if t else [] for t in texts]
                clean = [t if not s else redacted(t, s) for t, s in zip(texts, spans)]
                listed = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(listed, span_type), pa.array(clean, pa.string())],
                    names=[*part.schema.names[:-1], "spans", "clean_text"])

    return rows.mapInArrow(run, ", ".join(
        [*fields, "spans array<struct<kind:string,start:bigint,end:bigint>>", "clean_text string"]))


def redact_secrets(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The same documents and columns, the secrets taken out of their texts."""
    packed = docs.selectExpr(f"struct({', '.join(f'`{c}`' for c in docs.columns)}) AS _document", "text AS _text")
    cleaned = scan(packed, path, pattern, "_text", ("_document",))
    replaced = {"text": "clean_text", "n_chars": "if(size(spans) > 0, length(clean_text), _document.n_chars)"}
    return cleaned.selectExpr(*[
        f"{replaced.get(c, f'_document.`{c}`')} AS `{c}`" for c in docs.columns])
