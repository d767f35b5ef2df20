"""Messages from files of one JSON value per line.

Lines end at a line feed and nowhere else, and white space of any kind around
them, a byte order mark included, doesn't count.  A line is a message whatever it
holds: the fields of an object, or no field at all for any other JSON value.  Of a
key that occurs twice the last one counts.  A field that is null, false, zero or an
empty string counts as missing; other booleans are their text, numbers are doubles
in their shortest form, objects and arrays their JSON.  A blank line is none.  A
line that is not JSON is bad.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenward.functions.text import WHITESPACE, is_blank, let, number_text, quote, trim_all
from lumenward.schema import RAW_FIELDS

POSITION = "input_position"
LINE = "value"
_VALUE = "_value"
# Place in the input: file, split within it, line within that, from 0.
_PLACE = ("struct(_metadata.file_path AS file, _metadata.file_block_start AS block,"
          f" monotonically_increasing_id() & {(1 << 33) - 1}L AS row) AS {POSITION}")


#: The variant parser refuses a key that occurs twice unless told otherwise.
_REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def trimmed(line: str) -> str:
    """The line without white space at its ends; most lines have none, and are left alone."""
    return f"if(concat(left({line}, 1), right({line}, 1)) RLIKE {quote(f'[{WHITESPACE}]')}, {trim_all(line)}, {line})"


def parsed(line: str) -> str:
    """The line as a variant, null if it is not exactly one JSON value.

    The parser stops after a value and leaves the rest of its input unread, so
    the line is parsed as an element of a list and as a field of an object: what
    could end the one early breaks the other."""
    listed, field = f"try_parse_json(concat('[', {line}, ']'))", f"try_parse_json(concat('{{\"v\":', {line}, '}}'))"
    alone = f"variant_get({listed}, '$[0]') IS NOT NULL AND variant_get({listed}, '$[1]') IS NULL"
    return f"if({alone}, variant_get({field}, '$.v'), NULL)"


def field_text(value: str, name: str) -> str:
    """A field as text, null if it counts as missing."""
    found = f"try_variant_get({value}, '$.{name}', 'variant')"
    text = "variant_get(x, '$', 'string')"
    kind = "schema_of_variant(x)"
    body = (f"CASE WHEN x IS NULL OR is_variant_null(x) THEN NULL WHEN {kind} = 'BOOLEAN' THEN nullif({text}, 'false')"
            f" WHEN {kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {kind} LIKE 'DECIMAL%'"
            f" THEN {let('d', f'cast({text} AS double)', f'if(d = 0D, NULL, {number_text(chr(100))})')}"
            f" ELSE nullif({text}, '') END")
    return let("x", found, body)


def _values(lines: DataFrame) -> DataFrame:
    lines.sparkSession.conf.set(_REPEATED_KEYS, "true")
    others = [f"`{c}`" for c in lines.columns]
    return lines.where(f"NOT {is_blank(LINE)}").selectExpr("*", f"{trimmed(LINE)} AS _trimmed").selectExpr(
        *others, f"{parsed('_trimmed')} AS {_VALUE}")


def _fields() -> list[str]:
    return [f"{field_text(_VALUE, f)} AS {f}" for f in RAW_FIELDS]


def messages_of_lines(lines: DataFrame) -> DataFrame:
    """Raw messages of a table or stream of lines; bad ones are left out."""
    others = [f"`{c}`" for c in lines.columns if c != LINE]
    return _values(lines).where(f"{_VALUE} IS NOT NULL").selectExpr(*others, *_fields())


def bad_lines(lines: DataFrame) -> DataFrame:
    """The lines that are not JSON."""
    others = [f"`{c}`" for c in lines.columns if c != LINE]
    return _values(lines).where(f"{_VALUE} IS NULL").selectExpr(*others, f"{LINE} AS line")


def tagged_lines(lines: DataFrame) -> DataFrame:
    """Every line once: the line if it is bad, else its fields."""
    others = [f"`{c}`" for c in lines.columns if c != LINE]
    return _values(lines).selectExpr(*others, f"if({_VALUE} IS NULL, {LINE}, NULL) AS bad_line", *_fields())


def placed_lines(spark: SparkSession, path) -> DataFrame:
    """All lines with their place in the input."""
    return spark.read.text(path, lineSep="\n").selectExpr(_PLACE, LINE)


def read_jsonl(spark: SparkSession, path) -> DataFrame:
    """Raw messages with their place in the input; a bad line fails the job and says where it is."""
    place = f"concat({POSITION}.file, ', from byte ', {POSITION}.block, ' line ', {POSITION}.row + 1)"
    refuse = f"cast(raise_error(concat({quote('Invalid JSON in ')}, {place})) AS boolean)"
    return _values(placed_lines(spark, path)).where(f"if({_VALUE} IS NOT NULL, true, {refuse})").selectExpr(
        POSITION, *_fields())


def read_jsonl_tagged(spark: SparkSession, path) -> DataFrame:
    """Every line of files once: its place, the line if it is bad, else its fields."""
    return tagged_lines(placed_lines(spark, path))


def read_jsonl_with_rejects(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Raw messages, and the bad lines, both with their place."""
    lines = placed_lines(spark, path)
    return messages_of_lines(lines), bad_lines(lines)
