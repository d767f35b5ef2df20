"""String and number helpers that follow the message format's own rules.

The functions of this package build Spark SQL expression text from expression
text, for ``selectExpr`` and ``F.expr``: the lexicon makes expressions of
thousands of nodes, which parse in milliseconds but take seconds to assemble
from Python column objects.  Lengths and offsets are counted in code points.
"""

from __future__ import annotations

# Body of a character class holding every character counted as white space.
WHITESPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def quote(value: str) -> str:
    """A string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def check_literals(spark) -> None:
    """String literals are written with backslash escapes; refuse a session that reads them otherwise."""
    if spark.conf.get("spark.sql.parser.escapedStringLiterals", "false").lower() == "true":
        raise RuntimeError("set spark.sql.parser.escapedStringLiterals to false")


def quoted_list(values) -> str:
    return ", ".join(quote(v) for v in values)


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def present(value: str) -> str:
    """The value, or null where it is an empty string."""
    return f"nullif({value}, '')"


def is_blank(text: str) -> str:
    return f"NOT {text} RLIKE {quote(f'[^{WHITESPACE}]')}"


def collapse_spaces(text: str) -> str:
    return f"regexp_replace({text}, {quote(f'[{WHITESPACE}]+')}, ' ')"


def trim_all(text: str) -> str:
    ends = rf"\A[{WHITESPACE}]+|[{WHITESPACE}]+\z"
    return f"regexp_replace({text}, {quote(ends)}, '')"


def round2(value: str) -> str:
    """Round a double to two places, halves going up."""
    return f"floor(({value}) * 100D + 0.5D) / 100D"


def two_places(value: str) -> str:
    return f"format_string('%.2f', {value})"


def number_text(value: str) -> str:
    """A double that is not zero as ECMAScript writes it: the fewest digits that give it back, as
    an integer below 10^21, with an exponent from there on and below 10^-6."""
    shape = "concat('%.', p, 'e')"
    shortest = f"get(filter(transform(sequence(0, 16), p -> format_string({shape}, abs({value}))), s -> cast(s AS double) = abs({value})), 0)"
    # n is the place of the decimal point, counted from the first of the digits d.
    plain = ("CASE WHEN n > 21 OR n < -5 THEN concat(left(d, 1), if(length(d) > 1, concat('.', substring(d, 2)), ''),"
             " 'e', if(n > 0, '+', '-'), abs(n - 1))"
             " WHEN n >= length(d) THEN rpad(d, n, '0') WHEN n > 0 THEN concat(left(d, n), '.', substring(d, n + 1))"
             " ELSE concat('0.', repeat('0', -n), d) END")
    point = let("n", "cast(split_part(s, 'e', 2) AS int) + 1", plain)
    digits = let("d", "replace(split_part(s, 'e', 1), '.', '')", point)
    finite = let("s", shortest, digits)
    return (f"concat(if({value} < 0D, '-', ''), if(abs({value}) = double('Infinity'), 'Infinity', {finite}))")


def lookup(pairs, key: str) -> str:
    """Value of ``key`` in a small fixed table, null where it has none."""
    table = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in pairs)
    return f"try_element_at(map({table}), {key})"


def empty_array(sql_type: str) -> str:
    return f"cast(array() AS {sql_type})"
