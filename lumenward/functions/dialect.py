"""Rewriting ECMAScript patterns into the dialect of Spark's ``rlike``.

Four things differ between the two and all of them change results here:

* ``\\b`` knows ASCII word characters only, while Java 17 uses Unicode ones;
* case-insensitive matching covers accented letters but never maps a
  non-ASCII letter to an ASCII one;
* ``\\s`` includes the no-break space and other Unicode blanks;
* ``.`` stops at the two Unicode line separators, but not at U+0085.

The patterns scan for their start, so what runs at every character is kept
small: a lookahead for the first letter and a one-sided boundary.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

from lumenward.functions.lexicon import Entry
from lumenward.functions.text import WHITESPACE

# Java's \w, unlike its \b, is ASCII.
BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
# The boundary before a letter or a group; all such groups start with letters.
OPENING = r"(?<!\w)"
ANY_CHAR = r"[^\n\r\u2028\u2029]"


@lru_cache(maxsize=1)
def _case_groups() -> dict[str, list[str]]:
    """Non-ASCII characters of the basic plane by their upper-case form."""
    groups = defaultdict(list)
    for code in range(0x80, 0x10000):
        if not 0xD800 <= code <= 0xDFFF:
            groups[chr(code).upper()].append(chr(code))
    return groups


def _case_variants(letter: str) -> str:
    return "".join(_case_groups()[letter.upper()]) or letter


def first_letters(pattern: str) -> str:
    """The characters a match can start with, as written in the pattern."""
    letters, groups, at_start = set(), [True], True
    for char in pattern.replace(r"\b", ""):
        if char == "(":
            groups.append(at_start)
        elif char == ")":
            groups.pop()
            at_start = False
        elif char == "|":
            at_start = groups[-1]
        else:
            if at_start:
                letters.add(char)
            at_start = False
    return "".join(sorted(letters))


def to_java(pattern: str, ignore_case: bool) -> str:
    """The Java pattern that matches what the ECMAScript one matches."""
    first = first_letters(pattern)
    out = ["(?i:" if ignore_case else "(?:", f"(?=[{first}])" if first.isascii() else "", "(?:"]
    in_class = False
    for at, char in enumerate(pattern):
        before, after = pattern[at - 1:at], pattern[at + 1:at + 2]
        if before == "\\":
            continue
        if char == "\\" and after == "b" and not in_class:
            opens = pattern[at + 2:at + 3]
            out.append(OPENING if opens == "(" or opens.isalpha() else BOUNDARY)
        elif char == "\\" and after == "s":
            out.append(WHITESPACE if in_class else f"[{WHITESPACE}]")
        elif char == "\\":
            out.append(char + after)
        elif char in "[]":
            in_class = char == "["
            out.append(char)
        elif char == "." and not in_class:
            out.append(ANY_CHAR)
        elif ignore_case and ord(char) >= 0x80:
            variants = _case_variants(char)
            out.append(variants if in_class or len(variants) == 1 else f"[{variants}]")
        else:
            out.append(char)
    out.append("))")
    return "".join(out)


def check_entry(entry: Entry) -> None:
    """Refuse an entry that the rewriting would not get right.

    The lookahead for the first letter and the one-sided boundary hold for
    patterns each of whose alternatives starts with a letter that must be there."""
    _check_start(entry.pattern, entry.pattern)


def _check_start(part: str, pattern: str) -> None:
    for alternative in alternatives(part):
        start = alternative.removeprefix(r"\b")
        if start.startswith("("):
            depth = 0
            for at, char in enumerate(start):
                depth += (char == "(") - (char == ")")
                if not depth:
                    break
            inside, after = start[1:at], start[at + 1:at + 2]
            _check_start(inside, pattern)
        else:
            if not start[:1].isalpha():
                raise ValueError(f"an alternative must start with a letter or a group of such: {pattern}")
            after = start[1:2]
        if after in ("?", "*", "{"):
            raise ValueError(f"the start of an alternative must not be optional: {pattern}")


@lru_cache(maxsize=None)
def entry_regex(entry: Entry) -> str:
    check_entry(entry)
    return to_java(entry.pattern, entry.ignore_case)


# Gaps between the words that open a match and those that close it, as written
# in the patterns, and the class of characters each may hold.
_GAPS = {".*": ANY_CHAR, "[^.!?]*": "[^.!?]"}


def alternatives(pattern: str) -> list[str]:
    """The pattern cut at its outermost bars."""
    out, depth, in_class = [""], 0, False
    for at, char in enumerate(pattern):
        escaped = pattern[at - 1:at] == "\\"
        if not escaped:
            in_class = char == "[" or (in_class and char != "]")
            depth += (char == "(") - (char == ")") if not in_class else 0
            if char == "|" and not depth and not in_class:
                out.append("")
                continue
        out[-1] += char
    return out


def opener_and_gap(alternative: str) -> tuple[str, str] | None:
    """What stands before the gap of a pattern without outer bars, and the gap's class."""
    for gap, allowed in _GAPS.items():
        opener, found, _ = alternative.partition(gap)
        if found:
            if opener.count("(") != opener.count(")"):
                raise ValueError(f"a gap inside a group: {alternative}")
            return opener, allowed
    return None


def before_match(entry: Entry) -> str:
    """A pattern whose group 1 is everything before the leftmost match.

    It walks over the text with possessive steps, which neither back up nor use
    the stack.  An opener whose gap reaches no closer costs a look over the gap;
    no later opener in the same gap can do better, so the step then goes to the
    end of the gap, and a text is looked at a bounded number of times however
    often it repeats an opener.  The step stops early where something begins that
    does not depend on this gap: another alternative, or an opener that itself
    runs across the gap's end."""
    regex = entry_regex(entry)
    first = first_letters(entry.pattern)
    gapped = [(part, opener_and_gap(part)) for part in alternatives(entry.pattern)]
    if not any(found for _, found in gapped):
        return rf"(?s)\A(.*?){regex}"
    if not (first.isascii() and first.isalpha()):
        raise ValueError(f"a pattern with a gap must start with ASCII letters: {entry.pattern}")
    case = "(?i:" if entry.ignore_case else "(?:"
    others = [to_java(part, entry.ignore_case) for part, found in gapped if not found]
    skips = []
    for part, found in gapped:
        if not found:
            continue
        opener, allowed = found
        stops = list(others)
        if r"\s" in opener and allowed == ANY_CHAR:
            # With the white space that may stand in the opener holding the end of the gap.
            across = re.sub(r"\(\\s\+([^()]*)\)\?", lambda m: rf"(\s*[\n\r\u2028\u2029]\s*{m[1]})", opener)
            stops.append(to_java(across, entry.ignore_case))
        guard = f"(?!{'|'.join(stops)})" if stops else ""
        skips.append(f"(?={to_java(opener, entry.ignore_case)}){allowed}(?:{guard}{allowed})*+")
    step = "|".join([f"{case}[^{first}]++)", f"(?!{regex})(?:{'|'.join(skips)}|(?s:.))"])
    return rf"\A((?:{step})*+)(?={regex})"


def match_after_one(regex: str) -> str:
    """A pattern whose group 1 is the match right after the first character."""
    return rf"\A(?s:.)({regex})"
