"""What a text must hold for a pattern to match at all, read off the pattern's syntax tree.

A pattern is parsed into sequences, alternatives and repetitions.  From the tree come
*words*: of each way a match can be spelled, one whole run of ASCII word characters
that it holds, delimited inside the match or by a boundary.  A text that has none of
them can't match.  Where there are none, as in scripts that have no such runs, it
gives *parts*: strings one of which a match holds.  Where there are neither, the
pattern has to be tried on every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from lumenward.functions.languages import ALL_COUNTED_WORDS

#: Spellings of a stretch of a pattern that are looked at; a longer stretch is cut.
MOST_SPELLINGS = 256
#: Stands for white space of any kind in a spelling: no word, and nothing to look for.
_BLANK = "\0"
_COMMON = frozenset(ALL_COUNTED_WORDS)


class Node(NamedTuple):
    """``kind`` is chars (a string of which one stands there), any, blank, edge, seq, alt or repeat."""
    kind: str
    parts: tuple = ()
    chars: str = ""
    least: int = 1
    most: int | None = 1


class _Parser:
    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def peek(self) -> str:
        return self.pattern[self.at:self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.pattern[self.at - 1:self.at]

    def alternatives(self) -> Node:
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else Node("alt", tuple(found))

    def sequence(self) -> Node:
        found = []
        while self.peek() not in ("", "|", ")"):
            found.append(self.repeated(self.single()))
        return Node("seq", tuple(found))

    def single(self) -> Node:
        char = self.take()
        if char == "(":
            if self.peek() == "?":
                if self.pattern[self.at:self.at + 2] != "?:":
                    raise ValueError(f"a group of a kind that is not known: {self.pattern}")
                self.at += 2
            inside = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"a group without end: {self.pattern}")
            return inside
        if char == "[":
            return self.chosen()
        if char == ".":
            return Node("any")
        if char == "\\":
            char = self.take()
            if char == "b":
                return Node("edge")
            if char == "s":
                return Node("blank")
            if char.isalnum() or not char:
                raise ValueError(f"an escape that is not known: {self.pattern}")
        elif char in "*+?{^$":
            raise ValueError(f"{char} where something else should be: {self.pattern}")
        return Node("chars", chars=char)

    def chosen(self) -> Node:
        chars, negated = [], self.peek() == "^"
        while self.peek() != "]" or not chars:
            char = self.take()
            if not char or char == "\\":
                raise ValueError(f"a class that is not known: {self.pattern}")
            if self.peek() == "-" and self.pattern[self.at + 1:self.at + 2] not in ("]", ""):
                self.take()
                chars += map(chr, range(ord(char), ord(self.take()) + 1))
            else:
                chars.append(char)
        self.take()
        return Node("any") if negated else Node("chars", chars="".join(chars))

    def repeated(self, node: Node) -> Node:
        char = self.peek()
        if char in ("?", "*", "+"):
            self.take()
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[char]
            if self.peek() in ("?", "+"):
                raise ValueError(f"a repetition of a kind that is not known: {self.pattern}")
            return Node("repeat", (node,), least=least, most=most)
        if char == "{":
            raise ValueError(f"a repetition of a kind that is not known: {self.pattern}")
        return node


def parsed(pattern: str) -> Node:
    """The syntax tree; a pattern with anything but what the dialect rewrites is refused."""
    parser = _Parser(pattern)
    tree = parser.alternatives()
    if parser.at != len(pattern):
        raise ValueError(f"a bracket too many: {pattern}")
    return tree


def spellings(node: Node) -> list[str] | None:
    """All strings the node matches, None if there are too many; an edge is nothing, white space a mark."""
    if node.kind == "chars":
        return list(dict.fromkeys(node.chars.lower()))
    if node.kind == "blank":
        return [_BLANK]
    if node.kind == "edge":
        return [""]
    if node.kind == "any":
        return None
    if node.kind == "repeat":
        inside = spellings(node.parts[0])
        if inside is None or (node.most is None and inside != [_BLANK]):
            return None
        return inside if node.least else ["", *inside]
    lists = [spellings(part) for part in node.parts]
    if any(found is None for found in lists):
        return None
    if node.kind == "alt":
        out = [s for found in lists for s in found]
    else:
        out = [""]
        for found in lists:
            out = [a + b for a in out for b in found]
            if len(out) > MOST_SPELLINGS:
                return None
    return out if len(out) <= MOST_SPELLINGS else None


def _is_word(char: str) -> bool:
    return char.isascii() and (char.isalnum() or char == "_")


def _ends(nodes, last: bool) -> set[str]:
    """What can stand at the end, or the beginning, of a sequence: word, other, edge, or nothing at all."""
    found: set[str] = set()
    for node in (reversed(nodes) if last else nodes):
        own = _end(node, last)
        found |= own - {"nothing"}
        if "nothing" not in own:
            return found
    return found | {"nothing"}


def _end(node: Node, last: bool) -> set[str]:
    if node.kind == "chars":
        return {"word" if _is_word(c) else "other" for c in node.chars}
    if node.kind in ("blank", "edge"):
        return {"other"}
    if node.kind == "any":
        return {"word", "other"}
    if node.kind == "repeat":
        return _end(node.parts[0], last) | (set() if node.least else {"nothing"})
    if node.kind == "alt":
        return set().union(*(_end(part, last) for part in node.parts))
    return _ends(node.parts, last)


def _score(cover) -> tuple:
    """Rare words are better: no function words, none that are short, few of them."""
    return (min((w not in _COMMON, min(len(w), 5)) for w in cover), -len(cover))


def _runs(spelling: str, left: bool, right: bool) -> Iterator[str]:
    """The whole runs of word characters; those at an end count if that end is delimited."""
    at = 0
    while at < len(spelling):
        end = at
        while end < len(spelling) and _is_word(spelling[end]):
            end += 1
        if end > at and (at > 0 or left) and (end < len(spelling) or right):
            yield spelling[at:end]
        at = end + 1


def _delimited(nodes, last: bool, context: bool) -> bool:
    found = _ends(nodes, last)
    return "word" not in found and ("nothing" not in found or context)


def _stretches(node: Node) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of neighbours in a sequence with their spellings, as long as there are not too many."""
    for first in range(len(node.parts)):
        found = [""]
        for last in range(first, len(node.parts)):
            own = spellings(node.parts[last])
            if own is None or len(found) * len(own) > MOST_SPELLINGS:
                break
            found = [a + b for a in found for b in own]
            yield first, last + 1, found


def words(node: Node, left: bool = False, right: bool = False) -> frozenset[str] | None:
    """Whole words one of which every match holds, if ``left`` and ``right`` of it there is no word character."""
    if node.kind == "alt":
        covers = [words(part, left, right) for part in node.parts]
        return None if any(c is None for c in covers) else frozenset().union(*covers)
    if node.kind != "seq":
        return words(Node("seq", (node,)), left, right) if node.kind == "chars" else None
    covers = []
    for first, end, found in _stretches(node):
        before = _delimited(node.parts[:first], True, left)
        after = _delimited(node.parts[end:], False, right)
        best = [max(_runs(s, before, after), key=lambda w: (w not in _COMMON, len(w)), default=None) for s in found]
        if None not in best:
            covers.append(frozenset(best))
    for i, part in enumerate(node.parts):
        if part.kind in ("alt", "seq"):
            own = words(part, _delimited(node.parts[:i], True, left), _delimited(node.parts[i + 1:], False, right))
            if own is not None:
                covers.append(own)
    return max(covers, key=_score, default=None)


def parts(node: Node) -> frozenset[str] | None:
    """Strings in lower case one of which every match holds."""
    if node.kind == "alt":
        covers = [parts(part) for part in node.parts]
        return None if any(c is None for c in covers) else frozenset().union(*covers)
    if node.kind != "seq":
        return parts(Node("seq", (node,))) if node.kind == "chars" else None
    covers = []
    for _, _, found in _stretches(node):
        best = [max(s.split(_BLANK), key=len) for s in found]
        if all(best):
            covers.append(frozenset(best))
    covers += [own for part in node.parts if part.kind in ("alt", "seq") and (own := parts(part)) is not None]
    return max(covers, key=lambda c: (min(map(len, c)), -len(c)), default=None)


def _folds_plainly(part: str) -> bool:
    """Whether the part is found in every lower-cased text that holds it in any case."""
    return all(c.lower() == c and len(c.upper()) == 1 and c.upper().lower() == c for c in part)


def triggers(pattern: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The words, or else the parts, to look for; both empty if the pattern has to be tried always."""
    tree = parsed(pattern)
    found = words(tree)
    if found:
        return tuple(sorted(found)), ()
    other = parts(tree)
    if not other or not all(map(_folds_plainly, other)):
        return (), ()
    return (), tuple(sorted(other))
