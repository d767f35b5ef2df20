"""Matching the lexicon, in two narrow steps.

1. *Candidates*: one bit per lexicon entry, set where the entry applies to the
   message and the text holds a word the pattern cannot do without.  The text is
   split once, and one lookup per word finds the few that matter.
2. *Hits*: the regexes of the set bits only, with the span of the first match.

Nothing is shuffled and the lexicon is part of the plan, not a joined table.  A
lexicon of more entries than a bit set holds is worked off in groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenward.functions.dialect import before_match, entry_regex, match_after_one
from lumenward.functions.languages import in_scripts, maybe_script
from lumenward.functions.lexicon import ALWAYS_LANGUAGE, ANY_LANGUAGE, ENTRIES, OUTGOING_ONLY_CATEGORY, Entry
from lumenward.functions.scoring import is_unsure
from lumenward.functions.text import empty_array, let, quote, quoted_list
from lumenward.operators.pinning import with_columns
from lumenward.schema import HIT_TYPE, LANGUAGE_COLUMNS

NON_WORD = r"\W+"
#: Entries to a bit set.
GROUP = 62
_EVERYWHERE = (ANY_LANGUAGE, ALWAYS_LANGUAGE)
_TRIGGERED = "_triggered"
_HITS_TYPE = f"array<{HIT_TYPE}>"


def _mask(entries) -> str:
    return f"{sum(1 << e.ord % GROUP for e in entries)}L"


def _groups(entries) -> list:
    return [entries[at:at + GROUP] for at in range(0, len(entries), GROUP)]


def _triggered_name(group: int) -> str:
    return f"{_TRIGGERED}_{group}" if group else _TRIGGERED


def trigger_words(text: str, entries=ENTRIES) -> str:
    """The words of the text that some entry needs, as runs of ASCII word
    characters in lower case.

    The two replaced characters are the only others with an ASCII letter as
    their lower case, which the patterns do not take them for."""
    needed = sorted({word for entry in entries for word in entry.words.split()})
    no_lookalikes = f"replace(replace({text}, '{chr(0x212A)}', ' '), '{chr(0x130)}', ' ')"
    words = f"split(lower({no_lookalikes}), {quote(NON_WORD)})"
    return f"filter({words}, w -> w IN ({quoted_list(needed)}))"


def triggered_bits(text: str, has_script: str, entries=ENTRIES) -> str:
    """Bit set of the entries whose words or parts the text holds, and of those that have neither.

    ``has_script`` is false only for text without characters of any script that
    the parts are written in; parts of other characters are looked for everywhere."""
    by_word: dict[str, list[Entry]] = {}
    for entry in entries:
        for word in entry.words.split():
            by_word.setdefault(word, []).append(entry)
    bits = ", ".join(f"{quote(word)}, {_mask(own)}" for word, own in sorted(by_word.items()))
    found = [_mask(e for e in entries if not e.words and not e.parts)]
    if by_word:
        found.append(f"aggregate({trigger_words(text, entries)}, 0L, (bits, w) -> bits | element_at(map({bits}), w))")
    for own, wrap in (([e for e in entries if e.parts and in_scripts(e.parts)], f"if({has_script}, %s, 0L)"),
                      ([e for e in entries if e.parts and not in_scripts(e.parts)], "%s")):
        if own:
            by_parts = " | ".join(
                f"if({' OR '.join(f'contains(lowered, {quote(part)})' for part in e.parts)}, {_mask([e])}, 0L)" for e in own)
            found.append(wrap.replace("%s", let("lowered", f"lower({text})", by_parts)))
    return f"({' | '.join(found)})"


def applicable_bits(direction: str, language: str | None, confidence: str | None, entries=ENTRIES) -> str:
    """Bit set of the entries that apply to a message; with no language given,
    to a message of any language."""
    everywhere = _mask(e for e in entries if e.lang in _EVERYWHERE)
    by_language = _mask(entries)
    if language is not None:
        languages = sorted({e.lang for e in entries} - set(_EVERYWHERE))
        cases = " ".join(f"WHEN {quote(lang)} THEN {_mask(e for e in entries if e.lang == lang)}" for lang in languages)
        own = f"CASE {language} {cases} ELSE 0L END" if cases else "0L"
        by_language = f"if({is_unsure(confidence)}, {by_language}, {everywhere} | {own})"
    incoming = _mask(e for e in entries if e.category != OUTGOING_ONLY_CATEGORY)
    return f"({by_language} & if({direction} = 'outgoing', {_mask(entries)}, {incoming}))"


def first_match(entry: Entry, text: str) -> str:
    """The entry's leftmost match as a struct, null where it does not match.

    One pass over the text finds the start.  Without a match it finds 0, as it
    does for a match at the very start; matching there tells which, and gives
    the length.  The character before the start goes along for the boundary."""
    regex = entry_regex(entry)
    start = f"length(regexp_extract({text}, {quote(before_match(entry))}, 1))"
    rest = f"concat(if(start > 0, substring({text}, start, 1), ' '), substring({text}, start + 1))"
    length = f"length(regexp_extract({rest}, {quote(match_after_one(regex))}, 1))"
    signal = quote(entry.signal) if entry.signal else "cast(NULL AS string)"
    hit = (
        f"named_struct('ord', {entry.ord}, 'category', {quote(entry.category)}, 'signal', {signal},"
        f" 'lang', {quote(entry.lang)}, 'weight', {entry.weight}D, 'start', start, 'end', start + chars)")
    return let("start", start, let("chars", length, f"if(chars > 0, {hit}, NULL)"))


def triggered_messages(messages: DataFrame, entries=ENTRIES) -> DataFrame:
    """Only the messages that some entry might match, in any language.

    Where nothing but findings is wanted, the other messages, which are nearly
    all, then need no language.  The bits are kept for :func:`with_hits`."""
    bits = {_triggered_name(i): triggered_bits("text", maybe_script("text"), own) for i, own in enumerate(_groups(entries))}
    return with_columns(messages, bits).where(" OR ".join(f"{name} <> 0" for name in bits) or "false")


def with_hits(messages: DataFrame, any_language: bool = False, pinned: bool = True, entries=ENTRIES) -> DataFrame:
    """Add ``hits``, in lexicon order.

    Entries are chosen by the message's language, unless ``any_language`` asks
    for all of them, to be narrowed by :func:`gated_hits` once it is known."""
    chosen = (None, None) if any_language else ("language", "languageConfidence")
    groups = _groups(entries)
    bits, tried = [], []
    for i, own in enumerate(groups):
        name = _triggered_name(i)
        if name in messages.columns:
            triggered = name
        else:
            # Such a character decides the local language, so the language tells, as far as it has one of that script.
            scripts = quoted_list(sorted({e.lang for e in own if e.parts}))
            by_language = entries is ENTRIES and not any_language
            triggered = triggered_bits("text", f"language IN ({scripts})" if by_language else maybe_script("text"), own)
        bits.append(f"{triggered} & {applicable_bits('direction', *chosen, own)} AS _bits{i}")
        tried += [f"if(_bits{i} & {1 << e.ord % GROUP}L <> 0, {first_match(e, 'text')}, NULL)" for e in own]
    matched = messages.selectExpr("*", *bits)
    seen = {} if any_language else {c: c for c in LANGUAGE_COLUMNS}
    none = empty_array(_HITS_TYPE)
    nothing = " AND ".join(f"_bits{i} = 0" for i in range(len(groups))) or "true"
    found = f"cast(filter(array({', '.join(tried)}), h -> h IS NOT NULL) AS {_HITS_TYPE})" if tried else none
    return with_columns(matched, {**seen, "hits": f"if({nothing}, {none}, {found})"}, pinned).drop(
        *[f"_bits{i}" for i in range(len(groups))], *[_triggered_name(i) for i in range(len(groups))])


def gated_hits(hits: str, language: str, confidence: str) -> str:
    """The hits whose entries apply to the language."""
    everywhere = quoted_list(_EVERYWHERE)
    return (f"if({is_unsure(confidence)}, {hits},"
            f" filter({hits}, h -> h.lang IN ({everywhere}) OR h.lang = {language}))")
