"""Masked excerpts: short context around a trigger, never the trigger."""

from __future__ import annotations

from lumenward.functions.text import collapse_spaces, let

# The mask, the context kept on each side, the overall length.
MASK = "▇▇▇"
CONTEXT_CHARS = 22
MAX_CHARS = 70
CUT = "…"


def _part(text: str, start: str, end: str) -> str:
    """Characters ``[start, end)`` with runs of white space made one space."""
    return collapse_spaces(f"substring({text}, {start} + 1, {end} - {start})")


def redact_excerpt(text: str, start: str, end: str,
                   context: int = CONTEXT_CHARS, max_chars: int = MAX_CHARS) -> str:
    first, last = f"greatest(0, {start} - {context})", f"least(length({text}), {end} + {context})"
    # The parts hold no white space but plain spaces, so trim() is enough.
    around = (
        f"trim(concat(if({first} > 0, '{CUT}', ''), {_part(text, first, start)}, '{MASK}',"
        f" {_part(text, end, last)}, if({last} < length({text}), '{CUT}', '')))")
    capped = let("excerpt", around, (
        f"if(length(excerpt) > {max_chars},"
        f" concat(rtrim(substring(excerpt, 1, {max_chars - 1})), '{CUT}'), excerpt)"))
    masked_head = let("head", f"trim({_part(text, '0', str(context))})",
                      f"if(head = '', '{MASK}', concat(head, ' {MASK}'))")
    valid = f"{start} >= 0 AND {end} <= length({text}) AND {start} < {end}"
    return f"CASE WHEN {valid} THEN {capped} ELSE {masked_head} END"
