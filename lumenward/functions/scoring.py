"""Confidence arithmetic on doubles."""

from __future__ import annotations

from lumenward.functions.lexicon import STRANGER_CATEGORIES
from lumenward.functions.text import quoted_list, round2

# Thresholds and modifiers.
MIN_CONFIDENCE = 0.45
UNSURE_BELOW = 0.5
IMMEDIATE_FROM = 0.70
MAX_CONFIDENCE = 0.99
STRANGER_BOOST = 0.2
CONTACT_FACTOR = 0.9


def noisy_or(weights: str) -> str:
    """``1 - (1-w1)(1-w2)...`` folded in array order, so that the double result
    does not depend on how rows were grouped."""
    return f"(1D - aggregate({weights}, 1D, (rest, w) -> rest * (1D - w)))"


def sender_adjusted(confidence: str, category: str, relationship: str) -> str:
    """Raise a stranger-driven risk for strangers and lower it for contacts."""
    applies = f"{category} IN ({quoted_list(STRANGER_CATEGORIES)})"
    return (
        f"CASE WHEN {applies} AND {relationship} = 'not-mutual'"
        f" THEN 1D - (1D - {confidence}) * (1D - {STRANGER_BOOST}D)"
        f" WHEN {applies} AND {relationship} = 'mutual' THEN {confidence} * {CONTACT_FACTOR}D"
        f" ELSE {confidence} END")


def final_confidence(confidence: str) -> str:
    return f"least({MAX_CONFIDENCE}D, {round2(confidence)})"


def is_unsure(language_confidence: str) -> str:
    return f"({language_confidence} < {UNSURE_BELOW}D)"


def is_immediate(confidence: str) -> str:
    return f"({confidence} >= {IMMEDIATE_FROM}D)"


def tier(confidence: str) -> str:
    return f"if({is_immediate(confidence)}, 'immediate', 'review')"
