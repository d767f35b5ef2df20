"""From hits to scored, redacted findings: one array per message, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenward.functions.languages import language_name
from lumenward.functions.lexicon import ALWAYS_LANGUAGE, ANY_LANGUAGE, CATEGORIES
from lumenward.functions.redaction import redact_excerpt
from lumenward.functions.scoring import MIN_CONFIDENCE, final_confidence, is_unsure, noisy_or, sender_adjusted
from lumenward.functions.text import empty_array, quote, quoted_list
from lumenward.operators.pinning import with_columns
from lumenward.schema import FINDING_TYPE, LANGUAGE_COLUMNS

_FINDINGS_TYPE = f"array<{FINDING_TYPE}>"


def category_buckets(hits: str) -> str:
    """Hits gathered by category, categories in their fixed order.

    Each bucket holds the weights in lexicon order, the distinct signals, the
    earliest span (of two at one place the earlier entry's) and the first
    language that tells more than English does."""
    categories = ", ".join(
        f"named_struct('place', {i}, 'category', {quote(code)}, 'label', {quote(label)})"
        for i, (code, label) in enumerate(CATEGORIES))
    grouped = (
        f"transform(array({categories}), c -> struct(c.place AS place, c.category AS category,"
        f" c.label AS label, filter({hits}, h -> h.category = c.category) AS own))")
    common = quoted_list((ANY_LANGUAGE, ALWAYS_LANGUAGE))
    return f"""transform(filter({grouped}, g -> size(g.own) > 0), g -> struct(
        g.place AS place, g.category AS category, g.label AS label,
        transform(g.own, h -> h.weight) AS weights,
        array_distinct(filter(transform(g.own, h -> h.signal), s -> s IS NOT NULL)) AS signals,
        array_min(transform(g.own, h -> struct(h.start AS start, h.ord AS ord, h.end AS end))) AS first,
        get(filter(transform(g.own, h -> h.lang), l -> l NOT IN ({common})), 0) AS hint))"""


def with_buckets(matched: DataFrame) -> DataFrame:
    """Add ``buckets``: the hits of a message gathered by category."""
    return with_columns(matched, {"buckets": category_buckets("hits")})


def scored_buckets(buckets: str) -> str:
    """Buckets with their confidence and language, weak ones left out."""
    confidence = final_confidence(sender_adjusted(noisy_or("b.weights"), "b.category", "senderRelationship"))
    reported = f"if({is_unsure('languageConfidence')}, coalesce(b.hint, language), language)"
    scored = (
        f"transform({buckets}, b -> struct({confidence} AS confidence, {reported} AS language, b AS bucket))")
    return f"filter({scored}, s -> s.confidence >= {MIN_CONFIDENCE}D)"


def ranked_findings(hits: str) -> str:
    """Findings of a message, best first, equal ones in category order."""
    order = "struct(-s.confidence AS falling, s.bucket.place AS place, s AS scored)"
    ranked = f"array_sort(transform({scored_buckets(category_buckets(hits))}, s -> {order}))"
    return f"""transform({ranked}, r -> struct(
        r.scored.bucket.category AS category, r.scored.bucket.label AS label,
        r.scored.confidence AS confidence, r.scored.language AS language,
        {language_name('r.scored.language')} AS languageName,
        {redact_excerpt('text', 'r.scored.bucket.first.start', 'r.scored.bucket.first.end')} AS excerpt,
        r.scored.bucket.signals AS signals, senderRelationship, direction))"""


def with_findings(matched: DataFrame) -> DataFrame:
    """Replace ``hits`` by ``findings``; rows without hits cost nothing."""
    return with_columns(matched, {
        **{c: c for c in LANGUAGE_COLUMNS},
        "findings": f"if(size(hits) = 0, {empty_array(_FINDINGS_TYPE)},"
                    f" cast({ranked_findings('hits')} AS {_FINDINGS_TYPE}))",
    }).drop("hits")


def exploded_findings(messages: DataFrame, column: str = "findings") -> DataFrame:
    """One row per finding, ``rank`` counting from 1 within its message."""
    others = [f"`{c}`" for c in messages.columns if c != column]
    return messages.selectExpr(*others, f"posexplode({column}) AS (_place, finding)").selectExpr(
        *others, "_place + 1 AS rank", "finding")
