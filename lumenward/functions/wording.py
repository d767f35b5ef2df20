"""Texts of alerts and digests."""

from __future__ import annotations

from lumenward.functions.scoring import tier
from lumenward.functions.text import lookup, quote, two_places

# Suggested next step by category and tier.
ACTIONS = (
    ("grooming", "immediate", "This may need immediate attention. Review the conversation now and consider locking the app. If the contact is an unknown adult, preserve the messages and report to the platform and the NCMEC CyberTipline (report.cybertip.org)."),
    ("grooming", "review", "Borderline grooming signals. Review this conversation soon — watch for secrecy requests or pushes to move to another app."),
    ("sexual-solicitation", "immediate", "This may need immediate attention. Review the conversation, consider locking the app, and preserve the messages. Requests for images from a minor can be reported to the platform and NCMEC."),
    ("sexual-solicitation", "review", "Possible sexual content. Review the conversation with your child."),
    ("self-harm", "immediate", "This may need immediate attention. Talk with your child now and stay with them. If you believe they are in danger, contact a crisis line (in the US, call or text 988) or local emergency services."),
    ("self-harm", "review", "Your child's message shows possible distress. Check in with them soon."),
    ("violent-threat", "immediate", "Review the conversation. If the threat seems credible or imminent, contact the platform and, if there is immediate danger, local authorities. Save the messages."),
    ("violent-threat", "review", "Possible threat language. Review the conversation."),
    ("harassment", "immediate", "Review the conversation with your child. Consider blocking the sender and reporting to the platform; save screenshots."),
    ("harassment", "review", "Possible bullying. Included for your review — check in with your child."),
)
DEFAULT_ACTION = "Review the conversation with your child."

# How the sender is described.
SENDERS = (
    ("not-mutual", "sender: not a mutual connection"),
    ("mutual", "sender: mutual connection"),
    ("unknown", "sender relationship unknown"),
)
UNKNOWN_SENDER = "sender relationship unknown"

# The parts of a digest.
DIGEST_EMPTY = " SUMMARY: no borderline items to review."
DIGEST_HEAD = (" SUMMARY — ", " borderline item(s) to review:")
DIGEST_FOOT = "  No immediate action needed. Review these when you can."


def suggested_action(finding: str) -> str:
    key = f"concat({finding}.category, '|', {tier(f'{finding}.confidence')})"
    actions = [(f"{category}|{level}", text) for category, level, text in ACTIONS]
    return f"coalesce({lookup(actions, key)}, {quote(DEFAULT_ACTION)})"


def context_line(finding: str) -> str:
    sender = f"coalesce({lookup(SENDERS, f'{finding}.senderRelationship')}, {quote(UNKNOWN_SENDER)})"
    return f"""concat('"', {finding}.excerpt, '" · ', {sender})"""


def alert_text(finding: str) -> str:
    confidence = two_places(f"{finding}.confidence")
    return (
        f"concat('DETECTED: ', {finding}.category, ' | ', {finding}.language, ' | ', {confidence},"
        f" '\\nCONTEXT: ', {context_line(finding)},"
        f" '\\nSUGGESTED ACTION: ', {suggested_action(finding)})")


def digest_item(finding: str, number: str) -> str:
    return (
        f"concat('  ', {number}, '. ', {finding}.label, ' (', {finding}.language, ', ',"
        f" {two_places(f'{finding}.confidence')}, ') — ', {context_line(finding)})")


def digest_heading(period: str, items: str) -> str:
    """First line of a digest; the only one where there are no items."""
    name = period.upper()
    before, after = DIGEST_HEAD
    return f"if({items} = 0, {quote(name + DIGEST_EMPTY)}, concat({quote(name + before)}, {items}, {quote(after)}))"
