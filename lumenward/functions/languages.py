"""Language tables: scripts, function words and display names."""

from __future__ import annotations

import re

from lumenward.functions.text import lookup, quote, quoted_list, round2

# A character of a script decides the language; first one wins.
SCRIPTS = (
    ("ar", "Arabic", 0x0600, 0x06FF),
    ("ru", "Russian", 0x0400, 0x04FF),
    ("hi", "Hindi", 0x0900, 0x097F),
    ("zh", "Chinese", 0x4E00, 0x9FFF),
    ("ko", "Korean", 0xAC00, 0xD7AF),
    ("ja", "Japanese", 0x3040, 0x30FF),
    ("he", "Hebrew", 0x0590, 0x05FF),
    ("th", "Thai", 0x0E00, 0x0E7F),
    ("el", "Greek", 0x0370, 0x03FF),
)

# Function words by language; on equal counts the first wins.
STOPWORDS = {
    "en": ("the", "and", "you", "to", "is", "of", "in", "that", "it", "for", "are", "your", "on", "do"),
    "es": ("que", "de", "la", "el", "no", "en", "y", "los", "se", "un", "por", "con", "tu", "para", "eres"),
    "fr": ("le", "la", "les", "et", "de", "un", "une", "je", "tu", "ne", "pas", "est", "que", "on", "chez", "toi",
           "moi", "avec", "vous", "ça", "où", "ton", "ta", "suis"),
    "pt": ("que", "de", "não", "o", "a", "e", "um", "uma", "você", "com", "para", "os", "eu", "tá"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "du", "ich", "ein", "eine", "zu", "mit", "wie", "bist"),
    "it": ("che", "di", "il", "la", "e", "non", "un", "per", "con", "sono", "ti", "sei", "ho"),
}

# Display names.
NAMES = (
    ("en", "English"), ("es", "Spanish"), ("fr", "French"), ("pt", "Portuguese"),
    ("de", "German"), ("it", "Italian"), ("und", "Undetermined"),
)
UNDETERMINED = "und"
DEFAULT_LANGUAGE = "en"

# Confidences and detector names.
SCRIPT_CONFIDENCE = 0.95
DEFAULT_CONFIDENCE = 0.3
LOCAL_DETECTOR = "local"
LOCAL_SOURCE = "local-heuristic"
REMOTE_DETECTOR = "aws-comprehend"

# Words of one letter are too ambiguous to count.
COUNTED_WORDS = {lang: [w for w in words if len(w) > 1] for lang, words in STOPWORDS.items()}
ALL_COUNTED_WORDS = sorted({w for words in COUNTED_WORDS.values() for w in words})

TOKEN = r"[\p{L}']+"
_BETWEEN_TOKENS = r"[^\p{L}']+"
# No script starts before the first or lies between the two spans, while
# accented Latin letters and typographic punctuation do.
_MAYBE_SCRIPT = f"[{chr(0x0370)}-{chr(0x1FFF)}{chr(0x3040)}-{chr(0xD7FF)}]"


def language_name(code: str) -> str:
    return f"coalesce({lookup(NAMES, code)}, {code})"


def maybe_script(text: str) -> str:
    """False where the text can have no character of any script listed."""
    return f"(octet_length({text}) <> length({text}) AND {text} RLIKE '{_MAYBE_SCRIPT}')"


def in_scripts(parts) -> bool:
    """Whether each part holds a character that :func:`maybe_script` sees."""
    return all(re.search(_MAYBE_SCRIPT, part) for part in parts)


def script_language(text: str) -> str:
    """Language code by script, null for Latin text."""
    ordered = " ".join(
        f"WHEN {text} RLIKE '[{chr(low)}-{chr(high)}]' THEN '{code}'" for code, _, low, high in SCRIPTS)
    return f"if({maybe_script(text)}, CASE {ordered} END, NULL)"


def words_of(lowered: str) -> str:
    """Runs of letters and apostrophes; splitting is cheaper than extracting."""
    return f"array_remove(split({lowered}, {quote(_BETWEEN_TOKENS)}), '')"


def listed_words(words: str) -> str:
    """The words that are a function word of some language."""
    return f"filter({words}, w -> w IN ({quoted_list(ALL_COUNTED_WORDS)}))"


def stopword_counts(words: str) -> str:
    """A struct of the number of function words per language."""
    counts = ", ".join(
        f"size(filter({words}, w -> w IN ({quoted_list(listed)}))) AS {lang}"
        for lang, listed in COUNTED_WORDS.items())
    return f"struct({counts})"


def stopword_confidence(best: str, total: str, n_words: str) -> str:
    share = f"{best} / nullif({n_words}, 0) * 2D"
    agreement = f"{best} / greatest({total}, 1) * 0.2D"
    return round2(f"least(0.95D, 0.4D + {share} + {agreement})")
