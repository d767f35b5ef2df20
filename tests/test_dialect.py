"""The rewritten patterns and the words that decide whether they run."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lumenward.functions.dialect import (
    alternatives, before_match, entry_regex, first_letters, opener_and_gap, to_java,
)
from lumenward.functions.lexicon import ENTRIES
from lumenward.functions.text import quote
from lumenward.operators.findings import exploded_findings
from lumenward.operators.matching import first_match, with_hits
from lumenward.operators.normalize import normalize_messages
from lumenward.plans.messages import classify_messages, find_risks

LATIN = [e for e in ENTRIES if e.words]


def python_pattern(entry) -> str:
    """The pattern for Python's re, with the boundary in its general ASCII form.

    The group structure is left alone; only what differs is spelled out."""
    boundary = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
    blank = "[\\t\\n\\x0b\\x0c\\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
    pattern = entry.pattern.replace(".*", "[^\\n\\r\u2028\u2029]*")
    return pattern.replace(r"\b", boundary).replace(r"\s", blank)


COMPILED = {e.ord: re.compile(python_pattern(e), re.I if e.ignore_case else 0) for e in ENTRIES}


def expected_hits(text: str):
    spans = ((e.ord, COMPILED[e.ord].search(text)) for e in ENTRIES)
    return [(o, m.start(), m.end()) for o, m in spans if m]


@pytest.mark.parametrize("entry", ENTRIES, ids=lambda e: str(e.ord))
@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.data())
def test_matches_hold_a_needed_word(entry, data):
    plain = re.compile(entry.pattern.replace(r"\b", ""))
    match = data.draw(st.from_regex(plain, fullmatch=True, alphabet=st.characters(codec="cp1252")
                                    if entry.words else st.characters()))
    text = data.draw(st.sampled_from(["", "é", "x ", "ñ'", "- "])) + match + data.draw(
        st.sampled_from(["", " é", "à", "!", "'s"]))
    text = "".join(data.draw(st.sampled_from([c, c.upper()])) if c.isascii() else c for c in text)
    found = COMPILED[entry.ord].search(text)
    if not found:
        return
    if entry.words:
        assert set(entry.words.split()) & set(re.findall(r"\w+", text.lower(), re.ASCII))
        assert found.group()[0].lower() in first_letters(entry.pattern)
    else:
        assert any(part in text.lower() for part in entry.parts)


def test_groups_after_an_opening_boundary_start_with_letters():
    for entry in LATIN:
        for at in (m.end() for m in re.finditer(r"\\b(?=[(\w])", entry.pattern)):
            assert re.fullmatch("[a-z]+", first_letters(entry.pattern[at:])), entry


def matches(spark, pattern, text, ignore_case=True):
    return spark.sql(f"SELECT {quote(text)} RLIKE {quote(to_java(pattern, ignore_case))} AS v").first().v


@pytest.mark.parametrize("pattern, text, expected", [
    (r"\b(voc[eê])\b", "você,", False),       # the boundary is ASCII
    (r"\b(voc[eê])\b", "vocêx", True),
    (r"\b(loser)\b", "éloser", True),
    (r"\b(m[aá]nd)", "MÁND", True),            # accented letters fold
    (r"\b(kis)", "ſkis", True),
    (r"\b(kis)", "kiſ", False),                # but never to ASCII ones
    (r"\b(kis)", "\u212ais", False),
    (r"\b(it)", "İt", False),
    (r"\b(it)", "ıt", False),
    (r"\b(a)\s+(b)\b", "a\u00a0\u2003b", True),
    (r"\b(a).*(b)\b", "a\u0085b", True),
    (r"\b(a).*(b)\b", "a\u2028b", False),
    (r"\b(a).*(b)\b", "a\nb", False),
    (r"\b(a)[^.!?]*(b)\b", "a\nb", True),
    (r"привет", "ПРИВЕТ", True),
])
def test_dialect(spark, pattern, text, expected):
    assert matches(spark, pattern, text) is expected


def test_case_is_kept_where_the_pattern_keeps_it(spark):
    assert not matches(spark, "ab", "AB", ignore_case=False)


def random_texts(n):
    """Texts of pattern fragments, so that near misses are frequent."""
    rng = random.Random(5)
    pieces = sorted({w for e in LATIN for w in re.findall(r"[a-zA-Zà-ÿ']+", e.pattern)})
    pieces += [w for e in ENTRIES if not e.words for w in re.findall(r"[^|?]+", e.pattern)]
    samples = []
    from workload.phrases import PHRASES
    for _ in range(n):
        words = [rng.choice(PHRASES if rng.random() < 0.3 else pieces) for _ in range(rng.randint(1, 12))]
        words = [rng.choice([w, w, w, w.upper(), w.capitalize()]) for w in words]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\n", ". ", "'", "é", "\u00a0", "-", "_", "😀", ""])
                       for w in words)
        if not re.search("[ſ\u212aıİ]", text):
            samples.append(text)
    return samples


def test_gated_matching_equals_trying_every_pattern(spark):
    texts = random_texts(3000)
    table = spark.createDataFrame(list(enumerate(texts)), "n int, text string").selectExpr(
        "*", "'outgoing' AS direction")
    got = {r.n: [(h.ord, h.start, h.end) for h in r.hits] for r in with_hits(table, any_language=True).collect()}
    for n, text in enumerate(texts):
        assert got[n] == expected_hits(text), text
    assert len({o for hits in got.values() for o, _, _ in hits}) > 45


def test_dropping_messages_early_loses_no_finding(spark):
    texts = random_texts(1000) + ["nothing here", ""]
    table = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    messages = normalize_messages(table.selectExpr("*", "if(id % 2 = 0, 'outgoing', 'incoming') AS direction",
                                                   "'2024-01-01T00:00:00Z' AS timestamp"))
    want = sorted(map(str, exploded_findings(classify_messages(messages)).collect()))
    got = find_risks(messages)
    assert sorted(map(str, got.select(*exploded_findings(classify_messages(messages)).columns).collect())) == want
    assert len(want) > 500


def _fragment_texts(entry, n, rng):
    """Texts of pieces of a gapped pattern, in and out of order."""
    pieces = {
        1: ["mándame", "manda", "enviame", "foto", "fotos", "desnuda", "fotografia"],
        2: ["envoie", "envoie-moi", "montre", "photo", "nues", "nu", "envoiemoi"],
        3: ["manda", "envie", "mostra", "foto", "pelada", "nu", "mandar"],
        4: ["schick", "zeig", "mir", "bild", "nackt", "schick mir", "zeig\n mir", "schick\nmir", "bilder"],
        8: ["never tell", "don't", "do not say it to", "mom", "parents", "parental", "never"],
        10: ["no le digas", "no cuentes", "nuestro secreto", "padres", "nadie", "no"],
        12: ["não conta", "nao fala", "nosso segredo", "mae", "ninguém", "não"],
        16: ["add me on", "let's talk on", "hop on", "snap", "kik", "snapchatty", "do you have"],
        17: ["pasa a", "hablamos por", "escribeme en", "snap", "whatsapp", "kik"],
    }[entry.ord]
    glue = [" ", " ", "\n", ". ", "x", " \n ", "!", " ", "  "]
    return ["".join(rng.choice(pieces + ["word"]) + rng.choice(glue) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


GAPPED = [e for e in ENTRIES if any(opener_and_gap(a) for a in alternatives(e.pattern))]


def test_stepping_over_gaps_finds_the_leftmost_match(spark):
    rng = random.Random(5)
    for entry in GAPPED:
        texts = [(t,) for t in _fragment_texts(entry, 1500, rng)]
        plain = quote(rf"(?s)\A(.*?){entry_regex(entry)}")
        df = spark.createDataFrame(texts, "text string").selectExpr(
            "text", f"regexp_extract(text, {plain}, 1) AS want", f"regexp_extract(text, {quote(before_match(entry))}, 1) AS got",
            f"text RLIKE {quote(entry_regex(entry))} AS matches")
        rows = df.collect()
        assert all(r.want == r.got for r in rows), entry
        assert 0 < sum(r.matches for r in rows) < len(rows)


def test_repeated_openers_take_linear_time(spark):
    """A text that repeats an opener without a closer; quadratic time would be minutes."""
    openers = {1: "envíame ", 2: "envoie ", 3: "manda ", 4: "zeig\nmir schick mir ", 8: "never tell ", 10: "no cuentes ",
               12: "não conta ", 16: "dm me on ", 17: "pasa a "}
    assert set(openers) == {e.ord for e in GAPPED}
    started = time.monotonic()
    for entry in GAPPED:
        text = openers[entry.ord] * 64_000
        hit = f"{first_match(entry, 'text')} AS hit"
        rows = spark.createDataFrame([(text,), (text + "\n. foto mom photos bild snap kik padres pais",)], "text string")
        assert [r.hit for r in rows.selectExpr(hit).collect()] == [None, None]
    assert time.monotonic() - started < 60


def test_gaps_must_be_outside_groups_and_start_with_letters():
    assert alternatives(r"a(b|c)[|]|d\|e") == [r"a(b|c)[|]", r"d\|e"]
    with pytest.raises(ValueError):
        opener_and_gap(r"(a.*b)c")
    with pytest.raises(ValueError):
        before_match(ENTRIES[1]._replace(pattern=r"á.*b"))
