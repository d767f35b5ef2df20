"""Lexicons from tables, and what is derived from their patterns."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lumenward.functions.lexicon import ENTRIES
from lumenward.functions.triggers import parsed, spellings, triggers
from lumenward.operators.matching import GROUP, with_hits
from lumenward.operators.normalize import normalize_messages
from lumenward.plans.job import parse_options, run
from lumenward.plans.messages import find_risks, process_messages
from lumenward.sources.lexicon import SCHEMA, lexicon_table, read_lexicon
from tests.sample import SAMPLE
from tests.test_dialect import COMPILED


@pytest.mark.parametrize("entry", ENTRIES, ids=lambda e: str(e.ord))
@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.data())
def test_every_match_holds_something_derived(entry, data):
    words, parts = triggers(entry.pattern)
    assert bool(words) == bool(entry.words) and bool(words) != bool(parts)
    plain = re.compile(entry.pattern.replace(r"\b", ""))
    match = data.draw(st.from_regex(plain, fullmatch=True, alphabet=st.characters(codec="cp1252") if words else st.characters()))
    text = data.draw(st.sampled_from(["", "é", "x ", "ñ'", "- "])) + match + data.draw(st.sampled_from(["", " é", "à", "!", "'s"]))
    text = "".join(data.draw(st.sampled_from([c, c.upper()])) if c.isascii() else c for c in text)
    if not COMPILED[entry.ord].search(text):
        return
    if words:
        assert set(words) & set(re.findall(r"\w+", text.lower(), re.ASCII))
    else:
        assert any(part in text.lower() for part in parts)


@pytest.mark.parametrize("pattern, words, parts", [
    (r"\b(kys|kill yourself)\b", ("kill", "kys"), ()), (r"kys", (), ("kys",)), (r"\bsend\s+me", ("send",), ()), (r"send\s+me\b", ("me",), ()),
    (r"\bdrugs?\b", ("drug", "drugs"), ()), (r"\b(foo|.*)\b", (), ()), (r"\bx(y|z w)\b", ("xy", "xz"), ()), (r"\bm[aá]tate\b", ("matate", "tate"), ()),
    (r"a.*b", (), ("a",)), (r"\b(a|b)?c\b", ("ac", "bc", "c"), ()), (r"нет", (), ("нет",)), (r"\b(i'?ll)\s+win\b", ("win",), ()),
    (r"(?:x|y)z", (), ("xz", "yz")), (r"ß", (), ()), (r"foo\s+", (), ("foo",))])
def test_derived(pattern, words, parts):
    got = triggers(pattern)
    assert got[1] == parts and (got[0] == words or not words and not got[0] or set(got[0]) == {"kys", "yourself"})


@pytest.mark.parametrize("pattern", [r"a{2}", r"a*?", r"(?=a)", r"a\d", "(a", "a)", "[a", "*a", "a|^b", r"[\w]"])
def test_other_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        parsed(pattern)


def test_spellings():
    assert spellings(parsed("a(b|c)?[de]")) == ["ad", "ae", "abd", "abe", "acd", "ace"]
    assert spellings(parsed("a.*b")) is None and spellings(parsed("[a-z][a-z][a-z]")) is None


def _texts():
    rng = random.Random(12)
    pieces = [w for e in ENTRIES for w in (*e.words.split(), *e.parts)] + ["i", "to", "me", "you", "a", "the", "'", ".", "é"]
    return [" ".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(600)] + [m["text"] for m in SAMPLE]


def _hits(spark, entries):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(_texts())], "id string, text string").selectExpr("*", "'outgoing' AS direction")
    rows = with_hits(normalize_messages(df), any_language=True, entries=entries).collect()
    return {r.id: [tuple(h) for h in r.hits] for r in rows}


def test_the_same_lexicon_from_a_table_gives_the_same_hits(spark, raw):
    entries = read_lexicon(lexicon_table(spark).repartition(4))
    assert [tuple(e)[:7] for e in entries] == [tuple(e)[:7] for e in ENTRIES]
    want = _hits(spark, ENTRIES)
    assert _hits(spark, entries) == want and sum(map(len, want.values())) > 300
    results = [sorted(map(str, process_messages(raw(*SAMPLE), entries=e).drop("message").collect())) for e in (ENTRIES, entries)]
    assert results[0] == results[1]


def test_a_lexicon_of_more_entries_than_a_bit_set(spark):
    rows = [tuple(e)[:7] for e in ENTRIES]
    more = [(i, *rows[i % 53][1:]) for i in range(150)]
    entries = read_lexicon(spark.createDataFrame(more, SCHEMA))
    assert len(entries) > 2 * GROUP
    got, want = _hits(spark, entries), _hits(spark, ENTRIES)
    assert {i: [(h[0] % 53, *h[1:]) for h in hits if h[0] < 53] for i, hits in got.items()} == want
    assert sum(map(len, got.values())) == sum(sum(1 for k in range(h[0], 150, 53)) for hits in want.values() for h in hits)


def test_entries_with_nothing_to_look_for_and_other_scripts(spark, raw):
    rows = [(5, "harassment", None, None, 0.8, r"x.*y", None), (1, "grooming", "own", "uk", 0.9, "секретик", True), (2, "self-harm", None, "en", 0.9, "ß", False)]
    entries = read_lexicon(spark.createDataFrame(rows, SCHEMA))
    assert [(e.ord, e.words, e.parts) for e in entries] == [(0, "", ("секретик",)), (1, "", ()), (2, "", ("x",))]
    messages = raw({"id": "1", "text": "СЕКРЕТИК"}, {"id": "2", "text": "a x b y"}, {"id": "3", "text": "ß", "direction": "outgoing"}, {"id": "4", "text": "no"})
    found = find_risks(normalize_messages(messages), entries=entries).collect()
    assert sorted((r.id, r.finding.category) for r in found) == [("2", "harassment"), ("3", "self-harm")]
    unsure = process_messages(messages, detector="aws-comprehend", entries=entries, candidates=spark.createDataFrame(
        [("1", [("uk", 0.9)])], "id string, candidates array<struct<code:string,score:double>>")).collect()
    assert {r.message.id: len(r.immediate) for r in unsure} == {"1": 1, "2": 1, "3": 1, "4": 0}
    nothing = read_lexicon(spark.createDataFrame([], SCHEMA))
    assert nothing == () and find_risks(normalize_messages(messages), entries=nothing).count() == 0
    assert process_messages(messages, entries=nothing).where("size(batch) + size(immediate) > 0").count() == 0


@pytest.mark.parametrize("change", [{"category": "other"}, {"weight": 2.0}, {"weight": None}, {"pattern": None}, {"pattern": r"a\d"}, {"pattern": "[ab]c"}, {"ord": None}])
def test_bad_entries_are_refused(spark, change):
    row = {"ord": 1, "category": "grooming", "signal": None, "lang": "en", "weight": 0.5, "pattern": "abc", "ignore_case": True, **change}
    with pytest.raises(ValueError):
        read_lexicon(spark.createDataFrame([tuple(row.values())], SCHEMA))


def test_a_job_with_its_own_lexicon(spark, tmp_path):
    lexicon_table(spark).where("category = 'harassment'").write.parquet(str(tmp_path / "lexicon"))
    (tmp_path / "in.jsonl").write_text('{"id":"1","text":"kill yourself loser"}\n{"id":"2","text":"our little secret"}\n')
    run(spark, parse_options(["--file", str(tmp_path / "in.jsonl"), "--output", str(tmp_path / "out"), "--json", "--lexicon", str(tmp_path / "lexicon")]))
    counts = spark.read.json(str(tmp_path / "out" / "counts")).first()
    assert (counts.messages, counts.immediate + counts.batched) == (2, 1)
