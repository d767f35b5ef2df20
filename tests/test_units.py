"""Small operators on their own."""

import pytest

from lumenward.functions import wording
from lumenward.functions.redaction import redact_excerpt
from lumenward.functions.scoring import final_confidence, noisy_or, sender_adjusted, tier
from lumenward.functions.text import quote, round2, trim_all
from lumenward.operators.language import best_candidate, check_detector, remote_requests, with_language
from lumenward.operators.normalize import (
    SANCTIONED_SOURCES, accepted_messages, normalize_messages, refused_messages,
)
from lumenward.sources.tables import as_raw_messages


def value(spark, expression):
    return spark.sql(f"SELECT {expression} AS v").first().v


@pytest.mark.parametrize("weights, relationship, expected", [
    ((.5, .5, .4), "not-mutual", 0.88),
    ((.7,), "not-mutual", 0.76), ((.7,), "unknown", 0.70), ((.7,), "mutual", 0.63),
    ((.5,), "not-mutual", 0.60), ((.5,), "unknown", 0.50), ((.5,), "mutual", 0.45),
    ((.45,), "not-mutual", 0.56), ((.45,), "unknown", 0.45), ((.45,), "mutual", 0.41),
    ((.5, .4), "unknown", 0.70), ((.5, .5), "not-mutual", 0.80), ((.5, .5), "unknown", 0.75),
    ((.5, .5), "mutual", 0.68), ((.5, .5, .5, .5), "not-mutual", 0.95), ((.5, .45), "unknown", 0.73),
    ((.5, .45), "not-mutual", 0.78), ((.5, .45), "mutual", 0.65), ((.55,), "not-mutual", 0.64),
    ((.55,), "mutual", 0.50), ((.4,), "not-mutual", 0.52), ((.4,), "mutual", 0.36), ((.45, .4), "unknown", 0.67),
    ((.72, .72), "unknown", 0.92), ((.5, .5, .5, .45, .4), "not-mutual", 0.97),
    ((.7,) * 6, "not-mutual", 0.99),
])
def test_confidence(spark, weights, relationship, expected):
    listed = ", ".join(f"{w}D" for w in weights)
    combined = noisy_or(f"array({listed})")
    assert value(spark, final_confidence(sender_adjusted(combined, "'grooming'", f"'{relationship}'"))) == expected
    plain = value(spark, final_confidence(combined))
    assert value(spark, final_confidence(sender_adjusted(combined, "'harassment'", f"'{relationship}'"))) == plain


def test_rounding_and_tiers(spark):
    assert value(spark, round2("1.005D")) == 1.0
    assert value(spark, round2("0.125D")) == 0.13
    assert value(spark, tier("0.70D")) == "immediate"
    assert value(spark, tier("0.69D")) == "review"


@pytest.mark.parametrize("text, start, end, expected", [
    ("abc SECRET def", 4, 10, "abc ▇▇▇ def"),
    ("abc", None, None, "abc ▇▇▇"),
    ("abc", 2, 9, "abc ▇▇▇"),
    ("abc", 2, 2, "abc ▇▇▇"),
    ("", None, None, "▇▇▇"),
    (" a \n\t b  ", None, None, "a b ▇▇▇"),
    ("x" * 30 + "SECRET" + "y" * 30, 30, 36, "…" + "x" * 22 + "▇▇▇" + "y" * 22 + "…"),
    ("a  b\n\nSECRET  c", 6, 12, "a b ▇▇▇ c"),
])
def test_redaction(spark, text, start, end, expected):
    as_int = [f"cast({'NULL' if v is None else v} AS int)" for v in (start, end)]
    assert value(spark, redact_excerpt(quote(text), *as_int)) == expected


def test_redaction_cap(spark):
    got = value(spark, redact_excerpt(quote("x" * 100 + "S" + "y" * 100), "100", "101", context=60))
    assert len(got) == 70 and got.endswith("…")


@pytest.mark.parametrize("text, expected", [
    ("the quick brown fox and you", ("en", "English", 0.95)),
    ("no le digas a nadie que eres tan joven", ("es", "Spanish", 0.95)),
    ("tu es seul chez toi ce soir", ("fr", "French", 0.95)),
    ("você não conta para os seus pais", ("pt", "Portuguese", 0.95)),
    ("du bist so reif und ich sage nicht", ("de", "German", 0.95)),
    ("hola que tal estas", ("es", "Spanish", 0.95)),
    ("لا تخبر والديك", ("ar", "Arabic", 0.95)),
    ("хочу умереть", ("ru", "Russian", 0.95)),
    ("मैं मरना चाहता हूँ", ("hi", "Hindi", 0.95)),
    ("日本語のテキスト", ("zh", "Chinese", 0.95)),
    ("ひらがな", ("ja", "Japanese", 0.95)),
    ("한국어", ("ko", "Korean", 0.95)),
    ("שלום", ("he", "Hebrew", 0.95)),
    ("สวัสดี", ("th", "Thai", 0.95)),
    ("γειά", ("el", "Greek", 0.95)),
    ("hello привет سلام", ("ar", "Arabic", 0.95)),
    ("curly “quotes” … — and you", ("en", "English", 0.95)),
    ("perdedor", ("en", "English", 0.3)),
    ("che bello il sole di Roma", ("it", "Italian", 0.95)),
    ("", ("und", "Undetermined", 0.0)),
    (" \t\n ", ("und", "Undetermined", 0.0)),
    ("123 !?", ("und", "Undetermined", 0.0)),
    ("2you you2 you_ i'm you'", ("en", "English", 0.95)),
])
def test_language(spark, text, expected):
    assert tuple(with_language(spark.createDataFrame([(text,)], "text string")).drop("text").first()) == expected


def test_guard(spark, raw):
    table = raw({"id": "a", "source": "scraping"}, {"id": "b", "source": "instagram-private-api"},
                {"id": "c", "source": "family-link"}, {"id": "d"}, {"id": "e", "source": ""})
    assert [r.id for r in accepted_messages(table).collect()] == ["c", "d", "e"]
    refused = refused_messages(table).collect()
    assert [r.id for r in refused] == ["a", "b"]
    assert refused[0].reason == (
        'Refusing to ingest from "scraping". This system only consumes content via sanctioned integrations ('
        + ", ".join(SANCTIONED_SOURCES)
        + "). Scraping, private/unofficial endpoints, and automated logins are out of scope.")
    with pytest.raises(Exception, match="Refusing to ingest"):
        normalize_messages(table).select("platform").collect()
    assert normalize_messages(table, strict=False).count() == 3


def test_defaults(raw):
    row = normalize_messages(raw({"text": "hi"})).first()
    assert (row.direction, row.senderRelationship, row.platform, row.source, row.id) == (
        "incoming", "unknown", "unknown", "manual", None)
    assert row.timestamp.endswith("Z") and "T" in row.timestamp
    rows = normalize_messages(raw(
        {"text": "", "content": "x", "senderRelationship": "bogus", "direction": "OUTGOING", "platform": "",
         "source": "", "timestamp": "2024-01-01T00:00:00Z", "id": ""})).collect()
    assert rows[0].asDict() == dict(
        id=None, text="x", direction="incoming", senderRelationship="unknown", platform="unknown", source="manual",
        timestamp="2024-01-01T00:00:00Z")


def test_any_table_is_a_source(spark):
    table = spark.createDataFrame([(7, "hi", "out")], "n int, body string, way string")
    row = normalize_messages(as_raw_messages(
        table, {"id": "n", "text": "body", "direction": "if(way = 'out', 'outgoing', 'incoming')"}, ("n",)), ("n",)).first()
    assert (row.n, row.id, row.text, row.direction) == (7, "7", "hi", "outgoing")
    with pytest.raises(ValueError):
        as_raw_messages(table, {"body": "body"})
    # A table may lack fields altogether.
    assert normalize_messages(table.selectExpr("body AS text")).first().source == "manual"


def test_actions(spark):
    def action(category, confidence):
        return value(spark, wording.suggested_action(
            f"named_struct('category', '{category}', 'confidence', {confidence}D)"))
    assert "988" in action("self-harm", 0.72) and "block" not in action("self-harm", 0.72)
    assert action("harassment", 0.5).startswith("Possible bullying")
    assert action("other", 0.9) == wording.DEFAULT_ACTION


def test_best_candidate(spark):
    def best(*pairs):
        listed = ", ".join(f"named_struct('code', '{c}', 'score', {s}D)" for c, s in pairs)
        got = value(spark, best_candidate(f"cast(array({listed}) AS array<struct<code:string,score:double>>)"))
        return got and got.code
    assert best(("en", .2), ("zh-TW", .9), ("fr", .9)) == "zh-TW"
    assert best() is None


def test_detector_names():
    with pytest.raises(ValueError, match="not-a-real-backend"):
        check_detector("not-a-real-backend")


def test_remote_requests(spark, raw):
    messages = normalize_messages(raw({"id": "a", "text": "  " + "x" * 6000}, {"id": "b", "text": " "}))
    assert [(r.id, len(r.text)) for r in remote_requests(messages).collect()] == [("a", 6000)]
    assert [(r.id, len(r.text)) for r in remote_requests(messages, max_chars=5000).collect()] == [("a", 5000)]
    assert value(spark, trim_all(quote("　 a b\t"))) == "a b"
