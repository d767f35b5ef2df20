"""Examples by group: categories, directions, modifiers, false positives."""

import pytest

from lumenward.functions.redaction import MASK

IN, OUT = {"direction": "incoming"}, {"direction": "outgoing"}
NM, MU = {"senderRelationship": "not-mutual"}, {"senderRelationship": "mutual"}
MULTI = "you're so mature, don't tell your parents, add me on telegram"

# Text, fields, {category: confidence}
CASES = [
    (MULTI, NM, {"grooming": 0.88}),
    ("what's your address?", {}, {"grooming": 0.50}),
    ("send me a pic", NM, {"sexual-solicitation": 0.76}),
    ("mándame fotos desnuda", NM, {"sexual-solicitation": 0.76}),
    ("you're a worthless loser, nobody likes you", {}, {"harassment": 0.50}),
    ("ninguém gosta de você, perdedor", {}, {"harassment": 0.50}),
    ("i'm going to hurt you", {}, {"violent-threat": 0.72}),
    ("te voy a matar", {}, {"violent-threat": 0.72}),
    ("imma beat u up", {}, {"violent-threat": 0.72}),
    ("shut up ur dead", {}, {"violent-threat": 0.72}),
    ("I got some drugs for you", NM, {"grooming": 0.60}),
    ("do you want some heroine?", NM, {"grooming": 0.60}),
    ("i want to die", OUT, {"self-harm": 0.72}),
    ("i want to die", IN, {}),
    ("kill yourself", IN, {"harassment": 0.50}),
    ("quiero morirme, no puedo más", OUT, {"self-harm": 0.72}),
    ("je veux mourir", OUT, {"self-harm": 0.72}),
    ("ich will sterben", OUT, {"self-harm": 0.72}),
    ("أريد أن أموت", OUT, {"self-harm": 0.72}),
    ("хочу умереть", OUT, {"self-harm": 0.72}),
    ("मैं मरना चाहता हूँ", OUT, {"self-harm": 0.72}),
    ("add me on snapchat", NM, {"grooming": 0.60}),
    ("add me on snapchat", {}, {"grooming": 0.50}),
    ("add me on snapchat", MU, {"grooming": 0.45}),
    ("want to study for the math test tomorrow?", {}, {}),
    ("vamos al cine el sábado", {}, {}),
    # unsure of the language: every lexicon is tried
    ("perdedor", {}, {"harassment": 0.75}),
    ("te mato", {}, {"violent-threat": 0.92}),
    ("loser du bist dumm", {}, {"harassment": 0.75}),
    ("our little secret", {}, {"grooming": 0.70}),
    # quirks of the patterns
    ("i wanna die", OUT, {}),
    ("raté va", {}, {}),
    ("tes parents sont là ?", {}, {}),
    ("no digas nada a tu mamá ok", {}, {}),
    ("MÁNDAME UNA FOTO", NM, {"sexual-solicitation": 0.76}),
    ("how old are you", {}, {"grooming": 0.45}),
    ("how old are you", MU, {}),
    ("turn me on", MU, {"sexual-solicitation": 0.50}),
    ("send me a pic", {}, {"sexual-solicitation": 0.70}),
    ("manda foto", {}, {}),
    ("manda\u0085foto", {}, {"sexual-solicitation": 0.91}),
    ("", {}, {}),
    (" \t\n ", {}, {}),
]


@pytest.fixture(scope="module")
def found(find):
    return find(*[{"text": text, **fields} for text, fields, _ in CASES])


@pytest.mark.parametrize("at", range(len(CASES)), ids=lambda i: CASES[i][0][:30] or "empty")
def test_case(found, at):
    assert {c: f.confidence for c, f in found[str(at)].items()} == CASES[at][2]


def test_everything_at_once_stays_under_the_cap(find):
    text = MULTI + ", where do you live, are you alone, send me a pic"
    got = find({"text": text, **NM})["0"]
    assert got["grooming"].confidence == 0.97
    assert all(f.confidence <= 0.99 for f in got.values())


def test_details(find):
    got = find(
        {"text": "perdedor"}, {"text": "te mato"}, {"text": "our little secret"},
        {"text": "add me on telegram and don't tell your parents", **NM},
        {"text": "please don't tell your parents about this ok", **NM}, {"text": "sextet sext"},
        {"text": "loser du bist dumm"}, {"text": "I got some drugs for you", **NM}, {"text": "لا تخبر والديك"},
        {"text": "what's your address?"},
    )
    assert (got["0"]["harassment"].language, got["0"]["harassment"].excerpt) == ("es", MASK)
    assert got["1"]["violent-threat"].languageName == "Spanish"
    assert got["2"]["grooming"].signals == ["secrecy", "flattery"] and got["2"]["grooming"].excerpt == MASK
    assert got["3"]["grooming"].signals == ["secrecy", "platform-move"]
    assert got["3"]["grooming"].excerpt == f"{MASK} and don't tell your p…"
    assert got["4"]["grooming"].excerpt == f"please {MASK} about this ok"
    assert got["5"]["sexual-solicitation"].excerpt == f"sextet {MASK}"
    assert got["6"]["harassment"].language == "de"
    assert (got["7"]["grooming"].signals, got["7"]["grooming"].excerpt) == (["enticement"], f"I got {MASK}")
    assert got["8"]["grooming"].languageName == "ar"
    assert got["9"]["grooming"].excerpt == f"{MASK}?"


def test_matches_beyond_the_basic_plane_are_counted_in_code_points(find):
    got = find({"text": "😀😀 you loser 😀"})["0"]["harassment"]
    assert got.excerpt == f"😀😀 you {MASK} 😀"


def test_strangers_never_score_below_contacts(find):
    texts = [text for text, _, _ in CASES if text.strip()]
    relations = ("mutual", "unknown", "not-mutual")
    got = find(*[{"text": t, "direction": "outgoing", "senderRelationship": r} for t in texts for r in relations])
    for i in range(0, 3 * len(texts), 3):
        contact, unknown, stranger = (got[str(i + k)] for k in range(3))
        for category, finding in contact.items():
            assert 0.45 <= finding.confidence <= unknown[category].confidence
        for category, finding in unknown.items():
            assert finding.confidence <= stranger[category].confidence <= 0.99
            assert MASK in finding.excerpt and len(finding.excerpt) <= 70
