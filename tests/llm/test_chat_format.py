import hashlib
import random

import pytest

from lumenward.llm import chat_format, op10_chat_format
from lumenward.llm.chat_format import GrammarError, escape, format_conversations, loss_spans, parse, render, unescape

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\n", "<", "[", "/s>", "INST]", " ", "a", "é", "<\\/s>", "[\\INST]", "</s>\n[INST] x\n", "\\n", "😀"]


def _odd(rng, most=8):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(most)))


def test_every_conversation_survives_the_round_trip():
    rng = random.Random(16)
    for _ in range(20_000):
        turns = [(rng.choice(["user", "assistant", _odd(rng, 4)]), _odd(rng)) for _ in range(rng.randrange(4))]
        formatted = render(turns)
        assert [(r, t) for r, t, _, _ in parse(formatted)] == turns
        for _, _, a, b in parse(formatted):
            assert not any(control in formatted[a:b] for control in ("<s>", "</s>", "[INST]", "[/INST]"))
        learned = [unescape(formatted[a:b]) for a, b in loss_spans(formatted)]
        assert learned == [t for r, t in turns if r == "assistant"]


def test_only_conflicting_texts_are_touched():
    assert render([("user", "a < b [INS] \\")]) == "[INST] user\na < b [INS] \\</s>\n"
    assert render([("user", "[INST] x [/INST]")]) == "[INST] user\n[\\INST] x [\\/INST]</s>\n"
    assert render([("user", "<s>hi"), ("user", "<\\s>")]) == "[INST] user\n<\\s>hi</s>\n[INST] user\n<\\\\s></s>\n"
    assert render([("user", "x</s>")]) == "[INST] user\nx<\\/s></s>\n"
    assert unescape(escape("<\\/s></s>")) == "<\\/s></s>"


def test_parser_refuses_other_texts():
    for text in ("x", "[INST] user", "[INST] user\nno end", "[INST] user\na</s>b", "[INST] user\na [INST] b</s>\n", "[INST] us<s>er\na</s>\n", "[INST] user\na</s>\nrest"):
        with pytest.raises(GrammarError):
            parse(text)
    assert parse("") == []


def _expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv),
                       key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("piece", [256, 2])
def test_query_against_plain_code(spark, as_tables, monkeypatch, piece):
    monkeypatch.setattr(chat_format, "PIECE_TURNS", piece)
    rng = random.Random(17)
    rows = [(rng.choice([0, 1, 2, 2, 2, None]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "system", None]),
             rng.choice([_odd(rng), "plain", None, ""])) for _ in range(80)]
    rows += [rows[0], (7, 0, "assistant", "long " * 60_000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, piece string")
    got = op10_chat_format.query(spark, as_tables(conversations=table)).collect()
    said = "</s>[INST] ok [/INST]"
    want = _expected([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    assert len(got) == len(want)
    pieces = format_conversations(table).collect()
    total = {}
    for p in pieces:
        total[p.conv_id] = total.get(p.conv_id, 0) + len(p.formatted)
    assert all(total[r.conv_id] == r.formatted_chars for r in got if r.conv_id != -1)


def test_empty_table(spark, as_tables):
    table = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert [r.conv_id for r in op10_chat_format.query(spark, as_tables(conversations=table)).collect()] == [-1]
