import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lumenward.llm import byte_bpe, op3_byte_bpe
from lumenward.llm.byte_bpe import codec, decode_ids, encode_texts

PATH, PATTERN = public_tokenizers.path(op3_byte_bpe.VOCABULARY), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def other(own):
    return tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_same_ids_as_another_encoder(own, other):
    rng, tokens = random.Random(4), list(own.ranks)
    letters = "abcdefghijklmnopqrstuvwxyzéüñ \n0123#'<|endoftext|>"
    for _ in range(2000):
        joined = b"".join(rng.choice(tokens) for _ in range(rng.randrange(8))).decode("utf-8", "replace")
        mixed = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        odd = "".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(10))
        for text in (joined, mixed, odd):
            ids = own.encode(text)
            assert ids == other.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_long_pieces_in_linear_time(own, other):
    rng = random.Random(5)
    for text in ("a" * 20_000, "".join(rng.choice("abehinorst") for _ in range(60_000)), "ab" * 10_000, "é" * 9_000):
        assert own.encode(text) == other.encode_ordinary(text)


def test_full_memories_change_nothing(monkeypatch, other):
    monkeypatch.setattr(byte_bpe, "WORD_MEMORY", 3)
    monkeypatch.setattr(byte_bpe, "PAIR_MEMORY", 3)
    small = byte_bpe.Codec.from_file(PATH, PATTERN)
    text = "thistle unthinkable restoration anderen überhaupt ciónado " * 5
    assert small.encode(text) == other.encode_ordinary(text)


def test_round_trip_of_tables(spark, documents, as_tables, other):
    texts = {1: "Hello wörld", 2: "", 3: None, 4: "x y " * 5000, 5: "</s>\x00\n"}
    rows = [*texts.items(), (5, texts[5]), (None, "no id")]
    docs = documents(rows)
    encoded = encode_texts(docs, PATH, PATTERN)
    decoded = decode_ids(encoded, PATH, PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in decoded} == {**{k: v or "" for k, v in texts.items()}, None: "no id"}
    got = op3_byte_bpe.query(spark, as_tables(documents=docs)).collect()
    assert len(got) == len(rows)
    for row in got:
        text = "no id" if row.doc_id is None else texts[row.doc_id] or ""
        ids = other.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert encode_texts(documents([]), PATH, PATTERN).count() == 0
