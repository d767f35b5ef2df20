import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenward.llm import op12_packing, packing
from lumenward.llm.packing import Encoder, plan, shortest_pack_first

PATH = public_tokenizers.path(op12_packing.VOCABULARY)


def _one_by_one(counts, size):
    """Spaces left by shortest pack first, a pack at a time."""
    spaces = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            best = max(range(len(spaces)), key=lambda i: spaces[i], default=None)
            if best is None or spaces[best] < length:
                spaces.append(size)
                best = len(spaces) - 1
            taken = min(left, spaces[best] // length)
            spaces[best] -= length * taken
            left -= taken
    return sorted(spaces)


@pytest.mark.parametrize("seed", range(30))
def test_packs_against_one_by_one(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 16, 64])
    counts = {rng.randrange(1, size + 1): rng.choice([1, 2, 7, 40]) for _ in range(rng.randrange(12))}
    packs = shortest_pack_first(counts, size)
    assert sorted(p.space for p in packs for _ in range(p.n)) == _one_by_one(counts, size)
    held = sorted((length, rank + i) for p in packs for length, rank, each in p.content for i in range(p.n * each))
    assert held == sorted((length, r) for length, n in counts.items() for r in range(n))
    assert sorted(p.first + i for p in packs for i in range(p.n)) == list(range(len(_one_by_one(counts, size))))


def _check_plan(counts, size, least):
    """How much of each sequence is used."""
    covered, used = {}, {}
    for length, rank, n, skip, each, at, part, first, offset in plan(counts, size, least):
        for i in range(n):
            covered.setdefault((length, rank + i), []).append((at, part))
            used.setdefault(first + (skip + i) // each, []).append((offset + (skip + i) % each * part, part))
    assert set(covered) == {(length, r) for length, n in counts.items() for r in range(n)}
    for (length, _), parts in covered.items():
        place = 0
        for at, part in sorted(parts):
            assert at == place and part > 0
            place += part
        assert place == length
    out = []
    for parts in used.values():
        place = 0
        for offset, part in sorted(parts):
            assert offset == place and part > 0
            place += part
        assert place <= size
        out.append(place)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_plan_covers_everything_once(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 64, 2048])
    counts = {rng.randrange(1, size + 1): rng.choice([1, 2, 3, 50]) for _ in range(rng.randrange(1, 30))}
    least = rng.choice([k for k in (1, 4, 64) if k < size])
    used = _check_plan(counts, size, least)
    padding = sum(size - place for place in used if place & (place - 1))
    assert padding <= len(used) * (least - 1)
    total = sum(k * n for k, n in counts.items())
    assert (len(used) - size.bit_length()) * (size - least + 1) <= total


@pytest.mark.parametrize("lengths", [range(1, 2049), [1100], [700, 1500], range(900, 1400, 7), [5], range(1, 60), [1025, 683, 3]])
def test_plan_of_a_large_corpus_is_small(lengths):
    rng = random.Random(5)
    counts = {length: rng.randrange(10 ** 8) for length in lengths}
    placements = plan(counts)
    total = sum(k * n for k, n in counts.items())
    # Sequences, by the places at their beginnings.
    sequences = sum(-(-(skip + n) // each) - (skip > 0) for _, _, n, skip, each, _, _, _, offset in placements if offset == 0)
    assert len(placements) < 20_000 and sequences * 2048 < 1.035 * total + 2048 * 12
    assert plan({}) == []


@lru_cache
def _tokenizer():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


def _ids(text):
    return _tokenizer().encode(text or "", add_special_tokens=False).ids


TEXTS = ["Hello,  World!\n\n it's", "a\tb\r\nc d e f\x0bg\x0ch\x1ci", "é ́x İstanbul ΟΔΥΣΣΕΥΣ ß ﬁ", "", None, " ", "\n",
         "<|endoftext|> <|startoftext|>x", "漢字かな 한국어 123 4.5", "x" * 300, "don't  'll\n's", "😀👍🏽 ퟿", "​﻿ à́\ń"]


def test_ids_of_texts(monkeypatch):
    encoder, rng = Encoder(PATH), random.Random(4)
    odd = [t for t in TEXTS if t] + ["é", "́", "'", "s", "ẛ̣", "Σ", "É", "\x85", "\xa0"]
    texts = [t or "" for t in TEXTS]
    texts += ["".join(rng.choice([" ", "\n", "", "\t", "　"]) + rng.choice(odd) for _ in range(12)) for _ in range(400)]
    texts += ["".join(rng.choice([chr(rng.randrange(0x370)), " ", "a"]) for _ in range(40)) for _ in range(400)]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}'s 1{chr(c)}1" for c in range(0x370)]
    want = [_ids(t) for t in texts]
    for stretch in (1 << 18, 7):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        assert [ids.tolist() for ids in encoder.encode(texts)] == want
    assert list(encoder.encode([])) == []


def _verify(rows, docs):
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    want = {}
    for doc_id, text in docs:
        want.setdefault(doc_id, []).append([*_ids(text), 1])
    assert set(by_doc) == set(want)
    for doc_id, texts in want.items():
        if len(texts) > 1:
            assert sum(r.length for r in by_doc[doc_id]) == sum(map(len, texts))
            continue
        ids, place = texts[0], 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == place and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[place:place + r.length], "<u4").tobytes())
            place += r.length
        assert place == len(ids)
    for parts in sequences.values():
        place = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert 2048 - packing.LEAST_GAP < place <= 2048 or place & (place - 1) == 0


def test_query_against_the_texts(spark, documents, as_tables, words):
    docs = [(i, words(i, 3 * i % 700)) for i in range(120)] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    docs += [(5000, words(9, 30_000)), (5001, "same text"), (5001, "same text"), (None, "no id"), (5002, "y " * 3000)]
    rows = op12_packing.query(spark, as_tables(documents=documents(docs).repartition(5))).collect()
    _verify(rows, docs)


def test_ids_of_the_pieces(spark, documents, scratch, words):
    packed = packing.pack(documents([(i, words(i, 900)) for i in range(5)]), PATH, scratch).collect()
    for i in range(5):
        parts = sorted((r for r in packed if r.doc_id == i), key=lambda r: r.start)
        assert [t for r in parts for t in r.ids] == [*_ids(words(i, 900)), 1]


def test_empty_table(spark, documents, as_tables):
    assert op12_packing.query(spark, as_tables(documents=documents([]))).collect() == []


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = op12_packing.query(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    _verify(rows, docs)
