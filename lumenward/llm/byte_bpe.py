"""Byte-level BPE by longest matches and backtracking, in linear time.

Bytes are read as Latin-1 characters, so that one Aho-Corasick automaton over
the vocabulary finds all tokens of a piece of text in one scan.  The encoder
goes through the piece from the left, takes the longest token at each place that
is *compatible* with the token before it, and backs up where none is.  Two
adjacent tokens are compatible when merging the bytes of both by rank yields
exactly these two; a sequence whose neighbours are all compatible is the one that
the merges produce.  Positions that turned out to lead nowhere are remembered,
so each is left for good at most once; compatibility is memoised by pair.

Text is split by the tokenizer's own pattern and each match is encoded by
itself, without special tokens.  Decoding joins the tokens' bytes.

Defined results: null and empty texts have no tokens and decode to nothing;
very long texts and matches are encoded whole; repeated rows give repeated
rows; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Encoded matches and token pairs that a worker remembers; full memories start anew.
WORD_MEMORY = 400_000
PAIR_MEMORY = 500_000
#: Only matches up to this many characters are remembered; longer ones are encoded each time.
MEMORY_CHARS = 64


class Codec:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.digits = {rank: str(rank) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, pattern)

    def merge_by_rank(self, piece: bytes) -> list[int]:
        """The merges one after the other, lowest rank and leftmost first; for short pieces."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= PAIR_MEMORY:
                self._pairs.clear()
            known = self._pairs[pair] = self.merge_by_rank(self.token[left] + self.token[right]) == [left, right]
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        # Tokens that start at each place, shorter ones first, as the scan goes by their ends.
        at_place: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            at_place[end - found[0] + 1].append(found)
        open_place = bytearray(b"\1") * (n + 1)
        chosen: list[tuple[int, int]] = []  # token, and how many shorter ones are left at its place
        place, left = 0, len(at_place[0])
        while place < n:
            options, before = at_place[place], chosen[-1][0] if chosen else None
            while left:
                left -= 1
                length, rank = options[left]
                if open_place[place + length] and (before is None or self.compatible(before, rank)):
                    chosen.append((rank, left))
                    place += length
                    left = len(at_place[place]) if place < n else 0
                    break
            else:
                if not chosen:
                    raise ValueError("the vocabulary lacks single bytes of the text")
                open_place[place] = 0
                rank, left = chosen.pop()
                place -= len(self.token[rank])
        return tuple(rank for rank, _ in chosen)

    def encode(self, text: str) -> list[int]:
        words, out = self._words, []
        for word in self.split(text):
            ids = words.get(word)
            if ids is None:
                ids = self.encode_piece(word.encode())
                if len(word) <= MEMORY_CHARS:
                    if len(words) >= WORD_MEMORY:
                        words.clear()
                    words[word] = ids
            out += ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def ids_text(self, ids) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.digits.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and Python worker; the file lies on every machine."""
    return Codec.from_file(path, pattern)


def _texts(batches: Iterator[pa.RecordBatch], name: str):
    for batch in batches:
        at = batch.schema.get_field_index(name)
        others = [i for i in range(batch.num_columns) if i != at]
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            yield [part.column(i) for i in others], [part.schema.names[i] for i in others], part.column(at)


def _apply(docs: DataFrame, column: str, keep, extra: str, work) -> DataFrame:
    rows = docs.selectExpr(*[f"`{k}`" for k in keep], f"`{column}` AS _bpe_input")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches):
        for kept, names, values in _texts(batches, "_bpe_input"):
            made = work(values)
            yield pa.RecordBatch.from_arrays([*kept, *made.values()], names=[*names, *made])

    return rows.mapInArrow(run, ", ".join([*fields, extra]))


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` and ``ids``, the tokens of each whole text."""
    def work(values):
        encode = codec(path, pattern).encode
        return {"ids": pa.array([encode(t.as_py() or "") for t in values], pa.list_(pa.int32()))}
    return _apply(docs, text, keep, "ids array<int>", work)


def decode_ids(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", keep=("doc_id",)) -> DataFrame:
    """``keep`` and ``decoded``, the bytes of each row's tokens."""
    def work(values):
        decode = codec(path, pattern).decode
        return {"decoded": pa.array([decode(i.as_py() or ()) for i in values], pa.binary())}
    return _apply(encoded, ids, keep, "decoded binary", work)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Each text encoded, and its ids decoded again, as digests of both.

    Encoding, decoding and hashing go through one task's batch in turn, so
    that neither ids nor decoded texts of a table are ever held or shipped."""
    def work(values):
        own = codec(path, pattern)
        counts, ids_digest, decoded_digest = [], [], []
        for value in values:
            ids = own.encode(value.as_py() or "")
            counts.append(len(ids))
            ids_digest.append(hashlib.sha256(own.ids_text(ids).encode()).hexdigest())
            decoded_digest.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return {"n_tokens": pa.array(np.array(counts, np.int64)), "ids_sha256": pa.array(ids_digest, pa.string()),
                "decoded_sha256": pa.array(decoded_digest, pa.string())}
    return _apply(docs, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
