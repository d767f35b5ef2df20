"""Packing token sequences by shortest pack first over the histogram of lengths.

Every document is encoded whole and ends with an end token.  What is longer than a
sequence is cut into whole sequences and a rest; how many pieces there are of each
length is all that the packing looks at.  Lengths are placed longest first, into
the pack with most space left, as many as it takes, or into a new pack where none
has the space.  Packs that got the same lengths are one *pattern* with a count, so
a placement moves a run of equal pieces into a run of equal packs, and the work
depends on the number of lengths, never on the number of documents.

Cutting is free, so where gaps of :data:`LEAST_GAP` or more remain, the packs with
most space are dissolved, their pieces cut into parts of that size, and the parts
placed into the gaps of the others in the same way.  The last sequence is split into
sequences of the sizes of its binary digits: as those are powers of two, they are
not padded.

Pieces find their places by rank: the n-th piece of a length belongs to the run of
placements that holds rank n.  Ranks are running numbers within the tasks that
encoded the texts plus the numbers of the tasks before, so that no piece is
sorted or sent anywhere.  Placements are at most a few for every length, whatever
the size of the corpus, and are broadcast.

Defined results: a null or empty text has the end token only; very long texts
are encoded whole, a stretch at a time; repeated rows are documents of their own,
and a null id stays one; an empty table gives an empty one.  Other columns than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.llm.words import slices
from lumenward.storage import Scratch

SIZE = 2048
END = 1
#: Smaller gaps are left as padding rather than filled with cuttings.
LEAST_GAP = 64
#: Words that a worker remembers, and their characters; a full memory starts anew.
MEMORY_WORDS = 600_000
MEMORY_CHARS = 16 << 20
#: Characters that are encoded together, and pieces in a batch.
STRETCH = 1 << 18
BATCH_PIECES = 512


# ---- the plan, from the histogram alone ----

class Packs:
    """``n`` packs of one pattern, numbered from ``first``, with ``space`` left in each.

    ``content`` lists (length, rank, each): of the pieces of that length, the i-th
    pack holds the ``each`` ones from rank + i * each on."""
    __slots__ = ("first", "n", "space", "content")

    def __init__(self, first: int, n: int, space: int, content: list[tuple[int, int, int]]):
        self.first, self.n, self.space, self.content = first, n, space, content

    def split(self, n: int) -> Packs:
        """Take the packs after the first ``n`` away from these."""
        rest = Packs(self.first + n, self.n - n, self.space, [(k, rank + n * each, each) for k, rank, each in self.content])
        self.n = n
        return rest

    def put(self, length: int, rank: int, each: int) -> None:
        self.content.append((length, rank, each))
        self.space -= length * each


def shortest_pack_first(counts: dict[int, int], size: int, packs: list[Packs] = ()) -> list[Packs]:
    """Packs for the given number of pieces of each length, none cut; ``packs`` are there already.

    The pack with most space takes as many pieces of the length as fit, then the
    next one does.  What stays free in it is less than half of what was, so a
    pattern gets at most as many entries as ``size`` has binary digits, and a length
    adds at most three patterns."""
    by_space: list[list[Packs]] = [[] for _ in range(size + 1)]
    for old in packs:
        by_space[old.space].append(old)
    made, most = max((p.first + p.n for p in packs), default=0), size  # no pack has more space than ``most``
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            while most >= length and not by_space[most]:
                most -= 1
            if most >= length:
                chosen = by_space[most].pop()
                each = most // length
            else:
                each, most = size // length, size
                chosen = Packs(made, -(-left // each), size, [])
                made += chosen.n
            # Some packs take ``each``, at most one takes fewer, the others stay.
            takers = [(min(chosen.n, left // each), each)]
            if takers[0][0] < chosen.n and left % each:
                takers.append((1, left % each))
            for n, pieces in takers:
                if not n:
                    continue
                rest = chosen.split(n) if chosen.n > n else None
                chosen.put(length, rank, pieces)
                by_space[chosen.space].append(chosen)
                rank, left = rank + n * pieces, left - n * pieces
                chosen = rest
            if chosen:
                by_space[chosen.space].append(chosen)
    return [p for row in by_space for p in row]


#: length, first rank, ranks, ranks before them in their first pack, ranks to a pack, where in
#: the piece, how much of it, first sequence, offset there.
Placement = tuple[int, int, int, int, int, int, int, int, int]
PLACEMENT = ("l bigint, first_rank bigint, n bigint, skip bigint, each bigint, at bigint, taken bigint,"
             " first_sequence bigint, offset bigint")


def plan(counts: dict[int, int], size: int = SIZE, least_gap: int = LEAST_GAP) -> list[Placement]:
    """Where every piece, or part of a piece, of each length goes."""
    packs = sorted(shortest_pack_first(counts, size), key=lambda p: (p.space, p.first))
    wanted, cut = sum(p.n * p.space for p in packs if p.space >= least_gap), []
    while wanted > 0:
        # The emptiest packs are given up: their gaps are gone, and their pieces fill others.
        last = packs.pop()
        n = min(last.n, -(-wanted // size))
        if last.n > n:
            packs.append(last)
            last = last.split(last.n - n)
        wanted -= n * size
        cut += [(length, rank, last.n * each) for length, rank, each in last.content]
    out: list[Placement] = []
    for p in packs:
        at = 0
        for length, rank, each in p.content:
            out.append((length, rank, p.n * each, 0, each, 0, length, p.first, at))
            at += length * each
    if not cut:
        return out
    # Runs of parts by their length: (length of the piece, first rank, ranks, where in the piece).
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, rank, n in cut:
        for at in range(0, length, least_gap):
            runs.setdefault(min(least_gap, length - at), []).append((length, rank, n, at))
    made = max((p.first + p.n for p in packs), default=0)
    filled = sorted(shortest_pack_first(
        {part: sum(run[2] for run in own) for part, own in runs.items()}, size,
        [Packs(p.first, p.n, p.space, []) for p in packs]), key=lambda p: (p.first < made, -p.space))
    if filled[0].first >= made and filled[0].n > 1:
        filled.append(filled[0].split(1))
    free = max(p.first + p.n for p in filled)
    for i, p in enumerate(filled):
        offset = size - p.space - sum(part * each for part, _, each in p.content)
        for part, rank, each in p.content:
            for placement in _of_runs(runs[part], part, rank, each, p, offset):
                out += _in_powers(placement, size - p.space, free) if i == 0 and p.first >= made else [placement]
            offset += part * each
    return out


def _of_runs(runs, part: int, rank: int, each: int, packs: Packs, offset: int) -> Iterator[Placement]:
    """The places of an entry of the packs, run by run; its ranks count through all runs."""
    before, end = 0, rank + packs.n * each
    for length, first, n, at in runs:
        a, b = max(rank, before), min(end, before + n)
        if a < b:
            packs_before, skip = divmod(a - rank, each)
            yield length, first + a - before, b - a, skip, each, at, part, packs.first + packs_before, offset
        before += n


def _in_powers(placement: Placement, total: int, free: int) -> Iterator[Placement]:
    """The places of one pack's parts in sequences of the sizes of the binary digits of ``total``,
    numbered from ``free``."""
    length, first, n, skip, _, at, part, _, offset = placement
    for i in range(n):
        start = offset + (skip + i) * part
        stop, done, sequence = start + part, 0, free
        for bit in range(total.bit_length() - 1, -1, -1):
            if total >> bit & 1:
                a, b = max(start, done), min(stop, done + (1 << bit))
                if a < b:
                    yield length, first + i, 1, 0, 1, at + a - start, b - a, sequence, a - done
                done, sequence = done + (1 << bit), sequence + 1


# ---- encoding ----

def _ranges(kind: str) -> str:
    """Body of a character class of the Latin blocks' letters or numbers."""
    own = [c for c in range(_LATIN) if unicodedata.category(chr(c)).startswith(kind)]
    return re.escape("".join(map(chr, own)))


def _words_of(text: str) -> list[str]:
    """What the vocabulary's own pattern cuts normalised Latin text into."""
    return _WORD.findall(text)


_LATIN = 0x180
_BEYOND_LATIN = re.compile(f"[^\\x00-{chr(_LATIN - 1)}]").search
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_ranges('L')}]+|[{_ranges('N')}]|[^\t-\r \x85\xa0{_ranges('L')}{_ranges('N')}]+")


class Memory(dict):
    """Words by the order in which they came, with their ids one word after the other."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.chars = 0
        self.ids, self.bounds = array("i"), array("q", [0])

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def learn(self, encode) -> None:
        """Ids of the words that came since the last time."""
        for own in encode(self.new):
            self.ids.extend(own)
            self.bounds.append(len(self.ids))
        self.chars += sum(map(len, self.new))
        self.new = []

    def full(self) -> bool:
        return len(self) >= MEMORY_WORDS or self.chars >= MEMORY_CHARS

    def gather(self, words: np.ndarray) -> np.ndarray:
        """The ids of the words with these numbers."""
        ids, bounds = np.frombuffer(self.ids, np.int32), np.frombuffer(self.bounds, np.int64)
        starts = bounds[words]
        counts = bounds[words + 1] - starts
        before = np.cumsum(counts) - counts
        return ids[np.arange(counts.sum()) + np.repeat(starts - before, counts)]


class Encoder:
    """Ids of whole texts.

    The vocabulary drops white space and no token spans it, so a long text's ids
    are those of its stretches one after the other.  Text of the Latin blocks is
    normalised (NFC, lower case) and cut into words here, whose ids are remembered;
    that gives the same and is faster."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers
        self.whole, self.normalised = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.normalised.normalizer = normalizers.Sequence([])
        for tokenizer in (self.whole, self.normalised):
            tokenizer.encode_special_tokens = True
        self._memory = Memory()

    def _encode(self, tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _latin(self, texts: list[str]) -> Iterator[np.ndarray]:
        if self._memory.full():
            self._memory = Memory()
        memory = self._memory
        numbers = [np.fromiter(map(memory.__getitem__, _words_of(unicodedata.normalize("NFC", text).lower())), np.int64)
                   for text in texts]
        memory.learn(lambda words: self._encode(self.normalised, words))
        return map(memory.gather, numbers)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        latin = [not _BEYOND_LATIN(text) for text in texts]
        fast = iter(list(self._latin([t for t, plain in zip(texts, latin) if plain])))
        slow = iter(self._encode(self.whole, [t for t, plain in zip(texts, latin) if not plain]))
        return [next(fast) if plain else np.array(next(slow), np.int32) for plain in latin]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """One array for each text; only a few stretches are encoded at a time."""
        held: list[str] = []
        for text in texts:
            if len(text) <= STRETCH:
                held.append(text)
            if held and (len(text) > STRETCH or sum(map(len, held)) > STRETCH):
                yield from self.encode_all(held)
                held = []
            if len(text) > STRETCH:
                yield np.concatenate([self.encode_all([part])[0] for part in _stretches(text)])
        yield from self.encode_all(held)


def _stretches(text: str) -> Iterator[str]:
    """The text, cut only before a space."""
    at = 0
    while len(text) - at > STRETCH:
        end = text.find(" ", at + STRETCH)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One for each vocabulary and Python worker; the file lies on every machine."""
    return Encoder(path)


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


_PIECE = pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
                    ("length", pa.int64()), ("doc_tokens", pa.int64()), ("crc", pa.int64()), ("ids", pa.list_(pa.int32()))])
_PIECE_SQL = ("part bigint, nth bigint, doc_id bigint, start bigint, length bigint, doc_tokens bigint, crc bigint,"
              " ids array<int>")


def _cut(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            ids = columns[-1]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            plain = [pa.array(values, pa.int64()) for values in columns[:-1]]
            rows.clear()
            return pa.RecordBatch.from_arrays([*plain, lists], schema=_PIECE)

        for texts in slices(batches):
            encoded = encoder.encode([text or "" for text in texts.column(1).to_pylist()])
            for doc_id, own in zip(texts.column(0).to_pylist(), encoded):
                ids = np.append(own, np.int32(end))
                for start in range(0, len(ids), size):
                    piece = ids[start:start + size]
                    rows.append((part, int(seen[len(piece)]), doc_id, start, len(piece), len(ids), crc32(piece), piece))
                    seen[len(piece)] += 1
                    if len(rows) >= BATCH_PIECES:
                        yield batch()
        if rows:
            yield batch()
    return run


def cut_texts(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The texts' ids in pieces of at most ``size``; ``nth`` counts the pieces of a length in a task from 0.

    To be written to a table before anything else: a task's number means nothing
    beyond one run."""
    rows = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "cast(text AS string) AS text")
    return rows.mapInArrow(_cut(path, size, end), _PIECE_SQL)


# ---- pieces and places joined ----

def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        sums = [crc32(i.values.to_numpy()) for i in ids]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "ids_crc32"])


def pack(docs: DataFrame, path: str, scratch: Scratch, size: int = SIZE, end: int = END) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids, ids_crc32``, a row for each piece.

    ``path`` names a vocabulary of the tokenizers library whose tokens never span
    white space."""
    pieces = scratch.table(cut_texts(docs, path, size, end), "pieces")
    numbers = scratch.table(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "numbers")
    counts = {row.length: row.n for row in numbers.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.createDataFrame(
        plan(counts, size), PLACEMENT)
    before = numbers.selectExpr("part AS p", "length AS k", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS before")
    ranked = pieces.join(before, F.expr("part = p AND length = k")).withColumn("rank", F.expr("before + nth"))

    def placed(chosen: str, ids: str) -> DataFrame:
        return ranked.join(F.broadcast(places.where(chosen)),
                           F.expr("length = l AND rank >= first_rank AND rank < first_rank + n")).selectExpr(
            "doc_id", "start + at AS start", "taken AS length", "doc_tokens",
            "first_sequence + (rank - first_rank + skip) div each AS sequence_id",
            "offset + (rank - first_rank + skip) % each * taken AS offset", f"{ids} AS ids", "crc AS ids_crc32")

    cut = placed("taken < l", "slice(ids, cast(at + 1 AS int), cast(taken AS int))").drop("ids_crc32")
    return placed("taken = l", "ids").unionByName(cut.mapInArrow(
        _checked, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint,"
                  " ids array<int>, ids_crc32 bigint"))
