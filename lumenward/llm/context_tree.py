"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, its bits from the highest.  Each of the 255
decisions has a context tree of its own, whose nodes are the bytes before: the
root knows none, its children one, and so on.  A node estimates its decision by
Krichevsky-Trofimov from the two counts it has seen; context-tree weighting mixes
the estimates of all depths, each node giving half its trust to its own estimate
and half to the product of what lies deeper.  With counts at hand all of that has
closed forms, so training is counting: one pass gathers how often each byte
follows each context in the training texts.

:mod:`lumenward.llm.context_table` does this for a corpus, with a node for every
context seen twice.  :class:`ContextTree` here is the same tree held in memory, for
small ones: a context is a node of its own if it is at least one in
:data:`CONTEXT_SHARE` of all places, a kept one taking about 5 KB while the tree is
weighed.  A node's rarer contexts are pooled in one leaf, so no count is dropped.
The prediction after a context follows its path as far as counts reach.

A text is its bytes, A-Z in lower case, and an end mark, the byte FF, which also
stands before the text; FF occurs in no UTF-8 text.  Null and empty texts are an
end mark only.  Without any training text each decision is a half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.llm.words import LOWER, slices, text_buffer
from lumenward.storage import Scratch

DEPTH = 5
CONTEXT_SHARE = 1 << 16
END = 0xFF
#: Contexts weighed together on the driver.
CHUNK = 2048
_U64 = np.uint64


def _padded(data: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts with ``depth`` end marks before each and after the last; for each
    place from ``depth`` on, whether its symbol is to be predicted, which of the
    marks between two texts only the first is."""
    n = len(bounds) - 1
    out = np.full(len(data) + (n + 1) * depth, END, np.uint8)
    marks = (bounds[:, None] + np.arange(n + 1)[:, None] * depth + np.arange(depth)).ravel()
    is_text = np.ones(len(out), bool)
    is_text[marks] = False
    out[is_text] = data
    is_text[bounds[1:] + np.arange(1, n + 1) * depth] = True
    return out, is_text[depth:]


def _grams(padded: np.ndarray, depth: int) -> np.ndarray:
    """For each symbol from place ``depth`` on, the symbols up to it as one integer, the oldest highest."""
    n = len(padded) - depth
    key = padded[:n].astype(_U64)
    for later in range(1, depth + 1):
        key <<= _U64(8)
        key |= padded[later:later + n]
    return key


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(depth: int, most: int = 2_000_000, tagged: bool = False):
    """Counts of grams; tagged ones end in a bit that says whether their text is ``held_out``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(part):
            return pa.RecordBatch.from_arrays(
                [pa.array(part[0].view(np.int64)), pa.array(part[1])], names=["gram", "n"])

        parts, held = [], 0
        for part in slices(batches, "text"):
            data, bounds = text_buffer(part.column(0))
            padded, wanted = _padded(LOWER[data], bounds, depth)
            grams = _grams(padded, depth)
            if tagged:
                held_out = part.column(1).to_numpy(zero_copy_only=False).astype(_U64)
                grams = (grams << _U64(1)) | np.repeat(held_out, np.diff(bounds) + depth)
            keys, counts = np.unique(grams[wanted], return_counts=True)
            parts.append((keys, counts.astype(np.int64)))
            held += len(keys)
            if held > most:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > most // 2:
                    yield record(parts[0])
                    parts, held = [], 0
        if parts:
            yield record(_merged(parts))
    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted up by eight."""
    y, shift = x + 8.0, np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (
        1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives a sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The zeros and ones seen at each of the 255 decisions, for rows of 256 byte counts.

    Decision i leads to 2i or 2i + 1; byte b is the leaf 256 + b."""
    tree = np.zeros((len(counts), 512))
    tree[:, 256:] = counts
    for i in range(255, 0, -1):
        tree[:, i] = tree[:, 2 * i] + tree[:, 2 * i + 1]
    return tree[:, 2::2][:, :255], tree[:, 3::2][:, :255]


def _share(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The estimate that the decision is a one; nan where nothing was seen."""
    return np.where(n0 + n1 > 0, (n1 + 0.5) / (n0 + n1 + 1.0), np.nan)


@dataclass
class ContextTree:
    """For each kept context, shortest first, the log10 probability of each byte
    where no longer context is kept.  ``slots`` finds contexts by hash."""
    depth: int
    contexts: list[np.ndarray]
    log10: np.ndarray
    slots: list[tuple[np.ndarray, np.ndarray, int] | None]

    @classmethod
    def build(cls, depth: int, contexts: list[np.ndarray], counts: list[np.ndarray]) -> ContextTree:
        """From sorted contexts and their byte counts by depth; the root is depth 0."""
        own, weights, rests = ([np.empty((len(c), 255), np.float32) for c in contexts] for _ in range(3))
        weighted = None
        for d in range(depth, -1, -1):
            rest, deeper = None, None
            if d < depth:
                rest, deeper = counts[d].copy(), np.zeros((len(contexts[d]), 255))
                if len(contexts[d + 1]):
                    parent = np.searchsorted(contexts[d], contexts[d + 1] & _U64((1 << (8 * d)) - 1))
                    np.subtract.at(rest, parent, counts[d + 1])
                    np.add.at(deeper, parent, weighted)
            weighted = np.empty((len(contexts[d]), 255))
            for at in range(0, len(contexts[d]), CHUNK):
                part = slice(at, at + CHUNK)
                n0, n1 = _decisions(counts[d][part])
                estimate = log_kt(n0, n1)
                own[d][part] = _share(n0, n1)
                if d == depth:
                    weighted[part], weights[d][part], rests[d][part] = estimate, 1.0, np.nan
                    continue
                r0, r1 = _decisions(rest[part])
                weighted[part] = np.logaddexp(estimate, deeper[part] + log_kt(r0, r1)) - math.log(2)
                weights[d][part] = np.exp(estimate - math.log(2) - weighted[part])
                rests[d][part] = _share(r0, r1)
        rows = [cls._row(d, contexts, own, weights, rests) for d in range(depth + 1)]
        slots = [cls._slots(contexts[d]) if d > 2 else None for d in range(depth + 1)]
        return cls(depth, contexts, np.concatenate(rows), slots)

    @staticmethod
    def _row(d: int, contexts, own, weights, rests) -> np.ndarray:
        out = np.empty((len(contexts[d]), 256), np.float32)
        for at in range(0, len(out), CHUNK):
            keys = contexts[d][at:at + CHUNK]
            p = rests[d][at:at + CHUNK].astype(np.float64)
            for a in range(d, -1, -1):
                up = np.searchsorted(contexts[a], keys & _U64((1 << (8 * a)) - 1))
                mine, trust = own[a][up], weights[a][up]
                p = np.where(np.isnan(p), mine, trust * mine + (1 - trust) * p)
            p = np.where(np.isnan(p), 0.5, p)
            total = np.zeros((len(keys), 512))
            for i in range(1, 256):
                total[:, 2 * i] = total[:, i] + np.log10(1 - p[:, i - 1])
                total[:, 2 * i + 1] = total[:, i] + np.log10(p[:, i - 1])
            out[at:at + CHUNK] = total[:, 256:]
        return out

    @staticmethod
    def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """An open-addressing table of the keys, and the most steps a key is away from its place."""
        bits = max(4, int(len(keys) * 4).bit_length())
        table, value = np.full(1 << bits, ~_U64(0)), np.full(1 << bits, -1, np.int32)
        left, steps = np.arange(len(keys)), 0
        home = _home(keys, bits)
        while len(left):
            place = (home[left] + steps) & ((1 << bits) - 1)
            free = table[place] == ~_U64(0)
            _, first = np.unique(place, return_index=True)
            wins = np.zeros(len(left), bool)
            wins[first] = True
            wins &= free
            table[place[wins]], value[place[wins]] = keys[left[wins]], left[wins]
            left, steps = left[~wins], steps + 1
        return table, value, steps

    def rows_of(self, grams: np.ndarray) -> np.ndarray:
        """For each context and byte, the row of its longest kept context."""
        offset = np.concatenate([[0], np.cumsum([len(c) for c in self.contexts])])
        row = np.zeros(len(grams), np.int32)
        short = min(2, self.depth)
        if len(self.contexts[1]):
            direct = np.zeros(1 << (8 * short), np.int32)
            lowest = np.arange(len(direct)) & 0xFF
            first = np.zeros(256, np.int32)
            first[self.contexts[1].astype(np.int64)] = offset[1] + np.arange(len(self.contexts[1]))
            direct[:] = first[lowest]
            if short == 2:
                direct[self.contexts[2].astype(np.int64)] = offset[2] + np.arange(len(self.contexts[2]))
            row = direct[((grams >> _U64(8)) & _U64(len(direct) - 1)).astype(np.intp)]
        alive = np.flatnonzero(row >= offset[2]) if short == 2 else np.zeros(0, np.intp)
        held = grams[alive] >> _U64(8)
        for d in range(3, self.depth + 1):
            if not len(self.contexts[d]) or not len(alive):
                break
            found = self._find(held & _U64((1 << (8 * d)) - 1), *self.slots[d])
            kept = np.flatnonzero(found >= 0)
            alive, held = alive[kept], held[kept]
            row[alive] = found[kept] + np.int32(offset[d])
        return row

    @staticmethod
    def _find(key: np.ndarray, table: np.ndarray, value: np.ndarray, steps: int) -> np.ndarray:
        place = _home(key, len(table).bit_length() - 1)
        seen = table[place]
        found = np.where(seen == key, value[place], np.int32(-1))
        open_ = np.flatnonzero((seen != key) & (seen != ~_U64(0)))
        for _ in range(steps - 1):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & (len(table) - 1)
            seen = table[place[open_]]
            hit = seen == key[open_]
            found[open_[hit]] = value[place[open_[hit]]]
            open_ = open_[~hit & (seen != ~_U64(0))]
        return found

    def score(self, column: pa.Array, chunk: int = 1 << 19) -> np.ndarray:
        """log10 probability of each text of a column."""
        data, bounds = text_buffer(column)
        padded, wanted = _padded(LOWER[data], bounds, self.depth)
        # Texts end with their first end mark; what is not predicted counts nothing.
        begins = bounds[:-1] + np.arange(len(bounds) - 1) * self.depth
        out, flat = np.zeros(len(bounds) - 1), self.log10.ravel()
        for at in range(0, len(wanted), chunk):
            grams = _grams(padded[at:at + chunk + self.depth], self.depth)
            place = self.rows_of(grams).astype(np.intp) * 256
            place += padded[at + self.depth:at + self.depth + len(grams)]
            value = np.where(wanted[at:at + chunk], flat[place], np.float32(0)).astype(np.float64)
            one, last = np.searchsorted(begins, at, "right") - 1, np.searchsorted(begins, at + len(grams), "left")
            out[one:last] += np.add.reduceat(value, np.maximum(begins[one:last] - at, 0))
        return out


def _home(keys: np.ndarray, bits: int) -> np.ndarray:
    """Each key's first place in a table of that many bits."""
    return ((keys * _U64(0x9E3779B97F4A7C15)) >> _U64(64 - bits)).astype(np.intp)


def train(texts: DataFrame, depth: int = DEPTH, share: int = CONTEXT_SHARE, text: str = "text") -> ContextTree:
    """Count all training texts and weigh the tree.

    The grams of full depth are summed over the corpus; those of a shorter
    context are sums of these.  A context's bytes, at most 256, are put together
    by it, and only the contexts frequent enough come to the driver."""
    with Scratch(texts.sparkSession) as inner:
        return _train(texts.selectExpr(f"coalesce(cast(`{text}` AS string), '') AS text"), inner, depth, share)


def _train(rows: DataFrame, scratch: Scratch, depth: int, share: int) -> ContextTree:
    grams = scratch.table(
        rows.mapInArrow(_counted(depth), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    contexts, counts, least = [None] * (depth + 1), [None] * (depth + 1), None
    total = grams.agg(F.sum("n")).first()[0] or 0
    least = max(2, -(-total // share))
    for d in range(depth, -1, -1):
        mask = (1 << (8 * (d + 1))) - 1
        if d < depth:
            grams = scratch.table(
                grams.groupBy(F.expr(f"gram & {mask}L").alias("gram")).agg(F.sum("n").alias("n")), f"grams{d}")
        kept = (
            grams.groupBy(F.expr("shiftrightunsigned(gram, 8)").alias("context"))
            .agg(F.sum("n").alias("total"), F.collect_list(F.struct(F.expr("gram & 255L").alias("byte"), "n")).alias("bytes"))
            .where(f"total >= {least}" if d else "true")
            .selectExpr("context", "inline(bytes) AS (byte, n)").toArrow())
        key = kept["context"].to_numpy().astype(_U64)
        contexts[d] = np.unique(key) if d else np.zeros(1, _U64)
        counts[d] = np.zeros((len(contexts[d]), 256))
        counts[d][np.searchsorted(contexts[d], key), kept["byte"].to_numpy()] = kept["n"].to_numpy()
    return ContextTree.build(depth, contexts, counts)
