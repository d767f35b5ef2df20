"""The context tree of a whole corpus as tables: every context seen twice is a node.

The tree is that of :mod:`lumenward.llm.context_tree`, and only the contexts seen
less than :data:`LEAST` times, a fixed number, are pooled in their parent's leaf.
So the model has as many nodes as the corpus gives it, and none of them is held by
the driver.  What is kept is a row for each distinct gram (a context of full depth
and the byte after it) of all texts, with its count in the training texts:

* Contexts that share their last :data:`ROOT` bytes are a subtree.  A subtree is
  within one partition, is weighed there bottom-up, and for each of its grams the
  mix down to the subtree's root is written beside the gram.
* The contexts shorter than that, at most 65,793 whatever the corpus, are weighed
  on the driver from their byte counts and the sums over their subtrees.
* Mixing these in gives the log10 probability of each gram, a table.

A text's score is the sum over its grams.  The most frequent grams, at most
:data:`TOP_GRAMS`, go to every worker; the others of a text are looked up by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.llm.context_tree import DEPTH, ContextTree, _counted, _decisions, _grams, _padded, _share, log_kt
from lumenward.llm.words import LOWER, text_buffer
from lumenward.storage import Scratch

#: A context is a node if the training texts hold it this often.
LEAST = 2
#: Subtrees begin at contexts of this many bytes.
ROOT = 3
TOP_GRAMS = 1 << 20
#: Contexts of the driver's part that are weighed together.
TOP_CONTEXTS = 2048
#: Grams weighed together, and valued together.
CHUNK, PIECE = 200_000, 50_000
_U64 = np.uint64
_SUBTREES = "key bigint, places bigint, deep binary, weighted double, zeros bigint, ones bigint"


def _mask(depth: int) -> np.uint64:
    return _U64((1 << (8 * depth)) - 1)


def _path(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions of each gram's byte, and whether each is a one."""
    byte = grams & _U64(0xFF)
    nodes = np.stack([(byte | _U64(256)) >> _U64(8 - k) for k in range(8)], axis=1)
    return nodes, np.stack([(byte >> _U64(7 - k)) & _U64(1) for k in range(8)], axis=1).astype(bool)


def _node_values(n0: np.ndarray, n1: np.ndarray, below: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of contexts with these counts, above subtrees with these sums: the weighted code length, the share
    of ones, the trust in it, and the share of what lies in no subtree."""
    r0, r1 = n0 - below[1], n1 - below[2]
    estimate = log_kt(n0, n1)
    weighted = np.logaddexp(estimate, below[0] + log_kt(r0, r1)) - math.log(2)
    return weighted, _share(n0, n1), np.exp(estimate - math.log(2) - weighted), _share(r0, r1)


def _mixed(q: np.ndarray, mine: np.ndarray, trust: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(q), mine, trust * mine + (1 - trust) * q)


def _weigh(grams: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Weigh whole subtrees.

    For each gram the probabilities of its eight decisions, mixed down to the
    subtree's root, -1 if the root is no node; and the sums of the roots that are
    nodes by parent and decision: keys, log probabilities, zeros and ones."""
    nodes, ones = _path(grams)
    weight = np.repeat(n.astype(np.float64), 8)
    q, live = np.full(nodes.shape, np.nan), np.zeros(len(grams), bool)
    below = None
    for d in range(depth, ROOT - 1, -1):
        context = (grams >> _U64(8)) & _mask(d)
        keys, place = np.unique(((context[:, None] << _U64(8)) | nodes).ravel(), return_inverse=True)
        n1 = np.bincount(place, weight * ones.ravel(), len(keys))
        n0 = np.bincount(place, weight, len(keys)) - n1
        # The first decision of a context is its lowest key; all places of the context pass it.
        first = np.flatnonzero(np.concatenate([[True], keys[1:] >> _U64(8) != keys[:-1] >> _U64(8)]))
        kept = np.repeat((n0 + n1)[first] >= LEAST, np.diff(np.append(first, len(keys))))
        own, estimate, rest = _share(n0, n1), log_kt(n0, n1), np.full(len(keys), np.nan)
        if below is None:
            weighted, trust = estimate, np.ones(len(keys))
        else:
            up = np.searchsorted(keys, below[0])
            r0, r1 = (a - np.bincount(up, b, len(keys)) for a, b in ((n0, below[2]), (n1, below[3])))
            weighted = np.logaddexp(estimate, np.bincount(up, below[1], len(keys)) + log_kt(r0, r1)) - math.log(2)
            trust, rest = np.exp(estimate - math.log(2) - weighted), _share(r0, r1)
        parent = ((keys >> _U64(8)) & _mask(d - 1)) << _U64(8) | (keys & _U64(0xFF))
        below = parent[kept], weighted[kept], n0[kept], n1[kept]
        place = place.reshape(nodes.shape)
        here = kept[place[:, 0]]
        at, bit, new = place[here], ones[here], ~live[here]
        p, mine = rest[at], own[at]
        before = np.where(new[:, None], np.where(bit, p, 1 - p), q[here])
        q[here] = _mixed(before, np.where(bit, mine, 1 - mine), trust[at])
        live |= here
    q[~live] = -1
    parents, place = np.unique(below[0], return_inverse=True)
    return q, (parents, *(np.bincount(place, column, len(parents)) for column in below[1:]))


def _weighed(depth: int):
    def records(grams, n, places):
        q, (parents, weighted, zeros, ones) = _weigh(grams, n, depth)
        count, sums = len(grams), len(parents)
        deep = pa.Array.from_buffers(
            pa.binary(), count, [None, pa.py_buffer((np.arange(count + 1) * 32).astype(np.int32)),
                                 pa.py_buffer(np.ascontiguousarray(q, np.float32))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(grams.view(np.int64)), pa.array(places), deep, pa.nulls(count, pa.float64()),
             pa.nulls(count, pa.int64()), pa.nulls(count, pa.int64())],
            names=["key", "places", "deep", "weighted", "zeros", "ones"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(parents.view(np.int64)), pa.nulls(sums, pa.int64()), pa.nulls(sums, pa.binary()), pa.array(weighted, pa.float64()),
             pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64))],
            names=["key", "places", "deep", "weighted", "zeros", "ones"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, most = [], 0, CHUNK
        for batch in batches:
            parts.append([batch.column(i).to_numpy() for i in range(3)])
            held += batch.num_rows
            if held < most:
                continue
            grams, n, places = (np.concatenate(c) for c in zip(*parts))
            root = (grams >> 8) & int(_mask(ROOT))
            cut = int(np.searchsorted(root, root[-1], "left"))
            if cut:
                yield from records(grams[:cut].view(_U64), n[:cut], places[:cut])
            parts, held = [[grams[cut:], n[cut:], places[cut:]]], held - cut
            most = max(CHUNK, 2 * held)
        if held:
            grams, n, places = (np.concatenate(c) for c in zip(*parts))
            yield from records(grams.view(_U64), n, places)
    return run


class Top:
    """The contexts shorter than a subtree's root: of each kept one and each decision
    its estimate, the trust in it and the estimate of its pooled rest."""

    def __init__(self, counted: pa.Table, sums: pa.Table):
        """From ``key, n``, the counts of the last ROOT bytes, and the sums over subtrees by parent and decision."""
        key, n = counted["key"].to_numpy().astype(_U64), counted["n"].to_numpy()
        self.contexts, counts = [], []
        for d in range(ROOT):
            context, place = np.unique((key >> _U64(8)) & _mask(d), return_inverse=True)
            total = np.bincount(place, n, len(context))
            kept = total >= LEAST if d else np.ones(len(context), bool)
            self.contexts.append(context[kept] if d or len(context) else np.zeros(1, _U64))
            mine = kept[place]
            row = (np.cumsum(kept) - 1)[place[mine]]
            if d < ROOT - 1:
                counts.append(np.zeros((len(self.contexts[d]), 256)))
                np.add.at(counts[d], (row, (key[mine] & _U64(0xFF)).astype(np.intp)), n[mine])
            if d == ROOT - 1:
                deepest = row, (key[mine] & _U64(0xFF)).astype(np.intp), n[mine]
        self.own, self.trust, self.rest = [None] * ROOT, [None] * ROOT, [None] * ROOT
        below = self._weigh_deepest(deepest, sums)
        for d in range(ROOT - 2, -1, -1):
            n0, n1 = _decisions(counts[d])
            weighted, self.own[d], self.trust[d], self.rest[d] = _node_values(n0, n1, below)
            if d:
                up = np.searchsorted(self.contexts[d - 1], self.contexts[d] & _mask(d - 1))
                below = [np.zeros((len(self.contexts[d - 1]), 255)) for _ in range(3)]
                for array, of in zip(below, (weighted, n0, n1)):
                    np.add.at(array, up, of)

    def _weigh_deepest(self, counted: tuple, sums: pa.Table) -> list[np.ndarray]:
        """The contexts just above the subtrees, some at a time: of these there are up to 65,536 with 255
        decisions each, of which only those seen are kept; the sums over them for their parents."""
        contexts, d = self.contexts[-1], ROOT - 1
        row, byte, n = counted
        keys = sums["key"].to_numpy().astype(_U64)
        sum_row, node = np.searchsorted(contexts, keys >> _U64(8)), (keys & _U64(0xFF)).astype(np.intp) - 1
        of_sums = [sums[name].to_numpy() for name in ("weighted", "zeros", "ones")]
        by_row, by_sum_row = np.argsort(row, kind="stable"), np.argsort(sum_row, kind="stable")
        above = [np.zeros((len(self.contexts[d - 1]), 255)) for _ in range(3)]
        up = np.searchsorted(self.contexts[d - 1], contexts & _mask(d - 1))
        kept: list[list[np.ndarray]] = [[], [], [], []]
        for at in range(0, len(contexts), TOP_CONTEXTS):
            m = min(TOP_CONTEXTS, len(contexts) - at)
            mine = by_row[slice(*np.searchsorted(row[by_row], [at, at + m]))]
            counts = np.zeros((m, 256))
            np.add.at(counts, (row[mine] - at, byte[mine]), n[mine])
            below = [np.zeros((m, 255)) for _ in range(3)]
            mine = by_sum_row[slice(*np.searchsorted(sum_row[by_sum_row], [at, at + m]))]
            for array, values in zip(below, of_sums):
                array[sum_row[mine] - at, node[mine]] = values[mine]
            n0, n1 = _decisions(counts)
            weighted, *values = _node_values(n0, n1, below)
            live = np.flatnonzero((n0 + n1).ravel() > 0)
            for column, array in zip(kept, (None, *values)):
                column.append(live + at * 255 if array is None else array.ravel()[live].astype(np.float32))
            for array, of in zip(above, (weighted, n0, n1)):
                np.add.at(array, up[at:at + m], of)
        # A decision that was never seen is an even one in every respect; it is found at the end.
        self.seen = np.concatenate([np.zeros(0, np.int64), *kept[0]])
        self.own[d], self.trust[d], self.rest[d] = (
            np.concatenate([*column, np.full(1, 0.5, np.float32)]) for column in kept[1:])
        return above

    def _places(self, d: int, row: np.ndarray, nodes: np.ndarray):
        """Where the values of decisions of contexts stand."""
        if d < ROOT - 1:
            return row[:, None], nodes
        wanted = row[:, None] * 255 + nodes
        place = np.searchsorted(self.seen, wanted)
        found = place < len(self.seen)
        found[found] = self.seen[place[found]] == wanted[found]
        return np.where(found, place, len(self.seen))

    def log10(self, grams: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The log10 probability of each gram's byte, given what its subtree has mixed."""
        nodes, ones = _path(grams)
        nodes = nodes.astype(np.intp) - 1
        live = q[:, 0] != -1
        q = np.where(live[:, None], q, np.nan)
        for d in range(ROOT - 1, -1, -1):
            context = (grams >> _U64(8)) & _mask(d)
            row = np.minimum(np.searchsorted(self.contexts[d], context), max(len(self.contexts[d]) - 1, 0))
            here = np.flatnonzero(self.contexts[d][row] == context) if len(self.contexts[d]) else np.zeros(0, np.intp)
            at, bit = self._places(d, row[here], nodes[here]), ones[here]
            p, mine = self.rest[d][at], self.own[d][at]
            before = np.where(live[here][:, None], q[here], np.where(bit, p, 1 - p))
            q[here] = _mixed(before, np.where(bit, mine, 1 - mine), self.trust[d][at])
            live[here] = True
        return np.log10(np.where(np.isnan(q), 0.5, q)).sum(axis=1)


def gram_scores(docs: DataFrame, scratch: Scratch, depth: int = DEPTH) -> DataFrame:
    """``gram, places, value`` of every gram of (text, held_out): how often the texts
    hold it, and the log10 probability of its byte learned from those not held out.

    Depths from ROOT to 6 can be had."""
    with Scratch(docs.sparkSession) as inner:
        grams = inner.table(
            docs.selectExpr("coalesce(cast(text AS string), '') AS text", "held_out")
            .mapInArrow(_counted(depth, tagged=True), "gram bigint, n bigint")
            .groupBy(F.expr("shiftrightunsigned(gram, 1)").alias("gram"))
            .agg(F.sum(F.expr("if(gram & 1L = 0, n, 0L)")).alias("n"), F.sum("n").alias("places")), "grams")
        root = F.expr(f"shiftrightunsigned(gram, 8) & {int(_mask(ROOT))}L")
        subtrees = inner.table(
            grams.repartition(root).sortWithinPartitions(root).mapInArrow(_weighed(depth), _SUBTREES), "subtrees")
        counted = grams.where("n > 0").groupBy(F.expr(f"gram & {int(_mask(ROOT))}L").alias("key")).agg(F.sum("n").alias("n"))
        sums = subtrees.where("places IS NULL").groupBy("key").agg(
            *[F.sum(c).alias(c) for c in ("weighted", "zeros", "ones")])
        top = scratch.spark.sparkContext.broadcast(Top(counted.toArrow(), sums.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, PIECE):
                    part = batch.slice(at, PIECE)
                    q = np.frombuffer(b"".join(part.column(2).to_pylist()), np.float32).reshape(-1, 8)
                    value = top.value.log10(part.column(0).to_numpy().view(_U64), q.astype(np.float64))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(value)], names=["gram", "places", "value"])

        values = scratch.table(
            subtrees.where("places IS NOT NULL").select("key", "places", "deep")
            .mapInArrow(run, "gram bigint, places bigint, value double"), "values")
        top.destroy()
        return values


class GramTable:
    """The values of the most frequent grams."""

    def __init__(self, table: pa.Table, depth: int = DEPTH):
        self.depth = depth
        self.slots = ContextTree._slots(table["gram"].to_numpy().astype(_U64))
        # A gram that is not here is found at -1, the last.
        self.values = np.append(table["value"].to_numpy(), 0.0)

    def score(self, column: pa.Array, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sum over each text's grams that are here; the others, in order, and the text of each."""
        data, bounds = text_buffer(column)
        padded, wanted = _padded(LOWER[data], bounds, self.depth)
        begins = bounds[:-1] + np.arange(len(bounds) - 1) * self.depth
        out, others, owners = np.zeros(len(bounds) - 1), [np.zeros(0, _U64)], [np.zeros(0, np.intp)]
        for at in range(0, len(wanted), chunk):
            grams = _grams(padded[at:at + chunk + self.depth], self.depth)
            mine = wanted[at:at + chunk]
            found = ContextTree._find(grams, *self.slots)
            value = np.where(mine, self.values[found], 0.0)
            one, last = np.searchsorted(begins, at, "right") - 1, np.searchsorted(begins, at + len(grams), "left")
            out[one:last] += np.add.reduceat(value, np.maximum(begins[one:last] - at, 0))
            missing = np.flatnonzero(mine & (found < 0))
            others.append(grams[missing])
            owners.append(np.searchsorted(begins, missing + at, "right") - 1)
        return out, np.concatenate(others), np.concatenate(owners)
