"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a budget of words.  Whole passes over the source come first; for
the rest of the budget, documents are counted by their exact length, all of it but
a reserve is shared out over the lengths in proportion, and a bounded knapsack over
all documents left (dynamic programming on reachable sums) closes the gap.  Which
documents of a length are taken is decided by a seeded hash of their ids.

Only counts by (source, length) are brought together, one source to a task;
documents are never sorted by source, and a (source, length) with many documents
is cut into hash ranges, of which at most one needs a ranking.

Defined results: null and empty texts have size 0 and are never taken beyond the
whole passes; a source without words has target 0; null is a source of its own,
the last; repeated rows count as documents of their own, which of them is taken
is then arbitrary but the table of results is not; an empty table gives an empty
one.  Columns other than id, source and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.operators.numbering import with_row_numbers
from lumenward.storage import Scratch

WORD = r"[^\\x20\\x09-\\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
SEED = 20240
#: Words of a budget that are left to the knapsack: this many, or this often the longest document.
RESERVE_SUMS = 1 << 17
RESERVE_LONGEST = 8
#: Documents of one (source, length) to a hash range; only one range of each is ranked.
RANGE_DOCUMENTS = 512


def capped_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MAX_REPEATS,
                   scratch: Scratch | None = None) -> DataFrame:
    """Add ``target`` to a table of (source, source_size), a row for each source.

    Sources in code point order, null last, have the weights in turn and share
    the sum of all sizes; no target exceeds ``most`` times its source's size,
    the excess goes to the others by weight, until none is above.  Every round is
    two sums over the sources; only those sums reach the driver."""
    ranked = with_row_numbers(
        sizes.selectExpr("source", "source_size", "source IS NULL AS _last", "coalesce(source, '') AS _name"),
        ["_last", "_name"], "_rank", scratch)
    listed = ", ".join(f"{w}D" for w in weights)
    ranked = ranked.selectExpr("source", "source_size", f"array({listed})[cast((_rank - 1) % {len(weights)} AS int)] AS _weight",
                               f"{float(most)}D * source_size AS _cap")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, n_capped = 0.0, -1
    while True:
        open_ = f"_weight * {share!r}D < _cap" if n_capped >= 0 else "true"
        row = ranked.selectExpr(
            f"coalesce(sum(if({open_}, _weight, 0D)), 0D) AS w", f"coalesce(sum(if({open_}, 0D, _cap)), 0D) AS c",
            f"count_if(NOT ({open_})) AS n").first()
        if row.n == n_capped or not row.w:
            break
        n_capped, share = row.n, max(0.0, float(total) - row.c) / row.w
    return ranked.selectExpr("source", "source_size", f"least(_cap, _weight * {share!r}D) AS target")


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each length to take, for a sum as near to ``budget`` as found.

    All of the budget but a reserve, :data:`RESERVE_LONGEST` times the longest document or
    :data:`RESERVE_SUMS` if that is more, is shared out over the lengths in
    proportion.  What is no whole document is rounded, lengths taking turns in a
    seeded order, so that the words rounded up and down stay within half of the longest
    document.  The knapsack then chooses among all documents left for the rest of
    the budget.  A budget within the reserve is all knapsack, and hit as nearly as any
    choice of documents does."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    order = [i for i in np.random.Generator(np.random.PCG64(seed)).permutation(len(lengths)).tolist()
             if lengths[i] > 0 and counts[i] > 0]
    shared = max(0, budget - max(RESERVE_SUMS, RESERVE_LONGEST * int(lengths[order].max())))
    owed = 0.0  # words rounded down so far, less those rounded up
    for i in order:
        taken[i], left = divmod(int(counts[i]) * shared, total)
        share = left / total * float(lengths[i])
        if left and owed + share >= lengths[i] / 2:
            taken[i] += 1
            share -= float(lengths[i])
        owed += share
    gap = budget - int((lengths * taken).sum())
    return taken + _knapsack(lengths, counts - taken, gap, order)


def _mark(sums: int, n: int, part: int, via: np.ndarray) -> None:
    """Note the part at the places of the ones among the lowest n bits."""
    raw = np.frombuffer(sums.to_bytes(n // 8 + 1, "little"), np.uint8)
    for at in range(0, len(raw), 1 << 17):
        block = raw[at:at + (1 << 17)]
        if block.any():
            places = np.flatnonzero(np.unpackbits(block, bitorder="little")) + 8 * at
            via[places[places < n]] = part


def _knapsack(lengths: np.ndarray, left: np.ndarray, gap: int, order) -> np.ndarray:
    """Bounded knapsack: counts whose sum is the reachable one nearest to ``gap``.

    A length's count is split into parts of 1, 2, 4, ... documents.  The sums that
    are reachable are the ones of a long integer; adding a part is a shift.  A sum
    remembers the part that reached it first, and the sum before it was reached by
    earlier parts only, so walking back uses no part twice."""
    out = np.zeros(len(lengths), np.int64)
    usable = [i for i in order if left[i] > 0]
    if gap <= 0 or not usable:
        return out
    # The nearest sum may lie above the gap, by less than the longest document.
    limit = gap + min(gap, int(lengths[usable].max()))
    reached, full, most, parts = 1, (1 << (limit + 1)) - 1, 0, []
    via = np.full(limit + 1, -1, np.int32)
    for i in usable:
        n, size = min(int(left[i]), limit // int(lengths[i])), 1
        while n > 0 and via[gap] < 0:
            size = min(size, n)
            weight = int(lengths[i]) * size
            new = (reached << weight) & full & ~reached
            most = min(limit, most + weight)
            _mark(new, most + 1, len(parts), via)
            parts.append((weight, i, size))
            reached |= new
            n, size = n - size, size * 2
    via[0] = 0
    sums = np.flatnonzero(via >= 0)
    at = int(sums[np.argmin(np.abs(sums - gap))])
    while at > 0:
        weight, i, size = parts[via[at]]
        out[i] += size
        at -= weight
    return out


def _fit_source(seed: int):
    def run(counts: pd.DataFrame) -> pd.DataFrame:
        target, size, source = float(counts["target"].iloc[0]), int(counts["source_size"].iloc[0]), counts["source"].iloc[0]
        counts = counts.sort_values("size", kind="stable")
        budget = int(np.floor(target + 0.5))
        passes = min(budget // size, MAX_REPEATS) if size else 0
        rest = budget - passes * size if passes < MAX_REPEATS else 0
        own_seed = seed if pd.isna(source) else seed + zlib.crc32(source.encode()) + 1
        chosen = fit_counts(counts["size"].to_numpy(), counts["n"].to_numpy(), rest, own_seed)
        return pd.DataFrame({
            "source": counts["source"], "size": counts["size"], "n": counts["n"], "source_size": size, "target": target,
            "passes": passes, "chosen": chosen})
    return run


def mix(sized: DataFrame, scratch: Scratch, seed: int = SEED, weights=WEIGHTS) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of a table of (doc_id, source, size).

    ``copies`` is how often the mix holds the document, ``taken`` its words times that."""
    drawn = scratch.table(
        sized.selectExpr("doc_id", "source", "cast(size AS bigint) AS size",
                         f"xxhash64({int(seed)}L, doc_id) AS _draw"), "sized")
    by_length = scratch.table(drawn.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sizes = by_length.groupBy("source").agg(F.sum(F.expr("size * n")).alias("source_size"))
    targets = scratch.table(capped_targets(sizes, weights, scratch=scratch), "targets")
    budgets = by_length.join(targets, by_length["source"].eqNullSafe(targets["source"])).select(
        by_length["source"], "size", "n", "source_size", "target")
    fitted = scratch.table(
        budgets.groupBy("source").applyInPandas(
            _fit_source(int(seed)), "source string, size bigint, n bigint, source_size bigint, target double, passes bigint, chosen bigint"),
        "fitted")

    def on_length(docs: DataFrame, table: DataFrame) -> DataFrame:
        keys = table.withColumnsRenamed({"source": "_source", "size": "_size"})
        return docs.join(keys, F.expr("source <=> _source AND size = _size"))

    # Ranges of the draws, about RANGE_DOCUMENTS in each, in the order of the draws.
    ranged = on_length(drawn, fitted).selectExpr(
        "*", f"least(n div {RANGE_DOCUMENTS}, cast((_draw / 18446744073709551616D + 0.5D) * (n div {RANGE_DOCUMENTS} + 1) AS bigint)) AS _range")
    counted = ranged.groupBy("source", "size", "_range", "chosen").agg(F.count("*").alias("_in"))
    before = counted.selectExpr(
        "source AS _rs", "size AS _rz", "_range AS _rr",
        "sum(_in) OVER (PARTITION BY source, size ORDER BY _range) - _in AS _before", "_in", "chosen AS _chosen")
    # Of each (source, size), the range in which the choice ends; ranges before it are taken whole.
    ends = scratch.table(before.where("_before < _chosen AND _chosen < _before + _in").selectExpr(
        "_rs", "_rz", "_rr", "_chosen - _before AS _want"), "ends")
    full = scratch.table(before.where("_chosen >= _before + _in").groupBy("_rs", "_rz").agg(F.max("_rr").alias("_full")), "full")
    marked = ranged.join(full, F.expr("source <=> _rs AND size = _rz"), "left").drop("_rs", "_rz").join(
        ends, F.expr("source <=> _rs AND size = _rz AND _range = _rr"), "left")
    edge = marked.where("_want IS NOT NULL").selectExpr(
        "doc_id", "size", "source_size", "target", "passes",
        "if(row_number() OVER (PARTITION BY source, size ORDER BY _draw, doc_id) <= _want, 1, 0) AS extra")
    rest = marked.where("_want IS NULL").selectExpr(
        "doc_id", "size", "source_size", "target", "passes", "if(_range <= _full, 1, 0) AS extra")
    return rest.unionByName(edge).selectExpr(
        "doc_id", "size", "source_size", "target", "(passes + extra) * size AS taken", "passes + extra AS copies")


def word_count(text: str) -> str:
    return f"cast(coalesce(regexp_count({text}, '{WORD}'), 0) AS bigint)"


def mixed_documents(docs: DataFrame, scratch: Scratch, seed: int = SEED) -> DataFrame:
    """The documents of the mix, a row for each copy, with the columns they had.

    Rows are told apart by a number given once, as ids may repeat."""
    numbered = scratch.table(docs.selectExpr(
        "monotonically_increasing_id() AS _row", f"struct({', '.join(f'`{c}`' for c in docs.columns)}) AS _document"), "documents")
    sized = numbered.selectExpr("_row AS doc_id", "_document.source AS source", f"{word_count('_document.text')} AS size")
    chosen = mix(sized, scratch, seed).where("copies > 0").selectExpr("doc_id AS _chosen_row", "copies")
    return numbered.join(chosen, F.expr("_row = _chosen_row")).selectExpr(
        "explode(sequence(1L, copies)) AS _copy", "_document").selectExpr(
        *[f"_document.`{c}` AS `{c}`" for c in docs.columns])
