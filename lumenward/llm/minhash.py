"""Near-duplicate texts by circulant MinHash, confirmed on the full sets.

A text's set is its distinct shingles.  Two permutations make all signature
coordinates: one scatters a shingle over the places of the other, and that one is
read from there on, shifted by one place for each coordinate, so that the values
of all coordinates lie side by side.  Bands of coordinates propose candidates.

Nothing is lost beyond what banding may miss (see :func:`miss_probability`), and
no group of copies is expanded into pairs:

1. Equal sets are one *class*, found by a digest of the whole set.
2. In every bucket each class is compared with the smallest one only.
3. Classes in buckets that hold different components after that, the rest, are
   joined on their rarest shingles, an exact condition for a link, and compared
   across components.

Comparison reads both texts again and intersects their full sets.

Defined results: a null, empty or blank text has an empty set and links with
nothing; a text of fewer words than a shingle has its whole sequence as its only
shingle; very long texts are used whole; rows with the same id are one node of
the links, joined if any of them is; a row without an id has no component and
is kept; an empty table gives an empty one.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.llm.components import components
from lumenward.llm.words import LOWER, mix64, slices, text_buffer, window_hashes, word_hashes, word_spans
from lumenward.storage import Scratch

#: Places of the circulant permutation.
PLACES = 1 << 20
#: Shingles whose coordinates are computed together, which bounds a worker's memory.
STRIDE = 1 << 14


@dataclass(frozen=True)
class Settings:
    """``percent`` of the union that the intersection must reach; bands of rows."""
    width: int = 5
    percent: int = 80
    bands: int = 25
    rows: int = 5
    seed: int = 7


def miss_probability(settings: Settings) -> float:
    """The chance that a pair just at the threshold shares no band."""
    return (1 - (settings.percent / 100) ** settings.rows) ** settings.bands


@lru_cache(maxsize=2)
def _circulant(seed: int, coordinates: int) -> np.ndarray:
    """The permutation with its beginning appended; row p holds a shingle's values for all coordinates."""
    order = np.random.Generator(np.random.PCG64(seed)).permutation(PLACES).astype(np.uint32)
    ring = np.concatenate([order, order[:coordinates - 1]])
    return np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one after the other, and their numbers."""
    data, bounds = text_buffer(column)
    data = LOWER[data]
    starts, ends, counts = word_spans(data, bounds)
    shingles, per_row = window_hashes(word_hashes(data, starts, ends), counts, width)
    row = np.repeat(np.arange(len(per_row)), per_row)
    order = np.lexsort((shingles, row))
    shingles, row = shingles[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (row[1:] != row[:-1])
    return shingles[new], np.bincount(row[new], minlength=len(per_row))


def signatures(shingles: np.ndarray, sizes: np.ndarray, settings: Settings) -> np.ndarray:
    """One row of coordinates for each non-empty set."""
    k = settings.bands * settings.rows
    table = _circulant(settings.seed, k)
    place = (mix64(shingles + np.uint64(settings.seed)) >> np.uint64(44)).astype(np.int64) & (PLACES - 1)
    filled = np.flatnonzero(sizes)
    out = np.full((len(filled), k), np.iinfo(np.uint32).max, np.uint32)
    first = np.cumsum(sizes[filled]) - sizes[filled]
    for at in range(0, len(place), STRIDE):
        stop = min(at + STRIDE, len(place))
        one, last = np.searchsorted(first, at, "right") - 1, np.searchsorted(first, stop, "left")
        begins = np.maximum(first[one:last] - at, 0)
        least = np.minimum.reduceat(table[place[at:stop]], begins, axis=0)
        out[one:last] = np.minimum(out[one:last], least)
    return out


def band_keys(signature: np.ndarray, settings: Settings) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    parts = signature.reshape(len(signature), settings.bands, settings.rows)
    key = np.broadcast_to(np.arange(1, settings.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(settings.rows):
        key = mix64(key) + parts[:, :, j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(key).view(np.int64)


def _signed(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            shingles, sizes = shingle_sets(part.column(1), settings.width)
            keys = band_keys(signatures(shingles, sizes, settings), settings)
            stops = np.cumsum(sizes)
            digests = [hashlib.blake2b(shingles[b - n:b].tobytes(), digest_size=16).digest() if n else None
                       for b, n in zip(stops, sizes)]
            offsets = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(np.where(sizes > 0, settings.bands, 0), out=offsets[1:])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
                names=["doc_id", "n_shingles", "digest", "bands"])
    return run


def _compared(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("text_a", "text_b"):
                column = batch.column(batch.schema.get_field_index(name))
                sides.append(column)
            kept = np.zeros(batch.num_rows, bool)
            at = 0
            while at < batch.num_rows:
                stop, size = at, 0
                while stop < batch.num_rows and (stop == at or size < (2 << 20)):
                    size += len(sides[0][stop].as_buffer()) + len(sides[1][stop].as_buffer())
                    stop += 1
                a, n_a = shingle_sets(sides[0].slice(at, stop - at), settings.width)
                b, n_b = shingle_sets(sides[1].slice(at, stop - at), settings.width)
                row = np.concatenate([np.repeat(np.arange(stop - at), n_a), np.repeat(np.arange(stop - at), n_b)])
                both = np.concatenate([a, b])
                order = np.lexsort((both, row))
                same = (both[order][1:] == both[order][:-1]) & (row[order][1:] == row[order][:-1])
                shared = np.bincount(row[order][1:][same], minlength=stop - at)
                kept[at:stop] = (shared > 0) & (100 * shared >= settings.percent * (n_a + n_b - shared))
                at = stop
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(kept)) for i in range(2)], names=["a", "b"])
    return run


def confirmed(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a = texts.selectExpr("doc_id AS _ia", "text AS text_a")
    b = texts.selectExpr("doc_id AS _ib", "text AS text_b")
    joined = pairs.join(a, F.col("a") == F.col("_ia")).join(b, F.col("b") == F.col("_ib"))
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_compared(settings), "a bigint, b bigint")


def _sets(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            shingles, sizes = shingle_sets(part.column(1), settings.width)
            offsets = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingles.view(np.int64)))],
                names=["doc_id", "component", "shingles"])
    return run


def _rare_shingle_pairs(nodes: DataFrame, texts: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """Every pair (a, b) of nodes in different components that can be similar enough.

    A set that shares a given part of its shingles with another must share one of
    the few that are left out of that part, whichever they are; taking the rarest
    ones, a passage that many texts have in common brings none of them together.
    Nothing is lost: this is a condition that every link meets.  How many must be
    shared, and so how far from the rarest one a shared one can be, follows from
    the two sizes."""
    joined = texts.join(nodes.selectExpr("doc_id AS _node", "component"), F.col("doc_id") == F.col("_node"))
    sets = scratch.table(
        joined.select("doc_id", "text", "component").mapInArrow(
            _sets(settings), "doc_id bigint, component bigint, shingles array<bigint>"), "open_sets")
    entries = sets.selectExpr("doc_id", "explode(shingles) AS shingle")
    spread = entries.groupBy("shingle").agg(F.count("*").alias("df")).selectExpr("shingle AS _shingle", "df")
    ranked = entries.join(spread, F.col("shingle") == F.col("_shingle")).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("rarest"))
    needed = f"({settings.percent} * size(rarest) + 99) div 100"
    prefixes = scratch.table(
        ranked.selectExpr("doc_id AS _doc", "size(rarest) AS n",
                          f"posexplode(slice(rarest, 1, cast(size(rarest) - {needed} + 1 AS int))) AS (place, entry)")
        .where("entry.df > 1").join(sets.select("doc_id", "component"), F.col("_doc") == F.col("doc_id"))
        .selectExpr("entry.shingle AS shingle", "place", "doc_id", "n", "component"), "prefixes")
    # What two sets of these sizes must share leaves each with so many others, and a shared one right after them.
    shared = f"({settings.percent} * (n_a + n_b) + {99 + settings.percent}) div {100 + settings.percent}"
    return across_components(prefixes, scratch).where(f"p_a <= n_a - {shared} AND p_b <= n_b - {shared}").selectExpr(
        "least(a, b) AS a", "greatest(a, b) AS b").distinct()


def across_components(prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of rows of (shingle, place, doc_id, n, component) with the same shingle and different components.

    The rows of a shingle are first counted by component.  Where there is only one,
    nothing is paired; else every row outside of the shingle's largest component
    is paired with the others, so that a group of near copies never meets itself: at
    most twice as many pairs are made as are kept."""
    counted = prefixes.groupBy("shingle", "component").agg(F.count("*").alias("rows"))
    largest = counted.groupBy("shingle").agg(F.count("*").alias("components"), F.max(F.struct("rows", "component")).alias("most")).where(
        "components > 1").selectExpr("shingle AS _contested", "most.component AS largest")
    held = scratch.table(prefixes.join(largest, F.col("shingle") == F.col("_contested")).drop("_contested"), "contested")
    a = held.where("component <> largest").selectExpr("shingle AS _s", "place AS p_a", "doc_id AS a", "n AS n_a", "component AS c_a")
    b = held.selectExpr("shingle", "place AS p_b", "doc_id AS b", "n AS n_b", "component AS c_b", "largest")
    return a.join(b, F.expr("shingle = _s AND c_a <> c_b AND (c_b = largest OR a < b)")).select("a", "b", "p_a", "p_b", "n_a", "n_b")


def near_duplicates(docs: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row for each row of ``docs``."""
    texts = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "coalesce(cast(text AS string), '') AS text")
    with Scratch(scratch.spark) as inner:
        return _near_duplicates(texts, settings, scratch, inner)


def _near_duplicates(texts: DataFrame, settings: Settings, scratch: Scratch, inner: Scratch) -> DataFrame:
    """``inner`` holds what the result does not read."""
    signed = inner.table(
        texts.mapInArrow(_signed(settings), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"),
        "signed")
    sets = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # A class is named by its smallest id; any of its rows has its bands.
    classes = inner.table(
        sets.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("c")).selectExpr(
            "digest", "c.doc_id AS doc_id", "c.n_shingles AS n", "c.bands AS bands"),
        "classes")
    entries = classes.selectExpr("doc_id", "n", "explode(bands) AS key")
    buckets = entries.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("s"), F.count("*").alias("c")).where(
        "c > 1").selectExpr("key AS _key", "s.doc_id AS first", "s.n AS n_first")
    fits = f"100 * least({{0}}, {{1}}) >= {settings.percent} * greatest({{0}}, {{1}})"
    in_buckets = inner.table(
        entries.join(buckets, F.col("key") == F.col("_key")).select("key", "doc_id", "n", "first", "n_first"), "buckets")
    stars = in_buckets.where(f"doc_id <> first AND {fits.format('n', 'n_first')}").selectExpr(
        "first AS a", "doc_id AS b").distinct()
    class_texts = texts.join(in_buckets.select(F.col("doc_id").alias("_c")).distinct(), F.col("doc_id") == F.col("_c"),
                             "left_semi")
    class_texts = inner.table(class_texts, "texts")
    links = inner.table(confirmed(stars, class_texts, settings), "links")
    found = components(links, inner)

    placed = inner.table(in_buckets.join(found, F.col("doc_id") == F.col("node"), "left").selectExpr(
        "key", "doc_id", "coalesce(component, doc_id) AS component"), "placed")
    # The only pair of a bucket of two has been compared.
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where(
        "lo <> hi AND c > 2").selectExpr("key AS _key")
    open_ = placed.join(mixed, F.col("key") == F.col("_key"), "left_semi").select("doc_id", "component").distinct()
    across = _rare_shingle_pairs(open_, class_texts, settings, inner)
    more = inner.table(confirmed(across, class_texts, settings), "more_links")
    if more.limit(1).count():
        found = components(links.unionByName(more), inner)
    named = scratch.table(classes.selectExpr("digest", "doc_id AS class_id").join(
        found, F.col("class_id") == F.col("node"), "left").selectExpr(
        "digest AS _digest", "coalesce(component, class_id) AS component_id"), "components")
    members = scratch.table(signed.selectExpr(
        "doc_id", "n_shingles", "if(doc_id IS NULL, NULL, digest) AS digest"), "members")
    return members.join(named, F.col("digest") == F.col("_digest"), "left").selectExpr(
        "doc_id", "n_shingles", "coalesce(component_id, doc_id) AS component_id",
        "doc_id IS NULL OR coalesce(component_id, doc_id) = doc_id AS kept")


def keep_one_of_each(docs: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """The documents without near copies of others, one of each group staying, as they were.

    Of rows with the same id, the group's smallest, all stay."""
    gone = near_duplicates(docs, settings, scratch).where("NOT kept").selectExpr("doc_id AS _gone").distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*[docs[c] for c in docs.columns])
