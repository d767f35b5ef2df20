"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample (principal axes, then alternating between
the nearest binary codes and the best rotation onto them) gives each vector a
balanced binary code: the signs of its rotated coordinates.  The code is cut into
a few parts, each with a hash table of its own; vectors meet in a table, and pairs
that met are reranked by the cosine of the original vectors in double precision.

The tables lose nothing.  Unit vectors with cosine c are sqrt(2 - 2c) apart, also
after the rotation, so in one of m parts they are at most that / sqrt(m) apart.
Where two signs differ in a coordinate, the coordinates lie on both sides of zero
and the smaller one is at most half of their distance.  So if every vector is
entered not only under its own code but under all codes that flip coordinates
whose squares sum to at most (2 - 2c) / (4m), linked vectors meet in some table,
each flipping the coordinates in which it is the smaller one.  More tables mean
fewer flips but shorter codes, which more vectors share by chance; how many tables
make the least work of both is estimated from the sample.

Most vectors that meet do so by chance.  An entry therefore carries a *sketch*, a few of
its vector's coordinates in steps of a byte; the distance in these, less what rounding
can add to it, is at most that of the vectors, so a pair further apart there than
linked vectors can be goes no further.

A vector so close to many zeros that it would need more than :data:`PROBES`
entries in one table is compared with all vectors of its label instead, block
against block, the other vectors as usual.

Equal vectors of a label are one *class* and never paired.  Links between classes
count with the number of vectors in them.

Defined results: a vector that is null, empty, zero, or has a null or non-finite
component, and one without label, links with nothing; vectors of different
lengths do not link.  Repeated rows are vectors of their own; different vectors
with the same id are one node.  A row without id links with nothing, has no
component and is kept.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.llm.components import components
from lumenward.llm.words import mix64
from lumenward.storage import Scratch

SAMPLE = 4096
CODE_BITS = 63
MOST_TABLES = 8
PROBES = 4096
#: Vectors that the number of tables is estimated on.
ESTIMATE = 256
ROUNDS = 40
SEED = 11
#: Coordinates in a sketch, and the step they are rounded to; they are held between -1 and 1, which brings none apart.
SKETCH, SKETCH_STEP = 8, 2 / 256
#: Vectors to a block where blocks are compared.
BLOCK = 1024


@dataclass(frozen=True)
class Codes:
    """``axes`` maps a centred unit vector to the coordinates whose signs are its code."""
    mean: np.ndarray
    axes: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, bits: int = CODE_BITS, rounds: int = ROUNDS, seed: int = SEED) -> Codes:
        mean = sample.mean(axis=0)
        centred = sample - mean
        _, principal = np.linalg.eigh(centred.T @ centred)
        basis = principal[:, ::-1][:, :min(bits, sample.shape[1])]
        flat = centred @ basis
        turn, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((basis.shape[1],) * 2))
        for _ in range(rounds):
            code = np.where(flat @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(flat.T @ code)
            turn = left @ right
        return cls(mean, basis @ turn)

    def coordinates(self, units: np.ndarray) -> np.ndarray:
        return (units - self.mean) @ self.axes


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column without nulls as doubles, shorter lists filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, of vectors that are not zero."""
    a, b = (v / np.abs(v).max(axis=1, keepdims=True) for v in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def flips(coordinates: np.ndarray, budget: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All sets of coordinates whose squares sum to at most ``budget``, as bit masks with the code
    that each leads to; None if there are more than ``most``."""
    code = int(sum(1 << i for i, x in enumerate(coordinates) if x >= 0))
    squares = coordinates * coordinates
    masks, sums = np.zeros(1, np.int64), np.zeros(1)
    for i in np.argsort(squares):
        if squares[i] > budget:
            break
        more = sums + squares[i]
        fits = more <= budget
        masks, sums = np.concatenate([masks, masks[fits] | (1 << int(i))]), np.concatenate([sums, more[fits]])
        if len(masks) > most:
            return None
    return masks ^ code, masks


def flip_budget(least: float, tables: int) -> float:
    return (2 - 2 * least) / (4 * tables) * (1 + 1e-9) + 1e-12


def sketches(coordinates: np.ndarray) -> np.ndarray:
    """One number for each row, a byte for each of the first coordinates."""
    steps = np.floor((np.clip(coordinates[:, :SKETCH], -1, 1) + 1) / SKETCH_STEP)
    steps = np.minimum(steps, 255).astype(np.uint64)
    return (steps << (8 * np.arange(steps.shape[1], dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches_near(a: str, b: str, least: float) -> str:
    """False only for pairs with a cosine below ``least``."""
    apart = [f"greatest(abs((shiftrightunsigned({a}, {8 * i}) & 255L) - (shiftrightunsigned({b}, {8 * i}) & 255L)) - 1L, 0L)"
             for i in range(SKETCH)]
    most = int((2 - 2 * least) * (1 + 1e-9) / SKETCH_STEP ** 2 + 1e-6)
    return f"{' + '.join(f'{x} * {x}' for x in apart)} <= {most}L"


def choose_tables(codes: Codes, sample: np.ndarray, vectors: int, labels: int, least: float, probes: int) -> int:
    """The number of tables with the fewest entries and chance meetings together, of so many
    vectors with so many labels; ``sample`` are unit vectors."""
    spots = codes.coordinates(sample[:ESTIMATE])
    bits, best = spots.shape[1], None
    for tables in range(1, min(MOST_TABLES, bits) + 1):
        edges = np.linspace(0, bits, tables + 1).astype(int)
        work = 0.0
        for a, b in zip(edges, edges[1:]):
            found = [flips(row[a:b], flip_budget(least, tables), probes) for row in spots]
            each = vectors * float(np.mean([probes if f is None else len(f[0]) for f in found]))
            work += each + each * each / (2 * max(labels, 1) * 2.0 ** int(b - a))
        if best is None or work < best[0]:
            best = work, tables
    return best[1]


def _digest(label: int, vector: np.ndarray) -> bytes:
    return hashlib.blake2b(np.int64(label).tobytes() + (vector + 0.0).tobytes(), digest_size=16).digest()


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            labels, vectors = part.column(1).to_pylist(), part.column(2)
            digests = []
            for label, row in zip(labels, vectors):
                values = None if label is None or not row.is_valid else row.values
                if values is None or not len(values) or values.null_count:
                    digests.append(None)
                    continue
                vector = values.to_numpy().astype(np.float64)
                ok = np.isfinite(vector).all() and vector.any()
                digests.append(_digest(label, vector) if ok else None)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests, pa.binary())],
                                             names=["vec_id", "label", "vector", "digest"])


def _entered(codes: Codes, budget: float, tables: int, probes: int):
    edges = np.linspace(0, codes.axes.shape[1], tables + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                sizes = np.diff(part.column(2).offsets.to_numpy())
                spots = codes.coordinates(units(_matrix(part.column(2), len(codes.mean))))
                named = mix64(labels.astype(np.int64).view(np.uint64)) + sizes.astype(np.uint64)
                salts = mix64(mix64(named)[:, None] + np.arange(1, tables + 1, dtype=np.uint64))
                marks = sketches(spots)
                keys, masks, owners, drawn, heavy = [], [], [], [], []
                for r in range(len(ids)):
                    own = [flips(spots[r, a:b], budget, probes) for a, b in zip(edges, edges[1:])]
                    if any(x is None for x in own):
                        heavy.append(ids[r])
                        continue
                    for table, (code, mask) in enumerate(own):
                        keys.append(mix64(code.astype(np.uint64) + salts[r, table]).view(np.int64))
                        masks.append(mask)
                        owners.append(np.full(len(mask), ids[r]))
                        drawn.append(np.full(len(mask), marks[r]))
                n_heavy = len(heavy)
                empty = [np.zeros(0, np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([*(keys or empty), np.zeros(n_heavy, np.int64)])),
                     pa.array(np.concatenate([*(masks or empty), np.full(n_heavy, -1)])),
                     pa.array(np.concatenate([*(owners or empty), np.array(heavy, np.int64)]).astype(np.int64)),
                     pa.array(np.concatenate([*(drawn or empty), np.zeros(n_heavy, np.int64)]))],
                    names=["key", "mask", "id", "sketch"])
    return run


def _reranked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "n_a", "n_b"]
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                linked = pa.array(cosines(_matrix(part.column(4)), _matrix(part.column(5))) >= least)
                yield pa.RecordBatch.from_arrays([part.column(i).filter(linked) for i in range(4)], names=names)
    return run


def _blocks_compared(least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.combine_chunks(), right.combine_chunks()
        found = {name: [] for name in ("a", "b", "n_a", "n_b")}
        if a.num_rows and b.num_rows:
            x, y = (units(_matrix(t["vector"].chunk(0))) for t in (a, b))
            # The product only preselects; a pair's cosine is then computed as everywhere.
            i, j = np.nonzero(x @ y.T >= least - 1e-9)
            near = cosines(_matrix(a["vector"].chunk(0))[i], _matrix(b["vector"].chunk(0))[j]) >= least
            i, j = i[near], j[near]
            id_a, id_b = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
            n_a, n_b = a["n"].to_numpy()[i], b["n"].to_numpy()[j]
            swap, keep = id_a > id_b, id_a != id_b
            for name, values in (("a", np.where(swap, id_b, id_a)), ("b", np.where(swap, id_a, id_b)),
                                 ("n_a", np.where(swap, n_b, n_a)), ("n_b", np.where(swap, n_a, n_b))):
                found[name] = values[keep]
        return pa.table({name: pa.array(values, pa.int64()) for name, values in found.items()})
    return run


def _against_all(heavy: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Links of the given classes with all of their label, in blocks.

    A block holds about :data:`BLOCK` vectors of one label, chosen by hash; every
    block of the one side meets every block of the other in a task of its own."""
    def blocked(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy("label", F.size("vector").alias("_size")).agg(
            F.expr(f"count(*) div {BLOCK} + 1").alias("_blocks")).withColumnRenamed("label", "_label")
        return rows.join(sizes, F.expr("label = _label AND size(vector) = _size")).selectExpr(
            "id", "n", "label", "_size AS size", "vector", f"pmod(xxhash64(id, 3), _blocks) AS {name}", "_blocks")

    few, all_ = blocked(heavy, "hb"), blocked(classes, "ab")
    n_few = few.groupBy("label", "size").agg(F.max("_blocks").alias("_n")).withColumnsRenamed({"label": "_l", "size": "_s"})
    n_all = all_.groupBy("label", "size").agg(F.max("_blocks").alias("_n")).withColumnsRenamed({"label": "_l", "size": "_s"})
    same = F.expr("label = _l AND size = _s")
    left = few.join(n_all, same).selectExpr("id", "n", "label", "size", "vector", "hb", "explode(sequence(0L, _n - 1)) AS ab")
    right = all_.join(n_few, same).selectExpr("id", "n", "label", "size", "vector", "explode(sequence(0L, _n - 1)) AS hb", "ab")
    keys = ("label", "size", "hb", "ab")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _blocks_compared(least), "a bigint, b bigint, n_a bigint, n_b bigint")


def near_duplicates(vectors: DataFrame, least: float, scratch: Scratch, tables: int | None = None, probes: int = PROBES,
                    sample: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of (vec_id, label, embedding), a row for each row."""
    rows = vectors.selectExpr("cast(vec_id AS bigint) AS vec_id", "cast(label AS bigint) AS label", "embedding AS vector")
    kind = rows.schema["vector"].dataType.simpleString()
    prepared = scratch.table(
        rows.mapInArrow(_prepared, f"vec_id bigint, label bigint, vector {kind}, digest binary"), "prepared")
    # A vector goes through the aggregate once for each class, not once for each copy.
    named = prepared.where("vec_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = scratch.table(named, "classes")
    picked = classes.orderBy(F.expr("xxhash64(digest)"), "digest").limit(sample).select("vector").toArrow()["vector"]
    about = classes.agg(F.max(F.size("vector")).alias("width"), F.count("*").alias("n"), F.countDistinct("label").alias("labels")).first()
    width = about.width
    if width is None:
        return rows.selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id", "true AS kept")
    chosen = units(_matrix(picked.combine_chunks().cast(pa.list_(pa.float64())), width))
    codes = Codes.fit(chosen)
    if tables is None:
        tables = choose_tables(codes, chosen, about.n, about.labels, least, probes)
    budget = flip_budget(least, tables)
    entries = scratch.table(
        classes.select("id", "label", "vector").mapInArrow(
            _entered(codes, budget, tables, probes), "key bigint, mask bigint, id bigint, sketch bigint"), "entries")
    light = entries.where("mask >= 0")
    other = light.selectExpr("key AS _key", "mask AS _mask", "id AS b", "sketch AS _sketch")
    meet = f"key = _key AND id < b AND (mask & _mask) = 0 AND {sketches_near('sketch', '_sketch', least)}"
    pairs = light.join(other, F.expr(meet)).selectExpr("id AS a", "b").distinct()
    x = classes.selectExpr("id AS _a", "n AS n_a", "label AS l_a", "vector AS v_a")
    y = classes.selectExpr("id AS _b", "n AS n_b", "label AS l_b", "vector AS v_b")
    met = pairs.join(x, F.col("a") == F.col("_a")).join(y, F.col("b") == F.col("_b")).where(
        "l_a = l_b AND size(v_a) = size(v_b)").select("a", "b", "n_a", "n_b", "v_a", "v_b")
    links = scratch.table(met.mapInArrow(_reranked(least), "a bigint, b bigint, n_a bigint, n_b bigint"), "links")
    heavy = entries.where("mask < 0").selectExpr("id AS _heavy").distinct()
    if heavy.limit(1).count():
        chosen = scratch.table(classes.join(heavy, F.col("id") == F.col("_heavy"), "left_semi"), "heavy")
        links = scratch.table(links.unionByName(_against_all(chosen, classes, least)).distinct(), "all_links")

    both = links.selectExpr("a AS _id", "n_b AS other").unionByName(links.selectExpr("b AS _id", "n_a AS other"))
    counted = both.groupBy("_id").agg(F.sum("other").alias("_others"))
    found = components(links.select("a", "b"), scratch)
    results = scratch.table(
        classes.select("digest", "id", "n").join(counted, F.col("id") == F.col("_id"), "left")
        .join(found, F.col("id") == F.col("node"), "left").selectExpr(
            "digest AS _digest", "coalesce(_others, 0L) + n - 1 AS n_links", "coalesce(component, id) AS component_id"),
        "results")
    members = prepared.selectExpr("vec_id", "if(vec_id IS NULL, NULL, digest) AS digest").join(
        results, F.col("digest") == F.col("_digest"), "left")
    return members.selectExpr(
        "vec_id", "coalesce(n_links, 0L) AS n_links", "coalesce(component_id, vec_id) AS component_id",
        "vec_id IS NULL OR coalesce(component_id, vec_id) = vec_id AS kept")
