"""Hard negatives by an inverted multi-index with certified windows.

Vectors are scaled to integers and cut into two halves, each with a codebook of its
own, learned on a bounded sample.  A vector's *cell* is its pair of nearest code
words.  A row's inner product with an anchor is at most the sum, over the halves,
of the code word's product with the anchor's half plus the length of that half
times the code word's radius, the largest distance of any of its rows.  The
multi-sequence heap goes through the cells in descending order of these bounds.

Searches take two rounds, each a join of anchors with the cells they visit.  In the
first round an anchor visits its best cells, until they hold :data:`FIRST` rows.  That
gives it scores to hold against the bounds: in the second round it visits all
further cells down to the first whose bound shows that no row in it or after it can
change the answer.  So answers are exact, whatever the codebooks are.  Positives
are the best rows of the anchor's label.  Their scores open windows for negatives:
a window is certified when it holds enough rows above the next bound or the bound is
below the window.  Cells that lie above all windows of an anchor are passed over.

Cells are cut into blocks of rows, and anchors into blocks of anchors, so that a
task compares two bounded blocks; a cell or label with a third of all rows is many
blocks.  Only the codebooks, and one row for each cell, are brought together.

Defined results: rows without id or label, and vectors that are null or hold null or
non-finite components, take no part, nor do those whose scaled length is 2^31 or
more, as their scores would not fit 64 bits.  A shorter vector counts as zero beyond
its end.  Repeated rows are rows of their own, and an anchor's copy is another row.
Ties go to the smaller id.  An empty table gives an empty one.  Extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.storage import Scratch

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this many hundredths of its positive's.
LEAST_SHARE = 80
#: Vectors that the codebooks are learned on, rounds of learning, and rows to a cell that the number of code words aims at.
SAMPLE, ROUNDS, SEED = 8192, 12, 13
CELL_ROWS, MOST_WORDS = 256, 64
#: Rows in the cells an anchor visits at first.
FIRST = 1024
BLOCK_ROWS, BLOCK_ANCHORS, ANCHORS_AT_ONCE = 16384, 4096, 256
_EXACT = 2.0 ** 53


# ---- vectors ----

def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix, shorter lists filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keep, vectors = [], []
            for i, vector in enumerate(part.column(2)):
                if vector.values.null_count:
                    continue
                values = np.floor(SCALE * vector.values.to_numpy().astype(np.float64))
                if np.isfinite(values).all() and np.sqrt((values / 2.0 ** 31) ** 2).max(initial=0.0) < 1 and (
                        (values / 2.0 ** 31) ** 2).sum() < 1:
                    keep.append(i)
                    vectors.append(values.astype(np.int32))
            taken = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(taken), part.column(1).take(taken), pa.array(vectors, pa.list_(pa.int32()))],
                names=["vec_id", "label", "vector"])


def scaled_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, the vectors as integers."""
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").selectExpr(
        "cast(vec_id AS bigint) AS vec_id", "cast(label AS bigint) AS label", "embedding")
    return rows.mapInArrow(_scaled, "vec_id bigint, label bigint, vector array<int>")


# ---- the index ----

def _learn(points: np.ndarray, words: int) -> np.ndarray:
    """Code words of one half by Lloyd's rounds."""
    distinct = np.unique(points, axis=0)
    rng = np.random.Generator(np.random.PCG64(SEED))
    words = distinct[rng.permutation(len(distinct))[:words]]
    for _ in range(ROUNDS):
        nearest = _nearest(points, words)[0]
        sums = np.zeros_like(words)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(words))[:, None]
        words = np.where(counts > 0, sums / np.maximum(counts, 1), words)
    return words


def _nearest(points: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code word of each point, and its distance."""
    nearest = ((words * words).sum(axis=1) - 2 * points @ words.T).argmin(axis=1)
    return nearest, np.sqrt(((points - words[nearest]) ** 2).sum(axis=1))


@dataclass
class Index:
    """Codebooks of both halves, rows by cell, and the radius of each code word."""
    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    radii: tuple[np.ndarray, np.ndarray]

    @property
    def width(self) -> int:
        return self.halves[0].shape[1] + self.halves[1].shape[1]

    def split(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = self.halves[0].shape[1]
        return vectors[..., :middle].astype(np.float64), vectors[..., middle:].astype(np.float64)

    def visits(self, anchor: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
        """Cells that hold rows, with the number of these and the bounds of their scores, the highest
        upper bound first."""
        upper, lower = [], []
        for part, words, radii in zip(self.split(anchor), self.halves, self.radii):
            products, reach = words @ part, np.sqrt(part @ part) * radii
            # What rounding could take away from the bounds is added to them.
            slack = 1e-9 * (np.abs(words) @ np.abs(part) + reach) + 1e-3
            upper.append(products + reach + slack)
            lower.append(products - reach - slack)
        first, second = (np.argsort(-u, kind="stable") for u in upper)
        a, b = upper[0][first], upper[1][second]
        heap, seen = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, x, y = heapq.heappop(heap)
            i, j = int(first[x]), int(second[y])
            if self.counts[i, j]:
                yield i * self.counts.shape[1] + j, int(self.counts[i, j]), -bound, float(lower[0][i] + lower[1][j])
            for x, y in ((x + 1, y), (x, y + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(a[x] + b[y]), x, y))

    def chosen(self, anchor: np.ndarray, first: int, further: bool, stop: float, above: float) -> Iterator[int]:
        """Cells to visit in the first round, or in the second: down to a bound below ``stop``, without
        those that lie entirely above ``above``."""
        rows = 0
        for cell, count, most, least in self.visits(anchor):
            if further and most < stop:
                return
            if least > above:
                continue
            if rows < first:
                rows += count
                if not further:
                    yield cell
            elif further:
                yield cell
            else:
                return


def _assigned(halves: tuple[np.ndarray, np.ndarray]):
    width, middle = halves[0].shape[1] + halves[1].shape[1], halves[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                vectors = _matrix(part.column(2), width).astype(np.float64)
                (i, r1), (j, r2) = _nearest(vectors[:, :middle], halves[0]), _nearest(vectors[:, middle:], halves[1])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(i * len(halves[1]) + j, pa.int64()), pa.array(r1), pa.array(r2)],
                    names=["vec_id", "label", "vector", "cell", "r1", "r2"])
    return run


def build_index(vectors: DataFrame, scratch: Scratch, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> tuple[Index, DataFrame] | None:
    """The index, and the rows with their cell, block and a number of their own; None without rows."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not size.n or not size.width:
        return None
    picked = vectors.orderBy(F.expr("xxhash64(vec_id, 5)"), "vec_id").limit(sample).select("vector").toArrow()["vector"]
    points = _matrix(picked.combine_chunks(), max(size.width, 2)).astype(np.float64)
    words = int(min(MOST_WORDS, max(2, round((size.n / cell_rows) ** 0.5))))
    middle = points.shape[1] // 2
    halves = _learn(points[:, :middle], words), _learn(points[:, middle:], words)
    rows = scratch.table(
        vectors.mapInArrow(_assigned(halves), "vec_id bigint, label bigint, vector array<int>, cell bigint, r1 double, r2 double")
        .withColumn("row", F.monotonically_increasing_id()), "indexed")
    counts, radii = np.zeros((len(halves[0]), len(halves[1])), np.int64), tuple(np.zeros(len(h)) for h in halves)
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect()
    for c in cells:
        i, j = divmod(c.cell, len(halves[1]))
        counts[i, j] = c.n
        radii[0][i], radii[1][j] = max(radii[0][i], c.r1), max(radii[1][j], c.r2)
    return Index(halves, counts, radii), rows


# ---- searches ----

def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each row of ``scores``; those at the lowest number there is are none."""
    none = np.iinfo(np.int64).min
    if scores.shape[1] > k:
        kth = -np.partition(-np.maximum(scores, none + 1), k - 1, axis=1)[:, k - 1:k]
        a, r = np.nonzero((scores >= kth) & (scores > none))
    else:
        a, r = np.nonzero(scores > none)
    order = np.lexsort((rows[r], ids[r], -scores[a, r], a))
    a, r = a[order], r[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], r[place < k]


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact products: in doubles where these are exact, else in integers."""
    most = [np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)) for m in (anchors, rows)]
    if most[0] * most[1] < _EXACT / 4:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


_NONE = np.iinfo(np.int64).min


def _compared(width: int, positives: bool, k: int):
    """A block of anchors with a block of rows: the best rows by anchor, or by anchor and window."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        found: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            rows, ids, labels = (right[c].to_numpy() for c in ("row", "vec_id", "label"))
            vectors = _matrix(right["vector"].chunk(0), width)
            for at in range(0, left.num_rows, ANCHORS_AT_ONCE):
                part = left.slice(at, ANCHORS_AT_ONCE).combine_chunks()
                own, own_labels = part["anchor"].to_numpy(), part["a_label"].to_numpy()
                anchors = _matrix(part["a_vector"].chunk(0), width)
                if positives:
                    for label in np.unique(own_labels):
                        some, same = np.flatnonzero(own_labels == label), np.flatnonzero(labels == label)
                        scores = _scores(anchors[some], vectors[same])
                        scores[own[some][:, None] == rows[same]] = _NONE
                        a, r = _best(scores, ids[same], rows[same], k)
                        for column, values in zip(found, (own[some][a], np.zeros(len(a), np.int64), rows[same][r], ids[same][r], scores[a, r])):
                            column.append(values)
                    continue
                scores = _scores(anchors, vectors)
                scores[own_labels[:, None] == labels] = _NONE
                highs = part["highs"].to_pylist()
                for window in range(max(map(len, highs))):
                    some = np.array([i for i, h in enumerate(highs) if window < len(h)])
                    high = np.array([highs[i][window] for i in some], np.int64)
                    inside = scores[some]
                    inside[(inside > high[:, None]) | (inside < np.array([_low(int(h)) for h in high])[:, None])] = _NONE
                    a, r = _best(inside, ids, rows, k)
                    for column, values in zip(found, (own[some][a], high[a], rows[r], ids[r], inside[a, r])):
                        column.append(values)
        return pa.table({name: pa.array(np.concatenate(values) if values else [], pa.int64())
                         for name, values in zip(("anchor", "high", "row", "vec_id", "score"), found)})
    return run


def _low(high: int) -> int:
    """The least score in the window of a positive score."""
    return -(-LEAST_SHARE * high // 100)


def _search(anchors: DataFrame, rows: DataFrame, index: Index, choose: Callable, positives: bool, k: int,
            blocks: int, scratch: Scratch) -> DataFrame:
    """``anchor, high, row, vec_id, score``: the best k in the cells that ``choose`` gives an anchor."""
    fields = [(f.name, f.dataType.simpleString()) for f in anchors.schema.fields]

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                vectors = _matrix(part.column(part.schema.get_field_index("a_vector")), index.width)
                cells = [list(choose(index, vectors[i], row)) for i, row in enumerate(part.drop_columns(["a_vector"]).to_pylist())]
                which = pa.array(np.repeat(np.arange(len(cells)), [len(c) for c in cells]))
                flat = pa.array([c for own in cells for c in own], pa.int64())
                yield pa.RecordBatch.from_arrays([*(column.take(which) for column in part.columns), flat],
                                                 names=[*part.schema.names, "a_cell"])

    # A row for each cell and block of rows in it; the number of cells is bounded.
    cells = rows.sparkSession.createDataFrame(
        [(int(c), int(n) // BLOCK_ROWS + 1) for c, n in enumerate(index.counts.reshape(-1)) if n], "c bigint, n_blocks bigint")
    visits = scratch.table(
        anchors.mapInArrow(visited, ", ".join(f"{n} {t}" for n, t in [*fields, ("a_cell", "bigint")]))
        .join(F.broadcast(cells), F.expr("a_cell = c")).selectExpr(
            *[n for n, _ in fields], "a_cell AS cell", f"pmod(xxhash64(anchor), {blocks}) AS anchor_block",
            "explode(sequence(0L, n_blocks - 1)) AS row_block"), "visits")
    wanted = visits.selectExpr("cell AS v_cell", "anchor_block + 0L AS anchor_block").distinct()
    cut = rows.join(F.broadcast(cells), F.expr("cell = c")).selectExpr(
        "row", "vec_id", "label", "vector", "cell", "pmod(xxhash64(row), n_blocks) AS row_block").join(
        wanted, F.expr("cell = v_cell"))
    keys = ("cell", "row_block", "anchor_block")
    found = visits.groupBy(*keys).cogroup(cut.groupBy(*keys)).applyInArrow(
        _compared(index.width, positives, k), "anchor bigint, high bigint, row bigint, vec_id bigint, score bigint")
    return scratch.table(_first(found, k), "found")


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = "row_number() OVER (PARTITION BY anchor, high ORDER BY score DESC, vec_id, row)"
    return found.selectExpr("anchor", "high", "row", "vec_id", "score", f"{rank} AS rank").where(f"rank <= {k}")


def _in_rounds(anchors: DataFrame, rows: DataFrame, index: Index, positives: bool, k: int, first: int, blocks: int,
               scratch: Scratch) -> DataFrame:
    """Both rounds; anchors of the second one know what the first one found."""
    def at_first(index, vector, row):
        return index.chosen(vector, first, False, -np.inf, np.inf if positives else max(row["highs"]))

    def later(index, vector, row):
        found = dict(zip(row["f_highs"] or [], row["f_scores"] or []))
        if positives:
            return index.chosen(vector, first, True, found.get(0, -np.inf), np.inf)
        stop = min(found.get(high, _low(high)) for high in row["highs"])
        return index.chosen(vector, first, True, stop, max(row["highs"]))

    near = _search(anchors, rows, index, at_first, positives, k, blocks, scratch)
    # Only a full list of k rows can hold a row off.
    full = near.where(f"rank = {k}").groupBy("anchor").agg(
        F.expr("collect_list(struct(high, score))").alias("_full")).selectExpr(
        "anchor AS _anchor", "transform(_full, f -> f.high) AS f_highs", "transform(_full, f -> f.score) AS f_scores")
    known = anchors.join(full, F.expr("anchor = _anchor"), "left").drop("_anchor")
    far = _search(known, rows, index, later, positives, k, blocks, scratch)
    return scratch.table(_first(near.drop("rank").unionByName(far.drop("rank")), k), "best")


def hard_negatives(vectors: DataFrame, is_anchor: str, scratch: Scratch, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, sample: int = SAMPLE, first: int = FIRST) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of (vec_id, label, embedding).

    ``is_anchor`` is a condition on vec_id and label."""
    built = build_index(scaled_vectors(vectors), scratch, sample)
    if built is None:
        return vectors.sparkSession.createDataFrame(
            [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    index, rows = built
    anchors = scratch.table(rows.where(is_anchor).selectExpr(
        "row AS anchor", "vec_id AS a_id", "label AS a_label", "vector AS a_vector"), "anchors")
    blocks = anchors.count() // BLOCK_ANCHORS + 1
    best = _in_rounds(anchors, rows, index, True, positives, first, blocks, scratch).selectExpr(
        "anchor AS p_anchor", "vec_id AS positive_id", "score AS positive_score")
    windows = best.where("positive_score >= 0").groupBy("p_anchor").agg(F.expr("collect_set(positive_score)").alias("highs"))
    opened = scratch.table(anchors.join(windows, F.expr("anchor = p_anchor")).drop("p_anchor"), "windows")
    hard = _in_rounds(opened, rows, index, False, negatives, first, blocks, scratch)
    named = best.join(anchors.selectExpr("anchor AS n_anchor", "a_id"), F.expr("p_anchor = n_anchor"))
    return hard.join(named, F.expr("anchor = p_anchor AND high = positive_score")).selectExpr(
        "a_id AS anchor_id", "positive_id", "cast(rank AS int) AS rank", "vec_id AS negative_id", "positive_score",
        "score AS negative_score")
