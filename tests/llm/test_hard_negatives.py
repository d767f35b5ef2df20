import math
import random

import numpy as np
import pytest

from lumenward.llm import op13_hard_negatives
from lumenward.llm.hard_negatives import build_index, hard_negatives, scaled_vectors

VECTORS = "vec_id bigint, embedding array<float>, label int, score double, cell string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], VECTORS)


def brute(rows):
    """As (anchor, positive, rank, negative, both scores), from plain code."""
    valid = []
    for n, (vec_id, vector, label) in enumerate(rows):
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        valid.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector], n))
    out = []
    for anchor, label, own, me in valid:
        if anchor % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(own, v)), i, other) for i, other, v, n in valid if n != me]
        for score, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            found = sorted(s for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score)
            out += [(anchor, positive, rank, s[1], -score, -s[0]) for rank, s in enumerate(found[:5], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clustered(seed, n, width=8, clusters=6, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width)) / 2
    return [(int(i), (centres[rng.integers(clusters)] + rng.normal(size=width) * rng.choice([0, .05, .5])).tolist(), int(rng.integers(labels)))
            for i in rng.permutation(n)]


@pytest.mark.parametrize("seed, first", [(1, 1), (2, 60), (3, 10_000)])
def test_against_brute_force(spark, as_tables, scratch, monkeypatch, seed, first):
    rows = clustered(seed, 900)
    prepared = op13_hard_negatives.read_table(spark, as_tables(embeddings=table(spark, rows)), "embeddings").selectExpr(
        "vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) AS label", "embedding")
    got = rows_of(hard_negatives(prepared, "vec_id % 100 = 0", scratch, first=first))
    assert got == brute(rows) and got


def test_odd_rows(spark, as_tables):
    nan, inf = float("nan"), float("inf")
    rows = clustered(5, 301) + [
        (1000, None, 1), (1100, [nan] * 8, 1), (1200, [1.0, None], 1), (1300, [inf] * 8, 1), (1400, [1.0] * 8, None),
        (None, [1.0] * 8, 1), (1500, [], 1), (1600, [0.0] * 8, 2), (1700, [0.3], 1), (1800, [0.5] * 8, 99), (1801, [0.5] * 8, 1),
        (1802, [0.5] * 8, 1), (1803, [0.5] * 8, 2), (1804, [0.5] * 8, 99)]
    got = rows_of(op13_hard_negatives.query(spark, as_tables(embeddings=table(spark, rows))))
    assert got == brute(rows)
    assert [r[3] for r in got if r[0] == 1800][:3] == [1801, 1802, 1803]


def test_repeated_rows_and_few_of_a_label(spark, as_tables):
    rows = [(100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (3, [0.9, 0.5], 1), (4, [0.9, 0.4], 2), (5, [0.9, 0.4], 2), (200, [0.1, 0.2], 3)]
    got = rows_of(op13_hard_negatives.query(spark, as_tables(embeddings=table(spark, rows))))
    assert got == brute(rows) and len(got) == 8


def test_scores_beyond_doubles(spark, scratch):
    rows = [(i, [1000.0 + i / 3, 70_000.0 * (i % 5), 65_000.0 - i], i % 2) for i in range(1, 40)] + [(100, [80_000.0, 3.0, 65_000.1], 1)]
    rows.append((41, [1e30, 0.0, 0.0], 0))  # its scores would not fit
    got = rows_of(hard_negatives(table(spark, rows), "vec_id % 100 = 0", scratch))
    want = [r if r[0] % 7 else (r[0], r[1], (r[2] + 9) % 10) for r in rows[:-1]]
    assert got == brute(want) and got[0][4] > 2 ** 53 / 100


def test_bounds_hold_and_cells_come_in_order(spark, scratch):
    rows = clustered(8, 700)
    index, indexed = build_index(scaled_vectors(table(spark, rows)), scratch)
    found = indexed.select("vector", "cell").collect()
    by_cell = {}
    for r in found:
        by_cell.setdefault(r.cell, []).append(np.array(r.vector, np.int64))
    rng = random.Random(2)
    for r in rng.sample(found, 20):
        anchor, last, cells = np.array(r.vector, np.int64), math.inf, []
        for cell, count, most, least in index.visits(anchor):
            scores = [int(anchor @ v) for v in by_cell[cell]]
            assert len(scores) == count and least <= min(scores) and max(scores) <= most <= last
            last = most
            cells.append(cell)
        assert sorted(cells) == sorted(by_cell)


def test_far_cells_are_not_visited(spark, scratch):
    rows = [(i, [2.0 * (i % 10 == k) for k in range(10)], i % 3) for i in range(2000)]
    index, _ = build_index(scaled_vectors(table(spark, rows)), scratch, cell_rows=20)
    anchor = np.array([512 * (k == 3) for k in range(10)], np.int64)
    assert len(list(index.chosen(anchor, 1, False, -math.inf, math.inf))) == 1 < (index.counts > 0).sum()
    assert list(index.chosen(anchor, 1, True, 1000.0, math.inf)) == []


def test_empty_tables(spark, as_tables, scratch):
    assert hard_negatives(table(spark, []), "true", scratch).collect() == []
    assert hard_negatives(table(spark, [(1, [], 1)]), "true", scratch).collect() == []
    assert op13_hard_negatives.query(spark, as_tables(embeddings=table(spark, [(1, [0.5], 1)]))).collect() == []
