from collections import defaultdict

import numpy as np
import pytest

from lumenward.llm import itq_dedup, op1_itq_dedup
from lumenward.llm.itq_dedup import Codes, choose_tables, cosines, flips, near_duplicates, sketches, sketches_near, units
from tests.llm import brute


def _vectors(seed, dims=16, groups=25):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dims)
        for _ in range(rng.integers(1, 8)):
            noise = rng.choice([0, 0.05, 0.15, 0.25])
            rows.append((len(rows) * 3 % 1009, int(g % 3), [float(x) for x in np.float32(centre + noise * rng.normal(size=dims))]))
    return rows


def _valid(label, vector):
    return label is not None and vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector)


def _expected(rows):
    links = defaultdict(set)
    for i, (a, la, va) in enumerate(rows):
        for b, lb, vb in rows[:i]:
            if a is not None and b is not None and _valid(la, va) and _valid(lb, vb) and la == lb and len(va) == len(vb):
                if cosines(np.array([va], float), np.array([vb], float))[0] >= 0.98:
                    links[a].add(b)
                    links[b].add(a)
    ids = [r[0] for r in rows if r[0] is not None]
    top = brute.reach(ids, [(a, b) for a in links for b in links[a]])
    return {i: (len(links[i]), top[i], top[i] == i) for i in ids}


SCHEMA = "vec_id bigint, embedding array<float>, label int, digest string"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x") for i, label, v in rows], SCHEMA)


@pytest.mark.parametrize("tables, probes", [(None, 4096), (3, 4096), (3, 2), (1, 50), (7, 4096)])
def test_query_against_all_pairs(spark, as_tables, monkeypatch, tables, probes):
    monkeypatch.setattr(near_duplicates, "__defaults__", (tables, probes, 4096))
    monkeypatch.setattr(itq_dedup, "BLOCK", 16)
    rows = _vectors(18)
    odd = [(2000, 0, None), (2001, 0, []), (2002, 0, [0.0] * 16), (2003, 0, [float("nan")] * 16), (2004, 0, [None] * 16),
           (2005, 0, [float("inf")] + [0.0] * 15), (2006, None, rows[0][2]), (2007, 1, [1.0, 2.0]), (2008, 1, [1.0, 2.0]),
           (2009, 1, [2.0, 4.0]), (2010, 1, [-1.0, -2.0]), (2011, 0, [1e-30] * 16), (2012, 0, [1e30] * 16),
           (2013, 2, [0.0] * 15 + [1.0]), (2014, 2, [-0.0] * 15 + [1.0])]
    got = op1_itq_dedup.query(spark, as_tables(embeddings=_table(spark, rows + odd))).collect()
    want = _expected(rows + odd)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want
    assert len(got) == len(rows) + len(odd) and sum(n for n, _, _ in want.values()) > 50


def test_copies_repeated_rows_and_missing_ids(spark, scratch):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(i, 1, v) for i in range(5, 300)] + [(5, 1, v), (None, 1, v), (2, 1, w), (3, 2, v)]
    got = near_duplicates(_table(spark, rows), 0.98, scratch).collect()
    assert len(got) == len(rows)
    assert {(r.n_links, r.component_id) for r in got if r.vec_id and r.vec_id >= 5} == {(295, 5)}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id in (2, 3))
    assert near_duplicates(_table(spark, []), 0.98, scratch).count() == 0
    assert near_duplicates(_table(spark, [(1, None, v)]), 0.98, scratch).count() == 1


def test_codes_are_balanced_and_flips_complete():
    rng = np.random.default_rng(19)
    sample = units(rng.normal(size=(2000, 24)) * np.linspace(1, 3, 24))
    codes = Codes.fit(sample)
    assert np.allclose(codes.axes.T @ codes.axes, np.eye(24))
    share = (codes.coordinates(sample) >= 0).mean(axis=0)
    assert 0.4 < share.min() and share.max() < 0.6
    spot = rng.normal(size=8) * 0.1
    _, masks = flips(spot, 0.02, 256)
    want = {m for m in range(256) if sum(spot[i] ** 2 for i in range(8) if m >> i & 1) <= 0.02}
    assert set(masks.tolist()) == want and flips(spot, 0.02, len(want) - 1) is None


def test_more_vectors_get_longer_codes():
    rng = np.random.default_rng(9)
    sample = units(rng.normal(size=(1000, 64)))
    codes = Codes.fit(sample)
    chosen = [choose_tables(codes, sample, n, 10, 0.98, 4096) for n in (10 ** 4, 10 ** 6, 10 ** 9)]
    assert chosen == sorted(chosen, reverse=True) and chosen[0] > chosen[-1] >= 1
    assert choose_tables(Codes.fit(sample[:, :2]), sample[:, :2], 100, 1, 0.98, 4096) <= 2


def test_sketches_hold_no_link_off(spark):
    rng = np.random.default_rng(10)
    near = []
    for least in (0.98, 0.9, 0.5):
        x = units(rng.normal(size=(3000, 12)))
        y = units(x + rng.normal(size=x.shape) * rng.uniform(0, 0.5, (3000, 1)))
        codes = Codes.fit(np.vstack([x, y]))
        a, b, cosine = sketches(codes.coordinates(x)), sketches(codes.coordinates(y)), cosines(x, y)
        table = spark.createDataFrame([(int(p), int(q), float(c)) for p, q, c in zip(a, b, cosine)], "a bigint, b bigint, c double")
        kept = table.selectExpr("c", f"{sketches_near('a', 'b', least)} AS near").collect()
        assert all(r.near for r in kept if r.c >= least)
        near.append(sum(r.near for r in kept if r.c < least) / max(1, sum(r.c < least for r in kept)))
    assert near[0] < 0.8
    far = units(rng.normal(size=(2000, 64)))
    marks = sketches(Codes.fit(far).coordinates(far))
    table = spark.createDataFrame([(int(p), int(q)) for p, q in zip(marks[:1000], marks[1000:])], "a bigint, b bigint")
    assert table.where(sketches_near("a", "b", 0.98)).count() < 20
