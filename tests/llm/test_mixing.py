import random
from collections import Counter

import numpy as np
import pytest

from lumenward.llm import mixing, op2_mixing
from lumenward.llm.mixing import capped_targets, fit_counts, mixed_documents
from tests.llm import brute


def test_counts_hit_the_nearest_reachable_sum():
    rng = random.Random(6)
    for _ in range(300):
        lengths = sorted(rng.sample(range(1, 40), rng.randrange(1, 8)))
        counts = [rng.randrange(0, 6) for _ in lengths]
        budget = rng.randrange(0, sum(a * b for a, b in zip(lengths, counts)) + 5)
        sums = {0}
        for length, n in zip(lengths, counts):
            sums = {s + length * k for s in sums for k in range(n + 1)}
        chosen = fit_counts(np.array(lengths), np.array(counts), budget)
        got = int((chosen * lengths).sum())
        assert all(0 <= c <= n for c, n in zip(chosen, counts))
        assert abs(got - budget) <= min(abs(s - budget) for s in sums)


def test_large_budgets_and_empty_ones():
    lengths, counts = np.arange(0, 5000), np.full(5000, 1000)
    for budget in (1, 4999, 123_456_789, int((lengths * counts).sum()) - 1):
        assert int((fit_counts(lengths, counts, budget) * lengths).sum()) == budget
    assert fit_counts(lengths, counts, 0).sum() == 0
    assert fit_counts(np.array([0, 7]), np.array([5, 3]), 100).tolist() == [0, 3]
    assert fit_counts(np.array([0]), np.array([5]), 10).tolist() == [0]


def test_few_long_documents_against_brute_force():
    rng = random.Random(31)
    for _ in range(25):
        lengths = sorted({*rng.sample(range(100_000, 1_500_000), rng.randrange(2, 12)), 1_400_000})
        counts = [rng.choice([1, 1, 2]) for _ in lengths]
        sums = {0}
        for length, n in zip(lengths, counts):
            sums = {s + length * k for s in sums for k in range(n + 1)}
        budget = rng.randrange(1, 10_000_000)
        got = int((fit_counts(np.array(lengths), np.array(counts), budget) * lengths).sum())
        assert abs(got - budget) == min(abs(s - budget) for s in sums)
    assert int((fit_counts(np.array([300_000, 400_000, 500_000]), np.ones(3, int), 700_000) * [300_000, 400_000, 500_000]).sum()) == 700_000


def test_seeds_choose_among_all_lengths():
    lengths = np.arange(40_000, 140_000, 500)
    chosen = [fit_counts(lengths, np.ones(200, int), 1_000_000, seed) for seed in (1, 2, 3)]
    assert all(int((c * lengths).sum()) == 1_000_000 for c in chosen)
    assert len({tuple(c) for c in chosen}) == 3 and all(lengths[c > 0].min() < 90_000 < lengths[c > 0].max() for c in chosen)
    # Beyond the reserve too: shares of all lengths, and the sum is hit.
    many = np.full(200, 50)
    for budget in (5_000_500, 123_456_000, int((lengths * many).sum()) - 40_000):
        taken = fit_counts(lengths, many, budget, 4)
        assert int((taken * lengths).sum()) == budget and (taken >= 0).all() and (taken <= many).all()
    assert ((fit_counts(lengths, many, 450_000_000, 4) - 25) ** 2).mean() < 30


def test_one_rule_around_the_reserve():
    lengths, counts = np.arange(1, 400), np.full(399, 20)
    for budget in range(mixing.RESERVE_SUMS - 3, mixing.RESERVE_SUMS + 700, 97):
        assert int((fit_counts(lengths, counts, budget) * lengths).sum()) == budget


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 10, "c": 1}, {"a": 5, "b": 5, "c": 5, None: 5}, {"x": 0, "y": 9}, {"é": 1000, "z": 1, "Z": 3, None: 2},
    {"only": 7}, {"none": 0}])
def test_targets(spark, scratch, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in capped_targets(table).collect()}
    assert got == pytest.approx(brute.targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def _rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "d", None])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 10, 10, 25])), source))
    return rows


@pytest.mark.parametrize("per_range", [512, 4])
def test_query_against_brute_force(spark, documents, as_tables, monkeypatch, per_range):
    monkeypatch.setattr(mixing, "RANGE_DOCUMENTS", per_range)
    rows = [*_rows(7, 600), (600, None, "b"), (5, "repeated row", "c"), (None, "no id at all", "d")]
    folder = as_tables(documents=documents(rows))
    got = op2_mixing.query(spark, folder).collect()
    again = op2_mixing.query(spark, folder).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(brute.words(text))
    want = brute.targets(dict(sizes))
    by_size = {n: s for s, n in sizes.items()}
    taken = Counter()
    for r in got:
        source = by_size[r.source_size]
        assert r.target == pytest.approx(want[source]) and 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)


def test_copies_as_documents(spark, scratch, documents):
    rows = [(1, "a b", "x"), (2, "c d", "x"), (3, "e f", "y"), (4, "", "y"), (4, None, "z")]
    docs = documents(rows)
    mixed = mixed_documents(docs, scratch)
    assert mixed.columns == docs.columns
    # 6 words: x has 2 of 4 words, y 4 of 2 (twice each document), z nothing.
    got = Counter(r.doc_id for r in mixed.collect())
    assert got[1] + got[2] == 1 and got[3] == 2
    assert mixed_documents(documents([]), scratch).count() == 0


def test_empty_query(spark, documents, as_tables):
    assert op2_mixing.query(spark, as_tables(documents=documents([]))).count() == 0
