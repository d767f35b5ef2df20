import random

import numpy as np
import pyarrow as pa
import pytest

from lumenward.llm import op5_minhash
from lumenward.llm.components import components
from lumenward.llm.minhash import (
    Settings, across_components, keep_one_of_each, miss_probability, near_duplicates, shingle_sets, signatures,
)
from tests.llm import brute


def _pairs(kind, n, rng):
    if kind == "chain":
        order = list(range(n))
        rng.shuffle(order)
        return list(zip(order, order[1:]))
    if kind == "star":
        return [(n, i) for i in range(n)]
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(n * 2 // 3)]


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, scratch, kind):
    links = _pairs(kind, 150, random.Random(8))
    nodes = {n for link in links for n in link}
    found = components(spark.createDataFrame(links, "a bigint, b bigint"), scratch).collect()
    assert len(found) == len({r.node for r in found})
    got = {r.node: r.component for r in found}
    want = brute.reach(nodes, links)
    assert all(got.get(n, n) == want[n] for n in nodes)
    assert components(spark.createDataFrame([], "a bigint, b bigint"), scratch).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(9)
    a = [f"w{rng.randrange(10 ** 6)}" for _ in range(3000)]
    settings = Settings(width=1, bands=50, rows=10)
    for share in (0.0, 0.5, 0.9):
        b = [w if rng.random() < share else f"v{rng.randrange(10 ** 6)}" for w in a]
        shingles, sizes = shingle_sets(pa.array([" ".join(a), " ".join(b), ""]), 1)
        x, y = signatures(shingles, sizes, settings)
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs(np.mean(x == y) - true) < 0.08 and sizes[2] == 0
    assert miss_probability(op5_minhash.SETTINGS) < 1e-5 and miss_probability(Settings()) < 1e-4


def _corpus(words):
    rng, rows = random.Random(10), []
    for g in range(12):
        base = words(100 + g, rng.choice([3, 30, 120, 400]), 5000).split()
        for _ in range(rng.randrange(1, 12)):
            copy = [w if rng.random() > rng.choice([0, 0.01, 0.03, 0.1]) else f"n{rng.randrange(999)}" for w in base]
            rows.append((len(rows) * 7 % 101, " ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy)))
    passage = words(99, 60, 5000)
    rows += [(200 + i, f"{passage} {words(300 + i, 40, 5000)}") for i in range(20)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one two"), (404, "ONE TWO"), (405, "one"), (406, "one two three")]
    return {i: t for i, t in rows}


def test_query_against_all_pairs(spark, documents, as_tables, words):
    texts = _corpus(words)
    want, sizes = brute.near_components(texts, 3, 85)
    got = op5_minhash.query(spark, as_tables(documents=documents(list(texts.items())))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (sizes[i], want[i], want[i] == i) for i in texts}
    assert len(set(want.values())) < len(texts) - 20


def test_rows_without_id_or_repeated_and_one_large_group(spark, scratch, documents, words):
    base = words(11, 300, 9000).split()
    rng = random.Random(12)
    copies = []
    for i in range(120):
        copy = list(base)
        copy[rng.randrange(300)] = f"x{i % 40}"
        copies.append((i + 10, " ".join(copy)))
    rows = [*copies, (None, " ".join(base)), (None, None), (500, " ".join(base)), (500, " ".join(base)), (3, "other words here")]
    docs = documents(rows)
    got = near_duplicates(docs, Settings(), scratch).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id not in (None, 3)} == {10}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    kept = keep_one_of_each(docs, Settings(), scratch)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 3, 10]
    assert near_duplicates(documents([]), Settings(), scratch).count() == 0
    assert keep_one_of_each(documents([]), Settings(), scratch).count() == 0


def test_a_group_of_copies_never_meets_itself(spark, scratch):
    """Of rows (shingle, place, doc_id, n, component): all pairs across components, and few others made."""
    rng = random.Random(41)
    rows = [(s, 0, d, 40, 1) for s in range(20) for d in range(800)] + [(s, 0, 5000, 40, 2) for s in range(20)]
    rows += [(100 + s, 0, d, 40, d % 3) for s in range(5) for d in range(60)] + [(200, 0, d, 40, 7) for d in range(50)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "shingle bigint, place int, doc_id bigint, n int, component bigint")
    found = across_components(table, scratch)
    want = {(min(a[2], b[2]), max(a[2], b[2])) for s in {r[0] for r in rows} for own in [[r for r in rows if r[0] == s]]
            for a in own for b in own if a[4] < b[4]}
    got = [tuple(sorted((r.a, r.b))) for r in found.select("a", "b").collect()]
    assert set(got) == want and len(got) == 20 * 800 + 5 * 3 * 20 * 20
    # Rows of the larger side that meet a row outside of the largest component: what the join looks at.
    met = sum(sum(1 for r in own if r[4] != big) * len(own) for s in {r[0] for r in rows} for own in [[r for r in rows if r[0] == s]]
              for big in [max((sum(1 for r in own if r[4] == c), c) for c in {r[4] for r in own})[1]])
    assert met <= 2 * len(got) + 20
