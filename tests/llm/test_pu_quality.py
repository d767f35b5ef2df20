import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumenward.llm import op7_pu_quality, pu_quality
from lumenward.llm.pu_quality import (
    FEATURES, ArrayRows, TableRows, estimate_prior, features, fit, loss_sums, score_quality, standardised,
)


def _good(rng):
    return ". ".join(" ".join(rng.choice(["the", "river", "of", "stone", f"word{rng.randrange(900)}"]) for _ in range(12)).capitalize()
                     for _ in range(rng.randrange(5, 20)))


def _bad(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return f"buy{rng.randrange(9)} now " * rng.randrange(30, 90)
    return _good(rng).upper() if kind == 1 else " ".join(w + "***" for w in _good(rng).split())


def _tables(spark, documents, n=500):
    rng, rows, labels = random.Random(14), [], []
    for i in range(n):
        quality = int(rng.random() < 0.8)
        rows.append((i, _good(rng) if quality else _bad(rng)))
        if rng.random() < 0.5:
            labels.append((i, quality, 0))
    return documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_held_out_accuracy(spark, documents, as_tables):
    docs, labels, known = _tables(spark, documents)
    got = {r.doc_id: r for r in op7_pu_quality.query(spark, as_tables(documents=docs, labels=labels)).collect()}
    assert len(got) == 500
    held = [(i, q) for i, q, _ in known if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) < 300
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_labels_held_out_are_not_used(spark, documents, scratch):
    docs, labels, known = _tables(spark, documents, 200)
    flipped = spark.createDataFrame(
        [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 0) for i, q, _ in known], labels.schema)
    a = {r.doc_id: r.score for r in score_quality(docs, labels, scratch).collect()}
    assert a == {r.doc_id: r.score for r in score_quality(docs, flipped, scratch).collect()}


def test_awkward_rows(spark, documents, scratch):
    docs, labels, _ = _tables(spark, documents, 100)
    odd = documents([(1000, None), (1001, ""), (1002, " \n"), (1003, "x " * 200_000), (1004, "é"), (1004, "é"), (None, "no id")])
    labels = labels.union(spark.createDataFrame([(None, 1, 0), (1000, None, 1), (5, 1, 0), (5, 0, 0)], labels.schema))
    got = score_quality(docs.union(odd), labels, scratch).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 107 and by_id[1000].score == by_id[1001].score == by_id[1002].score
    assert by_id[None].held_out is False and 0 <= by_id[None].score <= 1
    assert score_quality(documents([]), labels, scratch).count() == 0
    untrained = score_quality(docs, labels.limit(0), scratch).collect()
    assert {r.score for r in untrained} == {0.5}


def test_prior_and_risk_on_two_clouds():
    rng = np.random.default_rng(15)
    good = rng.normal(0, 1, (2000, 3))
    mixed = np.vstack([rng.normal(0, 1, (2100, 3)), rng.normal(3, 1, (900, 3))])
    assert abs(estimate_prior(good, ArrayRows(mixed), good.mean(axis=0), good.std(axis=0)) - 0.7) < 0.1
    model = fit(good, ArrayRows(mixed))
    score = np.clip((mixed - model.mean) / model.scale, -8, 8) @ model.weights + model.bias
    assert np.mean(score[:2100] > 0) > 0.95 and np.mean(score[2100:] < 0) > 0.85


def test_fit_ends_where_the_plain_gradient_vanishes():
    rng = np.random.default_rng(16)
    good, mixed = rng.normal(0, 1, (300, 2)), np.vstack([rng.normal(0, 1, (350, 2)), rng.normal(2, 1, (150, 2))])
    model = fit(good, ArrayRows(mixed), 0.4)
    weights = [*model.weights, model.bias]

    def plain(row):
        return [*(max(-8.0, min(8.0, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale)), 1.0]

    def score(row):
        return sum(w * v for w, v in zip(weights, plain(row)))

    for k in range(3):
        unlabelled = sum(plain(r)[k] / (1 + math.exp(-score(r))) for r in mixed) / len(mixed)
        positive = sum(plain(r)[k] for r in good) / len(good)
        assert abs(unlabelled - 0.4 * positive + 1e-4 * weights[k]) < 1e-4
    rest = sum(math.log1p(math.exp(score(r))) for r in mixed) / len(mixed) - 0.4 * sum(math.log1p(math.exp(score(r))) for r in good) / len(good)
    assert rest >= 0


def test_the_remainder_stays_above_zero():
    # With too large a prior the unbiased risk has no lower bound worth reaching: steps stop at the edge.
    rng = np.random.default_rng(17)
    good, mixed = rng.normal(3, 1, (200, 2)), rng.normal(0, 1, (200, 2))
    model = fit(good, ArrayRows(mixed), 0.95)
    soft = lambda rows: np.logaddexp(0, standardised(rows, model.mean, model.scale) @ np.append(model.weights, model.bias)).mean()
    assert soft(mixed) - 0.95 * soft(good) >= 0


def test_sums_of_a_table_are_those_of_its_rows(spark):
    rng = np.random.default_rng(18)
    rows = rng.normal(1, 3, (777, len(FEATURES)))
    table = spark.createDataFrame([(r.tolist(),) for r in rows], "features array<double>").repartition(5)
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    weights = [rng.normal(0, 1, len(FEATURES) + 1) for _ in range(3)]
    for got, want in zip(TableRows(table).sums(mean, scale, weights), ArrayRows(rows).sums(mean, scale, weights)):
        assert np.allclose(got, want, atol=1e-6)
    marks = np.sort(rng.normal(0, 2, 50))
    assert (TableRows(table).above(mean, scale, weights[0], marks) == ArrayRows(rows).above(mean, scale, weights[0], marks)).all()
    z = [sum(w * v for w, v in zip(weights[0], row)) for row in standardised(rows, mean, scale)]
    assert np.isclose(loss_sums(standardised(rows, mean, scale), weights[0])[1], sum(max(x, 0) + math.log1p(math.exp(-abs(x))) for x in z))


def test_every_unlabelled_row_counts(spark, documents, scratch):
    """Beyond any sample: a kind of text that is rare, and by hash not among the first, moves the scores."""
    docs, labels, _ = _tables(spark, documents, 200)
    more = documents([(10_000 + i, "&&& " * 40) for i in range(60)])
    a = {r.doc_id: r.score for r in score_quality(docs, labels, scratch).collect()}
    b = {r.doc_id: r.score for r in score_quality(docs.union(more), labels, scratch).collect()}
    assert any(abs(a[i] - b[i]) > 1e-6 for i in a) and not hasattr(pu_quality, "UNLABELLED")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain_features(text):
    """By the definitions, one at a time."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    solid = [b for b in text.encode() if b not in b" \t\n\x0b\x0c\r"]
    n, size = max(len(words), 1), max(len(solid), 1)
    letters = [c for c in text if c.isascii() and c.isalpha()]
    counts = Counter(words)
    return [math.log1p(len(words)), sum(map(len, words)) / n, sum(c in "#*$%&|<>" for c in text) / n, dup / max(len(lines), 1),
            len(repeated) / n, sum(c.isupper() for c in letters) / max(len(letters), 1), sum(48 <= b <= 57 for b in solid) / size,
            sum(chr(b) in string.punctuation for b in solid) / size, sum(b >= 128 for b in solid) / size, len(counts) / n,
            max(counts.values(), default=0) / n, math.log1p(len(words) / max(len(lines), 1)), float(not words)]


def test_features_against_plain_code():
    rng = random.Random(19)
    texts = [None, "", "a", "A B\nA B\n", "1234 !!", "é" * 50, _good(rng), *(_bad(rng) for _ in range(6)),
             *("".join(rng.choice(["a", "B", " ", "\n", "é", "7", "#", "the ", ".", "x y z "]) for _ in range(60)) for _ in range(40))]
    got = features(pa.array(texts))
    for text, row in zip(texts, got):
        want = dict(zip(FEATURES, _plain_features(text)))
        assert dict(zip(FEATURES, row.tolist())) == pytest.approx(want, abs=1e-9), text


def test_features_are_finite():
    found = features(pa.array([None, "", "a", "A B\nA B\n", "1234 !!", "é" * 50]))
    assert found.shape == (6, len(FEATURES)) and np.isfinite(found).all()
    assert (found[0] == found[1]).all() and found[0][FEATURES.index("no_words")] == 1
