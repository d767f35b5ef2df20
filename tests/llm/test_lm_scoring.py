import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumenward.llm import context_tree, lm_scoring, op4_lm_scoring
from lumenward.llm.context_tree import ContextTree, log_gamma, train
from tests.llm import brute


def _held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _symbols(text):
    return (text or "").translate(brute.LOWER).encode() + b"\xff"


class PlainTree:
    """The weighted tree by recursion over dictionaries, one decision at a time."""

    def __init__(self, texts, depth, share):
        self.depth, grams = depth, Counter()
        for text in texts:
            padded = b"\xff" * depth + _symbols(text)
            for at in range(depth, len(padded)):
                grams[padded[at - depth:at], padded[at]] += 1
        total = sum(grams.values())
        least = max(2, -(-total // share))
        self.counts, per_context = Counter(), Counter()
        for (context, byte), n in grams.items():
            for d in range(depth + 1):
                per_context[context[depth - d:]] += n
                node = 1
                for bit in f"{byte:08b}":
                    self.counts[context[depth - d:], node, bit] += n
                    node = 2 * node + int(bit)
        self.kept = {c for c, n in per_context.items() if n >= least or not c}
        self.memo = {}

    def pair(self, context, node):
        return self.counts[context, node, "0"], self.counts[context, node, "1"]

    def rest(self, context, node):
        a, b = self.pair(context, node)
        for byte in range(256):
            child = bytes([byte]) + context
            if child in self.kept:
                c, d = self.pair(child, node)
                a, b = a - c, b - d
        return a, b

    @staticmethod
    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, context, node):
        """Log probability of the node's data, and the trust in its own estimate."""
        if (context, node) not in self.memo:
            own = self.log_kt(*self.pair(context, node))
            if len(context) == self.depth:
                self.memo[context, node] = own, 1.0
            else:
                deep = self.log_kt(*self.rest(context, node))
                deep += sum(self.weighted(bytes([b]) + context, node)[0] for b in range(256) if bytes([b]) + context in self.kept)
                both = np.logaddexp(own, deep) - math.log(2)
                self.memo[context, node] = both, math.exp(own - math.log(2) - both)
        return self.memo[context, node]

    def one(self, history, node):
        def estimate(a, b):
            return (b + 0.5) / (a + b + 1) if a + b else None

        d = max(d for d in range(self.depth + 1) if history[self.depth - d:] in self.kept)
        p = estimate(*self.rest(history[self.depth - d:], node)) if d < self.depth else None
        for e in range(d, -1, -1):
            context = history[self.depth - e:]
            mine, trust = estimate(*self.pair(context, node)), self.weighted(context, node)[1]
            p = mine if p is None else trust * mine + (1 - trust) * p
        return 0.5 if p is None else p

    def score(self, text):
        padded, total = b"\xff" * self.depth + _symbols(text), 0.0
        for at in range(self.depth, len(padded)):
            node = 1
            for bit in f"{padded[at]:08b}":
                p = self.one(padded[at - self.depth:at], node)
                total += math.log10(p if bit == "1" else 1 - p)
                node = 2 * node + int(bit)
        return total


def _texts(n, seed=13):
    rng = random.Random(seed)
    return {i: " ".join(rng.choice(["the", "The", "then", "cat", "dog", "éa", "x"]) for _ in range(rng.randrange(1, 14)))
            for i in range(n)}


@pytest.mark.parametrize("share", [20, 10 ** 6])
@pytest.mark.parametrize("depth", [1, 4])
def test_tree_against_recursion(spark, share, depth):
    texts = [*_texts(40).values(), "", None]
    tree = train(spark.createDataFrame([(t,) for t in texts], "text string"), depth, share)
    plain = PlainTree(texts, depth, share)
    for d in range(depth + 1):
        assert {int(c).to_bytes(d, "big") for c in tree.contexts[d]} == {c for c in plain.kept if len(c) == d}
    probes = ["the cat", "THE DOG", "zebra", "", None, "x éa \x00"]
    assert tree.score(pa.array(probes)) == pytest.approx([plain.score(t) for t in probes], rel=1e-5)
    assert tree.score(pa.array(probes), chunk=3) == pytest.approx(tree.score(pa.array(probes)), rel=1e-9)


def test_each_distribution_sums_to_one(spark):
    tree = train(spark.createDataFrame([(t,) for t in _texts(60).values()], "text string"), 3, 100)
    assert np.allclose((10.0 ** tree.log10.astype(float)).sum(axis=1), 1, atol=1e-4)
    x = np.array([0.5, 1, 1.5, 10, 1e3, 1e8])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12)


def test_no_training_text(spark):
    tree = train(spark.createDataFrame([], "text string"))
    assert tree.score(pa.array(["", "ab"])) == pytest.approx([-8 * math.log10(2), -24 * math.log10(2)], rel=1e-5)
    assert isinstance(tree, ContextTree)


@pytest.mark.parametrize("top", [1 << 18, 3])
def test_query_against_counting(spark, documents, as_tables, monkeypatch, top):
    monkeypatch.setattr(lm_scoring, "TOP_WORDS", top)
    monkeypatch.setattr(lm_scoring.frequent_words, "__defaults__", (top,))
    texts = _texts(120)
    rows = [*texts.items(), (200, None), (201, ""), (202, "W" * 5000 + " w"), (5, texts[5]), (None, "the cat nobody numbered")]
    got = op4_lm_scoring.query(spark, as_tables(documents=documents(rows))).collect()
    counts, n_docs = Counter(), 0
    for doc_id, text in rows:
        if not _held_out(doc_id):
            counts.update(brute.words(text))
            n_docs += 1
    n, v = sum(counts.values()) + n_docs, len(counts) + 1
    assert len(got) == len(rows)
    by_id = dict(rows)
    plain = PlainTree([t for i, t in rows if not _held_out(i)], context_tree.DEPTH, context_tree.CONTEXT_SHARE)
    for r in got:
        ws = brute.words(by_id[r.doc_id])
        assert (r.held_out, r.train_tokens, r.n_tokens) == (_held_out(r.doc_id), n, len(ws) + 1)
        assert r.n_known == sum(w in counts for w in ws) + 1
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((n_docs + 1) / (n + v + 1))
        assert r.base_score == pytest.approx(base)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (len((by_id[r.doc_id] or "").encode()) + 1))
    for r in got[:5]:
        assert r.score == pytest.approx(plain.score(by_id[r.doc_id]), rel=1e-4)


def test_empty_query(spark, documents, as_tables):
    assert op4_lm_scoring.query(spark, as_tables(documents=documents([]))).count() == 0
