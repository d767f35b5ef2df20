import math

import pytest

from lumenward.llm import context_table, context_tree, op4_lm_scoring
from tests.llm.test_lm_scoring import PlainTree, _held_out, _texts


@pytest.mark.parametrize("top, chunk, contexts", [(1 << 20, 200_000, 2048), (50, 40, 7)])
def test_rare_contexts_stay_nodes_in_a_larger_corpus(spark, documents, as_tables, monkeypatch, top, chunk, contexts):
    """400,000 more places must not pool the contexts that the short texts hold a few times."""
    monkeypatch.setattr(context_table, "TOP_GRAMS", top)
    monkeypatch.setattr(context_table, "CHUNK", chunk)
    monkeypatch.setattr(context_table, "TOP_CONTEXTS", contexts)
    filler = next(i for i in range(200, 300) if not _held_out(i))
    rows = [*_texts(60).items(), (filler, "a" * 400_000), (301, ""), (302, None), (303, "zebra \x00 é")]
    plain = PlainTree([t for i, t in rows if not _held_out(i)], context_tree.DEPTH, 10 ** 12)
    got = {r.doc_id: r.score for r in op4_lm_scoring.query(spark, as_tables(documents=documents(rows))).collect()}
    assert len(got) == len(rows)
    for doc_id, text in [*rows[:25], *rows[-3:]]:
        assert got[doc_id] == pytest.approx(plain.score(text), rel=1e-5), doc_id


def test_nothing_to_learn_from(spark, documents, as_tables):
    held = [i for i in range(100) if _held_out(i)][:2]
    rows = op4_lm_scoring.query(spark, as_tables(documents=documents([(held[0], "ab"), (held[1], "")]))).collect()
    half = math.log10(0.5)
    assert {r.doc_id: r.score for r in rows} == pytest.approx({held[0]: 24 * half, held[1]: 8 * half})
