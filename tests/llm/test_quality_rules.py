import random

import pyarrow as pa

from lumenward.llm import op8_quality_rules
from lumenward.llm.quality_rules import LATEST, MEASURES, POLICIES, RULES, ablation, judge, ledger, measure, reject_low_quality
from tests.llm import brute


def plain(text):
    text = text or ""
    ws = brute.words(text, lower=False)
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    inside = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if brute.words(line)]
    return {
        "n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_lines": len(lines),
        "n_upper": sum("A" <= c <= "Z" for c in text), "n_letters": sum(c.isascii() and c.isalpha() for c in text)}


def test_measurements_of_random_texts():
    rng = random.Random(1)
    texts = [None, "", "\n", "a\n\na\n a\na", "x y z x y z", "x x x x", "é#  ß*"]
    texts += ["".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "Q"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    found = measure(pa.array(texts))
    for name in MEASURES:
        assert found[name].tolist() == [plain(t)[name] for t in texts], name


def test_policies_ledger_and_ablation(documents, words):
    long_ok, noisy = words(1, 200, 10_000), " ".join(f"{w}***" for w in words(2, 200, 10_000).split())
    rows = [(1, long_ok), (2, noisy), (3, "too short"), (4, None), (5, ""), (5, ""), (6, "spam and more " * 60), (7, long_ok.upper())]
    entries = ledger(documents(rows))
    kept = {p: {r.doc_id for r in judge(entries, p).where("kept").collect()} for p in POLICIES}
    assert kept == {1: {1, 2, 7}, 2: {1, 7}, 3: {1}}
    counts = {r.rule: (r.documents, r.kept, r.failing, r.kept_without) for r in ablation(entries, LATEST).collect()}
    assert counts["symbols"] == (8, 1, 1, 1) and counts["shouting"] == (8, 1, 1, 1)
    assert counts["few_words"] == (8, 1, 4, 4) and counts["repeated_windows"][2] == 1
    assert set(counts) == set(POLICIES[LATEST]) <= {r.name for r in RULES}
    same = reject_low_quality(documents(rows))
    assert same.columns == documents(rows).columns
    assert [(r.doc_id, r.text) for r in same.collect()] == [(1, long_ok)]


def test_very_long_text_and_empty_table(documents, words):
    text = words(3, 300_000, 10 ** 6)
    row = ledger(documents([(1, text)])).collect()[0]
    assert row.n_words == 300_000 and row.word_chars == len(text) - 299_999 and row.failed == 0
    assert ledger(documents([])).count() == 0


def test_query_on_awkward_rows(spark, documents, as_tables):
    folder = as_tables(documents=documents([(None, "a b"), (1, None), (1, None), (2, "x " * 80)]))
    rows = sorted(op8_quality_rules.query(spark, folder).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in rows] == [
        (None, 2, True, False), (1, 0, True, False), (1, 0, True, False), (2, 80, True, False)]
