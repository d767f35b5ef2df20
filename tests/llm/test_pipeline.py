import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from lumenward.llm.byte_bpe import codec
from lumenward.llm.common import DOCUMENT_COLUMNS
from tests.llm import brute
from tests.llm.test_quality_rules import plain


def _rows(words):
    rng, rows = random.Random(20), []
    for i in range(60):
        text = words(500 + i, rng.randrange(60, 200), 5000)
        source = rng.choice(["a", "a", "b", "c", None])
        rows.append((i, text, source))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = text.split()
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((1000 + len(rows), " ".join(copy), rng.choice(["a", "b"])))
    rows.append((300, words(900, 80, 5000) + " password=abc123def", "c"))
    rows += [(301, "short", "a"), (302, None, "b"), (303, "spam and more " * 60, "a"), (304, words(901, 90, 5000).upper(), "b")]
    return rows


def test_stages_one_by_one(spark, documents, words, as_tables, scratch):
    rows = _rows(words)
    folder = as_tables(documents=documents(rows))
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, folder), name)
        seen[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == list(DOCUMENT_COLUMNS)
    source = {i: (t, s) for i, t, s in rows}

    good = {i for i, (t, _) in source.items() if plain(t)["n_words"] >= 50 and i not in (303, 304)}
    assert {r.doc_id for r in seen["quality_rules"]} == good
    assert all((r.text, r.source) == source[r.doc_id] for r in seen["quality_rules"])

    component, _ = brute.near_components({i: source[i][0] for i in good}, 5, 80)
    firsts = {i for i in good if component[i] == i}
    assert Counter(r.doc_id for r in seen["near_dedup"]) == Counter(firsts) and len(firsts) < len(good)

    clean = {r.doc_id: r.text for r in seen["secret_scan"]}
    assert set(clean) == firsts and clean[300].endswith(" [REDACTED]") and "abc123" not in clean[300]
    assert all(clean[i] == source[i][0] for i in firsts - {300})

    sizes, taken = Counter(), Counter()
    for i in firsts:
        sizes[source[i][1]] += len(brute.words(clean[i]))
    for r in seen["source_mix"]:
        assert r.text == clean[r.doc_id]
        taken[r.source] += len(brute.words(r.text))
    want = brute.targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 100 for s in want)  # half a long document
    assert max(Counter(r.doc_id for r in seen["source_mix"]).values()) <= 3

    own = codec(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY), corpus_pipeline.public_tokenizers.PATTERN)
    other = tiktoken.Encoding("o", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    assert Counter((r.doc_id, r.n_tokens) for r in seen["byte_bpe"]) == Counter(
        (r.doc_id, len(other.encode_ordinary(r.text))) for r in seen["source_mix"])

    key = lambda r: (r.doc_id, r.n_tokens)
    assert sorted(corpus_pipeline.run(spark, folder).collect(), key=key) == sorted(seen["byte_bpe"], key=key)


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None), (2, "")], [(None, "w " * 10), (3, "one two")]])
def test_awkward_tables(spark, documents, as_tables, rows):
    assert corpus_pipeline.run(spark, as_tables(documents=documents(rows))).count() == 0


def test_each_stage_on_rows_that_earlier_ones_drop(spark, documents, words):
    rows = [(None, None, None), (1, "", None), (1, "", "a"), (2, words(1, 2000, 9000), None), (None, "x", "b")]
    docs = documents(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        assert out.count() <= 3 * len(rows), name


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {n.split("_")[0] for n in names}
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A session started elsewhere, as by a tool that only puts the repository on its own path."""
    root = str(Path(corpus_pipeline.__file__).parent)
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.queries()["op8_quality_rules"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 200" in said.stdout, said.stderr[-500:]
