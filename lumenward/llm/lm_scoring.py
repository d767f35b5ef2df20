"""Scores of whole texts by a context tree and by word counts, both learned from the corpus.

Word counts of the whole vocabulary stay a table.  The most frequent words, at
most :data:`TOP_WORDS` of at most :data:`TOP_BYTES` bytes, go to every worker; the
other words of a text, a small part of it, are looked up by a join on the word.
No word of that join is frequent, so none makes a large group.  The grams of the
tree are looked up in the same way.

Defined results: see :mod:`lumenward.llm.context_tree`; very long texts are scored
whole and extra columns are ignored; null and empty texts have one token, their end;
repeated rows give repeated rows; an empty table gives an empty one, and without
any training text no token is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.llm import context_table
from lumenward.llm.context_table import GramTable, gram_scores
from lumenward.llm.words import LOWER, slices, text_buffer, word_array, word_spans
from lumenward.storage import Scratch

TOP_WORDS = 1 << 18
TOP_BYTES = 64


def _words_of(column: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    data, bounds = text_buffer(column)
    data = LOWER[data]
    starts, ends, counts = word_spans(data, bounds)
    return word_array(data, starts, ends), counts


def _counted(most: int = 500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in slices(batches, "text"):
            found = pc.value_counts(_words_of(part.column(0))[0])
            table = pa.table({"word": found.field(0), "n": found.field(1)})
            held = table if held is None else pa.concat_tables([held, table]).group_by("word").aggregate(
                [("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])
            if held.num_rows > most:
                yield from held.combine_chunks().to_batches()
                held = None
        if held is not None:
            yield from held.combine_chunks().to_batches()
    return run


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all texts, A-Z in lower case."""
    rows = texts.selectExpr("coalesce(text, '') AS text")
    return rows.mapInArrow(_counted(), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(table: DataFrame, count: str, most: int) -> DataFrame:
    """The rows above a count that at most ``most`` of them reach."""
    level = f"cast(floor(16 * log2({count})) AS int)"
    levels = table.groupBy(F.expr(level).alias("level")).count().collect()
    lowest, held = None, 0
    for row in sorted(levels, key=lambda r: -r.level):
        held += row["count"]
        if held > most:
            break
        lowest = row.level
    return table.where("false" if lowest is None else f"{level} >= {lowest}")


def frequent_words(vocabulary: DataFrame, most: int = TOP_WORDS) -> pa.Table:
    """The words above a count that at most ``most`` words reach, none longer than TOP_BYTES."""
    return _most_frequent(vocabulary, "n", most).where(f"octet_length(word) <= {TOP_BYTES}").toArrow()


def scores(docs: DataFrame, scratch: Scratch, training: str = "crc32(cast(doc_id AS string)) % 7 <> 2") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of (doc_id, text).

    The last is the code length of the text and its end mark for each byte of them.

    ``training`` says which rows are learned from; a row for which it is null is one of them."""
    docs = docs.selectExpr("doc_id", "text", f"NOT coalesce({training}, true) AS held_out")
    lessons = docs.where("NOT held_out").select("text")
    vocabulary = scratch.table(word_counts(lessons), "vocabulary")
    n_docs = lessons.count()
    sums = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = (sums.n or 0) + n_docs, sums.v + (n_docs > 0)
    common = frequent_words(vocabulary)
    values = gram_scores(docs.select("text", "held_out"), scratch)
    grams = GramTable(_most_frequent(values, "places", context_table.TOP_GRAMS).select("gram", "value").toArrow())
    shared = scratch.spark.sparkContext.broadcast((common, grams))
    end_gain, end_known = float(np.log10(n_docs + 1.0)), int(n_docs > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = shared.value
        listed = table["word"].combine_chunks()
        gain = np.log10(table["n"].to_numpy().astype(np.float64) + 1.0)
        for part in slices(batches, "text"):
            words, counts = _words_of(part.column(2))
            at = pc.index_in(words, value_set=listed)
            rare = at.is_null()
            owner = np.repeat(np.arange(len(counts)), counts)
            is_rare = rare.to_numpy(zero_copy_only=False)
            hit = owner[~is_rare]
            known = np.bincount(hit, minlength=len(counts))
            sums = np.bincount(hit, gain[at.drop_null().to_numpy()], len(counts))

            def listed_by(of: np.ndarray, items: pa.Array) -> pa.ListArray:
                offsets = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(np.bincount(of, minlength=len(counts)), out=offsets[1:])
                return pa.ListArray.from_arrays(pa.array(offsets), items)

            score, others, of = model.score(part.column(2))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(3), pa.array(counts.astype(np.int64) + 1), pa.array(known.astype(np.int64) + end_known),
                 pa.array(sums + end_gain), pa.array(score),
                 listed_by(owner[is_rare], words.filter(rare)), listed_by(of, pa.array(others.view(np.int64)))],
                names=["doc_id", "held_out", "n_bytes", "n_tokens", "known", "gain", "score", "rare", "grams"])

    scored = scratch.table(
        docs.selectExpr("doc_id", "held_out", "coalesce(text, '') AS text", "cast(coalesce(octet_length(text), 0) AS bigint) AS n_bytes").mapInArrow(
            run, "doc_id bigint, held_out boolean, n_bytes bigint, n_tokens bigint, known bigint, gain double, score double, rare array<string>, "
                 "grams array<bigint>")
        .selectExpr("monotonically_increasing_id() AS _row", "*"), "scored")
    rare = scored.selectExpr("_row", "explode(rare) AS word").groupBy("word", "_row").count()
    seen = rare.join(vocabulary, "word").groupBy("_row").agg(
        F.sum("count").alias("_known"), F.sum(F.expr("count * log10(n + 1D)")).alias("_gain")).withColumnRenamed("_row", "_seen")
    other = scored.selectExpr("_row", "explode(grams) AS gram").groupBy("gram", "_row").count()
    valued = other.join(values.select("gram", "value"), "gram").groupBy("_row").agg(
        F.sum(F.expr("count * value")).alias("_value")).withColumnRenamed("_row", "_valued")
    return (
        scored.drop("rare", "grams").join(seen, F.expr("_row = _seen"), "left").join(valued, F.expr("_row = _valued"), "left")
        .selectExpr(
            "doc_id", "held_out", "n_tokens", "known + coalesce(_known, 0L) AS n_known", f"{n}L AS train_tokens",
            f"gain + coalesce(_gain, 0D) - n_tokens * log10({n + v + 1}D) AS base_score",
            "score + coalesce(_value, 0D) AS score",
            "(score + coalesce(_value, 0D)) / (-log10(2D) * (n_bytes + 1)) AS bits_per_byte"))
