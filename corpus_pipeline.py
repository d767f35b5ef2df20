"""Training-data pipeline over ``documents``: rules, near copies, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; a runner writes it as
Parquet and reads it again as the next stage's ``docs``.  All but the last return
the columns of ``documents``.

1. ``quality_rules`` drops the documents that fail the latest policy of the rule ledger.
2. ``near_dedup`` keeps the document with the smallest id of each group of near
   copies: five words to a shingle, a similarity of 0.8 or more, confirmed on full sets.
3. ``secret_scan`` takes secrets out of the texts; texts without any are untouched.
4. ``source_mix`` holds each document as often as the mix of sources takes it, a
   row for each copy.
5. ``byte_bpe`` encodes and decodes each row's text: ``doc_id, source, n_tokens``
   and the digests of ids and decoded bytes.

Defined results: null and empty texts fail the first stage, so later stages see
none of them, but each handles them; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenward.llm.byte_bpe import round_trip_digests
from lumenward.llm.common import DOCUMENT_COLUMNS, with_package
from lumenward.llm.minhash import Settings, keep_one_of_each
from lumenward.llm.mixing import mixed_documents
from lumenward.llm.op3_byte_bpe import VOCABULARY
from lumenward.llm.quality_rules import reject_low_quality
from lumenward.llm.secret_scan import redact_secrets
from lumenward.storage import Scratch

NEAR = Settings(width=5, percent=80)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT_COLUMNS)


@with_package
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_low_quality(_documents(docs))


@with_package
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(_documents(docs), NEAR, Scratch(spark))


@with_package
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(_documents(docs), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@with_package
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(_documents(docs), Scratch(spark))


@with_package
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip_digests(
        _documents(docs), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=("doc_id", "source"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]


@with_package
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written and read again."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES:
        docs = tables.table(stage(spark, docs, sf_dir), name)
    return docs


#: What a knapsack picks is not SQL; tested against a brute-force version instead.
ORACLE_SQL = None
