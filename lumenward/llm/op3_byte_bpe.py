"""Query of the byte-level BPE.  No SQL: tested against another encoder of the same ranks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenward.llm.byte_bpe import round_trip_digests
from lumenward.llm.common import read_table, typed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = typed(read_table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    return round_trip_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
