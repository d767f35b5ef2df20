"""Query of the packing.  What a packing picks is not SQL: tested against the texts' ids and brute force."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenward.llm.common import read_table
from lumenward.llm.packing import pack
from lumenward.storage import Scratch

VOCABULARY = "word_bpe_49k.json"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), Scratch(spark))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
