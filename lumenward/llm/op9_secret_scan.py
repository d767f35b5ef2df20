"""Query of the secret scans.  The spans of the token test need the vocabulary, so there is no SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenward.llm.common import read_table, typed
from lumenward.llm.op3_byte_bpe import VOCABULARY
from lumenward.llm.secret_scan import ACCESS, ASSIGN, HEX, RANDOM, scan


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = typed(read_table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    scanned = scan(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).drop("clean_text")

    def count(kind: str) -> str:
        return f"cast(size(filter(spans, s -> s.kind = '{kind}')) AS bigint)"

    def listed(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"

    base = f"filter(spans, s -> s.kind <> '{RANDOM}')"
    return scanned.selectExpr(
        "doc_id", f"{count(ASSIGN)} AS n_assign", f"{count(ACCESS)} AS n_access", f"{count(HEX)} AS n_hex",
        f"sha2({listed(base)}, 256) AS base_sha256", f"{listed('spans')} AS spans", f"{count(RANDOM)} AS n_random")
