"""Query of the mix.  What a knapsack picks is not SQL: tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenward.llm.common import read_table, typed
from lumenward.llm.mixing import mix, word_count
from lumenward.storage import Scratch


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = typed(read_table(spark, sf_dir, "documents"), doc_id="bigint", text="string", source="string")
    sized = docs.selectExpr("doc_id", "source", f"{word_count('text')} AS size")
    return mix(sized, Scratch(spark))
