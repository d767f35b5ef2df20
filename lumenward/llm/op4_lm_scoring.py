"""Query of the language-model scores.  The tree's score is not SQL: tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenward.llm.common import read_table, typed
from lumenward.llm.lm_scoring import scores
from lumenward.storage import Scratch


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = typed(read_table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    return scores(docs, Scratch(spark))
