"""Query of the quality scores.  Training is not SQL: tested by held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenward.llm.common import read_table, typed
from lumenward.llm.pu_quality import score_quality
from lumenward.storage import Scratch


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = typed(read_table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    labels = typed(read_table(spark, sf_dir, "labels"), doc_id="bigint", quality="int")
    return score_quality(docs, labels, Scratch(spark))
