"""Query of the URL filters.  The model's weights are not SQL: tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenward.llm.common import read_table, typed
from lumenward.llm.url_filter import filter_urls, labelled_urls, train


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = typed(read_table(spark, sf_dir, "pages"), page_id="bigint", url="string")
    return filter_urls(pages, train(labelled_urls(spark)))
