"""Small helpers of the operators."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; a column that isn't there is null.

    Extra columns, whatever their names, go no further."""
    return df.selectExpr(*[
        f"cast({f'`{name}`' if name in df.columns else 'NULL'} AS {kind}) AS {name}" for name, kind in types.items()])


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_package(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, run so that Python workers find this package.

    They import it by name.  A session that was started in another folder does not
    have this one on its workers' path; where the package is installed on all
    machines this changes nothing."""
    @functools.wraps(query)
    def run(spark: SparkSession, *rest) -> DataFrame:
        environment = spark.sparkContext.environment
        paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if _ROOT not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
        return query(spark, *rest)
    return run
