"""A session with the settings this package is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lumenward.storage import check_shared_folder


def build_session(name: str = "lumenward", master: str | None = None, **settings: str) -> SparkSession:
    """A new or running session; cluster settings come from spark-submit.

    Intermediate tables need a folder that all executors reach, in
    ``spark.checkpoint.dir``; only a local session can do without the setting."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    check_shared_folder(spark)
    return spark
