"""Intermediate tables in the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Intermediate tables are mostly texts, written once and read once or twice.
COMPRESSION = "zstd"


def check_shared_folder(spark: SparkSession) -> None:
    """Refuse a cluster session without a folder for intermediate tables, or with a
    folder of one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.master.startswith("local"):
        return
    if not folder or folder.startswith("file:"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session, which has a single machine, gets one of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        check_shared_folder(spark)
        return configured
    context = spark.sparkContext
    if not context.getCheckpointDir():
        check_shared_folder(spark)
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lumenward-"))
    return context.getCheckpointDir()


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to a table and go on from there.

    Several results then share one computation, a lost executor costs a re-read
    instead of a re-run, and each reader takes only the columns it needs."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of this engine's own making that nothing will read again."""
    if not path.startswith(shared_folder(spark).rstrip("/") + "/"):
        raise ValueError(f"not in the shared folder: {path}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables that belong together and go together.

    As a context manager it deletes them on leaving, in success and failure."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def path(self, name: str) -> str:
        self.paths.append(new_table_path(self.spark, name))
        return self.paths[-1]

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Like :func:`materialize`, the table being one of these."""
        path = self.path(name)
        df.write.option("compression", COMPRESSION).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        while self.paths:
            drop_table(self.spark, self.paths.pop())

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()
