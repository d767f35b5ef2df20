"""Messages kept by id, so that new labels meet them where they lie.

A labelling service answers again and again: new labels, better ones, another
service's.  Joining them with all messages shuffles all messages every time.  Here messages
are matched once and stored in buckets of their id, labels are stored in the same
buckets, and the join reads bucket after bucket from both: nothing is shuffled, and
nothing is matched again.

An id with very many messages would fill one bucket.  Such *hot* ids are counted
when messages are stored; their messages are dealt to several buckets, and their
label, one row, is stored once for each.  Messages without id are dealt to all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenward.functions.languages import REMOTE_DETECTOR
from lumenward.functions.lexicon import ENTRIES
from lumenward.operators.findings import with_findings
from lumenward.operators.language import labelled_language, merged_labels
from lumenward.operators.normalize import normalize_messages
from lumenward.plans.messages import decided_messages, routed_messages, tried_messages

_KEY = "_key"


def _save(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """A table of one file for each bucket, sorted by the key."""
    df.repartition(buckets, _KEY).write.option("path", path).option("compression", "zstd").bucketBy(buckets, _KEY).sortBy(_KEY).saveAsTable(table)


@dataclass(frozen=True)
class MessageStore:
    """Tables ``name``, ``name_hot`` and ``name_labels_...`` in the catalog, in a folder that all executors reach.

    ``most`` is how many messages of an id a bucket gets before others are used."""
    spark: SparkSession
    name: str
    folder: str
    buckets: int = 64
    most: int = 100_000

    def _path(self, table: str) -> str:
        return f"{self.folder.rstrip('/')}/{table}"

    def write_messages(self, raw: DataFrame, keep=(), strict: bool = True, entries=ENTRIES) -> None:
        """Normalize and match raw messages, and store what results need."""
        normalized = normalize_messages(raw, keep, strict)
        counted = normalized.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where(f"n > {self.most}")
        counted.selectExpr("id AS _hot", f"cast(ceil(n / {self.most}) AS int) AS _shares").write.option(
            "path", self._path("hot")).saveAsTable(f"{self.name}_hot")
        others = ", ".join(f"`{c}`" for c in normalized.columns)
        dealt = normalized.selectExpr("*", f"xxhash64({others}) AS _deal").join(
            self.spark.table(f"{self.name}_hot"), F.expr("id = _hot"), "left")
        key = ("CASE WHEN id IS NULL THEN concat('none ', _deal) ELSE"
               " concat('id ', pmod(_deal, coalesce(_shares, 1)), ' ', id) END")
        tried = tried_messages(dealt.withColumn(_KEY, F.expr(key)).drop("_deal", "_hot", "_shares"), entries)
        _save(tried, self.name, self._path("messages"), self.buckets)

    def write_labels(self, candidates: DataFrame, label: str) -> None:
        """Store a table of labels, merged by id, under a name of their own."""
        labels = merged_labels(candidates).join(self.spark.table(f"{self.name}_hot"), F.expr("_label_id = _hot"), "left").selectExpr(
            "_label_id", "_label", "explode(sequence(0, coalesce(_shares, 1) - 1)) AS _share").selectExpr(
            f"concat('id ', _share, ' ', _label_id) AS {_KEY}", "_label_id", "_label")
        _save(labels, f"{self.name}_labels_{label}", self._path(f"labels-{label}"), self.buckets)

    def classified(self, label: str) -> DataFrame:
        """The stored messages with their findings by the labels of that name."""
        labels = self.spark.table(f"{self.name}_labels_{label}").withColumnRenamed(_KEY, "_label_key")
        joined = self.spark.table(self.name).join(labels, F.expr(f"{_KEY} = _label_key"), "left").drop("_label_key", _KEY)
        return with_findings(decided_messages(labelled_language(joined), pinned=False)).drop("text")

    def results(self, label: str, keep=()) -> DataFrame:
        """One nested result row per stored message."""
        return routed_messages(self.classified(label), keep, REMOTE_DETECTOR)

    def drop(self) -> None:
        """Take the tables out of the catalog; the folder is the caller's."""
        for table in self.spark.catalog.listTables():
            if table.name in (self.name, f"{self.name}_hot") or table.name.startswith(f"{self.name}_labels_"):
                self.spark.sql(f"DROP TABLE {table.name}")
