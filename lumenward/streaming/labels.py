"""Language labels that arrive as a stream beside the messages.

A message waits for its label a while.  One that comes in time, before or after the
message, decides its language; when the time is up the local result does.

Spark's outer join of two streams does the waiting.  It drops rows that come later
than its watermark allows, so the time it goes by is when a row *arrived*, such as
the time a broker gives it, which no late message can be behind.  Messages that
have nothing to wait for don't go through the join: those without id, without text
or without an arrival time.

Of several labels for an id within the wait, the first to arrive counts.  The state
is the narrow rows of the messages of the last ``wait``, with text only where a
pattern matched, and the labels of about twice that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.operators.language import best_candidate, label_of, labelled_language


@dataclass(frozen=True)
class ArrivingLabels:
    """A stream of (id, candidates, ``arrived``), in place of a table of labels.

    ``arrived`` names the arrival time on both streams; messages must keep it.
    ``disorder`` is by how much arrival times of a stream may be out of order."""
    labels: DataFrame
    arrived: str
    wait: str = "10 minutes"
    disorder: str = "0 seconds"

    def language_of(self, messages: DataFrame) -> DataFrame:
        """Like ``with_remote_language``, of a stream of messages."""
        waits = f"id IS NOT NULL AND NOT _blank AND `{self.arrived}` IS NOT NULL"
        label = "struct<score:double,place:int,code:string>"
        at_once = messages.where(f"NOT ({waits})").selectExpr(
            "*", "cast(NULL AS string) AS _label_id", f"cast(NULL AS {label}) AS _label")
        labels = (
            self.labels.where(f"id IS NOT NULL AND `{self.arrived}` IS NOT NULL")
            .selectExpr("id AS _label_id", f"cast({label_of(best_candidate('candidates'))} AS {label}) AS _label", f"`{self.arrived}` AS _labelled")
            .withWatermark("_labelled", self.disorder).dropDuplicatesWithinWatermark(["_label_id"]))
        timely = (f"id = _label_id AND _labelled >= `{self.arrived}` - INTERVAL {self.wait}"
                  f" AND _labelled <= `{self.arrived}` + INTERVAL {self.wait}")
        waiting = messages.where(waits).withWatermark(self.arrived, self.disorder).join(labels, F.expr(timely), "left").drop("_labelled")
        return labelled_language(waiting.unionByName(at_once))
