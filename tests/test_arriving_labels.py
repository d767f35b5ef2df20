"""Labels that arrive as a stream, in time or not."""

import pytest

from lumenward.streaming.alerts import process_message_stream, to_table
from lumenward.streaming.labels import ArrivingLabels

MESSAGES = "id string, text string, direction string, arrived timestamp"
LABELS = "id string, candidates array<struct<code:string,score:double>>, arrived timestamp"


@pytest.fixture()
def two_streams(spark, tmp_path):
    """Play rows of messages and labels, one pair of files after the other; language and alerts by id."""
    def play(*goes):
        out = tmp_path / "out"
        for messages, labels in goes:
            stamped = [(i, text, "outgoing", at) for i, text, at in messages]
            for name, rows, schema in (("messages", stamped, MESSAGES), ("labels", labels, LABELS)):
                kind = schema.replace("timestamp", "string")
                spark.createDataFrame(rows, kind).withColumn("arrived", spark_time()).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            raw = spark.readStream.schema(MESSAGES).parquet(str(tmp_path / "messages"))
            arriving = ArrivingLabels(spark.readStream.schema(LABELS).parquet(str(tmp_path / "labels")), "arrived")
            results = process_message_stream(raw, ("arrived",), detector="aws-comprehend", candidates=arriving)
            flat = results.selectExpr("message.id AS id", "language", "languageSource", "fallback", "size(alerts) AS alerts")
            to_table(flat, str(out), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return [(r.id, r.language, r.languageSource, r.fallback is not None) for r in spark.read.parquet(str(out)).collect()]

    def spark_time():
        from pyspark.sql import functions as F
        return F.to_timestamp(F.concat(F.lit("2024-01-01 "), "arrived"))

    return play


def de(score=0.9):
    return [("de", score)]


def test_labels_before_after_and_too_late(two_streams):
    end = ([("end", "the end", "20:00:00")], [("none", de(), "20:00:00")])
    got = two_streams(
        ([("before", "the cat and the dog", "10:00:00"), ("after", "the cat and the dog", "10:00:00"), ("late", "the cat and the dog", "10:00:00"),
          ("early", "the cat and the dog", "10:00:00"), (None, "no id is the case", "10:00:00"), ("blank", "  ", "10:00:00"),
          ("no time", "the cat and the dog", None), ("empty", "the cat and the dog", "10:00:00"), ("twice", "the cat and the dog", "10:00:00")],
         [("before", de(), "09:55:00"), ("early", de(), "09:40:00"), ("empty", [], "10:00:00"), ("no time", de(), "10:00:00"),
          (None, de(), "10:00:00"), ("twice", de(), "10:00:00"), ("twice", [("fr", 1.0)], "10:00:00")]),
        ([("later", "the cat and the dog", "10:08:00")], [("after", de(), "10:08:00")]),
        ([], [("late", de(), "10:30:00"), ("later", de(), "10:18:00")]), end)
    found = {i: (language, source, fallback) for i, language, source, fallback in got if i != "end"}
    assert len([i for i, *_ in got if i != "end"]) == len(found) == 10
    local, remote = ("en", "local-heuristic", True), ("de", "aws-comprehend", False)
    assert found["before"] == found["after"] == found["later"] == remote
    assert found["late"] == found["early"] == found["no time"] == found[None] == local
    assert found["blank"] == ("und", "aws-comprehend", False) and found["empty"] == ("und", "aws-comprehend", False)
    assert found["twice"][0] in ("de", "fr")


def test_messages_far_behind_are_not_lost(two_streams):
    got = two_streams(([("a", "the cat and the dog", "10:00:00")], []), ([("b", "the cat and the dog", "12:00:00")], [("b", de(), "12:00:00")]),
                      ([("c", "the cat and the dog", "12:30:00")], [("x", de(), "15:00:00")]), ([("end", "e", "20:00:00")], [("y", de(), "20:00:00")]))
    assert {i for i, *_ in got} >= {"a", "b", "c"}
