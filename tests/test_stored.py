"""Stored messages meet new labels without a shuffle."""

import uuid

import pytest

from lumenward.plans.messages import process_messages
from lumenward.plans.stored import MessageStore
from lumenward.schema import CANDIDATES_SCHEMA
from tests.sample import SAMPLE


@pytest.fixture()
def store(spark, tmp_path):
    made = MessageStore(spark, f"store_{uuid.uuid4().hex}", str(tmp_path / "store"), buckets=8, most=30)
    yield made
    made.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(made.name)]


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _flat(results):
    return sorted(map(str, results.selectExpr("message.id AS id", "language", "languageSource", "fallback", "immediate", "batch").collect()))


def test_labels_meet_stored_messages_without_an_exchange(spark, raw, store, no_broadcast):
    # m1 is hot: 200 of the messages, with texts of their own; some have no id.
    messages = raw(*[{**SAMPLE[0], "text": f"{SAMPLE[0]['text']} {i}"} for i in range(200)], *SAMPLE, *[{**m, "id": None} for m in SAMPLE * 5])
    store.write_messages(messages)
    first = spark.createDataFrame([("m1", [("de", 0.9)]), ("m5", [("fr", 0.7)]), ("m5", [("es", 0.9)]), (None, [("it", 0.9)]), ("other", [])], CANDIDATES_SCHEMA)
    second = spark.createDataFrame([("m1", []), ("m2", [("pt-BR", 0.8)])], CANDIDATES_SCHEMA)
    for name, labels in (("first", first), ("second", second)):
        store.write_labels(labels, name)
        results = store.results(name)
        plan = results._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "regexp_extract" not in plan.lower().split("sortmergejoin")[1]
        want = process_messages(messages, detector="aws-comprehend", candidates=labels)
        assert _flat(results) == _flat(want)


def test_a_hot_id_lies_in_several_buckets(spark, raw, store):
    store.write_messages(raw(*[{"id": "hot", "text": f"kill yourself {i}"} for i in range(300)], *[{"id": f"c{i}", "text": "hi"} for i in range(60)]))
    files = spark.table(store.name).where("id = 'hot'").selectExpr("input_file_name() AS file").groupBy("file").count().collect()
    assert len(files) >= 4 and max(f["count"] for f in files) < 200 and sum(f["count"] for f in files) == 300
    assert spark.table(f"{store.name}_hot").collect()[0]._shares == 10


def test_empty_tables(spark, raw, store):
    store.write_messages(raw())
    store.write_labels(spark.createDataFrame([], CANDIDATES_SCHEMA), "none")
    assert store.results("none").collect() == []
