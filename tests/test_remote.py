"""Languages from a table of labels."""

import pytest

from lumenward.operators.findings import exploded_findings
from lumenward.operators.normalize import normalize_messages
from lumenward.plans.messages import classify_messages, label_messages, match_messages, process_messages
from lumenward.schema import CANDIDATES_SCHEMA
from tests.sample import SAMPLE

LABELS = [
    ("top", [("en", .3), ("zh-TW", .877), ("fr", .1)]),
    ("tie", [("pt-BR", .5), ("es", .5)]),
    ("none", []),
    ("blank", [("en", .9)]),
    ("low", [("fr", .2)]),
]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, CANDIDATES_SCHEMA)


@pytest.fixture(scope="module")
def labelled(raw, labels):
    messages = [{"id": name, "text": "the loser and you perdedor"} for name in ("top", "tie", "none", "low", "absent")]
    messages += [{"id": "blank", "text": " \n"}, {"id": None, "text": "no id but it is a loser"},
                 {"id": None, "text": "another one for you and me"}]
    normalized = normalize_messages(raw(*messages))
    return match_messages(normalized, "aws-comprehend", labels).collect()


def test_labels(labelled):
    got = {r.id: (r.language, r.languageName, r.languageConfidence, r.languageSource, r.fallback)
           for r in labelled if r.id}
    remote = "aws-comprehend"
    assert got["top"] == ("zh", "zh", 0.88, remote, None)
    assert got["tie"] == ("pt", "Portuguese", 0.5, remote, None)
    assert got["none"] == ("und", "Undetermined", 0.0, remote, None)
    assert got["blank"] == ("und", "Undetermined", 0.0, remote, None)
    assert got["low"][:3] == ("fr", "French", 0.2)
    language, _, confidence, source, reason = got["absent"]
    assert (language, confidence, source) == ("en", 0.95, "local-heuristic") and remote in reason


def test_messages_without_id_fall_back(labelled):
    assert [r.languageSource for r in labelled if r.id is None] == ["local-heuristic"] * 2


def test_hits_follow_the_label(labelled):
    got = {r.id: [h.lang for h in r.hits] for r in labelled if r.id}
    assert got["top"] == ["en"]                # only what always applies
    assert got["tie"] == ["en", "pt"]
    assert got["low"] == ["en", "es", "pt", "de"]    # unsure: everything
    assert got["none"] == ["en", "es", "pt", "de"]
    assert got["blank"] == []


def test_no_table_falls_back_everywhere(raw):
    stamped = raw(*[{**m, "timestamp": "2024-01-01T00:00:00Z"} for m in SAMPLE])
    remote = process_messages(stamped, detector="aws-comprehend")
    assert all("aws-comprehend" in r.fallback for r in remote.collect())
    plain = process_messages(stamped)
    assert sorted(map(str, remote.drop("languageSource", "fallback").collect())) == sorted(map(str, plain.collect()))


def test_unknown_detector(raw):
    with pytest.raises(ValueError):
        process_messages(raw({"text": "hi"}), detector="not-a-real-backend")


def test_a_hot_id_is_split(spark, raw, labels):
    """A third of all rows under one id go to several tasks of the join."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, setting in settings.items():
        spark.conf.set(key, setting)
    try:
        rows = spark.range(0, 30000, 1, 8).selectExpr(
            "if(id % 3 = 0, 'top', concat('id', id)) AS id", "concat('the loser and you ', id) AS text",
            "'incoming' AS direction", "'unknown' AS senderRelationship", "'p' AS platform", "'manual' AS source",
            "'2024-01-01T00:00:00Z' AS timestamp")
        joined = match_messages(rows, "aws-comprehend", labels).select("id", "language", "text", "hits")
        got = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, setting in before.items():
            spark.conf.set(key, setting)
    assert len(got) == 30000
    assert sum(r.language == "zh" for r in got) == 10000
    assert "skew=true" in plan


def test_any_label_table_leaves_one_row_per_message(raw, spark):
    rows = [("a", [("en", .3)]), ("a", [("fr", .9), ("de", .9)]), ("a", []), ("b", [("", .8)]), ("c", [(None, .8)]),
            ("d", [("es", .5)]), ("d", [("pt", .5)]), ("e", None), ("e", None), (None, [("it", 1.0)])]
    table = spark.createDataFrame(rows, CANDIDATES_SCHEMA)
    messages = normalize_messages(raw(*[{"id": i, "text": "you are a loser"} for i in "abcdef"], {"text": "no id"}))
    for run in (match_messages, label_messages):
        got = {r.id: (r.language, r.languageConfidence, r.languageSource) for r in run(messages, "aws-comprehend", table).collect()}
        remote = "aws-comprehend"
        assert len(got) == 7
        assert got["a"] == ("fr", 0.9, remote) and got["b"] == ("und", 0.8, remote) and got["c"] == ("und", 0.8, remote)
        assert got["d"] == ("pt", 0.5, remote) and got["e"] == ("und", 0.0, remote)
        assert got["f"][2] == got[None][2] == "local-heuristic"
    assert len(process_messages(raw({"id": "a", "text": "x"}), detector="aws-comprehend", candidates=table).collect()) == 1


def test_the_language_step_alone_gives_the_same(raw, labels):
    messages = normalize_messages(raw(*SAMPLE, {"id": "top", "text": "abc"}, {"id": "tie", "text": " "}))
    for detector in (None, "local", "aws-comprehend"):
        alone = label_messages(messages, detector, labels)
        names = [c for c in alone.columns if c.startswith("language") or c in ("id", "fallback")]
        whole = match_messages(messages, detector, labels)
        assert sorted(map(str, alone.select(names).collect())) == sorted(map(str, whole.select(names).collect()))
