"""Shape of the physical plans, numbering, storage."""

import pytest

from lumenward.functions.lexicon import ENTRIES
from lumenward.operators.digest import digest_lines, digest_pages
from lumenward.operators.numbering import with_row_numbers
from lumenward.plans.messages import classify_messages, label_messages, process_messages
from lumenward.operators.normalize import normalize_messages
from lumenward.storage import shared_folder
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df, step="executedPlan") -> str:
    """The plan with nothing cut short."""
    conf = df.sparkSession.conf
    limits = {"spark.sql.debug.maxToStringFields": "100000", "spark.sql.maxMetadataStringLength": "100000"}
    before = {key: conf.get(key) for key in limits}
    for key, limit in limits.items():
        conf.set(key, limit)
    try:
        return getattr(df._jdf.queryExecution(), step)().toString()
    finally:
        for key, limit in before.items():
            conf.set(key, limit)


def read_schema(plan: str) -> str:
    return plan.split("ReadSchema: ")[1].splitlines()[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A message table on disk, with a column nobody asks for."""
    path = str(tmp_path_factory.mktemp("stored") / "messages")
    spark.read.parquet(f"{SF}/documents.parquet").selectExpr(
        "concat('d', doc_id) AS id", "text", "cast(NULL AS string) AS content", "'incoming' AS direction",
        "'unknown' AS senderRelationship", "'p' AS platform", "'manual' AS source",
        "'2024-01-01T00:00:00Z' AS timestamp", "doc_id", "lang", "text AS unused").write.parquet(path)
    return spark.read.parquet(path)


def test_the_message_path_has_no_shuffle(stored):
    plan = plan_of(process_messages(stored, ("doc_id",)))
    assert "Exchange" not in plan and "Python" not in plan
    assert "unused" not in read_schema(plan) and "lang" not in read_schema(plan)


def test_each_pattern_runs_once(stored):
    """Filters on results must not copy the matching below themselves."""
    df = process_messages(stored, ("doc_id",)).where("size(immediate) > 0 AND language = 'en'")
    plan = plan_of(df, "optimizedPlan")
    worthless = next(e for e in ENTRIES if "worthless" in e.words).pattern.split("worthless")[1][:20]
    assert plan.count(worthless) == 2    # once for the start, once for the length
    df.collect()


def test_filters_on_other_columns_reach_the_scan(stored):
    plan = plan_of(classify_messages(normalize_messages(stored, ("doc_id",), strict=False)).where("doc_id < 5"))
    assert "PushedFilters" in plan and "LessThan(doc_id,5)" in plan


def test_remote_labels_shuffle_no_text_without_hits(spark, stored):
    candidates = stored.selectExpr("id", "array(named_struct('code', 'en', 'score', 0.9D)) AS candidates")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(process_messages(stored, ("doc_id",), detector="aws-comprehend", candidates=candidates))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The two sides of the join, and the merging of labels below one of them.
    assert plan.count("Exchange hashpartitioning") == 3
    assert "CASE WHEN (size(hits" in plan or "if ((size(hits" in plan


def test_carried_columns_may_have_any_name(spark, raw):
    names = ("words", "counts", "best", "total", "code", "score", "label", "script", "rest", "start", "excerpt", "w", "h")
    table = raw({"id": "a", "text": "add me on snapchat"}).selectExpr("*", *[f"'x' AS {n}" for n in names])
    for detector in (None, "local", "aws-comprehend"):
        row = process_messages(table, names, detector=detector).first()
        assert [row[n] for n in names] == ["x"] * len(names) and row.batch[0].confidence == 0.5
        assert row.batch[0].excerpt == "▇▇▇"


def test_numbers(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5003 AS k", "id % 3 AS other")
    got = with_row_numbers(df, ["k"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 5001))
    assert [r.k for r in got] == sorted(r.k for r in got)
    assert with_row_numbers(df.where("false"), ["k"], "n").collect() == []


def test_pages_join_to_the_whole_digest(spark, raw):
    messages = [{"id": f"{i:03d}", "text": "add me on snapchat"} for i in range(257)]
    lines = digest_lines(process_messages(raw(*messages), ("id",)), ["id"], "weekly")
    ordered = [r.line for r in lines.orderBy("line_no").collect()]
    assert len(ordered) == 259 and ordered[0].startswith("WEEKLY SUMMARY — 257 ")
    assert ordered[257].startswith("  257. Grooming pattern (en, 0.50)")
    pages = digest_pages(lines, 50).orderBy("page").collect()
    assert len(pages) == 6
    assert "\n".join(p.text for p in pages) == "\n".join(ordered)


def test_the_shared_folder_is_the_configured_one(spark):
    class Configured:
        conf = {"spark.checkpoint.dir": "hdfs:///shared"}

        class sparkContext:
            master = "yarn"

    class OneMachine(Configured):
        conf = {"spark.checkpoint.dir": "file:/tmp/own"}

    class Cluster:
        conf = {}

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    assert shared_folder(Configured) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Cluster)
    with pytest.raises(RuntimeError, match="all executors"):
        shared_folder(OneMachine)
    assert shared_folder(spark) == shared_folder(spark)


TEXT_QUERIES = ("normalize_messages", "detect_language", "tokens", "lexicon_hits", "hits_gated", "findings", "finding_texts",
                "process_messages", "process_messages_local", "formatted_alerts", "digest_items", "digest_per_message")


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_registered_text_queries_shuffle_nothing(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "Exchange" not in plan and "Python" not in plan


def test_the_language_step_runs_no_pattern(spark, stored):
    labels = stored.selectExpr("id", "array(named_struct('code', 'en', 'score', 0.9D)) AS candidates")
    labelled = label_messages(normalize_messages(stored), "aws-comprehend", labels)
    plan = plan_of(labelled, "optimizedPlan")
    assert "regexp_extract" not in plan and "worthless" not in plan
    assert "text" not in labelled.columns


def test_streams_read_a_table_of_one_file_and_of_many(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    for name in ("stream_alerts", "stream_digest_items", "stream_daily_counts"):
        one = sorted(map(str, QUERIES[name](spark, SF).collect()))
        many = sorted(map(str, QUERIES[name](spark, str(tmp_path)).collect()))
        assert one == many and one
