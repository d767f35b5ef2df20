"""One streaming run: every message once, digests when periods close, nothing twice after a failure."""

import json

import pytest

from lumenward.operators.digest import digest_of_findings
from lumenward.plans.messages import process_messages
from lumenward.schema import CANDIDATES_SCHEMA
from lumenward.sources.lexicon import lexicon_table
from lumenward.streaming import run as run_module
from lumenward.streaming.job import parse_options, start
from lumenward.streaming.run import StreamRun, read_placed_line_stream
from tests.sample import SAMPLE


def lines_of(folder, name, messages):
    (folder / name).write_text("".join((m if isinstance(m, str) else json.dumps(m)) + "\n" for m in messages))


def stamped(at, message, **more):
    return {**message, "timestamp": at, **more}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in"


def made(spark, folder, tmp_path, **options):
    options = {"delay": "1 hour", **options}
    return StreamRun(read_placed_line_stream(spark, str(folder)), str(tmp_path / "out"), **options)


def drain(run, tmp_path):
    run.writer(str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return run


BATCHES = [
    [stamped("2024-01-01T10:00:00Z", SAMPLE[0]), {**SAMPLE[4], "id": "no time"}, stamped("yesterday", SAMPLE[4]), "not json"],
    [stamped("2024-01-01T11:00:00Z", SAMPLE[1]), stamped("2024-01-01T09:00:00Z", SAMPLE[5])],
    [stamped("2024-01-02T01:00:00+02:00", SAMPLE[2]), stamped(1704189600000, SAMPLE[3]), stamped("2999-01-01", SAMPLE[5], id="far")],
    [stamped("2024-01-05T00:00:00Z", SAMPLE[8]), {"id": "x", "text": "kill yourself", "source": "scraping"}],
    [stamped("2024-01-01T09:00:00Z", SAMPLE[5], id="too late"), stamped("2024-01-09T00:00:00Z", SAMPLE[9])],
    [stamped("2024-01-03T09:00:00Z", SAMPLE[0], id="late, with an alert")],
]


def outcome(run):
    """Everything a run wrote, without places."""
    return {
        "fates": sorted((r.fate, r.n) for r in run.messages().groupBy("fate").count().withColumnRenamed("count", "n").collect()),
        "windows": sorted((str(r.period), r.messages, r.immediate, r.batched) for r in run.windows().collect()),
        "digests": sorted((str(r.period), r.line_no, r.line) for r in run.digests().collect()),
        "alerts": sorted((r.id, r.place) for r in run.alerts().collect()),
        "late": sorted((r.id, str(r.period), r.immediate, r.batched, len(r.findings)) for r in run.late().collect()),
        "undated": sorted((r.id, r.reason, r.immediate) for r in run.undated().collect()),
        "refused": sorted((r.id, r.source, r.text, r.reason[:8]) for r in run.refused().collect()),
        "bad": sorted(r.line for r in run.bad_lines().collect()),
    }


def play(spark, folder, tmp_path, batches=BATCHES, **options):
    for i, batch in enumerate(batches):
        lines_of(folder, f"{i}.jsonl", batch)
        run = drain(made(spark, folder, tmp_path, **options), tmp_path)
    return run


def test_every_message_is_in_one_table(spark, folder, tmp_path):
    got = outcome(play(spark, folder, tmp_path))
    assert got["fates"] == [("bad", 1), ("counted", 7), ("late", 2), ("refused", 1), ("undated", 3)]
    assert sum(n for _, n in got["fates"]) == sum(map(len, BATCHES))
    assert got["windows"] == [("2024-01-01", 4, 3, 2), ("2024-01-02", 1, 1, 0), ("2024-01-05", 1, 0, 0)]
    assert got["late"] == [("late, with an alert", "2024-01-03", 1, 0, 0), ("too late", "2024-01-01", 0, 1, 1)]
    assert got["undated"] == [("far", "future", 0), ("m5", "unreadable", 1), ("no time", "missing", 1)]
    assert got["refused"] == [("x", "scraping", "kill yourself", "Refusing")] and got["bad"] == ["not json"]
    assert {"no time", "m5", "late, with an alert"} <= {i for i, _ in got["alerts"]}
    days = {}
    for day, no, line in got["digests"]:
        days.setdefault(day, []).append(line)
    assert {d: len(v) for d, v in days.items()} == {"2024-01-01": 4, "2024-01-02": 1, "2024-01-05": 1}
    assert [line[:6] for line in days["2024-01-01"]] == ["DAILY ", "  1. G", "  2. H", "  No i"]


def test_digests_equal_those_of_the_batch_plan(spark, folder, tmp_path):
    messages = [stamped(f"2024-01-0{1 + i % 3}T10:00:00Z", m, id=f"{i:03}") for i, m in enumerate(SAMPLE * 4)]
    lines_of(folder, "0.jsonl", messages)
    lines_of(folder, "1.jsonl", [stamped("2024-02-01T00:00:00Z", SAMPLE[9])])
    run = drain(made(spark, folder, tmp_path), tmp_path)
    results = process_messages(spark.read.json(str(folder)), strict=False).selectExpr(
        "message.id AS id", "to_date(message.timestamp) AS day", "posexplode(batch) AS (place, finding)")
    got = run.digests().collect()
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        want = digest_of_findings(results.where(f"day = DATE'{day}'"), ["id", "place"]).orderBy("line_no").collect()
        assert sorted((r.line_no, r.line) for r in got if str(r.period) == day) == [(r.line_no, r.line) for r in want]


def test_a_batch_that_failed_is_done_again(spark, folder, tmp_path):
    batches = [BATCHES[0], BATCHES[1] + BATCHES[3], BATCHES[4]]
    whole = outcome(play(spark, folder, tmp_path, batches))
    again = tmp_path / "again"
    (again / "in").mkdir(parents=True)
    failed = []

    class Fails(StreamRun):
        """Is lost after each of its tables once."""
        def _write(self, df, name, batch, *by):
            super()._write(df, name, batch, *by)
            if (batch, name) not in failed:
                failed.append((batch, name))
                raise RuntimeError("lost")

    for i, batch in enumerate(batches):
        lines_of(again / "in", f"{i}.jsonl", batch)
        for attempt in range(5):
            run = Fails(read_placed_line_stream(spark, str(again / "in")), str(again / "out"), delay="1 hour")
            try:
                drain(run, again)
                assert attempt == 4
            except Exception as error:
                assert "lost" in str(error) and attempt < 4
    assert [name for batch, name in failed if batch == 0] == ["messages", "digests", "windows", "state"] and len(failed) == 12
    assert outcome(run) == whole


def test_matching_is_done_once(spark, folder, tmp_path, monkeypatch):
    lines_of(folder, "0.jsonl", BATCHES[0])
    done = []
    original = run_module.process_messages
    run = made(spark, folder, tmp_path)
    monkeypatch.setattr(run_module, "process_messages", lambda *a: done.append(1) or original(*a))
    drain(run, tmp_path)
    assert len(done) == 1
    for table in (run.alerts(), run.late(), run.digests(), run._item_table(spark)):
        assert "regexp" not in table._jdf.queryExecution().executedPlan().toString().lower()


def test_weeks_zones_and_labels(spark, folder, tmp_path):
    # Sunday evening in New York is Monday in UTC.
    batches = [[stamped("2024-01-08T03:00:00Z", SAMPLE[5]), stamped("2024-01-08T06:00:00Z", SAMPLE[4])],
               [stamped("2024-01-20T00:00:00Z", SAMPLE[9])]]
    labels = spark.createDataFrame([("m5", [("de", 0.9)])], CANDIDATES_SCHEMA)
    run = play(spark, folder, tmp_path, batches, period="weekly", zone="America/New_York", detector="aws-comprehend", candidates=labels)
    assert [(str(r.period), r.messages, str(r.ends)) for r in run.windows().orderBy("period").collect()] == [
        ("2024-01-01", 1, "2024-01-08 05:00:00"), ("2024-01-08", 1, "2024-01-15 05:00:00")]
    assert run.digests().where("line_no = 0 AND period = DATE'2024-01-01'").first().line.startswith("WEEKLY SUMMARY")
    assert {r.message.id: r.language for r in run.messages().collect()}["m5"] == "de"
    with pytest.raises(KeyError):
        made(spark, folder, tmp_path, period="monthly")


def test_no_input(spark, folder, tmp_path):
    lines_of(folder, "0.jsonl", [])
    got = outcome(drain(made(spark, folder, tmp_path), tmp_path))
    assert not any(got.values())


def test_the_job(spark, folder, tmp_path, capsys):
    lines_of(folder, "0.jsonl", BATCHES[0])
    lines_of(folder, "1.jsonl", BATCHES[3])
    lexicon_table(spark).where("category = 'harassment'").write.parquet(str(tmp_path / "lexicon"))
    paths = ["--input", str(folder), "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "state")]
    query, run = start(spark, parse_options([*paths, "--delay", "1 hour", "--period", "weekly", "--files", "1", "--lexicon", str(tmp_path / "lexicon")]))
    query.awaitTermination()
    got = outcome(run)
    assert got["fates"] == [("bad", 1), ("counted", 2), ("refused", 1), ("undated", 2)]
    assert run.messages().select("batch_id").distinct().count() == 2 and got["windows"] == []
    with pytest.raises(SystemExit):
        parse_options([*paths, "--candidates", "z"])
    assert "--candidates needs --detector" in capsys.readouterr().err
