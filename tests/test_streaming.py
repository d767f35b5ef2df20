"""Streams give what the batch plan gives."""

import json

import pytest

from lumenward.functions.times import day_of, event_time
from lumenward.operators.digest import digest_of_findings
from lumenward.plans.messages import process_messages
from lumenward.streaming.alerts import (
    alert_stream, digest_count_stream, digest_item_stream, process_message_stream, read_bad_line_stream,
    read_message_stream, refused_message_stream, to_table, undated_stream,
)
from lumenward.schema import CANDIDATES_SCHEMA
from tests.sample import SAMPLE


def write_file(folder, name, messages):
    (folder / name).write_text("".join(json.dumps(m) + "\n" for m in messages))


def drain(stream, out, state, **options):
    to_table(stream, str(out), str(state), **options).trigger(availableNow=True).start().awaitTermination()


def stamped(at, message):
    return {**message, "timestamp": at}


@pytest.fixture()
def folder(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    return folder


def test_alerts_and_items_equal_batch(spark, folder, tmp_path):
    messages = [stamped(f"2024-01-0{1 + i % 3}T10:00:00Z", m) for i, m in enumerate(SAMPLE)]
    write_file(folder, "a.jsonl", messages[:4])
    write_file(folder, "b.jsonl", messages[4:] + [{"id": "x", "text": "kill yourself loser", "source": "scraping"}])
    results = process_message_stream(read_message_stream(spark, str(folder), max_files=1))
    drain(alert_stream(results), tmp_path / "alerts", tmp_path / "s1")
    drain(digest_item_stream(results), tmp_path / "items", tmp_path / "s2", partition_by=["day"])

    batch = process_messages(spark.read.json(str(folder)), strict=False)
    want = sorted(a for r in batch.collect() for a in r.alerts)
    assert sorted(r.alert for r in spark.read.parquet(str(tmp_path / "alerts")).collect()) == want
    items = spark.read.parquet(str(tmp_path / "items")).collect()
    assert sorted((r.id, r.finding.category, str(r.day)) for r in items) == [
        ("m2", "grooming", "2024-01-02"), ("m6", "harassment", "2024-01-03"), ("m8", "grooming", "2024-01-02")]

    # The digest of a closed day is a batch job over that day's items.
    day = spark.read.parquet(str(tmp_path / "items")).where("day = DATE'2024-01-02'")
    lines = [r.line for r in digest_of_findings(day, ["event_ts", "id", "place"]).orderBy("line_no").collect()]
    assert lines == [
        "DAILY SUMMARY — 2 borderline item(s) to review:",
        '  1. Grooming pattern (es, 0.60) — "… unas fotos desnuda y ▇▇▇" · sender: not a mutual connection',
        '  2. Grooming pattern (ar, 0.60) — "▇▇▇ عن حديثنا" · sender: not a mutual connection',
        "  No immediate action needed. Review these when you can."]


def test_windows_close_after_the_watermark_and_drop_late_messages(spark, folder, tmp_path):
    def run():
        results = process_message_stream(read_message_stream(spark, str(folder)))
        drain(digest_count_stream(results, "1 day", "1 hour"), tmp_path / "out", tmp_path / "state")
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.window_start.day, r.messages, r.immediate, r.batched) for r in rows)

    write_file(folder, "a.jsonl", [stamped("2024-01-01T08:00:00Z", SAMPLE[0]), stamped("2024-01-01T23:30:00Z", SAMPLE[1])])
    assert run() == []
    # Half an hour into the next day the first one is still open.
    write_file(folder, "b.jsonl", [stamped("2024-01-02T00:30:00Z", SAMPLE[8]), stamped("2024-01-01T22:00:00Z", SAMPLE[5])])
    assert run() == []
    write_file(folder, "c.jsonl", [stamped("2024-01-02T02:00:00Z", SAMPLE[2])])
    assert run() == [(1, 3, 2, 2)]
    write_file(folder, "d.jsonl", [stamped("2024-01-01T09:00:00Z", SAMPLE[0]), stamped("2024-01-03T12:00:00Z", SAMPLE[3])])
    assert run() == [(1, 3, 2, 2), (2, 2, 1, 0)]


def test_a_strict_stream_fails_on_a_refused_source(spark, folder, tmp_path):
    write_file(folder, "a.jsonl", [{"id": "x", "text": "hi", "source": "scraping"}])
    results = process_message_stream(read_message_stream(spark, str(folder)), strict=True)
    with pytest.raises(Exception, match="Refusing to ingest"):
        drain(alert_stream(results), tmp_path / "out", tmp_path / "state")


def test_every_message_is_counted_somewhere(spark, folder, tmp_path):
    """A message without a time must not close the windows of those that come later."""
    batches = [
        [stamped("2024-01-01T10:00:00Z", SAMPLE[0]), {**SAMPLE[4], "id": "no time"}, stamped("yesterday", SAMPLE[4])],
        [stamped("2024-01-01T11:00:00Z", SAMPLE[1])],
        [stamped("2024-01-02T01:00:00+02:00", SAMPLE[2]), stamped(1704189600000, SAMPLE[3]), stamped("2999-01-01", SAMPLE[5])],
        [stamped("2024-01-05T00:00:00Z", SAMPLE[8]), {"id": "x", "text": "kill yourself", "source": "scraping"}],
        [stamped("2024-01-01T09:00:00Z", SAMPLE[6]), stamped("2024-01-09T00:00:00Z", SAMPLE[9])],
    ]
    for i, batch in enumerate(batches):
        write_file(folder, f"{i}.jsonl", batch)
        with open(folder / f"{i}.jsonl", "a") as lines:
            lines.write("not json\n" if i == 2 else "")
        results = process_message_stream(read_message_stream(spark, str(folder)))
        drain(digest_count_stream(results, "1 day", "1 hour"), tmp_path / "counts", tmp_path / "s1")
        drain(undated_stream(results), tmp_path / "undated", tmp_path / "s2")
        drain(refused_message_stream(read_message_stream(spark, str(folder))), tmp_path / "refused", tmp_path / "s3")
        drain(read_bad_line_stream(spark, str(folder)), tmp_path / "bad", tmp_path / "s4")
        drain(alert_stream(results), tmp_path / "alerts", tmp_path / "s5")
    rows = lambda name: spark.read.parquet(str(tmp_path / name)).collect()
    counted = sorted((r.window_start.day, r.messages) for r in rows("counts"))
    assert counted == [(1, 3), (2, 1), (5, 1)]
    undated = {r.id: (r.reason, r.immediate) for r in rows("undated")}
    assert undated == {"no time": ("missing", 1), "m5": ("unreadable", 1), "m6": ("future", 0)}
    assert [r.reason[:8] for r in rows("refused")] == ["Refusing"] and [r.line for r in rows("bad")] == ["not json"]
    late, still_open = 1, 1
    read = sum(map(len, batches)) + 1
    assert sum(n for _, n in counted) + len(undated) + len(rows("refused")) + len(rows("bad")) + late + still_open == read
    assert {"no time", "m5"} <= {r.id for r in rows("alerts")}


@pytest.mark.parametrize("text, want", [
    ("2024-01-05T00:00:00Z", "2024-01-05 00:00:00"), ("2024-01-05T00:00:00+02:00", "2024-01-04 22:00:00"),
    ("2024-01-05t10:00:00.5z", "2024-01-05 10:00:00.5"), (" 2024-01-05 ", "2024-01-05 00:00:00"), ("2024-01-05 10:20", "2024-01-05 10:20:00"),
    ("2024-01-05T10:20:30", "2024-01-05 10:20:30"), ("1704067200", "2024-01-01 00:00:00"), ("1704067200000", "2024-01-01 00:00:00"),
    ("1704067200000000", "2024-01-01 00:00:00"), ("yesterday", None), ("", None), (None, None), ("2024-13-01", None), ("12", None)])
def test_event_times(spark, text, want):
    given = "cast(NULL AS string)" if text is None else f"'{text}'"
    sql = f"SELECT cast({event_time('t')} AS string) AS t FROM (SELECT {given} AS t)"
    assert spark.sql(sql).first().t == want


def test_days_depend_on_the_zone_asked_for_only(spark):
    sql = (f"SELECT {day_of('t')} AS utc, {day_of('t', 'Asia/Tokyo')} AS tokyo, {day_of('t', 'America/New_York')} AS york,"
           f" {event_time('local', 'Asia/Tokyo')} = TIMESTAMP'2024-01-04 15:30:00Z' AS same"
           " FROM (SELECT TIMESTAMP'2024-01-04 15:30:00Z' AS t, '2024-01-05T00:30:00' AS local)")
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "Australia/Sydney", "America/Los_Angeles"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            row = spark.sql(sql).first()
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        assert (str(row.utc), str(row.tokyo), str(row.york), row.same) == ("2024-01-04", "2024-01-05", "2024-01-04", True)


def test_labels_on_a_stream(spark, folder, tmp_path):
    write_file(folder, "a.jsonl", [stamped("2024-01-01T10:00:00Z", m) for m in SAMPLE])
    labels = spark.createDataFrame([("m5", [("de", 0.9)]), ("m5", [("fr", 0.1)])], CANDIDATES_SCHEMA)
    results = process_message_stream(read_message_stream(spark, str(folder)), detector="aws-comprehend", candidates=labels)
    drain(alert_stream(results, ("language",)), tmp_path / "alerts", tmp_path / "state")
    got = {r.id: r.language for r in spark.read.parquet(str(tmp_path / "alerts")).collect()}
    assert got["m5"] == "de" and len(got) >= 2
