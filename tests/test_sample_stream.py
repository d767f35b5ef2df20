import json

import pytest

from lumenward.operators.digest import digest_pages
from lumenward.operators.findings import exploded_findings
from lumenward.operators.normalize import normalize_messages
from lumenward.plans.job import parse_options, run
from lumenward.plans.messages import classify_messages, process_messages
from lumenward.plans.stream import process_stream
from lumenward.sources.jsonl import POSITION, read_jsonl
from tests.sample import FINDINGS, LANGUAGES, SAMPLE

DIGEST = "\n".join([
    "DAILY SUMMARY — 3 borderline item(s) to review:",
    '  1. Grooming pattern (es, 0.60) — "… unas fotos desnuda y ▇▇▇" · sender: not a mutual connection',
    '  2. Harassment / bullying (pt, 0.50) — "…inguém gosta de você, ▇▇▇" · sender: mutual connection',
    '  3. Grooming pattern (ar, 0.60) — "▇▇▇ عن حديثنا" · sender: not a mutual connection',
    "  No immediate action needed. Review these when you can.",
])


@pytest.fixture(scope="module")
def sample_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("sample") / "messages.jsonl"
    path.write_text("\n\n".join(json.dumps(m, ensure_ascii=False) for m in SAMPLE) + "\n  \n", encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def report(spark, sample_file):
    return process_stream(read_jsonl(spark, sample_file), (POSITION,))


def test_languages(raw):
    rows = classify_messages(normalize_messages(raw(*SAMPLE))).collect()
    assert {r.id: (r.language, r.languageName, r.languageConfidence) for r in rows} == LANGUAGES


def test_findings(raw):
    rows = exploded_findings(classify_messages(normalize_messages(raw(*SAMPLE)))).collect()
    got = sorted((r.id, r["rank"], r.finding.category, r.finding.confidence, r.finding.language,
                  r.finding.signals, r.finding.excerpt) for r in rows)
    assert got == sorted(FINDINGS)


def test_results_hold_one_row_per_message(report):
    rows = report.results.collect()
    assert len(rows) == 10
    by_id = {r.message.id: r for r in rows}
    assert by_id["m9"].immediate == by_id["m9"].batch == by_id["m9"].alerts == []
    assert by_id["m1"].message.platform == "instagram"
    assert by_id["m1"].alerts == [
        'DETECTED: grooming | en | 0.88\nCONTEXT: "hey ▇▇▇ for your age, don\'t t…" · sender: not a mutual connection\n'
        "SUGGESTED ACTION: This may need immediate attention. Review the conversation now and consider locking the "
        "app. If the contact is an unknown adult, preserve the messages and report to the platform and the NCMEC "
        "CyberTipline (report.cybertip.org)."]


def test_counts(report):
    assert tuple(report.counts.first()) == (10, 6, 3)


def test_alert_order(report):
    alerts = [r.alert for r in report.immediate_alerts.orderBy(POSITION, "rank").collect()]
    assert [a.split(" | ")[0] for a in alerts] == [
        "DETECTED: grooming", "DETECTED: sexual-solicitation", "DETECTED: self-harm", "DETECTED: self-harm",
        "DETECTED: violent-threat", "DETECTED: grooming"]


def test_digest(report):
    assert [r.text for r in digest_pages(report.summary).collect()] == [DIGEST]


def test_empty_digest(spark, raw):
    report = process_stream(raw(SAMPLE[8]), ("id",), "weekly")
    assert [r.line for r in report.summary.collect()] == ["WEEKLY SUMMARY: no borderline items to review."]
    assert tuple(report.counts.first()) == (1, 0, 0)


def test_empty_input(spark, raw):
    report = process_stream(raw(SAMPLE[0]).where("false"), ("id",))
    assert [r.line for r in report.summary.collect()] == ["DAILY SUMMARY: no borderline items to review."]
    assert tuple(report.counts.first()) == (0, 0, 0)


def test_selectable_detector_gives_the_same(raw):
    stamped = raw(*[{**m, "timestamp": "2024-01-01T00:00:00Z"} for m in SAMPLE])
    plain, local = process_messages(stamped), process_messages(stamped, detector="local")
    assert {r.languageSource for r in local.collect()} == {"local-heuristic"}
    assert sorted(map(str, local.drop("languageSource", "fallback").collect())) == sorted(map(str, plain.collect()))


def test_job_writes_the_text_report(spark, sample_file, tmp_path):
    out = tmp_path / "report"
    run(spark, parse_options(["--file", sample_file, "--output", str(out)]))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(out.glob("part-*.txt")))
    assert text.startswith("Scanned 10 message(s): 6 immediate, 3 batched.\n\n══ IMMEDIATE ALERTS ══\n\nDETECTED: grooming")
    assert text.endswith("\n\n" + DIGEST + "\n")
    assert text.count("DETECTED:") == 6


def test_job_writes_json(spark, sample_file, tmp_path):
    out = tmp_path / "report"
    run(spark, parse_options(["--file", sample_file, "--output", str(out), "--json", "--period", "weekly"]))
    results = spark.read.json(f"{out}/results").collect()
    assert len(results) == 10
    assert {r.message.id for r in results if r.batch} == {"m2", "m6", "m8"}
    assert spark.read.json(f"{out}/counts").first().asDict() == {"messages": 10, "immediate": 6, "batched": 3}
    lines = spark.read.json(f"{out}/summary").orderBy("line_no").collect()
    assert lines[0].line == "WEEKLY SUMMARY — 3 borderline item(s) to review:"
    assert spark.read.json(f"{out}/immediate_alerts").count() == 6


def test_job_sets_bad_input_aside(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text('{"id":"a","text":"kill yourself"}\n{"id": broken\n{"id":"b","text":"x","source":"scraping"}\n')
    run(spark, parse_options(["--file", str(source), "--output", str(tmp_path / "out"), "--json",
                              "--quarantine", str(tmp_path / "aside")]))
    assert spark.read.json(str(tmp_path / "out/results")).count() == 1
    assert [r.line for r in spark.read.json(str(tmp_path / "aside/bad_lines")).collect()] == ['{"id": broken']
    refused = spark.read.json(str(tmp_path / "aside/refused")).collect()
    assert [r.id for r in refused] == ["b"] and refused[0].reason.startswith('Refusing to ingest from "scraping".')


def test_bad_line_fails_the_job(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text('{"id":"a","text":"hi"}\n{"id": broken\n')
    with pytest.raises(Exception, match="Invalid JSON in .*in.jsonl, from byte 0 line 2"):
        process_messages(read_jsonl(spark, str(source))).collect()
