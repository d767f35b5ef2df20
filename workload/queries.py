"""Every registered query, over the whole given tables."""

from __future__ import annotations

import uuid

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenward.functions.languages import COUNTED_WORDS, LOCAL_DETECTOR, REMOTE_DETECTOR, SCRIPTS
from lumenward.functions.scoring import final_confidence, noisy_or, sender_adjusted, tier
from lumenward.functions.redaction import redact_excerpt
from lumenward.functions.text import lookup
from lumenward.functions.times import WEEKLY, day_of, usable_event_time
from lumenward.functions.wording import alert_text, context_line, digest_item, suggested_action
from lumenward.operators.digest import digest_of_findings, digest_pages, digests_by, findings_by_period, message_digest
from lumenward.operators.findings import exploded_findings, with_buckets
from lumenward.operators.language import remote_requests, with_language, with_stopword_counts, with_words
from lumenward.operators.matching import triggered_messages, with_hits
from lumenward.operators.normalize import accepted_messages, normalize_messages, refused_messages
from lumenward.operators.numbering import with_row_numbers
from lumenward.operators.routing import batched_findings, immediate_alerts, stream_counts
from lumenward.plans.messages import find_risks, label_messages, match_messages, process_messages
from lumenward.plans.job import parse_options
from lumenward.plans.job import run as run_job
from lumenward.plans.stored import MessageStore
from lumenward.plans.stream import StreamReport, process_stream, report_lines
from lumenward.sources.jsonl import POSITION, read_jsonl, read_jsonl_tagged, read_jsonl_with_rejects
from lumenward.sources.tables import as_raw_messages
from lumenward.storage import materialize, new_table_path
from lumenward.streaming.alerts import (
    alert_stream, digest_count_stream, digest_item_stream, process_message_stream, read_message_stream,
    refused_message_stream, to_table, undated_stream,
)
from lumenward.streaming.labels import ArrivingLabels
from lumenward.streaming.run import StreamRun, read_placed_line_stream
from workload.tables import (
    CONVERSATION_FIELDS, CONVERSATION_KEY, DOCUMENT_KEY, MINUTE, PHRASE_FIELDS, conversation_messages, document_messages,
    documents, label_candidates, read_table,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_messages(document_messages(spark, sf_dir), DOCUMENT_KEY, strict=False)


def _document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_risks(_documents(spark, sf_dir))


def _document_results(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return process_messages(document_messages(spark, sf_dir), DOCUMENT_KEY, strict=False, **options)


def _conversation_report(spark: SparkSession, sf_dir: str) -> StreamReport:
    return process_stream(conversation_messages(spark, sf_dir), CONVERSATION_KEY, strict=False)


# ---- normalization ----

def normalized(spark, sf_dir):
    return _documents(spark, sf_dir)


def accepted(spark, sf_dir):
    return accepted_messages(document_messages(spark, sf_dir)).select("doc_id", "source")


def refused(spark, sf_dir):
    return refused_messages(document_messages(spark, sf_dir)).select("doc_id", "source", "reason")


def strict_guard(spark, sf_dir):
    """What a strict run over all messages stops with, and what it keeps of the sanctioned ones."""
    raw = conversation_messages(spark, sf_dir)
    try:
        normalize_messages(raw, CONVERSATION_KEY).write.format("noop").mode("overwrite").save()
        reason = None
    except SparkRuntimeException as refused:
        reason = str(refused).partition("] ")[2].partition(" SQLSTATE")[0].splitlines()[0]
    kept = normalize_messages(accepted_messages(raw), CONVERSATION_KEY)
    return kept.agg(F.count("*").alias("kept")).withColumn("reason", F.lit(reason))


# ---- language ----

def script_detect(spark, sf_dir):
    names = lookup([(code, name) for code, name, *_ in SCRIPTS], "_script")
    return with_words(_documents(spark, sf_dir)).selectExpr(
        "doc_id", "_script AS script", f"{names} AS script_name")


def tokens(spark, sf_dir):
    return with_words(_documents(spark, sf_dir)).selectExpr(
        "doc_id", "size(_words) AS n_words", "md5(array_join(_words, ' ')) AS words_md5")


def stopword_scores(spark, sf_dir):
    counted = with_stopword_counts(_documents(spark, sf_dir))
    pairs = ", ".join(f"'{lang}', _counts.{lang}" for lang in COUNTED_WORDS)
    return counted.selectExpr("doc_id", "_n_words AS n_words", f"stack({len(COUNTED_WORDS)}, {pairs}) AS (lang, hits)")


def detect_language(spark, sf_dir):
    return with_language(_documents(spark, sf_dir)).selectExpr(
        "doc_id", "language", "languageName", "languageConfidence")


def language_vs_label(spark, sf_dir):
    return (
        with_language(documents(spark, sf_dir)).groupBy("lang", "language")
        .agg(F.count("*").alias("documents"), F.sum(F.expr("if(languageConfidence < 0.5D, 1, 0)")).alias("unsure"))
    )


def remote_language_enrich(spark, sf_dir):
    return label_messages(_documents(spark, sf_dir), REMOTE_DETECTOR, label_candidates(spark, sf_dir)).selectExpr(
        "doc_id", "language", "languageName", "languageConfidence", "languageSource", "fallback")


# ---- matching and scoring ----

def _hit_rows(matched: DataFrame) -> DataFrame:
    return matched.selectExpr("doc_id", "explode(hits) AS hit").selectExpr(
        "doc_id", "hit.ord AS ord", "hit.category AS category", "hit.signal AS signal", "hit.lang AS lang",
        "hit.weight AS weight", "hit.start AS start_pos", "hit.end AS end_pos")


def lexicon_hits(spark, sf_dir):
    return _hit_rows(with_hits(_documents(spark, sf_dir), any_language=True))


def hits_gated(spark, sf_dir):
    return _hit_rows(match_messages(triggered_messages(_documents(spark, sf_dir))))


def category_buckets(spark, sf_dir):
    return (
        with_buckets(match_messages(triggered_messages(_documents(spark, sf_dir)))).selectExpr("doc_id", "explode(buckets) AS b")
        .selectExpr("doc_id", "b.category AS category",
                    "array_join(transform(b.weights, w -> format_string('%.2f', w)), ',') AS weights",
                    "array_join(b.signals, ',') AS signals", "b.first.start AS first_start",
                    "b.first.end AS first_end", "b.hint AS hint"))


def category_confidence(spark, sf_dir):
    """Confidence of every category with a hit, also below the threshold."""
    confidence = final_confidence(sender_adjusted(noisy_or("b.weights"), "b.category", "senderRelationship"))
    return (
        with_buckets(match_messages(triggered_messages(_documents(spark, sf_dir))))
        .selectExpr("doc_id", "senderRelationship", "explode(buckets) AS b")
        .selectExpr("doc_id", "b.category AS category", f"{noisy_or('b.weights')} AS combined",
                    f"{confidence} AS confidence"))


_FINDING = ("doc_id", "finding.category AS category", "finding.label AS label", "finding.confidence AS confidence",
            "finding.language AS language", "finding.languageName AS languageName", "finding.excerpt AS excerpt",
            "array_join(finding.signals, ',') AS signals", "finding.senderRelationship AS senderRelationship",
            "finding.direction AS direction")


def findings(spark, sf_dir):
    return _document_findings(spark, sf_dir).selectExpr(*_FINDING)


def findings_ranked(spark, sf_dir):
    return _document_findings(spark, sf_dir).selectExpr(
        "doc_id", "rank", "finding.category AS category", "finding.confidence AS confidence")


def redacted_excerpts(spark, sf_dir):
    return _document_findings(spark, sf_dir).selectExpr(
        "doc_id", "finding.category AS category", "finding.excerpt AS excerpt",
        "length(finding.excerpt) AS excerpt_chars")


def classify_remote(spark, sf_dir):
    found = find_risks(_documents(spark, sf_dir), REMOTE_DETECTOR, label_candidates(spark, sf_dir))
    return found.selectExpr(*_FINDING)


def classify_stored(spark, sf_dir):
    """Findings of stored messages by stored labels; only the tables of the join are read."""
    store = MessageStore(spark, f"messages_{uuid.uuid4().hex}", new_table_path(spark, "store"), buckets=16)
    store.write_messages(document_messages(spark, sf_dir), DOCUMENT_KEY, strict=False)
    store.write_labels(label_candidates(spark, sf_dir), "given")
    return exploded_findings(store.classified("given")).selectExpr(*_FINDING)


# ---- routing, alerts, digest ----

def route_tiers(spark, sf_dir):
    return (
        _document_findings(spark, sf_dir)
        .selectExpr("finding.category AS category", f"{tier('finding.confidence')} AS tier")
        .groupBy("category", "tier").agg(F.count("*").alias("findings"))
    )


def suggested_actions(spark, sf_dir):
    return _document_findings(spark, sf_dir).selectExpr(
        "doc_id", "finding.category AS category", f"{suggested_action('finding')} AS action",
        f"{context_line('finding')} AS context")


def formatted_alerts(spark, sf_dir):
    return immediate_alerts(_document_results(spark, sf_dir), DOCUMENT_KEY)


def finding_texts(spark, sf_dir):
    """Every finding, whatever its tier, in the form of an alert."""
    return _document_findings(spark, sf_dir).selectExpr(
        "doc_id", "finding.category AS category", f"{alert_text('finding')} AS alert")


def digest_item_lines(spark, sf_dir):
    return batched_findings(_document_results(spark, sf_dir), DOCUMENT_KEY).selectExpr(
        "doc_id", "rank", f"{digest_item('finding', 'rank')} AS line")


def digest(spark, sf_dir):
    findings = materialize(batched_findings(_document_results(spark, sf_dir), DOCUMENT_KEY), "findings")
    return digest_of_findings(findings, [*DOCUMENT_KEY, "rank"], "weekly")


def digest_text(spark, sf_dir):
    return digest_pages(_conversation_report(spark, sf_dir).summary, 100)


def _digests(spark: SparkSession, sf_dir: str, **period) -> DataFrame:
    raw = conversation_messages(spark, sf_dir).withColumn("sent", F.expr(usable_event_time("timestamp")))
    results = process_stream(raw, CONVERSATION_KEY, strict=False, keep=("sent",)).results
    findings, periods = findings_by_period(results, CONVERSATION_KEY, "sent", **period)
    label = period.get("period", "daily")
    return digests_by(findings, periods, "period", [*CONVERSATION_KEY, "rank"], label).selectExpr(
        "cast(period AS string) AS period", "line_no", "line")


def daily_digests(spark, sf_dir):
    """The digests of all days of Tokyo."""
    return _digests(spark, sf_dir, zone="Asia/Tokyo")


def weekly_digests(spark, sf_dir):
    return _digests(spark, sf_dir, period=WEEKLY)


def digest_per_message(spark, sf_dir):
    return _document_results(spark, sf_dir).selectExpr("doc_id", f"{message_digest('batch')} AS digest")


# ---- whole runs ----

def counts(spark, sf_dir):
    return stream_counts(_document_results(spark, sf_dir))


_RESULT = ("doc_id", "message.id AS id", "message.platform AS platform", "message.direction AS direction",
           "message.timestamp AS timestamp", "language", "languageName", "size(immediate) AS n_immediate",
           "size(batch) AS n_batch", "array_join(transform(immediate, f -> f.category), ',') AS immediate_categories",
           "array_join(transform(batch, f -> f.category), ',') AS batch_categories",
           "array_join(alerts, '\\n\\n') AS alerts")


def processed(spark, sf_dir):
    return _document_results(spark, sf_dir).selectExpr(*_RESULT)


def processed_local(spark, sf_dir):
    return _document_results(spark, sf_dir, detector=LOCAL_DETECTOR).selectExpr(
        *_RESULT, "languageSource", "fallback")


def processed_remote(spark, sf_dir):
    return _document_results(
        spark, sf_dir, detector=REMOTE_DETECTOR, candidates=label_candidates(spark, sf_dir),
    ).selectExpr(*_RESULT, "languageSource", "fallback")


def stream_report(spark, sf_dir):
    """Lines of the text report of a whole run."""
    return report_lines(_conversation_report(spark, sf_dir))


def toxicity_precision_recall(spark, sf_dir):
    """How well harassment findings agree with the labels."""
    ids = read_table(spark, sf_dir, "documents").select("doc_id")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").join(ids, "doc_id", "left_semi")
    messages = documents(spark, sf_dir).selectExpr(
        "doc_id", "text", "'incoming' AS direction", "'unknown' AS senderRelationship")
    # A document has at most one finding of a category.
    flagged = find_risks(messages).where("finding.category = 'harassment'").selectExpr("doc_id", "true AS flagged")
    return (
        labels.join(flagged, "doc_id", "left").selectExpr("toxic", "coalesce(flagged, false) AS flagged")
        .selectExpr("count_if(flagged AND toxic = 1) AS hits", "count_if(flagged AND toxic = 0) AS false_alarms",
                    "count_if(NOT flagged AND toxic = 1) AS misses",
                    "count_if(NOT flagged AND toxic = 0) AS passed")
        .selectExpr("*", "hits / nullif(hits + false_alarms, 0) AS precision",
                    "hits / nullif(hits + misses, 0) AS recall")
    )


def daily_digest_counts(spark, sf_dir):
    """Counts by day, messages without a usable time having none."""
    raw = conversation_messages(spark, sf_dir).selectExpr("*", f"{day_of(usable_event_time('timestamp'))} AS day")
    return (
        process_messages(raw, ("day",), strict=False)
        .selectExpr("cast(day AS string) AS day", "size(immediate) AS immediate", "size(batch) AS batched")
        .groupBy("day").agg(F.count("*").alias("messages"), F.sum("immediate").alias("immediate"),
                            F.sum("batched").alias("batched"))
    )


def redacted_spans(spark, sf_dir):
    """Excerpts around spans anywhere in the texts, valid or not, with usual and wide context."""
    spans = documents(spark, sf_dir).selectExpr(
        "doc_id", "text", "cast(doc_id * 37 % (length(text) + 20) - 5 AS int) AS first",
        "cast(doc_id * 37 % (length(text) + 20) - 5 + doc_id % 40 - 3 AS int) AS last")
    return spans.selectExpr(
        "doc_id", f"{redact_excerpt('text', 'first', 'last')} AS excerpt",
        f"{redact_excerpt('text', 'first', 'last', 60)} AS wide", f"{redact_excerpt('text', 'first', 'last', 60, 1000)} AS long")


def phrase_language(spark, sf_dir):
    """Languages of phrases of all kinds in front of whole texts, of texts without letters, and of blanks."""
    raw = as_raw_messages(read_table(spark, sf_dir, "documents").select("doc_id", "text"), PHRASE_FIELDS, DOCUMENT_KEY)
    return with_language(normalize_messages(raw, DOCUMENT_KEY)).selectExpr(
        "doc_id", "language", "languageName", "languageConfidence")


def requests(spark, sf_dir):
    """What a labelling service is sent: whole texts, and as much as one with a limit takes."""
    messages = _documents(spark, sf_dir)
    whole = remote_requests(messages, keep=DOCUMENT_KEY).selectExpr("doc_id", "md5(text) AS text_md5")
    cut = remote_requests(messages, 5000, keep=DOCUMENT_KEY).selectExpr("doc_id AS cut_id", "length(text) AS sent_chars")
    return whole.join(cut, F.col("doc_id") == F.col("cut_id")).select("doc_id", "text_md5", "sent_chars")


# ---- files and streams ----

# Lines that are odd in one way each, made of every message by its number.
_ODD_LINES = (
    """concat('{"id":0,"text":0,"content":', t, ',"platform":false}')""",
    """concat('{"id":"', n, '","text":false,"content":', t, ',"direction":null}')""",
    """concat('{"id":', n, ',"text":null,"content":', t, '}')""",
    """concat('  {"id":"', n, '","text":', t, ',"extra":{"a":[1]}}  ')""",
    "'[]'", """concat('[{"text":', t, '},{"text":', t, '}]')""", "'null'", "'12.5'",
    """concat('{"id":"', n, '","text":"0"}')""", """concat('{"id":', n, '.5,"text":', t, '}')""",
    """concat('{"id":"', n, '","text":', t)""", """concat('{"id":"', n, '","text":', t, '} x')""",
    """concat('{"id":"', n, '","text":', t, '},{"id":"y"}')""", "'not json'", "' '", "''",
    # a byte order mark in front, white space of other kinds behind, carriage returns between
    # tokens, a key twice, numbers in other forms
    """concat('\\uFEFF{"id":"', n, '","text":', t, '}')""", """concat('{"id":"', n, '","text":', t, '}\\u00A0\\u2003')""",
    """concat('{"id":\\r"', n, '",\\r"text":', t, '}\\r')""", """concat('{"id":"x","text":"kill yourself","id":"', n, '","text":', t, '}')""",
    """concat('{"id":', n, '.50e2,"text":', t, '}')""", """concat('{"id":"', n, '"},{"text":', t, '}\\uFEFF')""",
)


def _odd_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of such lines."""
    cases = " ".join(f"WHEN {i} THEN {line}" for i, line in enumerate(_ODD_LINES))
    path = new_table_path(spark, "lines")
    conversation_messages(spark, sf_dir).selectExpr(
        "conv_id * 10 + turn AS n", "substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9) AS t").selectExpr(
        f"CASE n % {len(_ODD_LINES)} {cases} END AS value").write.text(path)
    return path


def jsonl_lines(spark, sf_dir):
    """What becomes of each kind of line."""
    tagged = read_jsonl_tagged(spark, _odd_lines(spark, sf_dir))
    return tagged.selectExpr(
        "bad_line IS NOT NULL AS bad", "id", "md5(coalesce(text, content, '')) AS text_md5", "platform", "direction").groupBy(
        "bad", "id", "text_md5", "platform", "direction").agg(F.count("*").alias("lines"))


def jsonl_rejects(spark, sf_dir):
    """The bad lines; each has a place of its own."""
    messages, bad = read_jsonl_with_rejects(spark, _odd_lines(spark, sf_dir))
    placed = bad.selectExpr("line", f"{POSITION}.row AS row", f"{POSITION}.file AS file", f"{POSITION}.block AS block")
    return placed.groupBy("line").agg(F.count("*").alias("lines"), F.countDistinct("file", "block", "row").alias("places"))


def _message_lines(spark: SparkSession, sf_dir: str) -> str:
    path = new_table_path(spark, "jsonl")
    conversation_messages(spark, sf_dir).drop(*CONVERSATION_KEY).write.json(path)
    return path


def jsonl_round_trip(spark, sf_dir):
    """Messages written as JSON lines, read back and processed."""
    return process_messages(read_jsonl(spark, _message_lines(spark, sf_dir)), strict=False).selectExpr(
        "message.id AS id", "language", "size(immediate) AS n_immediate", "size(batch) AS n_batch",
        "array_join(alerts, '\\n\\n') AS alerts")


def _job(spark: SparkSession, sf_dir: str, *more: str) -> tuple[str, str]:
    """Run the batch job on the messages as JSON lines; the folders it wrote."""
    output, aside = new_table_path(spark, "report"), new_table_path(spark, "aside")
    run_job(spark, parse_options(["--file", _message_lines(spark, sf_dir), "--output", output, "--quarantine", aside, *more]))
    return output, aside


def job_text_report(spark, sf_dir):
    """The lines of the job's text report, numbered as its part files follow one another by name."""
    output, _ = _job(spark, sf_dir)
    placed = spark.read.text(output, lineSep="\n").selectExpr(
        "_metadata.file_name AS file", "monotonically_increasing_id() AS row", "value AS line")
    return with_row_numbers(materialize(placed, "report"), ["file", "row"], "line_no").select("line_no", "line")


def job_json_results(spark, sf_dir):
    """The job's nested results, read back."""
    output, _ = _job(spark, sf_dir, "--json")
    nested = "message struct<id:string>, language string, immediate array<struct<category:string>>, alerts array<string>"
    return spark.read.schema(nested).json(f"{output}/results").selectExpr(
        "message.id AS id", "language", "array_join(transform(coalesce(immediate, array()), f -> f.category), ',') AS immediate_categories",
        "array_join(coalesce(alerts, array()), '\\n\\n') AS alerts")


def job_refused(spark, sf_dir):
    """What the job set aside."""
    _, aside = _job(spark, sf_dir)
    return spark.read.schema("id string, source string, reason string").json(f"{aside}/refused")


def _raw_conversation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "conversations").schema
    # A pattern for the table's own name: a stream takes a folder of files by its
    # name, but a single file only by a pattern.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]")
    return as_raw_messages(stream, CONVERSATION_FIELDS, CONVERSATION_KEY)


def _conversation_stream(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return process_message_stream(_raw_conversation_stream(spark, sf_dir), CONVERSATION_KEY, **options)


def _run(stream: DataFrame, name: str) -> DataFrame:
    """Run the stream over all there is and return what it wrote."""
    spark = stream.sparkSession
    path, checkpoint = new_table_path(spark, name), new_table_path(spark, f"{name}-offsets")
    to_table(stream, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_alerts(spark, sf_dir):
    return _run(alert_stream(_conversation_stream(spark, sf_dir), CONVERSATION_KEY), "alerts").select(
        *CONVERSATION_KEY, "id", "place", "alert")


def stream_alerts_remote(spark, sf_dir):
    """Alerts of a stream that meets a static table of language labels."""
    labels = read_table(spark, sf_dir, "conversations").where("turn % 2 = 0").selectExpr(
        "concat('c', conv_id, '-', turn) AS id", "array(named_struct('code', 'de', 'score', 0.9D)) AS candidates")
    results = _conversation_stream(spark, sf_dir, detector=REMOTE_DETECTOR, candidates=labels)
    return _run(alert_stream(results, (*CONVERSATION_KEY, "language")), "alerts").select(
        *CONVERSATION_KEY, "language", "place", "alert")


def stream_alerts_late_labels(spark, sf_dir):
    """Alerts of a stream whose labels arrive beside it: before a message, after it, too late, or never."""
    messages, labels, out, offsets = (new_table_path(spark, name) for name in ("arriving", "labels", "alerts", "alerts-offsets"))
    at = f"timestampadd(MINUTE, {MINUTE}, TIMESTAMP'2024-01-01 00:00:00')"
    raw = conversation_messages(spark, sf_dir).withColumn("arrived", F.expr(at))
    named = raw.selectExpr(
        "id", "array(named_struct('code', 'de', 'score', 0.9D)) AS candidates",
        "timestampadd(MINUTE, element_at(array(-5, 5, 60), cast((conv_id + turn) % 4 AS int)), arrived) AS arrived", "conv_id", "turn").where(
        "(conv_id + turn) % 4 > 0").drop("conv_id", "turn")
    # What arrives long after says that the time of all others is up.
    end = "timestampadd(DAY, 1000, arrived) AS arrived"
    for last in (False, True):
        for table, path in ((raw, messages), (named, labels)):
            others = [f"concat('end ', id) AS id" if c == "id" else c for c in table.columns if c != "arrived"]
            (table.selectExpr(*others, end) if last else table).write.mode("append").parquet(path)
        stream = spark.readStream.schema(raw.schema).parquet(messages)
        arriving = ArrivingLabels(spark.readStream.schema(named.schema).parquet(labels), "arrived")
        results = process_message_stream(
            stream, (*CONVERSATION_KEY, "arrived"), detector=REMOTE_DETECTOR, candidates=arriving)
        alerts = alert_stream(results, (*CONVERSATION_KEY, "language", "languageSource"))
        to_table(alerts, out, offsets).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(alerts.schema).parquet(out).where("id NOT LIKE 'end %'").select(
        *CONVERSATION_KEY, "language", "languageSource", "place", "alert")


def stream_alerts_jsonl(spark, sf_dir):
    """Alerts of a stream of JSON lines."""
    raw = read_message_stream(spark, _message_lines(spark, sf_dir))
    return _run(alert_stream(process_message_stream(raw)), "alerts").select("id", "place", "alert")


def stream_digest_items(spark, sf_dir):
    items = _run(digest_item_stream(_conversation_stream(spark, sf_dir), CONVERSATION_KEY), "items")
    return items.selectExpr(
        *CONVERSATION_KEY, "cast(day AS string) AS day", "place", "finding.category AS category",
        "finding.confidence AS confidence", "finding.excerpt AS excerpt")


def stream_daily_counts(spark, sf_dir):
    """Windows closed by a watermark one hour behind the last message."""
    closed = _run(digest_count_stream(_conversation_stream(spark, sf_dir), "1 day", "1 hour"), "windows")
    return closed.selectExpr("date_format(window_start, 'yyyy-MM-dd') AS day", "messages", "immediate", "batched")


def stream_undated(spark, sf_dir):
    return _run(undated_stream(_conversation_stream(spark, sf_dir), CONVERSATION_KEY), "undated")


def stream_refused(spark, sf_dir):
    return _run(refused_message_stream(_raw_conversation_stream(spark, sf_dir)), "refused").select(
        *CONVERSATION_KEY, "id", "source", "reason")


def _arriving(spark: SparkSession, sf_dir: str) -> StreamRun:
    """A run over messages that come in two goes, every fifth of them in the second."""
    source, out, offsets = (new_table_path(spark, name) for name in ("arriving", "run", "run-offsets"))
    raw = conversation_messages(spark, sf_dir)
    run = None
    for go in ("<>", "="):
        raw.where(f"(conv_id + turn) % 5 {go} 0").write.mode("append").parquet(source)
        stream = spark.readStream.schema(raw.schema).parquet(source)
        run = StreamRun(stream, out, CONVERSATION_KEY, delay="1 hour")
        run.writer(offsets).trigger(availableNow=True).start().awaitTermination()
    return run


def stream_daily_digest(spark, sf_dir):
    """Digests written as days close."""
    return _arriving(spark, sf_dir).digests().selectExpr("cast(period AS string) AS day", "line_no", "line")


def stream_late(spark, sf_dir):
    """Messages that came after their day was closed."""
    return _arriving(spark, sf_dir).late().selectExpr(
        *CONVERSATION_KEY, "id", "cast(period AS string) AS day", "immediate", "batched",
        "array_join(transform(findings, f -> f.category), ',') AS categories")


def stream_fates(spark, sf_dir):
    """What becomes of the lines of a stream, each once, and what they hold."""
    source, out, offsets = (new_table_path(spark, name) for name in ("arriving", "run", "run-offsets"))
    message = "to_json(struct(id, text, direction, senderRelationship, platform, source, timestamp))"
    lines = conversation_messages(spark, sf_dir).selectExpr(
        "(conv_id + turn) % 5 = 0 AS second", f"if((conv_id * 10 + turn) % 9 = 0, concat({message}, ','), {message}) AS value")
    run = None
    for go in ("NOT second", "second"):
        lines.where(go).select("value").write.mode("append").text(source)
        run = StreamRun(read_placed_line_stream(spark, source), out, delay="1 hour")
        run.writer(offsets).trigger(availableNow=True).start().awaitTermination()
    return run.messages().groupBy("fate").agg(
        F.count("*").alias("messages"), F.sum(F.size("immediate")).alias("immediate"), F.sum(F.size("batch")).alias("batched"))


QUERIES = {
    "normalize_messages": normalized,
    "accepted_sources": accepted,
    "refused_sources": refused,
    "strict_guard": strict_guard,
    "script_detect": script_detect,
    "tokens": tokens,
    "stopword_scores": stopword_scores,
    "detect_language": detect_language,
    "language_vs_label": language_vs_label,
    "remote_language_enrich": remote_language_enrich,
    "lexicon_hits": lexicon_hits,
    "hits_gated": hits_gated,
    "category_buckets": category_buckets,
    "category_confidence": category_confidence,
    "findings": findings,
    "findings_ranked": findings_ranked,
    "redacted_excerpts": redacted_excerpts,
    "classify_remote": classify_remote,
    "classify_stored": classify_stored,
    "route_tiers": route_tiers,
    "suggested_actions": suggested_actions,
    "formatted_alerts": formatted_alerts,
    "finding_texts": finding_texts,
    "digest_items": digest_item_lines,
    "digest_lines": digest,
    "digest_text": digest_text,
    "digest_per_message": digest_per_message,
    "stream_counts": counts,
    "process_messages": processed,
    "process_messages_local": processed_local,
    "process_messages_remote": processed_remote,
    "stream_report": stream_report,
    "toxicity_precision_recall": toxicity_precision_recall,
    "daily_digest_counts": daily_digest_counts,
    "daily_digests": daily_digests,
    "weekly_digests": weekly_digests,
    "redacted_spans": redacted_spans,
    "phrase_language": phrase_language,
    "remote_requests": requests,
    "jsonl_lines": jsonl_lines,
    "jsonl_rejects": jsonl_rejects,
    "job_text_report": job_text_report,
    "job_json_results": job_json_results,
    "job_refused": job_refused,
    "stream_alerts_remote": stream_alerts_remote,
    "stream_alerts_late_labels": stream_alerts_late_labels,
    "stream_alerts_jsonl": stream_alerts_jsonl,
    "stream_undated": stream_undated,
    "stream_refused": stream_refused,
    "jsonl_round_trip": jsonl_round_trip,
    "stream_alerts": stream_alerts,
    "stream_digest_items": stream_digest_items,
    "stream_daily_counts": stream_daily_counts,
    "stream_daily_digest": stream_daily_digest,
    "stream_late": stream_late,
    "stream_fates": stream_fates,
}
