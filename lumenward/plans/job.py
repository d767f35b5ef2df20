"""Batch job: ``spark-submit lumenward_job.py --file messages.jsonl --output report``."""

from __future__ import annotations

import argparse

from lumenward.functions.languages import LOCAL_DETECTOR, REMOTE_DETECTOR
from lumenward.functions.lexicon import ENTRIES
from lumenward.operators.normalize import is_sanctioned, refused_messages
from lumenward.plans.stream import process_stream
from lumenward.schema import CANDIDATES_SCHEMA
from lumenward.session import build_session
from lumenward.sources.jsonl import POSITION, read_jsonl, read_jsonl_tagged
from lumenward.sources.lexicon import read_lexicon
from lumenward.sources.sinks import write_report_json, write_report_text
from lumenward.storage import Scratch


def parse_options(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Scan messages for risks and report; nothing is blocked.")
    parser.add_argument("--file", required=True, help="JSON-lines file or folder")
    parser.add_argument("--output", required=True, help="folder to write the report to")
    parser.add_argument("--period", default="daily", help="label of the digest")
    parser.add_argument("--json", action="store_true", help="write JSON instead of text")
    parser.add_argument("--detector", choices=(LOCAL_DETECTOR, REMOTE_DETECTOR),
                        help="where languages come from")
    parser.add_argument("--candidates", help="parquet table of language labels by message id")
    parser.add_argument("--lexicon", help="parquet table of lexicon entries, in place of the built-in ones")
    parser.add_argument("--quarantine", help="folder for bad lines and refused messages; without it they fail the job")
    options = parser.parse_args(argv)
    if options.candidates and options.detector != REMOTE_DETECTOR:
        parser.error(f"--candidates needs --detector {REMOTE_DETECTOR}")
    return options


def run(spark, options: argparse.Namespace) -> None:
    """One pass over the input; intermediate tables are gone afterwards."""
    candidates = None
    if options.candidates:
        candidates = spark.read.schema(CANDIDATES_SCHEMA).parquet(options.candidates)
    entries = read_lexicon(spark.read.parquet(options.lexicon)) if options.lexicon else ENTRIES
    with Scratch(spark) as scratch:
        if options.quarantine:
            # Each line is parsed once and written by its fate, which is read back apart.
            sanctioned = is_sanctioned("source")
            fate = f"CASE WHEN bad_line IS NOT NULL THEN 'bad' WHEN {sanctioned} THEN 'accepted' ELSE 'refused' END"
            tagged = read_jsonl_tagged(spark, options.file).selectExpr("*", f"{fate} AS fate")
            path = scratch.path("lines")
            tagged.write.partitionBy("fate").parquet(path)
            lines = spark.read.schema(tagged.schema).parquet(path)
            lines.where("fate = 'bad'").selectExpr(POSITION, "bad_line AS line").write.json(f"{options.quarantine}/bad_lines")
            refused_messages(lines.where("fate = 'refused'").drop("fate", "bad_line")).write.json(f"{options.quarantine}/refused")
            raw = lines.where("fate = 'accepted'").drop("fate", "bad_line")
        else:
            raw = read_jsonl(spark, options.file)
        with process_stream(raw, (POSITION,), options.period, detector=options.detector, candidates=candidates,
                            entries=entries) as report:
            write = write_report_json if options.json else write_report_text
            write(report, options.output)


def main(argv=None) -> None:
    run(build_session(), parse_options(argv))
