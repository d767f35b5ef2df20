"""Streaming job: ``spark-submit lumenward_stream.py --input folder --output folder --checkpoint folder``."""

from __future__ import annotations

import argparse

from lumenward.functions.languages import LOCAL_DETECTOR, REMOTE_DETECTOR
from lumenward.functions.lexicon import ENTRIES
from lumenward.functions.times import DAILY, UTC, WEEKLY
from lumenward.schema import CANDIDATES_SCHEMA
from lumenward.session import build_session
from lumenward.sources.lexicon import read_lexicon
from lumenward.streaming.run import StreamRun, read_placed_line_stream


def parse_options(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Scan messages for risks as they arrive; nothing is blocked.")
    parser.add_argument("--input", required=True, help="folder that JSON-lines files are put into")
    parser.add_argument("--output", required=True, help="folder for messages, items, windows and digests")
    parser.add_argument("--checkpoint", required=True, help="folder for what has been read; it belongs to the output")
    parser.add_argument("--period", default=DAILY, choices=(DAILY, WEEKLY), help="what a digest covers")
    parser.add_argument("--delay", default="1 day", help="how long after its end a period is closed, by the latest message")
    parser.add_argument("--zone", default=UTC, help="zone of the days, and of times without offset")
    parser.add_argument("--detector", choices=(LOCAL_DETECTOR, REMOTE_DETECTOR), help="where languages come from")
    parser.add_argument("--candidates", help="parquet table of language labels by message id")
    parser.add_argument("--lexicon", help="parquet table of lexicon entries, in place of the built-in ones")
    parser.add_argument("--files", type=int, help="most files to a batch")
    parser.add_argument("--every", help="time between batches, such as '1 minute'; without it, what is there is read once")
    options = parser.parse_args(argv)
    if options.candidates and options.detector != REMOTE_DETECTOR:
        parser.error(f"--candidates needs --detector {REMOTE_DETECTOR}")
    return options


def start(spark, options: argparse.Namespace):
    """The running query and the run whose tables it writes."""
    candidates = spark.read.schema(CANDIDATES_SCHEMA).parquet(options.candidates) if options.candidates else None
    entries = read_lexicon(spark.read.parquet(options.lexicon)) if options.lexicon else ENTRIES
    run = StreamRun(
        read_placed_line_stream(spark, options.input, options.files), options.output, period=options.period, delay=options.delay,
        zone=options.zone, detector=options.detector, candidates=candidates, entries=entries)
    trigger = {"processingTime": options.every} if options.every else {"availableNow": True}
    return run.writer(options.checkpoint).trigger(**trigger).start(), run


def main(argv=None) -> None:
    start(build_session(), parse_options(argv))[0].awaitTermination()
