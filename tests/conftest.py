import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lumenward.operators.findings import exploded_findings  # noqa: E402
from lumenward.plans.messages import classify_messages  # noqa: E402
from lumenward.operators.normalize import normalize_messages  # noqa: E402
from lumenward.schema import RAW_FIELDS, RAW_SCHEMA  # noqa: E402
from lumenward.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
                            spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    """Build a raw message table from dictionaries."""
    def build(*messages):
        return spark.createDataFrame([tuple(m.get(f) for f in RAW_FIELDS) for m in messages], RAW_SCHEMA)
    return build


@pytest.fixture(scope="session")
def find(raw):
    """Findings of several messages at once: {id: {category: finding}}."""
    def run(*messages, **options):
        named = [{"id": str(i), **m} for i, m in enumerate(messages)]
        found = exploded_findings(classify_messages(normalize_messages(raw(*named)), **options))
        out = {m["id"]: {} for m in named}
        for row in found.select("id", "rank", "finding").collect():
            out[row.id][row.finding.category] = row.finding
        return out
    return run
