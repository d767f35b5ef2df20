import random

import pytest

from lumenward.storage import Scratch

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source), with extra columns of awkward names."""
    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", "y", 0.5) for r in rows]
        return spark.createDataFrame(
            full, f"{DOCUMENTS}, n_words int, node string, _row string, score double")
    return build


@pytest.fixture()
def scratch(spark):
    with Scratch(spark) as tables:
        yield tables


@pytest.fixture(scope="session")
def words():
    """Seeded texts of made-up words."""
    def make(seed, n, vocabulary=400):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
    return make


@pytest.fixture()
def as_tables(spark, tmp_path):
    """A folder of Parquet tables for queries that read one."""
    def write(**tables):
        for name, df in tables.items():
            df.coalesce(2).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return write
