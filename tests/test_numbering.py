"""Running numbers."""

import random

from lumenward.operators.numbering import with_group_numbers
from lumenward.storage import Scratch


def test_numbers_within_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *range(50)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o int, i int").repartition(7)
    with Scratch(spark) as scratch:
        got = with_group_numbers(df, ["g"], ["o", "i"], "nr", scratch, ["g", "i"]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (g, n) for n, r in enumerate(own, 1)}
    assert {r.i: (r.g, r.nr) for r in got} == want
