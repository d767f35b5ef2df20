import hashlib
import random
import re
import zlib

import pytest

from lumenward.llm import op11_prefix_trie
from lumenward.llm.prefix_trie import prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, n_convs int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    words = lambda path: len(re.findall(rb"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[b] for b in below) or 1
        saved[path] = (len(members[path]) - 1) * words(path) + sum(saved[b] for b in below)
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(path))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children.get(path, [])),
                    leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def some_rows(seed, convs, longest, kinds):
    """Conversations that share beginnings, some equal, some one the beginning of another."""
    rng, rows = random.Random(seed), []
    for _ in range(convs):
        conv = rng.randrange(-30, 300)
        if any(r[0] == conv for r in rows):
            continue
        for turn in range(rng.randrange(1, longest)):
            rows.append((conv, None if turn == 0 and rng.random() < .2 else turn, rng.choice(["user", "assistant", None]) if kinds > 1 else "user",
                         f"a b {rng.randrange(kinds)}" if rng.random() < .5 else "same  text"))
    return rows


@pytest.mark.parametrize("seed, convs, longest, kinds, options", [
    (1, 60, 9, 2, {}), (2, 80, 9, 1, {"block": 2, "fan": 2, "chunk": 3}), (3, 60, 12, 2, {"block": 3, "fan": 3, "chunk": 2}),
    (4, 50, 14, 1, {"block": 1, "fan": 2, "chunk": 5}), (5, 120, 6, 2, {"block": 4, "fan": 2, "chunk": 1}),
    (6, 40, 30, 1, {"block": 5, "chunk": 4})])
def test_against_brute_force(spark, scratch, seed, convs, longest, kinds, options):
    rows = some_rows(seed, convs, longest, kinds)
    assert rows_of(prefix_trie(table(spark, rows).repartition(5), scratch, **options)) == brute(rows)


def test_odd_rows(spark, as_tables):
    rows = [(0, 0, "user", "hi there"), (0, 0, "user", "hi there"), (1, 0, "user", "x"), (2, None, None, None), (2, 5, "user", "w " * 90_000),
            (3, 1, "us", "erhi"), (3, 1, "user", "hi"), (None, 0, "user", "nobody's"), (20, 0, "user", "late"), (25, 0, "user", "one"),
            (47, 0, "", ""), (-7, 0, "user", "below"), (9_000_000_000, 0, "user", "x")]
    got = rows_of(op11_prefix_trie.query(spark, as_tables(conversations=table(spark, rows))))
    assert got == brute(rows)


def test_equal_and_turnless_conversations(spark, scratch):
    # Every conversation of ten families is the same; those that only had shared turns and lost them are turnless.
    rows = [(c, t, "user", f"turn {t}") for c in range(200) for t in range(4)]
    rows += [(c, 0, "user", "alone") for c in range(1001, 1015)]
    got = rows_of(prefix_trie(table(spark, rows), scratch, block=3, fan=2, chunk=2))
    assert got == brute(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)


def test_one_long_conversation_and_its_copy(spark, scratch):
    rows = [(c, t, "user", f"turn {t % 7}") for c in (20, 40) for t in range(70)] + [(60, t, "user", f"turn {t % 7}") for t in range(33)]
    assert rows_of(prefix_trie(table(spark, rows), scratch, block=16)) == brute(rows)


def test_empty_table(spark, as_tables):
    assert op11_prefix_trie.query(spark, as_tables(conversations=table(spark, []))).collect() == []
