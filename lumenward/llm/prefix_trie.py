"""The trie of conversation prefixes, by union-find over sorted neighbours.

Conversations are sorted by their turns.  Those with a common prefix then stand
together, and the longest common prefix (LCP) of two neighbours says how far they
go together.  Taking these edges in descending depth, union-find grows components
from single conversations: the component that an edge of depth d makes is the node
of depth d on their common path, so every merge creates a branching node, and the
turns between it and a component below it are nodes with one child.

Each task does this for its share of the sorted table, a chunk at a time.  What
holds neither the first nor the last conversation of a share is complete and
written.  The rest, the paths to these two, is contracted: whatever hangs off such
a path is summed up in one item for each node of it.  The shares' items in their
order are again a sorted sequence whose neighbours have LCPs, so they are merged
across boundaries by the very same procedure, :data:`FAN` shares to a task, until
one is left.

No conversation is ever held whole.  It is cut into blocks of :data:`BLOCK` turns; a
block hangs below the node where the one before it ended, equal blocks below the
same node are one row with a count, and every row is bounded.  Blocks of deeper
levels are worked off first, and a level hands the sums of its subtrees to the one
above.  Where a conversation is alone, its nodes follow from its turns, so that
rounds grow with the longest prefix that several conversations share.

Turns, prefixes and blocks are told apart by 128-bit digests.

Defined results: turns are in order of turn, null first, then of role and text; a
null role or text is empty; rows without conversation id take no part; repeated
rows are repeated turns; very long texts only count by digest and words; an
empty table gives an empty one.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.operators.numbering import with_group_numbers
from lumenward.storage import Scratch

BLOCK = 128
#: Shares whose contracted forests one task merges, and rows or bytes to a chunk.
FAN = 256
CHUNK_ROWS = 4096
CHUNK_BYTES = 8 << 20
#: Ids to a piece of the list of conversations that end at a node.
PIECE_IDS = 4096

#: Every conversation starts with up to three turns of the first of its twenty.
FAMILY, MOST_SHARED = 20, 4
WORD = r"[^\\x20\\x09-\\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()
_DIGEST = 16


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def _path_digest(level: int, keys: bytes) -> tuple[int, int]:
    """Of a path within a block; the empty path adds nothing to what is above it."""
    if not keys:
        return 0, 0
    return _halves(hashlib.blake2b(level.to_bytes(8, "little") + keys, digest_size=_DIGEST).digest())


# ---- conversations as blocks ----

def rebuilt_turns(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, digest, words`` of every turn of the rebuilt conversations, and the ids of
    those without a turn."""
    rows = turns.where("conv_id IS NOT NULL").selectExpr(
        "cast(conv_id AS bigint) AS conv_id", "cast(turn AS bigint) AS turn", "coalesce(cast(role AS string), '') AS role",
        "coalesce(cast(text AS string), '') AS text")
    numbered = scratch.table(with_group_numbers(
        rows, ["conv_id"], ["turn", "role", "text"], "place", scratch,
        ["conv_id", "unhex(md5(concat(length(role), ':', role, text))) AS digest",
         f"cast(regexp_count(text, '{WORD}') AS bigint) AS words"]), "turns")
    shared = f"crc32(cast(cast(conv_id AS string) AS binary)) % {MOST_SHARED}"
    counts = scratch.table(numbered.groupBy("conv_id").agg(F.count("*").alias("n")).selectExpr(
        "conv_id", "n", f"{shared} AS shared", f"conv_id - conv_id % {FAMILY} AS base"), "conversations")
    bases = counts.selectExpr("conv_id AS _base", "n AS _n")
    fewer = counts.join(bases, F.expr("base = _base"), "left").selectExpr(
        "conv_id AS _c", "shared AS _shared", "n AS _own", "least(shared, coalesce(_n, 0L)) AS _found").where("_found < _shared")
    own = numbered.selectExpr("*", f"{shared} AS shared").where("place > shared").join(
        fewer, F.expr("conv_id = _c"), "left").selectExpr(
        "conv_id", "place - shared + coalesce(_found, shared) AS depth", "digest", "words")
    heads = numbered.where(f"place < {MOST_SHARED}").selectExpr("conv_id AS _head", "place AS depth", "digest", "words")
    first = counts.where("shared > 0").join(heads, F.expr("base = _head AND depth <= shared")).select(
        "conv_id", "depth", "digest", "words")
    return own.unionByName(first), fewer.where("_found = 0 AND _own <= _shared").selectExpr("_c AS conv_id")


_BLOCK_SQL = "conv_id bigint, level bigint, keys binary, words array<bigint>, b1 bigint, b2 bigint"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to rows of a block each."""
    current, keys, words = None, [], []
    rows: list[tuple] = []

    def close() -> None:
        joined = b"".join(keys)
        rows.append((*current, joined, list(words), *_path_digest(current[1], joined)))
        keys.clear()
        words.clear()

    def batch() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), types)]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "level", "keys", "words", "b1", "b2"])

    for part in batches:
        for conv, level, digest, n in zip(*(part.column(i).to_pylist() for i in range(4))):
            if (conv, level) != current:
                if current:
                    close()
                    if len(rows) >= 1000:
                        yield batch()
                current = conv, level
            keys.append(digest)
            words.append(n)
    if current:
        close()
    if rows:
        yield batch()


def conversation_blocks(turns: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Every conversation's blocks: where they hang (p1, p2), where they lead to (i1, i2), whether it ends there."""
    rebuilt, turnless = rebuilt_turns(turns, scratch)
    ordered = rebuilt.selectExpr("conv_id", f"(depth - 1) div {block} AS level", "depth", "digest", "words").repartition(
        "conv_id", "level").sortWithinPartitions("conv_id", "level", "depth")
    blocks = ordered.select("conv_id", "level", "digest", "words").mapInArrow(_blocks, _BLOCK_SQL)
    none = turnless.selectExpr("conv_id", "0L AS level", "X'' AS keys", "cast(array() AS array<bigint>) AS words", "0L AS b1", "0L AS b2")
    path = "OVER (PARTITION BY conv_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return scratch.table(
        blocks.unionByName(none).selectExpr(
            "*", f"coalesce(bit_xor(b1) {path}, 0L) AS p1", f"coalesce(bit_xor(b2) {path}, 0L) AS p2",
            "lead(level) OVER (PARTITION BY conv_id ORDER BY level) IS NULL AS ends").selectExpr(
            "conv_id", "level", "p1", "p2", "p1 ^ b1 AS i1", "p2 ^ b2 AS i2", "keys", "words", "ends"), "blocks")


# ---- conversations that end at a node ----

def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (i1, i2, conv_id) to pieces of the joined list."""
    held: list[int] = []
    current, rows = None, []

    def close() -> None:
        rows.append((*current, held[0], ",".join(map(str, held))))
        held.clear()

    def batch() -> pa.RecordBatch:
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names=["i1", "i2", "first", "ids"])

    for part in batches:
        for a, b, conv in zip(*(part.column(i).to_pylist() for i in range(3))):
            if held and ((a, b) != current or len(held) >= PIECE_IDS):
                close()
                if len(rows) >= 500:
                    yield batch()
            current = a, b
            held.append(conv)
    if held:
        close()
    if rows:
        yield batch()


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, state, rows = None, None, []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names=["e1", "e2", "ends"])

    for part in batches:
        for a, b, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3)):
            if (a, b) == current:
                state.update(b",")
            else:
                if current:
                    rows.append((*current, state.hexdigest()))
                    if len(rows) >= 5000:
                        yield batch()
                current, state = (a, b), hashlib.sha256()
            state.update(ids.as_py().encode())
    if current:
        rows.append((*current, state.hexdigest()))
        yield batch()


def ends_digests(blocks: DataFrame) -> DataFrame:
    """``e1, e2, ends``: of every class of last blocks, the digest of its ids in order.

    The digest has to see a node's ids one after the other; it gets them in pieces
    that were sorted and joined before."""
    keys = ("i1", "i2", "conv_id")
    pieces = blocks.where("ends").select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        _id_pieces, "i1 bigint, i2 bigint, first bigint, ids string")
    return pieces.repartition("i1", "i2").sortWithinPartitions("i1", "i2", "first").mapInArrow(
        _id_digests, "e1 bigint, e2 bigint, ends string")


# ---- the forest ----

class Item:
    """What is known of the node ``depth`` turns down a block: ``n`` conversations, the smallest being
    ``conv``, ``children`` so far with their ``leaves`` and ``saved`` tokens."""
    __slots__ = ("above", "keys", "words", "depth", "n", "conv", "children", "leaves", "saved", "ends", "waiting", "named")

    def __init__(self, above, keys, words, depth, n, conv, children, leaves, saved, ends, named=False):
        self.above, self.keys, self.words, self.depth = above, keys, words, depth
        self.n, self.conv, self.children, self.leaves, self.saved, self.ends = n, conv, children, leaves, saved, ends
        self.waiting: list[list] = []  # rows of children that need this node's conversation
        self.named = named             # whether rows written earlier wait for it

    def add(self, other: Item) -> None:
        """Another part of the same node."""
        self.n += other.n
        self.conv = min(self.conv, other.conv)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends
        self.waiting += other.waiting
        self.named |= other.named


class Component:
    """Neighbours that were merged.  ``rest`` is the node they make, None if nothing but open paths
    hangs there; ``left`` and ``right`` are the paths to the first and the last of a share, deepest first."""
    __slots__ = ("rest", "left", "right", "first", "last")

    def __init__(self, item: Item, first: bool, last: bool):
        self.rest: Item | None = item
        self.first, self.last = first, last
        self.left: list[Item] = []
        self.right: list[Item] = []

    def items(self) -> list[Item]:
        return [*self.left, *([self.rest] if self.rest else []), *reversed(self.right)]


def common(a: Item, b: Item) -> int:
    """Turns that two neighbours have in common, -1 if they hang below different nodes."""
    if a.above != b.above:
        return -1
    low, high = 0, min(a.depth, b.depth)
    while low < high:
        middle = (low + high + 1) // 2
        if a.keys[:middle * _DIGEST] == b.keys[:middle * _DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


#: kind, own id, id waited for, conversation, depth, parent, n, children, leaves, saved, ends.
NODE, ITEM, TOTAL = 0, 1, 2
_ID, _AWAITED, _PARENT = 1, 3, 7


class Forest:
    """The components of one level; finished nodes gather in ``rows``."""

    def __init__(self, level: int, block: int):
        self.level, self.block = level, block
        self.rows: list[list] = []

    def _id(self, item: Item, depth: int) -> tuple[int, int]:
        a, b = _path_digest(self.level, item.keys[:depth * _DIGEST])
        return item.above[0] ^ a, item.above[1] ^ b

    def _node(self, item: Item, depth: int, parent, children: int, leaves: int, saved: int, ends, named: bool) -> list:
        own = self._id(item, depth) if named else (None, None)
        row = [NODE, *own, None, None, item.conv, self.level * self.block + depth, parent, item.n, children, leaves, saved, ends or NO_ENDS]
        self.rows.append(row)
        return row

    def _finish(self, item: Item) -> None:
        if not item.children:
            item.leaves = 1
        for row in item.waiting:
            row[_PARENT] = item.conv

    def close(self, item: Item, depth: int) -> Item:
        """Write the finished node and those above it down to below ``depth``; the part it is of the node there."""
        self._finish(item)
        saved, children, ends = item.saved, item.children, item.ends
        for at in range(item.depth, depth, -1):
            saved += (item.n - 1) * item.words[at - 1]
            named = at == self.block or (item.named and at == item.depth)
            row = self._node(item, at, item.conv, children, item.leaves, saved, ends, named)
            children, ends = 1, None
        row[_PARENT] = None
        above = Item(item.above, item.keys, item.words, depth, item.n, item.conv, 1, item.leaves, saved, None)
        above.waiting.append(row)
        return above

    def _lift(self, part: Component, depth: int) -> None:
        if part.rest is None or part.rest.depth == depth:
            return
        if part.first:
            part.left.append(part.rest)
            part.rest = None
        elif part.last:
            part.right.append(part.rest)
            part.rest = None
        else:
            part.rest = self.close(part.rest, depth)

    def _close_tree(self, part: Component) -> None:
        self._lift(part, 0)
        top = part.rest
        if self.level == 0:
            self._finish(top)
            self._node(top, 0, None, top.children, top.leaves, top.saved, top.ends, top.named)
        else:
            for row in top.waiting:
                row[_AWAITED:_AWAITED + 2] = top.above
            self.rows.append([TOTAL, *top.above, None, None, None, None, None, None, top.children, top.leaves, top.saved, None])

    def merge(self, items: list[Item], left_open: bool, right_open: bool) -> list[Item]:
        """Merge neighbours in descending depth; what stays open at either end, contracted."""
        last = len(items) - 1
        parts = [Component(x, left_open and i == 0, right_open and i == last) for i, x in enumerate(items)]
        depths = np.array([common(a, b) for a, b in zip(items, items[1:])], np.int64)
        root = list(range(len(items)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for edge in np.argsort(-depths, kind="stable").tolist():
            depth = int(depths[edge])
            if depth < 0:
                break
            i, j = find(edge), find(edge + 1)
            a, b = parts[i], parts[j]
            self._lift(a, depth)
            self._lift(b, depth)
            if a.rest is None:
                a.rest = b.rest
            elif b.rest is not None:
                a.rest.add(b.rest)
            a.right, a.last = b.right, b.last
            root[j] = i
        open_items: list[Item] = []
        for i, part in enumerate(parts):
            if root[i] != i:
                continue
            if part.first or part.last:
                open_items += part.items()
            else:
                self._close_tree(part)
        for item in open_items:
            for row in item.waiting:
                row[_AWAITED:_AWAITED + 2] = self._id(item, item.depth)
                item.named = True
            item.waiting = []
        return open_items


_ROW = pa.schema([("kind", pa.int32()), *[(name, pa.int64()) for name in (
    "id1", "id2", "r1", "r2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
    ("ends", pa.string()), ("keys", pa.binary()), ("words", pa.list_(pa.int64())), ("named", pa.bool_()),
    ("share", pa.int64()), ("place", pa.int64())])
_ROW_SQL = ("kind int, id1 bigint, id2 bigint, r1 bigint, r2 bigint, conv_id bigint, depth bigint, parent_conv_id bigint,"
            " n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, keys binary,"
            " words array<bigint>, named boolean, share bigint, place bigint")
_ITEM_COLUMNS = ("id1", "id2", "keys", "words", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", "ends", "named", "share")


def _batch(rows: list[list]) -> pa.RecordBatch:
    missing = len(_ROW) - len(rows[0])
    columns = list(zip(*rows)) + [[None] * len(rows)] * missing
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _ROW)], schema=_ROW)


def _grow(level: int, final: bool, block: int, chunk: int):
    """Sorted items of shares, in order, to finished nodes, totals, and the items that stay open.

    A null share is the number of the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, size, share = Forest(level, block), [], 0, None

        def flush(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                held = forest.merge(held, not final, not (final and end))
            for at in range(0, len(forest.rows), 5000):
                yield _batch(forest.rows[at:at + 5000])
            forest.rows, size = [], 0
            if end and held:
                yield _batch([[ITEM, *x.above, None, None, x.conv, None, None, x.n, x.children, x.leaves, x.saved, x.ends,
                               x.keys[:x.depth * _DIGEST], x.words[:x.depth], x.named, share, i] for i, x in enumerate(held)])
                held = []

        for batch in batches:
            for a, b, keys, words, n, conv, children, leaves, saved, ends, named, own in zip(
                    *(batch.column(i).to_pylist() for i in range(len(_ITEM_COLUMNS)))):
                own = TaskContext.get().partitionId() if own is None else own
                if own != share:
                    yield from flush(True)
                    share = own
                held.append(Item((a, b), keys, words, len(words), n, conv, children, leaves, saved, ends, named))
                size += len(keys) * 2
                if len(held) >= chunk or size >= CHUNK_BYTES:
                    yield from flush(False)
        yield from flush(True)
    return run


def _level_trees(items: DataFrame, level: int, scratch: Scratch, block: int, fan: int, chunk: int) -> list[DataFrame]:
    """The finished rows of a level, a table for each round."""
    order = ("id1", "id2", "keys")
    ordered = items.repartitionByRange(*order).sortWithinPartitions(*order)
    tables = [scratch.table(ordered.select(*_ITEM_COLUMNS).mapInArrow(_grow(level, False, block, chunk), _ROW_SQL), "forest")]
    while True:
        left = tables[-1].where(f"kind = {ITEM}")
        shares = left.agg(F.max("share")).first()[0]
        if shares is None:
            return tables
        final = shares < fan
        ordered = left.withColumn("_next", F.expr(f"share div {fan}")).repartition("_next").sortWithinPartitions(
            "_next", "share", "place").withColumn("share", F.col("_next"))
        tables.append(scratch.table(ordered.select(*_ITEM_COLUMNS).mapInArrow(_grow(level, final, block, chunk), _ROW_SQL), "forest"))
        if final:
            return tables


_RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends AS ends_sha256")


def prefix_trie(turns: DataFrame, scratch: Scratch, block: int = BLOCK, fan: int = FAN, chunk: int = CHUNK_ROWS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``, a
    row for each node."""
    blocks = conversation_blocks(turns, scratch, block)
    classes = blocks.groupBy("i1", "i2").agg(
        *[F.first(c).alias(c) for c in ("level", "p1", "p2", "keys", "words")], F.count("*").alias("n"),
        F.min("conv_id").alias("conv_id"), F.expr("count_if(NOT ends)").alias("going_on"))
    ends = ends_digests(blocks)
    classes = scratch.table(classes.join(ends, F.expr("i1 = e1 AND i2 = e2"), "left").drop("e1", "e2"), "classes")
    deepest = classes.agg(F.max("level")).first()[0]
    tables, alone, shared = [], None, classes
    if deepest:
        above = classes.where("going_on > 0").selectExpr("i1 AS a1", "i2 AS a2", "going_on AS a_going_on", "n AS a_n")
        hung = scratch.table(classes.join(above, F.expr("level > 0 AND p1 = a1 AND p2 = a2"), "left"), "hung")
        shared = hung.where("level = 0 OR a_going_on > 1")
        alone = hung.where("level > 0 AND a_going_on = 1")
        deepest = shared.agg(F.max("level")).first()[0]
    totals = None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        rows = shared.where(f"level = {level}")
        if totals is not None:
            rows = rows.join(totals, F.expr("i1 = t1 AND i2 = t2"), "left")
            below = [f"coalesce(t_{c}, if(going_on > 0, {one}, 0L)) AS {c}"
                     for c, one in (("n_children", "1L"), ("n_leaves", "1L"), ("saved_tokens", "0L"))]
        else:
            # No deeper block is shared: what goes on goes on alone.
            below = ["if(going_on > 0, 1L, 0L) AS n_children", "if(going_on > 0, 1L, 0L) AS n_leaves", "0L AS saved_tokens"]
        items = rows.selectExpr("p1 AS id1", "p2 AS id2", "keys", "words", "n AS n_convs", "conv_id", *below, "ends",
                                "false AS named", "cast(NULL AS bigint) AS share")
        grown = _level_trees(items, level, scratch, block, fan, chunk)
        tables += grown
        totals = None
        for table in grown:
            found = table.where(f"kind = {TOTAL}").selectExpr(
                "id1 AS t1", "id2 AS t2", "n_children AS t_n_children", "n_leaves AS t_n_leaves", "saved_tokens AS t_saved_tokens")
            totals = found if totals is None else totals.unionByName(found)
        if level:
            totals = scratch.table(totals, "totals")
    columns = ("id1", "id2", "r1", "r2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    nodes = None
    for table in tables:
        found = table.where(f"kind = {NODE}").select(*columns)
        nodes = found if nodes is None else nodes.unionByName(found)
    if nodes is None:
        return classes.limit(0).selectExpr(
            "conv_id", "0L AS depth", "0L AS parent_conv_id", "0L AS n_convs", "0L AS n_children", "0L AS n_leaves", "0L AS saved_tokens",
            "'' AS ends_sha256")
    if alone is not None:
        end, last = "at = size(words) - 1", "going_on = 0"
        nodes = nodes.unionByName(alone.selectExpr("*", "posexplode(words) AS (at, _words)").selectExpr(
            "cast(NULL AS bigint) AS id1", "cast(NULL AS bigint) AS id2",
            "if(at = 0 AND a_n > 1, p1, NULL) AS r1", "if(at = 0 AND a_n > 1, p2, NULL) AS r2", "conv_id",
            f"level * {block} + at + 1 AS depth", "if(at = 0 AND a_n > 1, NULL, conv_id) AS parent_conv_id", "1L AS n_convs",
            f"if({end} AND {last}, 0L, 1L) AS n_children", "1L AS n_leaves", "0L AS saved_tokens",
            f"if({end} AND {last}, ends, '{NO_ENDS}') AS ends"))
    named = nodes.where("id1 IS NOT NULL").selectExpr("id1 AS n1", "id2 AS n2", "conv_id AS _parent")
    found = nodes.where("r1 IS NOT NULL").drop("parent_conv_id").join(named, F.expr("r1 = n1 AND r2 = n2"), "left").withColumnRenamed(
        "_parent", "parent_conv_id")
    return nodes.where("r1 IS NULL").selectExpr(*_RESULT).unionByName(found.selectExpr(*_RESULT))
