"""The trie of all prefixes of conversations, with totals of every subtree by time-forward processing.

A node is a distinct sequence of first turns; a chain of hashes over (role, text) names it. Totals go upwards: nodes are sorted
by falling depth, and each sends its totals to its parent through a priority queue whose order is that of the nodes, so a
parent finds all messages for it on top when its turn comes. A node's row is itself the message: it leaves the queue with its
parent's conv_id.

The trie is cut into shards. Nodes with more than ``MEMBERS`` conversations (or a ``1 / TOP`` part of all rows, if more) are
the top; there are at most ``TOP`` of them, or rows / ``MEMBERS``, as their conversations sum up to no more than all rows.
Below, each first node with fewer conversations is the root of a shard, so a turn with which a third of all conversations
begin falls into many shards. Shards go through queues of their own side by side; then what their roots send is summed by
parent, and the top, of bounded size, goes through one more queue.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import discard, written

#: Most conversations of a node inside a shard, and the most nodes of the top beyond that.
MEMBERS, TOP = 50, 20_000
#: Messages that a queue holds in memory; more go to sorted runs on disk.
QUEUE = 200_000
#: Runs of a queue that lie open at a time; more are merged into one.
RUNS = 64
#: Turns that a conversation may take from another one.
MOST_SHARED = 3
#: Rows of an Arrow batch that a task returns, and characters of a stretch of ids that is hashed at a time.
ROWS, STRETCH = 10_000, 1 << 20

_WORD = r"[^\x20\x09-\x0D]+"
_ROOT = bytes(16)
_NONE = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """A priority queue of (order, item): once ``limit`` items are in memory they go to disk as a sorted run.

    Runs are unnamed files of the task, as Spark's own spills are; they vanish when they are read or the task ends. Beyond
    ``RUNS`` of them they are merged into one. Items come out by rising order, equal ones in any order.
    """

    def __init__(self, limit: int = QUEUE):
        self.limit, self.items, self.count = limit, [], 0
        self.runs: list[tuple[bytes, int, object, Iterator]] = []

    def __bool__(self) -> bool:
        return bool(self.items or self.runs)

    def push(self, order: bytes, item: object) -> None:
        self.count += 1
        heapq.heappush(self.items, (order, self.count, item))
        if len(self.items) >= self.limit:
            self._spill(iter(sorted(self.items)))
            self.items = []

    def least(self) -> bytes | None:
        heads = [x[0][0] for x in (self.items, self.runs) if x]
        return min(heads) if heads else None

    def pop(self) -> object:
        if self.runs and (not self.items or self.runs[0][:2] < self.items[0][:2]):
            *_, item, rest = heapq.heappop(self.runs)
            self._open(rest)
            return item
        return heapq.heappop(self.items)[2]

    def _spill(self, entries: Iterator) -> None:
        file = tempfile.TemporaryFile()
        for e in entries:
            pickle.dump(e, file, pickle.HIGHEST_PROTOCOL)
        file.seek(0)
        self._open(_read(file))
        if len(self.runs) > RUNS:
            opened, self.runs = self.runs, []
            self._spill(heapq.merge(*(_chained(r) for r in opened), key=lambda e: e[:2]))

    def _open(self, rest: Iterator) -> None:
        head = next(rest, None)
        if head is not None:
            heapq.heappush(self.runs, (*head, rest))


def _read(file) -> Iterator[tuple]:
    with file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def _chained(run: tuple) -> Iterator[tuple]:
    *head, rest = run
    yield tuple(head)
    yield from rest


def rebuilt(conversations: DataFrame, shared: int = MOST_SHARED, block: int = 20) -> DataFrame:
    """(conv_id, place, digest, words, own, heads): turns in order, with what a conversation takes from the first of its block.

    Conversation c takes the first h turns of c - c % block, or all if there are fewer, in place of its own first h, with h
    the CRC-32 of its decimal id modulo ``shared + 1``. ``heads`` are these turns, on the row of place 1 alone; ``own`` marks
    the rows that stay. Only digests of turns travel, never their texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    rows = written(rows.withColumn("place", F.row_number().over(order)).select("conv_id", "place", "digest", "words"), "turns")
    first = F.array_sort(F.collect_list(F.struct("place", "digest", "words")))
    heads = rows.where(F.col("place") <= shared).groupBy("conv_id").agg(first.alias("heads")).withColumnRenamed("conv_id", "block")
    takes = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared + 1)).cast("int")
    convs = rows.where("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("block"), takes.alias("takes"))
    convs = convs.join(heads, "block", "left").select("conv_id", "takes", F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), F.lit(1), F.col("takes")).alias("heads"))
    own = F.col("place") > F.col("takes")
    return rows.join(convs, "conv_id").where(own | (F.col("place") == 1)).select("conv_id", "place", "digest", "words", own.alias("own"), F.when(F.col("place") == 1, F.col("heads")).alias("heads"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (conv_id, depth, key, parent, words, last) for each conversation and each of its prefixes, the empty one too.

    Rows come by conversation and place; only the last prefix is kept between them, so a conversation may be of any length.
    """
    out: list[tuple] = []
    conv = held = None

    def batch():
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], names=["conv_id", "depth", "key", "parent", "words", "last"])

    def step(digest, words):
        nonlocal held
        out.append((*held, False))
        held = (conv, held[1] + 1, hashlib.sha256(held[2] + digest).digest()[:16], held[2], words)

    for rows in batches:
        for c, digest, words, own, heads in zip(*(rows.column(k).to_pylist() for k in ("conv_id", "digest", "words", "own", "heads")), strict=True):
            if heads is not None:
                if held is not None:
                    out.append((*held, True))
                conv, held = c, (c, 0, _ROOT, None, 0)
                for h in heads:
                    step(h["digest"], h["words"])
            if own:
                step(digest, words)
            if len(out) >= ROWS:
                yield batch()
    if held is not None:
        out.append((*held, True))
        yield batch()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each key, sorted, joined by commas, in strings of bounded size: (key, first, ids)."""
    out: list[tuple] = []
    key, first, ids, size, total = None, None, [], 0, 0
    names, types = ["key", "first", "ids"], (pa.binary(), pa.int64(), pa.string())

    def batch():
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    for rows in batches:
        for k, c in zip(rows.column("key").to_pylist(), rows.column("conv_id").to_pylist(), strict=True):
            if ids and (k != key or size >= STRETCH):
                out.append((key, first, ",".join(ids)))
                total, ids, size = total + size, [], 0
                if len(out) >= ROWS or total >= STRETCH:
                    yield batch()
                    total = 0
            if not ids:
                key, first = k, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        out.append((key, first, ",".join(ids)))
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of stretches in order; a hash takes them one by one."""
    keys, hashes = [], []
    key = state = None
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])
    for rows in batches:
        for k, ids in zip(rows.column("key").to_pylist(), rows.column("ids").to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(keys) >= ROWS:
            yield batch()
            keys, hashes = [], []
    if state is not None:
        keys.append(key)
        hashes.append(state.hexdigest())
        yield batch()


def ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end.

    Ids are sorted and joined in ranges, which split a node of many; only the joined stretches come together by node.
    """
    ids = members.where("last").select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    stretches = ids.mapInArrow(_stretches, "key binary, first long, ids string")
    return stretches.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")


_NODE = ("key", "parent", "depth", "conv_id", "n_convs", "words", "ends_sha256", "shard")
_TOTALS = "key binary, parent binary, depth long, conv_id long, n_convs long, words long, ends_sha256 string, shard binary, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
_ARROW = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), *(pa.int64(),) * 4)


def _order(depth: int, key: bytes) -> bytes:
    """Deeper nodes first, then by key; as bytes, which compare fast."""
    return struct.pack(">q", -depth + (1 << 62)) + key


def time_forward(limit: int = QUEUE):
    """A function for tasks over nodes by (shard, falling depth, key) with the totals that come from other shards.

    Nodes are rows ``_NODE`` with n_children, n_leaves and saved_tokens as received so far. Each one takes the messages for it from
    the queue, adds its own part, and waits in the queue for its parent; one whose parent is in no node of the shard, its
    root, goes out without the parent's conv_id as the shard ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        queue, shard = SpillingQueue(limit), None

        def batch(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _ARROW, strict=True)], names=[x.split()[0] for x in _TOTALS.split(", ")])

        def full() -> Iterator[pa.RecordBatch]:
            while len(out) >= ROWS:
                yield batch(out[:ROWS])
                del out[:ROWS]

        for rows in batches:
            for *node, children, leaves, saved in zip(*(rows.column(k).to_pylist() for k in (*_NODE, "n_children", "n_leaves", "saved_tokens")), strict=True):
                key, parent, depth, conv, convs, words, _, of = node
                if of != shard:
                    while queue:
                        out.append(queue.pop())
                        yield from full()
                    shard = of
                mine = _order(depth, key)
                while queue and (least := queue.least()) <= mine:
                    child = queue.pop()
                    if least == mine:
                        children, leaves, saved = children + 1, leaves + child[-2], saved + child[-1]
                        child = (*child[:8], conv, *child[9:])
                    out.append(child)
                    yield from full()
                total = (*node, None, children, leaves or 1, saved + (convs - 1) * words)
                if parent is None:
                    out.append(total)
                else:
                    queue.push(_order(depth - 1, parent), total)
        while queue:
            out.append(queue.pop())
            yield from full()
        if out:
            yield batch(out)

    return run


def trie(conversations: DataFrame, shared: int = MOST_SHARED, block: int = 20, members: int = MEMBERS, queue: int = QUEUE) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns stand in order of turn, null first; rows that share a turn in order of role, then of a digest of their text, so
    equal rows count each. Null roles and texts are empty; rows without conv_id belong to no conversation and are left
    out. An empty table has no nodes, not even a root. Columns other than conv_id, turn, role and text are not read. All
    turns of a conversation stream through one task, which keeps none of them.
    """
    rows = rebuilt(conversations, shared, block).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    paths = written(rows.mapInArrow(_chain, "conv_id long, depth long, key binary, parent binary, words long, last boolean"), "paths")
    bound = max(members, paths.count() // TOP)
    counts = [F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words"), F.count("*").alias("n_convs")]
    nodes = written(paths.groupBy("key").agg(*counts).join(ends(paths), "key", "left"), "nodes")
    top = written(nodes.where(F.col("n_convs") > bound), "top")
    mark = F.broadcast(top.select("key", F.lit(True).alias("in_top")))
    roots = paths.select("conv_id", "depth", "key").join(mark, "key", "left_anti").groupBy("conv_id").agg(F.min_by("key", "depth").alias("shard"))
    low = nodes.where(F.col("n_convs") <= bound).join(roots, "conv_id").select(*_NODE, *(F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    low = low.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "key")
    below = written(low.mapInArrow(time_forward(queue), _TOTALS), "below")
    sent = below.where("key = shard and parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    above = top.join(sent, "key", "left").select(*_NODE[:-1], F.lit(_ROOT).alias("shard"), *zero)
    above = written(above.coalesce(1).sortWithinPartitions(F.desc("depth"), "key").mapInArrow(time_forward(queue), _TOTALS), "above")
    ids = F.broadcast(above.select(F.col("key").alias("parent"), F.col("conv_id").alias("above_id")))
    below = below.join(ids, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_id")).drop("above_id")
    discard(paths, nodes, top)
    out = below.unionByName(above).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
