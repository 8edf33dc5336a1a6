"""Repeated fixed-length windows of token sequences, found without sorting every position.

Every window of ``width`` tokens holds one anchor: its least ``gram``-token hash (winnowing). Equal windows have equal
anchors at equal offsets, so only windows at anchors whose gram occurs more than once can repeat. The windows of an
anchor form a node. A depth-limited most-significant-first refinement then decides nodes as a whole where it can:

* the ``core`` of a node is the range that all its windows share, the ``union`` the range that they cover together;
* nodes with equal union are copies of each other in full;
* a node whose core occurs under one union only has no other repeats, and is dropped;
* what is left is cut into narrower nodes and meets the next pass, down to single windows.

Only the first node of each union class goes on, so a group of copies costs one row in later passes. Within a task, equal
nodes are combined before the shuffle. A node's key is its core's hash modulo 2**64, by which nodes meet, and its union's
hash modulo the prime 2**61 - 1, on which equality rests.

Texts lie in buckets of doc_id, so the passes join nodes to them without moving a text again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import Buckets, PrimeRolling, Rolling, bucketed, byte_values, joined, mix, sliding_argmin, text_steps, word_hashes, words, written

NODES = "core long, uni long, doc_id long, anchor int, pos int, n int, cnt int"
#: Nodes that a task gathers before it combines equal ones.
COMBINE = 1 << 20
_SALT = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Tokens:
    """What windows are made of. kind: ``bytes`` or ``words``; steps: node widths of the passes after the first."""

    kind: str
    width: int
    gram: int
    steps: tuple[int, ...]

    def hashes(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each token of all texts, the second for equality, and where each text starts (and ends)."""
        data, starts = joined(text)
        if self.kind == "bytes":
            # the space after each text stays as a token that no valid window reaches
            return byte_values(0)[data], byte_values(1)[data], starts
        begin, end, first = words(data, starts)
        return word_hashes(data, begin, end), word_hashes(data, begin, end, prime=True), first

    def counts(self, first: np.ndarray) -> np.ndarray:
        return np.diff(first) - (1 if self.kind == "bytes" else 0)


def _emit(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Nodes of a task with equal ones combined: a first node that counts them; later ones have cnt 0 and a spread key."""
    if not parts:
        return
    core, uni, doc, anchor, pos, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pos, doc, uni, core))
    core, uni, doc, anchor, pos, n = (x[order] for x in (core, uni, doc, anchor, pos, n))
    fresh = np.ones(len(core), dtype=bool)
    fresh[1:] = (core[1:] != core[:-1]) | (uni[1:] != uni[:-1])
    at = np.flatnonzero(fresh)
    cnt = np.zeros(len(core), dtype=np.int32)
    cnt[at] = np.diff(np.append(at, len(core)))
    core = np.where(fresh, core, mix(doc.astype(np.uint64) ^ _SALT))
    arrays = [core.view(np.int64), uni.view(np.int64), doc, anchor.astype(np.int32), pos.astype(np.int32), n.astype(np.int32), cnt]
    table = pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[x.split()[0] for x in NODES.split(", ")])
    for at in range(0, table.num_rows, 1 << 16):
        yield table.slice(at, 1 << 16)


def anchors_of(tokens: Tokens) -> Callable:
    """mapInArrow function: the nodes of the first pass, one for each anchor of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for step in text_steps(batches):
            ids = step.column("doc_id").to_numpy(zero_copy_only=False)
            h, g, first = tokens.hashes(step.column("text"))
            count = tokens.counts(first)
            r, q = Rolling(h), PrimeRolling(g)
            m = len(h) - tokens.gram + 1
            if m < 1:
                continue
            at = np.arange(m)
            grams = r.of(at, at + tokens.gram)
            best = sliding_argmin(grams, tokens.width - tokens.gram + 1)
            doc = np.repeat(np.arange(len(count)), np.maximum(count - tokens.width + 1, 0))
            if not len(doc):
                continue
            begin = np.concatenate([[0], np.cumsum(np.maximum(count - tokens.width + 1, 0))])[:-1]
            s = np.arange(len(doc)) - begin[doc] + first[:-1][doc]
            a = best[s]
            new = np.ones(len(s), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
            lead = np.flatnonzero(new)
            n = np.diff(np.append(lead, len(s)))
            s, a, doc = s[lead], a[lead], doc[lead]
            base = first[:-1][doc]
            parts.append((grams[a], q.of(s, s + n - 1 + tokens.width), ids[doc].astype(np.int64), a - base, s - base, n))
            held += len(s)
            if held >= COMBINE:
                yield from _emit(parts)
                parts, held = [], 0
        yield from _emit(parts)

    return run


def narrower(tokens: Tokens, step_width: int) -> Callable:
    """mapInArrow function: rows of (doc_id, text, nodes) become nodes of at most ``step_width`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for step in text_steps(batches):
            ids = step.column("doc_id").to_numpy(zero_copy_only=False)
            h, g, first = tokens.hashes(step.column("text"))
            r, q = Rolling(h), PrimeRolling(g)
            nodes = step.column("nodes")
            off = nodes.offsets.to_numpy()
            flat = nodes.flatten()
            anchor, pos, n = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("anchor", "pos", "n"))
            row = np.repeat(np.arange(len(ids)), np.diff(off))
            base = first[:-1][row]
            # offsets of the anchor in the node's windows run from low to high; cut them at multiples of the width
            low, high = anchor - (pos + n - 1), anchor - pos
            j0, j1 = low // step_width, high // step_width
            k = np.repeat(np.arange(len(anchor)), j1 - j0 + 1)
            j = np.arange(len(k)) - np.repeat(np.cumsum(j1 - j0 + 1) - (j1 - j0 + 1), j1 - j0 + 1) + j0[k]
            o1, o2 = j * step_width, j * step_width + step_width - 1
            lo, hi = np.maximum(o1, low[k]), np.minimum(o2, high[k])
            a, b = anchor[k] + base[k], base[k]
            first_window, last_window = a - hi, a - lo
            core = r.of(a - o1, a - o2 + tokens.width) ^ mix(j.astype(np.uint64) + np.uint64(step_width << 20))
            uni = q.of(first_window, last_window + tokens.width)
            parts.append((core, uni, ids[row[k]].astype(np.int64), anchor[k], first_window - b, hi - lo + 1))
            held += len(k)
            if held >= COMBINE:
                yield from _emit(parts)
                parts, held = [], 0
        yield from _emit(parts)

    return run


def judged(nodes: DataFrame, mode: str) -> DataFrame:
    """Each node with ``hit`` (all its windows repeat), ``first`` (of its union class) and ``open`` (goes to the next pass).

    mode ``any``: a window is a hit if it occurs elsewhere; ``earlier``: if it occurs at a smaller (doc_id, start). Nodes
    are ordered by core, union and place; a frequent core's rows stream through their task.
    """
    by = Window.partitionBy("core", "uni")
    core = Window.partitionBy("core")
    live = F.col("cnt") > 0
    out = nodes.repartition("core")
    out = out.withColumn("rank", F.row_number().over(by.orderBy("doc_id", "pos", F.col("cnt").desc())))
    out = out.withColumn("copies", F.sum("cnt").over(by)).withColumn("several", F.min("uni").over(core) != F.max("uni").over(core))
    hit = ~live | ((F.col("rank") > 1) if mode == "earlier" else (F.col("copies") > 1))
    return out.select(*nodes.columns, hit.alias("hit"), (live & (F.col("rank") == 1)).alias("first"), (live & (F.col("rank") == 1) & F.col("several")).alias("open"))


def texts_by_id(docs: DataFrame) -> Buckets:
    """(doc_id, text) rows with unique ids, in buckets of doc_id."""
    return bucketed(docs, "doc_id", "texts")


def refine(texts: DataFrame, judged_nodes: DataFrame, tokens: Tokens, mode: str, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """The later passes: (doc_id, spans) with all windows that repeat, the first pass's included, and the tables behind it."""
    spans, made = judged_nodes.where("hit").select("doc_id", "pos", "n"), []
    for width in tokens.steps:
        todo = judged_nodes.where("open").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "pos", "n")).alias("nodes"))
        cut = texts.join(todo.hint("shuffle_hash"), "doc_id").mapInArrow(narrower(tokens, width), NODES)
        judged_nodes = written(judged(cut, mode).where("hit or open"), f"{name}-{width}")
        made.append(judged_nodes)
        spans = spans.unionByName(judged_nodes.where("hit").select("doc_id", "pos", "n"))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n")).alias("spans")), made


def attach(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, spans) with the repeated windows of each document, null where there are none."""
    return texts.join(spans.hint("shuffle_hash"), "doc_id", "left")


def covered(step: pa.RecordBatch, row: int, size: int, width: int) -> np.ndarray:
    """Which of the ``size`` tokens of a row some repeated window covers."""
    found = step.column("spans")[row].values
    if not size or found is None or not len(found):
        return np.zeros(size, dtype=bool)
    pos, n = (found.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("pos", "n"))
    change = np.bincount(pos, minlength=size + 1) - np.bincount(np.minimum(size, pos + n - 1 + width), minlength=size + 1)
    return np.cumsum(change)[:size] > 0
