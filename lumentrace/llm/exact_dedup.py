"""Exact deduplication with a cuckoo-filter index over the digests of normalised texts.

The index is split into buckets by digest. A bucket holds a cuckoo filter (two candidate cells of four 16-bit
fingerprints per digest) and its content, the full digests with their group. Batches of documents are inserted one after
another: a filter hit is verified against the content and joins the group there; a miss proves a digest new without looking.
Digests can be deleted again. When an insertion finds no free slot after ``MAX_KICKS`` displacements the filter is doubled
and rebuilt from the stored keys; when the buckets hold more digests than they are meant for, their number is doubled and
they are dealt anew, from the stored keys as well.
"""

from __future__ import annotations

from array import array
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.llm.common import NULL_ID, discard, with_ids, with_text, written

#: Distinct digests that a bucket holds on average, at most, and the buckets of a new index.
BUCKET_KEYS, FIRST_BUCKETS = 50_000, 8
#: Batches in which ``deduplicate`` feeds its documents.
BATCHES = 4
MAX_KICKS = 200
SLOTS = 4
STATE = "bucket int, digest string, keep_id long, group_size long, cells int, filter binary"
WHITE = r"[\x20\x09-\x0D]+"


class CuckooFilter:
    """Approximate membership of 64-bit keys with deletion; never misses a key that it holds."""

    def __init__(self, cells: int = 1024, table: bytes | None = None):
        self.cells = cells
        self.table = array("H", table) if table else array("H", bytes(2 * SLOTS * cells))

    def _places(self, key: int) -> tuple[int, int, int]:
        mark = (key >> 48) or 1
        at = key & (self.cells - 1)
        return mark, at, self._other(at, mark)

    def _other(self, at: int, mark: int) -> int:
        return at ^ ((mark * 0x5BD1E995) & (self.cells - 1))

    def _slot(self, at: int, mark: int) -> int:
        for i in range(at * SLOTS, at * SLOTS + SLOTS):
            if self.table[i] == mark:
                return i
        return -1

    def holds(self, key: int) -> bool:
        mark, a, b = self._places(key)
        return self._slot(a, mark) >= 0 or self._slot(b, mark) >= 0

    def add(self, key: int) -> bool:
        """False if there is no room; the filter must then be rebuilt larger from the stored keys."""
        mark, a, b = self._places(key)
        for at in (a, b):
            if (i := self._slot(at, 0)) >= 0:
                self.table[i] = mark
                return True
        at = b
        for kick in range(MAX_KICKS):
            i = at * SLOTS + (kick + mark) % SLOTS
            mark, self.table[i] = self.table[i], mark
            at = self._other(at, mark)
            if (i := self._slot(at, 0)) >= 0:
                self.table[i] = mark
                return True
        return False

    def remove(self, key: int) -> bool:
        mark, a, b = self._places(key)
        for at in (a, b):
            if (i := self._slot(at, mark)) >= 0:
                self.table[i] = 0
                return True
        return False


def filter_key(digest: str) -> int:
    return int(digest[8:24], 16)


class Bucket:
    """A filter and the digests behind it."""

    def __init__(self, content: dict[str, list[int]], cells: int = 1024, table: bytes | None = None):
        self.content, self.filter = content, CuckooFilter(cells, table)
        if table is None and content:
            self.resize(cells)

    def resize(self, cells: int) -> None:
        while True:
            self.filter = CuckooFilter(cells)
            if all(self.filter.add(filter_key(d)) for d in self.content):
                return
            cells *= 2

    def put(self, digest: str, keep_id: int, size: int) -> None:
        if self.filter.holds(filter_key(digest)) and (group := self.content.get(digest)):
            group[0], group[1] = min(group[0], keep_id), group[1] + size
            return
        self.content[digest] = [keep_id, size]
        if not self.filter.add(filter_key(digest)):
            self.resize(2 * self.filter.cells)

    def take(self, digest: str, keep_id: int | None, size: int) -> None:
        """``size`` rows of a digest go; ``keep_id`` is the smallest id that is left, None if none is."""
        if not (self.filter.holds(filter_key(digest)) and (group := self.content.get(digest))):
            return
        if keep_id is None:
            del self.content[digest]
            self.filter.remove(filter_key(digest))
        else:
            group[0], group[1] = keep_id, group[1] - size

    def rows(self, bucket: int) -> pd.DataFrame:
        n = len(self.content)
        out = {
            "bucket": [bucket] * (n + 1),
            "digest": [None, *self.content],
            "keep_id": pd.array([None, *(g[0] for g in self.content.values())], dtype="Int64"),
            "group_size": pd.array([None, *(g[1] for g in self.content.values())], dtype="Int64"),
            "cells": pd.array([self.filter.cells] + [None] * n, dtype="Int32"),
            "filter": [self.filter.table.tobytes()] + [None] * n,
        }
        return pd.DataFrame(out)


def _load(state: pd.DataFrame) -> Bucket:
    keys = state[state["digest"].notna()]
    content = {d: [int(k), int(n)] for d, k, n in zip(keys["digest"], keys["keep_id"], keys["group_size"], strict=True)}
    head = state[state["digest"].isna()]
    return Bucket(content, int(head["cells"].iloc[0]), bytes(head["filter"].iloc[0])) if len(head) else Bucket(content)


def _insert(key: tuple, state: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    bucket = _load(state)
    for digest, keep_id, size in zip(new["digest"], new["keep_id"], new["size"], strict=True):
        bucket.put(digest, int(keep_id), int(size))
    return bucket.rows(int(key[0]))


def _delete(key: tuple, state: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
    bucket = _load(state)
    for digest, keep_id, size in zip(gone["digest"], gone["keep_id"], gone["size"], strict=True):
        bucket.take(digest, None if pd.isna(keep_id) else int(keep_id), int(size))
    return bucket.rows(int(key[0]))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of each whole text with runs of ASCII white space as one space; null text is empty."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), WHITE, " ")
    return with_text(docs).select("doc_id", F.sha2(text, 256).alias("digest"))


class DedupIndex:
    """Live digests over all batches, in tables of the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int = FIRST_BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.state: DataFrame | None = None
        self.members: list[DataFrame] = []

    def _bucket(self):
        return F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _grown(self, extra: int) -> DataFrame:
        """The state with room for ``extra`` digests; with more buckets than before it is the keys alone, and filters are made anew."""
        if self.state is None:
            return self.spark.createDataFrame([], STATE)
        keys, before = self.state.where("digest is not null"), self.buckets
        need = keys.count() + extra
        while need > self.buckets * BUCKET_KEYS:
            self.buckets *= 2
        return self.state if self.buckets == before else keys.withColumn("bucket", self._bucket())

    def _apply(self, change: DataFrame, f) -> None:
        change = written(change, "change")
        old, before = self.state, self._grown(change.count())
        new = before.groupBy("bucket").cogroup(change.select(self._bucket(), "digest", "keep_id", "size").groupBy("bucket")).applyInPandas(f, STATE)
        self.state = written(new, "cuckoo")
        discard(change)
        if old is not None:
            discard(old)

    def insert(self, rows: DataFrame) -> None:
        """Add a batch of ``digests``; rows of a digest are combined before the shuffle, so a large group reaches its bucket as a few rows."""
        self._apply(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("size")), _insert)
        self.members.append(rows)

    def delete(self, ids: DataFrame) -> None:
        """Remove documents by doc_id; a digest with no live row left leaves the filter."""
        gone = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")).distinct()
        rows = self.live()
        out, rest = rows.join(gone, "doc_id", "left_semi"), rows.join(gone, "doc_id", "left_anti")
        sizes = out.groupBy("digest").agg(F.count("*").alias("size"))
        left = rest.join(sizes.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        self._apply(sizes.join(left, "digest", "left"), _delete)
        self.members = [written(rest, "members")]

    def live(self) -> DataFrame:
        """(doc_id, digest) of the documents that are in."""
        out = self.spark.createDataFrame([], "doc_id long, digest string")
        return reduce(DataFrame.unionByName, (m.select("doc_id", "digest") for m in self.members), out)

    def groups(self, rows: DataFrame) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of the given (doc_id, digest) rows."""
        live = self.state.where("digest is not null").select("digest", "keep_id", "group_size")
        out = rows.join(live, "digest").select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
        return with_ids(out, "doc_id", "keep_id")


def deduplicate(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per document with the group of equal texts that it belongs to; the smallest doc_id of a group stays.

    Documents enter the index in ``batches`` parts by a hash of doc_id, so most copies meet their group by a filter hit.
    Returns doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when identical after each run of ASCII white
    space is replaced by one space; null counts as empty, and empty texts form a group. A null doc_id counts as smaller
    than all others; rows with the same doc_id and text are both kept if that id stays. Other columns are not read. An
    empty table gives an empty result.
    """
    rows = written(digests(docs), "digests")
    index = DedupIndex(docs.sparkSession)
    for i in range(batches):
        index.insert(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
    return index.groups(rows)
