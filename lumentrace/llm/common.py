"""Helpers that the text operators share: tables in the shared folder, Arrow slicing and vectorised text hashing.

Arrow batches of text are bounded in bytes by Spark itself; workers cut them into smaller steps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.session import CLEANUP, discard, remove, setting, shared_path, written

__all__ = ["discard", "remove", "shared_path", "written"]

#: Bytes of text that one vectorised step works on; a longer document is worked on alone.
STEP_BYTES = 1 << 19

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_PRIME_BASE = 0x16A09E667F3BCC9


@dataclass(frozen=True)
class Buckets:
    """A table of the shared folder in buckets of a key, so that joins and windows on the key need no exchange."""

    spark: SparkSession
    name: str
    path: str
    count: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.forget()
        remove(self.spark, self.path)

    def forget(self) -> None:
        """Leave the files where they are."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def bucketed(df: DataFrame, key: str, name: str, order: tuple[str, ...] = (), path: str | None = None, count: int | None = None) -> Buckets:
    """Write ``df`` in ``count`` buckets of ``key``, as many as shuffles have partitions by default, one file each, sorted by key and ``order``."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    count = count or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = Buckets(spark, f"lumentrace_{uuid.uuid4().hex}", path, count)
    with setting(spark, CLEANUP, "true"):
        df.repartition(count, key).write.option("compression", "zstd").option("path", path).bucketBy(count, key).sortBy(key, *order).saveAsTable(out.name)
    return out


def opened(spark: SparkSession, path: str, schema: str, key: str, order: tuple[str, ...], count: int) -> Buckets:
    """A table that ``bucketed`` wrote in another session."""
    out = Buckets(spark, f"lumentrace_{uuid.uuid4().hex}", path, count)
    by = ", ".join((key, *order))
    spark.sql(f"CREATE TABLE {out.name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({by}) INTO {count} BUCKETS LOCATION '{path}'")
    return out


def text_steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``text`` column holds about ``limit`` bytes, or one row."""
    for batch in batches:
        text = batch.column("text")
        size = np.concatenate([[0], np.cumsum(lengths(text))])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def lengths(text: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; null counts as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def joined(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array with a space after each, and where each text starts (one entry more than rows)."""
    values = [v.encode() if isinstance(v, str) else (v or b"") for v in text.to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(v) + 1 for v in values], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b" ".join([*values, b""]), dtype=np.uint8), starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes of any range of a token sequence, modulo 2**64: fast, and good for choosing and grouping.

    ``values`` are 64-bit token hashes. ``of(start, end)`` is vectorised; equal ranges have equal hashes whatever
    their place. Unequal ranges may agree, so equality is for ``PrimeRolling`` to tell.
    """

    _powers: list[np.ndarray] = []

    def __init__(self, values: np.ndarray):
        base, inverse = self._tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * base[: len(values)], out=self.sums[1:])
        self.inverse = inverse

    @classmethod
    def _tables(cls, size: int) -> list[np.ndarray]:
        if not cls._powers or len(cls._powers[0]) < size:
            size = max(1 << 16, 1 << (size - 1).bit_length())
            base = _BASES[0] | 1
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                powers = np.full(size, b, dtype=np.uint64)
                powers[0] = 1
                made.append(np.cumprod(powers))
            cls._powers = made
        return cls._powers

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it, in 64-bit words."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    cross = a1 * b0
    cross += a0 * b1
    a0 *= b0
    a1 *= b1
    a1 <<= np.uint64(3)
    a1 += cross >> np.uint64(29)
    cross &= np.uint64((1 << 29) - 1)
    cross <<= half
    a1 += cross
    a1 += a0 & _P
    a0 >>= np.uint64(61)
    a1 += a0
    return _reduced(a1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """The residue of 64-bit words."""
    x = (x & _P) + (x >> np.uint64(61))
    x -= _P * (x >= _P)
    return x


class PrimeRolling:
    """As ``Rolling`` but modulo the prime 2**61 - 1, where no two texts agree for every base.

    This is the hash that equality rests on: unequal ranges of n tokens agree for at most n of the 2**61 bases. (Modulo
    2**64 there are words that agree for all odd bases, so two bases are not two witnesses.)
    """

    #: Tokens that one step of the sums works on, so that its arrays stay in a processor's cache.
    STRIDE = 1 << 13
    _powers: list[np.ndarray] = []

    def __init__(self, values: np.ndarray):
        powers, self.inverse = self._tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        for at in range(0, len(values), self.STRIDE):
            part = _reduced(values[at : at + self.STRIDE])
            terms = _times(part, powers[at : at + len(part)])
            low = np.cumsum(terms & np.uint64((1 << 31) - 1))
            high = np.cumsum(terms >> np.uint64(31))
            # a power of two turns the 61 bits round
            sums = ((high & np.uint64((1 << 30) - 1)) << np.uint64(31)) + (high >> np.uint64(30)) + low
            self.sums[at + 1 : at + 1 + len(terms)] = _reduced(sums + self.sums[at])

    @classmethod
    def _tables(cls, size: int) -> list[np.ndarray]:
        if not cls._powers or len(cls._powers[0]) < size:
            size = max(1 << 16, 1 << (size - 1).bit_length())
            made = []
            for base in (_PRIME_BASE, pow(_PRIME_BASE, -1, PRIME)):
                powers = np.ones(size, dtype=np.uint64)
                have, step = 1, base
                while have < size:
                    powers[have : 2 * have] = _times(powers[:have], np.full(have, step, dtype=np.uint64))
                    have, step = 2 * have, step * step % PRIME
                made.append(powers)
            cls._powers = made
        return cls._powers

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(_times(_reduced(self.sums[end] + _P - self.sums[start]), self.inverse[start]))


def byte_values(seed: int = 0) -> np.ndarray:
    """A 64-bit word for each of the 256 bytes."""
    return mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * seed)) * np.uint64(_BASES[seed]))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than ASCII white space: their starts, ends, and the first word of each text (and the end)."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    return begin, end, np.searchsorted(begin, starts)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = False, prime: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z read as a-z if ``lower``; with ``prime`` one that equality may rest on."""
    table = byte_values(int(prime))
    table = table[_LOWER] if lower else table
    return (PrimeRolling if prime else Rolling)(table[data]).of(begin, end)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Of every window of ``width`` values the place of the least; the leftmost of equal ones.

    Values are compared by their high bits, ties by place, which keeps the choice the same in equal windows.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    bits = np.uint64(31)
    keys = ((values >> bits) << bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


#: Stands for a null doc_id inside operators, so that keys can be joined.
NULL_ID = -(1 << 63)


def with_text(docs: DataFrame) -> DataFrame:
    """Only the columns that an operator needs, so scans read no others and clashing names can't matter."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def with_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Null ids as they were."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(NULL_ID)) for c in columns or ("doc_id",)})


def text_hash() -> Column:
    """A 64-bit hash of ``text``; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def one_a_text(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) rows under unique keys in order of doc_id, and what the keys stand for.

    Unique ids are their own keys, and the second table is None. Else each distinct (doc_id, text) is written once under a
    row number in place of the id, texts of one id in order of their hash; the second table is (doc_id, hash, text, row).
    """
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs, None
    own = docs.groupBy("doc_id", text_hash().alias("hash")).agg(F.min("text").alias("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    keys = written(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    return keys.select(F.col("row").alias("doc_id"), "text"), keys


def own_ids(out: DataFrame, keys: DataFrame | None, docs: DataFrame | None = None) -> DataFrame:
    """Results by the keys of ``one_a_text`` with doc_ids again; with ``docs`` one for each of its rows."""
    if keys is None:
        return out
    of = keys.select("doc_id", "hash", "row")
    if docs is not None:
        of = docs.select("doc_id", text_hash().alias("hash")).join(of, ["doc_id", "hash"])
    return of.join(out.withColumnRenamed("doc_id", "row"), "row").select(*out.columns)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, also where ``f`` uses it inside other functions of higher order."""
    return F.transform(F.array(value), f)[0]


def in_batches(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], limit: int = STEP_BYTES) -> Callable:
    """A mapInArrow function that applies ``f`` to slices of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches, limit):
            if (out := f(step)) is not None:
                yield out

    return run


class Recent(dict):
    """A bounded memo of ``make``: once ``size`` keys are new, the older generation is forgotten; keys of more than ``LONGEST`` are not kept."""

    LONGEST = 64

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class IdFilter:
    """A Bloom filter of doc_ids, to skip documents before their texts are worked on.

    It has about 16 bits an id within bounds of 128 KB and 32 MB. It never misses an id; with more ids than it has room for
    it lets more others pass, so what it lets through must still be joined with the ids.
    """

    LEAST, MOST, HASHES = 1 << 20, 1 << 28, 4

    def __init__(self, ids: DataFrame):
        bits = self.bits = min(self.MOST, max(self.LEAST, 1 << (16 * ids.count()).bit_length()))

        def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                at = np.unique(self._places(x.column(0).to_numpy(zero_copy_only=False), bits).ravel())
                bit = np.uint64(1) << (at & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], names=["word", "bits"])

        found = ids.mapInArrow(spots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(bits // 64, dtype=np.uint64)
        table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        self.shared = ids.sparkSession.sparkContext.broadcast(table)

    @classmethod
    def _places(cls, ids: np.ndarray, bits: int) -> np.ndarray:
        h = mix(ids.astype(np.int64).view(np.uint64))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return (h[:, None] + np.arange(cls.HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)

    def may_hold(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function of arrays of ids for use inside tasks."""
        shared, places, bits = self.shared, self._places, self.bits

        def test(ids: np.ndarray) -> np.ndarray:
            at = places(ids, bits)
            return ((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)

        return test
