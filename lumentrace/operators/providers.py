"""Calls of language and embedding models behind one interface, cached by a hash of the request.

Model calls never stand inside a plan that may be recomputed: what the cache lacks is called once, written, and read back.
"""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.operators.call_runs import MOST_RUNS, STALE, Runs
from lumentrace.session import written

Provider = Callable[[str], str | None]
Embedder = Callable[[str], np.ndarray]


def retried(provider: Provider, tries: int = 3, wait: float = 0.0) -> Provider:
    """The provider with repeated attempts and growing waits; None when all fail."""

    def call(request: str) -> str | None:
        for attempt in range(tries):
            try:
                return provider(request)
            except Exception:  # any failure of an outside service
                if attempt + 1 < tries:
                    time.sleep(wait * 1.5**attempt)
        return None

    return call


class Pace:
    """Waits so that at most ``per_second`` calls begin in a second, whatever the number of threads."""

    def __init__(self, per_second: float):
        self.gap, self.next, self.lock = 1 / per_second, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            at = max(self.next, time.monotonic())
            self.next = at + self.gap
        time.sleep(max(0.0, at - time.monotonic()))


def paced(provider: Provider, per_second: float) -> Provider:
    """The provider at a bounded pace in each task; attempts that ``retried`` repeats count too."""
    made: list[Pace] = []

    def call(request: str) -> str | None:
        if not made:
            made.append(Pace(per_second))
        made[0].wait()
        return provider(request)

    return call


def called(requests: DataFrame, provider: Provider, workers: int = 8, tries: int = 3) -> DataFrame:
    """(key, request, response) of distinct requests (key, request), with a bounded pool of threads in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = retried(provider, tries)
        for rows in batches:
            with ThreadPoolExecutor(workers) as pool:
                yield rows.assign(response=list(pool.map(call, rows["request"])))

    return requests.mapInPandas(run, "key string, request string, response string")


class CallCache:
    """Answers under hashes of their requests in a shared folder; failures are not kept, so they are tried again.

    A frame reads the runs that there were when it was made. Several sessions may share a cache: each request is called by
    one of them, and the others wait for the answer (``call_runs``).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, most_runs: int = MOST_RUNS, stale: float = STALE):
        self.spark, self.path, self.most_runs = spark, path, most_runs
        self.runs = Runs(spark, path, buckets, stale)

    def table(self) -> DataFrame:
        return self.runs.table()

    def complete(self, df: DataFrame, request: str, provider: Provider, to: str = "response") -> DataFrame:
        """``df`` with the response to each request; null where the provider failed or the request is null."""
        keyed = df.withColumn("_key", F.sha2(F.col(request), 256))
        wanted = keyed.where(F.col(request).isNotNull()).select(F.col("_key").alias("key"), F.col(request).alias("request")).distinct()
        claim, own, others = self.runs.claim(wanted)
        try:
            if not own.isEmpty():
                self.runs.write(called(own, provider).where("response is not null"))
        finally:
            self.runs.release(claim)
        if others:
            self.runs.wait()
            return self.complete(df, request, provider, to)
        self.runs.compact(self.most_runs)
        return self.runs.answers(keyed, "_key", to).drop("_key")


def embedded_by_calls(df: DataFrame, text: str, provider: Provider, cache: CallCache, to: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows with the vectors that a provider answers as JSON arrays, and the dead letters (text, reason) of texts without one.

    Each distinct text is called once in all: answers are in the cache, so a run after a failure calls only what failed, and
    an answer that is not an array of numbers counts as one, which is not called again. Null texts are neither.
    """
    said = cache.complete(df.select(text).where(F.col(text).isNotNull()).distinct(), text, provider, "_said")
    vector = F.from_json("_said", "array<float>")
    sound = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    told = written(said.select(text, F.when(sound, vector).alias(to), F.when(F.col("_said").isNull(), "no answer").when(~F.coalesce(sound, F.lit(False)), "no vector").alias("reason")), "vectors")
    keyed = lambda rows: rows.withColumn("_hash", F.xxhash64(text))
    out = keyed(df).join(keyed(told.select(text, to)), ["_hash", text], "left").select(*df.columns, to)
    return out, told.where("reason is not null").select(text, "reason")


def hashing_embedder(size: int = 64) -> Callable[[str], np.ndarray]:
    """A deterministic embedding without a model: signed counts of hashed words, at unit length.

    Where the signed counts of all words cancel, the words are counted without signs; only a text without words has zeros.
    """

    def embed(text: str) -> np.ndarray:
        h = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in text.lower().split()], dtype=np.uint64)
        at = (h % np.uint64(size)).astype(np.int64)
        v = np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), size)
        if len(at) and not v.any():
            v = np.bincount(at, minlength=size).astype(np.float64)
        n = np.linalg.norm(v)
        return v / n if n else v

    return embed


def embedded(df: DataFrame, text: str, embed: Callable[[str], np.ndarray], to: str = "embedding") -> DataFrame:
    """Distinct texts with their vectors, joined back to the rows; null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(**{to: [embed(t).astype(np.float32).tolist() for t in rows[text]]})

    one = df.where(F.col(text).isNotNull()).select(text).distinct().mapInPandas(run, f"{text} string, {to} array<float>")
    # long texts meet on their hashes
    keyed = lambda rows: rows.withColumn("_hash", F.xxhash64(text))
    return keyed(df).join(keyed(one), ["_hash", text], "left").select(*df.columns, to)
