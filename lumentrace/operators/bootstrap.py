"""Bootstrap confidence intervals of the behaviour metrics.

A replicate draws as many conversations, with replacement, as there are. Draws come from a hash of (replicate, draw), so
they are the same whatever the partitions. They are shuffled as places in blocks of conversations, two bytes a draw, and
counted by block into a byte for each replicate of each conversation; facts meet these weights in a join of their own size.
A group's rows are summed as arrays, so a cell is one row with all its replicates. Proportions of undrawn cells
are 0; means of undrawn cells are missing and are left out of the intervals, with ``n_valid`` telling how many replicates
remain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import sin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumentrace.operators.metrics import in_cluster, metric_names, pairs_of, scored_triples
from lumentrace.session import discard, written
from lumentrace.sources import loaders

LOW, HIGH = 0.025, 0.975
#: Bytes of sums that a task holds before it passes them on.
HELD = 64 << 20
#: Conversations of a block, whose places fit two bytes; draws that a task packs at a time, and that it hashes at a time.
BLOCK, GATHERED, HASHED = 1 << 14, 1 << 21, 1 << 14
#: Constants of MD5: what each step adds, and by how much it turns.
_SINES = [np.uint32(int(abs(sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def numbered(facts: DataFrame) -> DataFrame:
    """(conversation_id, conv_idx): conversations numbered from 0 in order of id."""
    return loaders.indexed(facts.select("conversation_id").distinct(), "conversation_id").withColumnRenamed("row_idx", "conv_idx")


def md5_heads(rep: int, low: int, high: int) -> np.ndarray:
    """The first four bytes, as one number, of the MD5 digests of the texts ``rep-d`` for d from ``low`` to ``high``.

    The texts have the same length and take one block of the digest, so its 64 steps are done on arrays of them.
    """
    d, head, size = np.arange(low, high), f"{rep}-".encode(), len(f"{rep}-{low}")
    text = np.zeros((len(d), 64), dtype=np.uint8)
    text[:, : len(head)] = np.frombuffer(head, dtype=np.uint8)
    for place in range(size - 1, len(head) - 1, -1):
        d, digit = np.divmod(d, 10)
        text[:, place] = digit + 48
    text[:, size], text[:, 56], text[:, 57] = 128, 8 * size & 255, 8 * size >> 8
    words = text.view("<u4")
    words = [words[:, j].copy() if j <= size // 4 else words[0, j] for j in range(16)]
    a, b, c, d = (np.full(len(text), x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    with np.errstate(over="ignore"):
        for i in range(64):
            turn, place = divmod(i, 16)
            f = _mixed(turn, b, c, d)
            f = f + a + _SINES[i] + words[(place, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[turn]]
            left = _TURNS[turn][i % 4]
            a, d, c, b = d, c, b, b + ((f << np.uint32(left)) | (f >> np.uint32(32 - left)))
        return (a + np.uint32(0x67452301)).byteswap()


def _mixed(turn: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if turn == 0:
        return d ^ (b & (c ^ d))
    if turn == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if turn == 2 else c ^ (b | ~d)


def drawn_places(rep: int, low: int, high: int, n: int) -> np.ndarray:
    """Which of ``n`` conversations the draws from ``low`` to ``high`` of a replicate take, in steps of texts of one length."""
    out = np.empty(high - low, dtype=np.int64)
    at = low
    while at < high:
        end = min(high, at + HASHED, 10 ** len(str(at)))
        out[at - low : end - low] = md5_heads(rep, at, end)
        at = end
    return out % n


def _packed(n: int, replicates: int) -> Callable:
    """Of stretches of draws (rep, low) rows (block, rep, at): places in a block of ``BLOCK`` conversations, two bytes each."""

    def pack(rep: int, low: int) -> pa.RecordBatch:
        places = drawn_places(rep, low, min(n, low + GATHERED), n)
        block = places // BLOCK
        # few blocks are sorted by their digits
        order = np.argsort(block.astype(np.uint16) if n <= BLOCK << 16 else block, kind="stable")
        block = block[order]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        ends = pa.array(2 * np.append(starts, len(block)).astype(np.int32)).buffers()[1]
        at = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer((places % BLOCK).astype("<u2")[order])])
        return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(np.full(len(starts), rep)), at], names=["block", "rep", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, low in zip(batch.column("rep").to_pylist(), batch.column("low").to_pylist(), strict=True):
                yield pack(rep, low)

    return run


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows of a binary column, one after the other, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _counted(replicates: int, out: Callable[[int, np.ndarray], Iterator[pa.RecordBatch]]) -> Callable:
    """Of packed draws in order of block what ``out`` makes of a block and its counts (conversation, replicate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, np.zeros(BLOCK * replicates, dtype=np.int32)
        for batch in batches:
            blocks, reps = (batch.column(c).to_numpy() for c in ("block", "rep"))
            for low in np.flatnonzero(np.diff(blocks, prepend=-1)).tolist():
                n = int(np.searchsorted(blocks[low:], blocks[low], side="right"))
                if at is not None and at != blocks[low]:
                    yield from out(at, counts.reshape(BLOCK, replicates))
                    counts[:] = 0
                at = int(blocks[low])
                places, sizes = _bytes(batch.column("at").slice(low, n))
                np.add.at(counts, np.frombuffer(places.tobytes(), dtype="<u2").astype(np.int64) * replicates + np.repeat(reps[low : low + n], sizes // 2), 1)
        if at is not None:
            yield from out(at, counts.reshape(BLOCK, replicates))

    return run


def _by_block(spark, n: int, replicates: int) -> DataFrame:
    """(block, rep, at): all draws, n for each replicate, packed and in order of block within a partition."""
    each = -(-n // GATHERED)
    tasks = max(1, min(each * replicates, max(spark.sparkContext.defaultParallelism, each * replicates // 8)))
    stretches = spark.range(0, each * replicates, 1, tasks).select(F.floor(F.col("id") / max(1, each)).alias("rep"), (F.col("id") % max(1, each) * GATHERED).alias("low"))
    packed = stretches.mapInArrow(_packed(n, replicates), "block long, rep long, at binary")
    return packed.repartition("block").sortWithinPartitions("block")


def draws(spark, n: int, replicates: int) -> DataFrame:
    """(rep, conv_idx, w): how often each replicate draws each of ``n`` conversations; undrawn ones have no row."""

    def rows(block: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, rep = np.nonzero(counts)
        whole = pa.RecordBatch.from_arrays([pa.array(rep), pa.array(block * BLOCK + at), pa.array(counts[at, rep].astype(np.int64))], names=["rep", "conv_idx", "w"])
        yield from (whole.slice(low, 1 << 16) for low in range(0, whole.num_rows, 1 << 16))

    return _by_block(spark, n, replicates).mapInArrow(_counted(replicates, rows), "rep long, conv_idx long, w long")


def _weights(block: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(conv_idx, weights) of a block's drawn conversations, a byte for each replicate."""
    at = np.flatnonzero(counts.any(axis=1))
    if len(at) and counts.max() > 255:
        raise OverflowError("a replicate draws a conversation more than 255 times")
    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * counts.shape[1]).buffers()[1]
    lists = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(counts[at].astype(np.uint8))])
    yield pa.RecordBatch.from_arrays([pa.array(block * BLOCK + at), lists], names=["conv_idx", "weights"])


def _lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as an array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)


def drawn(facts: DataFrame, replicates: int) -> DataFrame:
    """(conversation_id, weights): how often each replicate draws each conversation, a byte for each; undrawn ones have no row.

    Written, so that the interval tables of an analysis may share it.
    """
    ids = numbered(facts)
    weights = _by_block(facts.sparkSession, ids.count(), replicates).mapInArrow(_counted(replicates, _weights), "conv_idx long, weights binary")
    return written(weights.join(ids.hint("merge"), "conv_idx").select("conversation_id", "weights"), "drawn")


class Sums:
    """Vectors summed by key, in order of the keys' first rows."""

    def __init__(self, by: list[str], schema: pa.Schema):
        self.by, self.schema, self.held = by, schema, {}

    def add(self, keys: pa.RecordBatch, rows: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """``rows(order, starts)`` gives the sums of the rows in that order between those starts."""
        n = keys.num_rows
        codes = pd.DataFrame(keys.to_pydict()).groupby(self.by, dropna=False, sort=False).ngroup().to_numpy() if self.by else np.zeros(n, dtype=np.int64)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        for key, vector in zip(self._keys(keys, order[starts]), rows(order, starts), strict=True):
            if key in self.held:
                self.held[key] += vector
            else:
                self.held[key] = vector.copy()

    def _keys(self, keys: pa.RecordBatch, at: np.ndarray) -> list[tuple]:
        return list(zip(*(keys.column(c).take(pa.array(at)).to_pylist() for c in self.by), strict=True)) if self.by else [()]

    def batch(self, leave: int = 0) -> pa.RecordBatch | None:
        """The sums, all but those of the last ``leave`` keys, which stay."""
        out = list(self.held)[: len(self.held) - leave]
        if not out:
            return None
        vectors = _lists(np.stack([self.held.pop(k) for k in out]))
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in out], self.schema.field(c).type) for i, c in enumerate(self.by)), vectors], names=[*self.by, "sums"])


def group_sums(rows: DataFrame, by: list[str], names: list[str], lists: DataFrame, replicates: int) -> DataFrame:
    """(by..., sums): for each group, replicate by replicate, the drawn rows, then of each metric the weighted sum and the weight of its rows.

    A row meets its conversation's weights once and is never repeated. Tasks sum the vectors of their rows by group before the
    shuffle, so a group sends one vector a task (or a few, if a task has many groups), however many rows it has.
    """
    width = replicates * (1 + 2 * len(names))
    most = max(64, HELD // (8 * width))
    weights = F.coalesce("weights", F.lit(bytes(replicates))).alias("weights")
    joined = rows.select("conversation_id", *by, *(F.col(m).cast("double").alias(m) for m in names)).join(lists.hint("merge"), "conversation_id", "left").select(*by, *names, weights)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            sums = sums or Sums(by, batch.schema)
            w = _bytes(batch.column("weights"))[0].reshape(batch.num_rows, -1).astype(np.float64) if batch.num_rows else np.zeros((0, replicates))
            x = [batch.column(m).to_numpy(zero_copy_only=False) for m in names]

            def added(order: np.ndarray, starts: np.ndarray, w=w, x=x) -> np.ndarray:
                parts = [w]
                for v in x:
                    parts += [w * np.nan_to_num(v)[:, None], w * ~np.isnan(v)[:, None]]
                return np.concatenate([np.add.reduceat(p[order], starts, axis=0) for p in parts], axis=1)

            if batch.num_rows:
                sums.add(batch.select(by), added)
            if len(sums.held) > most:
                yield sums.batch()
        if sums and (out := sums.batch()) is not None:
            yield out

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            sums = sums or Sums(by, batch.schema)
            v = _matrix(batch.column("sums"))
            if batch.num_rows:
                sums.add(batch.select(by), lambda order, starts, v=v: np.add.reduceat(v[order], starts, axis=0))
            if (out := sums.batch(leave=1)) is not None:
                yield out
        if sums and (out := sums.batch()) is not None:
            yield out

    schema = T.StructType([*(joined.schema[c] for c in by), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    parts = joined.mapInArrow(first, schema)
    parts = parts.repartition(*by).sortWithinPartitions(*by) if by else parts.repartition(1)
    return parts.mapInArrow(second, schema)


def _split(sums: np.ndarray, metrics: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes (row, replicate) and means (metric, row, replicate) of vectors of ``group_sums``; a mean of nothing is not a number."""
    parts = sums.reshape(len(sums), 1 + 2 * metrics, -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        means = parts[:, 1::2] / parts[:, 2::2]
    return parts[:, 0], means.transpose(1, 0, 2)


def _intervals(keys: pd.DataFrame, measures: dict[str, np.ndarray]) -> pd.DataFrame:
    """Rows (keys..., measure, ci_lower, ci_upper, ci_mean, n_valid) of arrays (row, replicate); those without a valid replicate have none."""
    out = []
    for name, x in measures.items():
        n = (~np.isnan(x)).sum(axis=1)
        some = np.flatnonzero(n)
        x = x[some]
        whole = (n[some] == x.shape[1]).all()
        low, high = (np.percentile if whole else np.nanpercentile)(x, [100 * LOW, 100 * HIGH], axis=1) if len(some) else np.zeros((2, 0))
        out.append(keys.iloc[some].assign(measure=name, ci_lower=low, ci_upper=high, ci_mean=np.nanmean(x, axis=1) if len(some) else low, n_valid=n[some].astype(np.int64)))
    return pd.concat(out)


def _parted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros_like(a), where=b != 0)


def _interval_schema(table: DataFrame, by: list[str]) -> T.StructType:
    rest = [T.StructField("measure", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("ci_lower", "ci_upper", "ci_mean")), T.StructField("n_valid", T.LongType())]
    return T.StructType([*(table.schema[c] for c in by), *rest])


def _sums_by(level: str, facts: DataFrame, scores: DataFrame, replicates: int, lists: DataFrame | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Written sums of the cells of a level (model-cluster, cluster or none) and of each model, from triples that are written once."""
    names = metric_names(scores)
    lists = lists if lists is not None else drawn(facts, replicates)
    triples = written(scored_triples(facts, scores), "triples")
    models = written(group_sums(pairs_of(triples, names), ["model"], names, lists, replicates), "model-sums")
    by = {"model-cluster": ["cluster", "model"], "cluster": ["cluster"]}.get(level)
    cells = written(group_sums(triples.where(in_cluster()), by, names, lists, replicates), "cell-sums") if by else models
    discard(triples)
    return cells, models, names


def _whole(models: DataFrame) -> DataFrame:
    """(all): the vector of all rows, from those of the models."""
    summed = F.aggregate(F.collect_list(F.struct("dim", "x")), F.lit(0.0), lambda a, p: a + p["x"])
    by_place = models.select(F.posexplode("sums").alias("dim", "x")).groupBy("dim").agg(summed.alias("x"))
    return by_place.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("all"))


def model_cluster_intervals(facts: DataFrame, scores: DataFrame, replicates: int = 100, lists: DataFrame | None = None) -> DataFrame:
    """Intervals of proportion, proportion_delta, quality_* and quality_delta_* of every model and cluster, absent pairs too.

    Every cluster meets all models, a broadcast list of as many rows as there are models, and is finished in one task.
    """
    cells, models, names = _sums_by("model-cluster", facts, scores, replicates, lists)
    of = models.select("model", F.col("sums").alias("model_sums"))
    dense = cells.select("cluster").distinct().crossJoin(F.broadcast(of)).join(cells, ["cluster", "model"], "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(rows["model_sums"].to_numpy())
        c = np.stack([s if s is not None else np.zeros(m.shape[1]) for s in rows["sums"]])
        (size, means), (model_size, model_means) = _split(c, len(names)), _split(m, len(names))
        share = _parted(size, model_size)
        others = (share.sum(axis=0) - share) / (len(share) - 1) if len(share) > 1 else 0.0
        measures = {"proportion": share, "proportion_delta": share - others}
        measures |= {f"quality_{n}": means[i] for i, n in enumerate(names)} | {f"quality_delta_{n}": means[i] - model_means[i] for i, n in enumerate(names)}
        return _intervals(rows[["model", "cluster"]], measures)

    return dense.groupBy("cluster").applyInPandas(run, _interval_schema(dense, ["model", "cluster"]))


def model_intervals(facts: DataFrame, scores: DataFrame, replicates: int = 100, lists: DataFrame | None = None) -> DataFrame:
    """Intervals of each model's quality and of its distance from all rows."""
    _, models, names = _sums_by("none", facts, scores, replicates, lists)
    rows = models.crossJoin(F.broadcast(_whole(models)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            if len(some):
                (_, means), (_, all_means) = (_split(np.stack(some[c].to_numpy()), len(names)) for c in ("sums", "all"))
                yield _intervals(some[["model"]], {f"quality_{n}": means[i] for i, n in enumerate(names)} | {f"quality_delta_{n}": means[i] - all_means[i] for i, n in enumerate(names)})

    return rows.mapInPandas(run, _interval_schema(rows, ["model"]))


def cluster_intervals(facts: DataFrame, scores: DataFrame, replicates: int = 100, lists: DataFrame | None = None) -> DataFrame:
    """Intervals of each cluster's proportion and quality over all models."""
    cells, models, names = _sums_by("cluster", facts, scores, replicates, lists)
    rows = cells.crossJoin(F.broadcast(_whole(models)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            if len(some):
                (size, means), (all_size, all_means) = (_split(np.stack(some[c].to_numpy()), len(names)) for c in ("sums", "all"))
                measures = {"proportion": _parted(size, all_size)}
                measures |= {f"quality_{n}": means[i] for i, n in enumerate(names)} | {f"quality_delta_{n}": means[i] - all_means[i] for i, n in enumerate(names)}
                yield _intervals(some[["cluster"]], measures)

    return rows.mapInPandas(run, _interval_schema(rows, ["cluster"]))


def attached(cells: DataFrame, ci: DataFrame, by: list[str], overwrite: bool = False) -> DataFrame:
    """Point metrics with *_ci_lower, *_ci_upper, *_ci_mean and, for deltas, *_significant; ``overwrite`` puts the means in place of the points."""
    measures = [c for c in cells.columns if c.startswith(("proportion", "quality"))]
    wide = ci.groupBy(*by).pivot("measure", measures).agg(F.first("ci_lower").alias("ci_lower"), F.first("ci_upper").alias("ci_upper"), F.first("ci_mean").alias("ci_mean"))
    out = cells.join(wide, by, "left")
    for m in measures:
        if "delta" in m:
            excludes = ~((F.col(f"{m}_ci_lower") <= 0) & (F.col(f"{m}_ci_upper") >= 0))
            out = out.withColumn(f"{m}_significant", excludes)
        if overwrite:
            out = out.withColumn(m, F.col(f"{m}_ci_mean"))
    return out
