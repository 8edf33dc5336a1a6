"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated at random and split into blocks of a few dimensions. If the squared distance of two vectors is at
most the budget, then in some block it is at most the block's proportional share; so a range join of each block under its
share finds every pair. A block's vectors are dealt to slabs along its first dimension, twice as wide as the block's radius:
partners lie in the same or in adjacent slabs, and each vector is sent to its own slab and, as a guest, to the one before if
it lies within a radius of it. Within a slab the block distances select candidates, which whole vectors verify in double
precision. A pair that several blocks find counts only in the first. Slabs give counts and a spanning forest of links, so a
large group of close vectors is never written out as pairs; equal vectors are one to begin with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumentrace.llm.common import NULL_ID, discard, with_ids, written
from lumentrace.llm.components import components

BLOCKS = 4
#: Vectors of a slab that one task compares with each other, and pairs that it looks at in one step.
TILE, PAIRS = 16384, 1 << 21
CELL = "size int, cell long, guest boolean, vid long, copies int, v binary"
#: Slack of squared distances for the single-precision product, and for sums in double precision.
SLACK, EPSILON = 1e-4, 1e-9


def rotation(size: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))[0]


def edges(size: int) -> np.ndarray:
    """Where the blocks begin, and the end."""
    return np.linspace(0, size, min(BLOCKS, size) + 1).astype(int)


def shares(size: int, budget: float) -> np.ndarray:
    return (budget + EPSILON) * np.diff(edges(size)) / size


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision from the vectors as they are stored."""
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def dealt(rows: pd.DataFrame, kind: str, budget: float) -> pd.DataFrame:
    """Rows of vectors of one size at their own slabs and, as guests, at the ones before."""
    v = units(rows["v"].tolist(), kind)
    at, size = edges(v.shape[1]), v.shape[1]
    place = (v @ rotation(size)[:, at[:-1]]) / (2 * np.sqrt(shares(size, budget)) + SLACK)
    out = []
    for b in range(len(at) - 1):
        own = np.floor(place[:, b]).astype(np.int64)
        # a guest can only meet vectors of the slab before within half its width
        near = np.flatnonzero(place[:, b] - own <= 0.5 + SLACK)
        out += [rows.assign(cell=own * BLOCKS + b, guest=False), rows.iloc[near].assign(cell=(own[near] - 1) * BLOCKS + b, guest=True)]
    return pd.concat(out)[[c.split()[0] for c in CELL.split(", ")]]


def at_cells(classes: DataFrame, kind: str, budget: float, only_places: bool = False) -> DataFrame:
    names = ["size", "cell", "guest"] if only_places else [c.split()[0] for c in CELL.split(", ")]
    schema = ", ".join(c for c in CELL.split(", ") if c.split()[0] in names)

    def run(parts):
        for rows in parts:
            for _, same in rows.groupby("size"):
                yield dealt(same, kind, budget)[names]

    return classes.mapInPandas(run, schema)


def tile(own: Column, other: Column) -> Column:
    """The number of a pair of chunks, whichever comes first; a slab may have up to 2**31 of them."""
    return F.least(own, other).cast("long") * (1 << 32) + F.greatest(own, other)


class Forest:
    """Union-find over the members of a tile."""

    def __init__(self, size: int):
        self.parent, self.links = np.arange(size), []

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Take up the links (i, j), which need not be all new."""
        while len(i):
            root = self.roots()
            a, b = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            apart = np.flatnonzero(a != b)
            # of the links that would hang the same tree up, one is taken at a time
            b, lead = np.unique(b[apart], return_index=True)
            taken = apart[lead]
            self.parent[b] = a[taken]
            self.links += zip(i[taken].tolist(), j[taken].tolist(), strict=True)
            i, j = i[apart], j[apart]


def cell_links(group: pd.DataFrame, kind: str, budget: float, least: float) -> pd.DataFrame:
    """Links within one tile of a slab: counts of links of each vector, and a spanning forest (a, b)."""
    block = int(group["cell"].iloc[0]) % BLOCKS
    v = units(group["v"].tolist(), kind)
    size = v.shape[1]
    turned = v @ rotation(size)
    at, share = edges(size), shares(size, budget)
    vid, copies = group["vid"].to_numpy(), group["copies"].to_numpy(dtype=np.int64)
    host, side = ~group["guest"].to_numpy(), group["side"].to_numpy().astype(np.int8)
    # pairs of two members of the slab, or of a member and a guest; with two sides only pairs across them
    left, right = (np.flatnonzero(host & (side == 0)), np.arange(len(v))) if (side == 0).all() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    counts, forest = np.zeros(len(v), dtype=np.int64), Forest(len(v))

    def within(i: np.ndarray, j: np.ndarray, b: int) -> np.ndarray:
        """Whether block b finds the pairs; the same two vectors give the same answer in every tile."""
        return ((turned[i, at[b] : at[b + 1]] - turned[j, at[b] : at[b + 1]]) ** 2).sum(axis=1) <= share[b]

    # with its squared length and a one beside each vector, one product gives distance less share
    own = turned[:, at[block] : at[block + 1]].astype(np.float32)
    length, one = (own**2).sum(axis=1, keepdims=True), np.ones((len(v), 1), dtype=np.float32)
    rights, lefts = np.hstack([own, one, length - np.float32(share[block] + SLACK)])[right].T.copy(), np.hstack([-2 * own, length, one])
    step = max(1, PAIRS // max(1, len(right)))
    for low in range(0, len(left), step):
        rows = left[low : low + step]
        i, j = np.divmod(np.flatnonzero(lefts[rows] @ rights <= 0), len(right))
        i, j = rows[i], right[j]
        meet = (host[i] | host[j]) & (i != j) & ((i < j) | ~host[j] | (side[i] != side[j]))
        i, j = i[meet], j[meet]
        for k in range(0, len(i), 65536):
            p, q = i[k : k + 65536], j[k : k + 65536]
            good = within(p, q, block)
            for b in range(block):
                good[good] = ~within(p[good], q[good], b)
            good[good] = (v[p[good]] * v[q[good]]).sum(axis=1) >= least
            p, q = p[good], q[good]
            counts += np.bincount(p, copies[q], len(v)).astype(np.int64) + np.bincount(q, copies[p], len(v)).astype(np.int64)
            forest.join(p, q)
    some = np.flatnonzero(counts)
    single = pd.DataFrame({"a": vid[some], "b": pd.array([None] * len(some), dtype="Int64"), "links": counts[some]})
    if not forest.links:
        return single
    p, q = np.array(forest.links).T
    pairs = pd.DataFrame({"a": vid[p], "b": pd.array(vid[q], dtype="Int64"), "links": 0})
    return pd.concat([single, pairs])


def stored_vectors(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, v) with the components as bytes, null for vectors that link with nothing, and the kind of the numbers."""
    kind = "<f4" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "<f8"

    def run(parts):
        for rows in parts:
            out = []
            for x in rows["embedding"]:
                y = np.array([np.nan if z is None else z for z in x] if x is not None else [], dtype=kind)
                out.append(y.tobytes() if len(y) and np.isfinite(y).all() and y.any() else None)
            yield pd.DataFrame({"vec_id": rows["vec_id"], "v": out})

    own = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    return own.mapInPandas(run, "vec_id long, v binary"), kind


def grouped(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector (vec_id, embedding).

    Vectors are linked when their cosine, in double precision, is at least ``least``. Null, empty and zero vectors, and ones
    with null or non-finite components, are linked with nothing; vectors of different sizes are never linked. n_links
    counts other vectors linked directly; component_id is the smallest vec_id reachable. A null vec_id counts as smaller
    than all others; rows that repeat a vec_id are rows of their own, linked by what each of them holds. Other columns are
    not read. An empty table gives an empty result.
    """
    budget = 2 - 2 * least
    raw, kind = stored_vectors(vectors)
    table = written(raw, "raw-vectors")
    classes = table.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").cast("int").alias("copies"))
    classes = written(classes.withColumns({"size": F.length("v"), "vid": F.col("least")}), "vectors")
    if not classes.groupBy("least").count().where("count > 1").isEmpty():
        # different vectors share an id or have none: they go by numbers in order of their ids
        numbered = classes.repartitionByRange("least", "v").sortWithinPartitions("least", "v").withColumn("vid", F.monotonically_increasing_id())
        classes = written(numbered, "vectors")
    # A block has at most 1 / radius + 2 slabs, as unit vectors lie within 1 of the origin: few enough to broadcast.
    places = at_cells(classes, kind, budget, only_places=True)
    count = places.groupBy("size", "cell").agg(F.count("*").alias("n"), F.sum((~F.col("guest")).cast("int")).alias("hosts")).where("hosts > 0 and n > 1")
    # a slab with many vectors is compared in pairs of chunks
    parts = at_cells(classes, kind, budget).join(F.broadcast(count), ["size", "cell"]).withColumn("chunks", F.ceil(F.col("n") / TILE).cast("int"))
    parts = parts.withColumn("own", F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    parts = parts.select("cell", "size", "guest", "vid", "copies", "v", tile(F.col("own"), F.col("other")).alias("tile"), (F.col("own") > F.col("other")).alias("side"))
    found = parts.groupBy("size", "cell", "tile").applyInPandas(lambda g: cell_links(g, kind, budget, least), "a long, b long, links long")
    found = written(found, "vector-links")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "vid")
    forest = written(components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "vid"), "groups")
    top = classes.select(F.col("vid").alias("component"), F.col("least").alias("top"))
    group = forest.join(top, "component").select("vid", "top")
    of_class = written(classes.join(links, "vid", "left").join(group, "vid", "left"), "of-class")
    discard(classes, found, forest)
    out = table.join(of_class, "v", "left")
    n_links = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    out = out.select("vec_id", n_links.cast("long").alias("n_links"), F.coalesce("top", "least", "vec_id").alias("component_id"))
    return with_ids(out.withColumn("kept", F.col("vec_id") == F.col("component_id")), "vec_id", "component_id")
