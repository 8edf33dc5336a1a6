"""Vectors and text clusters.

Density clusters are found by blocks of points that lie close together, and pairs of them: core distances from the nearest
neighbours, then the minimum spanning tree under mutual reachability from the trees of blocks and pairs, since an edge that
is not in the tree of some pair is the longest of a circle and in no tree of the whole. Borůvka's rounds over these edges
give the tree of the whole (``spanning``). A pair is left out where the boxes or balls around its blocks are so far apart that
it can change nothing: beyond the neighbours that its points have, or not nearer than the longest edge on a way that
already joins the two. So work follows the number of blocks where places are spread in few dimensions and grows with its square
where all blocks lie near all others. Tasks compare the points of two blocks, or one row for each block of a stratum; only the
tree, which has one edge less than the stratum has values, is walked in one task for each stratum.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumentrace.operators import spanning
from lumentrace.session import discard, written
from lumentrace.sources import loaders

#: Values of a block; a task compares those of two blocks.
BLOCK = 1500
#: Places of a block's size from which the cuts between blocks are made, and how often one lies half way, not at the median.
PLACES, HALVES = 64, 64
#: Bytes of vectors that are broadcast at a time, and products that a task makes in one step.
BROADCAST, PRODUCTS = 32 << 20, 1 << 22
PAIRS = "sid long, t long, u long, span double"


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def standardised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, dim, z): each dimension with mean 0 and population deviation 1, slightly damped; one aggregation by dimension."""
    long = vectors.select(key, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    stats = long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return long.join(F.broadcast(stats), "dim").select(key, "dim", ((F.col("x") - F.col("mean")) / (F.col("sd") + 1e-8)).alias("z"))


def mean_vectors(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, vector): the mean of all vectors of each label."""
    means = vectors.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias(vector))


def _packed(lists: pa.Array, size: int) -> np.ndarray:
    """Unit vectors of lists of ``size`` numbers; those of other lists, and of ones that are null, zero or not finite, are not numbers."""
    out = np.full((len(lists), size), np.nan)
    fit = pc.fill_null(pc.equal(pc.list_value_length(lists), size), False)
    out[fit.to_numpy(zero_copy_only=False)] = lists.filter(fit).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.sqrt((out * out).sum(axis=1))[:, None]


def closest(fine: DataFrame, coarse: DataFrame, fine_id: str, coarse_id: str, most: int = 1, vector: str = "embedding", block_bytes: int = BROADCAST) -> DataFrame:
    """(fine_id, near): for each fine id the ``most`` coarse rows of the largest cosines, as structs (away, coarse_id), nearest first.

    ``away`` is the negative cosine, rounded to nine digits; equal ones stand in order of the coarse id, whatever its type. A
    pair without a cosine has 2, which is farther than any can be. Coarse vectors are packed into matrices of at most
    ``block_bytes``, one after the other broadcast to all fine rows, which take products in Arrow batches; what each matrix
    finds is combined at the end, so neither side needs to fit in a task.
    """
    spark = fine.sparkSession
    fine = fine.select(F.col(fine_id), F.col(vector).cast("array<double>").alias("_v"))
    held = written(loaders.indexed(coarse.select(F.col(coarse_id), F.col(vector).cast("array<double>").alias("_v")), coarse_id), "coarse")
    n, size = held.agg(F.count("*"), F.max(F.size("_v"))).first()
    per = max(1, block_bytes // (8 * max(1, size or 1)))
    schema = T.StructType([fine.schema[fine_id], T.StructField("away", T.DoubleType()), held.schema[coarse_id]])
    found = spark.createDataFrame([], schema)
    for low in range(0, n, per):
        block = held.where(F.col("row_idx").between(low, low + per - 1)).orderBy("row_idx").select(coarse_id, "_v").toArrow().combine_chunks()
        ids = block.column(coarse_id).combine_chunks()
        shared = spark.sparkContext.broadcast((ids, _packed(block.column("_v").combine_chunks(), size or 1)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for batch in batches:
                step = max(1, PRODUCTS // len(matrix))
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    away = -np.round(_packed(some.column("_v"), matrix.shape[1]) @ matrix.T, 9)
                    away[~np.isfinite(away)] = 2.0
                    k = min(most, len(matrix))
                    best = away.argmin(axis=1)[:, None] if k == 1 else np.argsort(away, axis=1, kind="stable")[:, :k]
                    of = np.repeat(np.arange(some.num_rows), k)
                    yield pa.RecordBatch.from_arrays([some.column(fine_id).take(pa.array(of)), pa.array(np.take_along_axis(away, best, axis=1).ravel() + 0.0), ids.take(pa.array(best.ravel()))], names=schema.names)

        found = found.unionByName(fine.mapInArrow(run, schema))
    pair = F.struct("away", coarse_id)
    if most == 1:
        return found.groupBy(fine_id).agg(F.array(F.min(pair)).alias("near"))
    return found.groupBy(fine_id).agg(F.slice(F.array_sort(F.collect_set(pair)), 1, most).alias("near"))


def nearest(fine: DataFrame, coarse: DataFrame, fine_id: str, coarse_id: str, vector: str = "embedding", block_bytes: int = BROADCAST) -> DataFrame:
    """The coarse row of the largest cosine for each fine row, ties to the smaller id, whatever the type of the ids.

    A fine row that has no cosine with any (null, zero or not finite) gets the smallest id and no cosine.
    """
    best = closest(fine, coarse, fine_id, coarse_id, 1, vector, block_bytes)
    away = F.col("near")[0]["away"]
    return best.select(fine_id, F.col("near")[0][coarse_id].alias(coarse_id), F.when(away <= 1.5, -away).alias("cosine"))


def components_rule(n: int, d: int) -> int:
    """How many principal components to keep of n vectors of d dimensions; 0 keeps the vectors."""
    return min(100, d - 1, n - 1) if n >= 100 and (n > 5000 or d > 200) else 0


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0))


def nearest_distances(x: np.ndarray, y: np.ndarray, k: int, same: bool) -> np.ndarray:
    """The k least distances of each row of x to those of y, ascending; ``same`` if they are one block, a row not counting for itself."""
    out = []
    for low in range(0, len(x), 256):
        away = distances(x[low : low + 256], y)
        if same:
            away[np.arange(len(away)), low + np.arange(len(away))] = np.inf
        out.append(np.sort(np.partition(away, min(k, away.shape[1]) - 1, axis=1)[:, :k], axis=1))
    return np.concatenate(out)


def mutual_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, distance) of a minimum spanning tree under mutual reachability (Prim)."""
    n = len(x)
    square = (x * x).sum(axis=1)
    best, source, out = np.full(n, np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=bool)
    a, b, d, at = np.zeros(n - 1, dtype=int), np.zeros(n - 1, dtype=int), np.zeros(n - 1), 0
    out[0] = True
    for k in range(n - 1):
        away = np.sqrt(np.maximum(square + square[at] - 2 * (x @ x[at]), 0))
        reach = np.maximum(np.maximum(away, core), core[at])
        closer = ~out & (reach < best)
        best[closer], source[closer] = reach[closer], at
        at = int(np.argmin(np.where(out, np.inf, best)))
        out[at] = True
        a[k], b[k], d[k] = source[at], at, best[at]
    return a, b, d


def shortest_tree(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the edges make the minimum spanning forest, shortest first (Kruskal); ties by their ends."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = ends[: len(a)].tolist(), ends[len(a) :].tolist()
    parent, out = list(range(len(names))), []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for k in np.lexsort((np.maximum(a, b), np.minimum(a, b), d)).tolist():
        x, y = find(p[k]), find(q[k])
        if x != y:
            parent[y] = x
            out.append(k)
    return np.array(out, dtype=int)


def tree_clusters(n: int, edges: list[tuple[int, int, float]], min_cluster_size: int, epsilon: float = 0.0) -> np.ndarray:
    """HDBSCAN* labels with excess of mass from the tree's edges, shortest first; -1 is noise.

    The hierarchy of the mutual-reachability tree is walked from the top. A split into two parts of at least
    ``min_cluster_size`` makes two clusters; smaller parts fall out as noise. A cluster is chosen if it is more stable than
    its descendants together. One that splits off at a distance below ``epsilon`` is given up for the nearest ancestor that
    splits off above it, or for the highest below the root, so clusters closer than that stay together.
    """
    if n <= min_cluster_size:
        return np.full(n, -1)
    parent, node, size = list(range(n)), list(range(n)), [1] * n
    left, right, height, weight = [0] * n, [0] * n, [0.0] * n, [1] * n

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b, d in edges:
        p, q = find(int(a)), find(int(b))
        left.append(node[p]), right.append(node[q]), height.append(float(d)), weight.append(size[p] + size[q])
        parent[q], size[p], node[p] = p, size[p] + size[q], len(left) - 1

    def leaves(v: int) -> list[int]:
        out, todo = [], [v]
        while todo:
            u = todo.pop()
            out += [u] if u < n else []
            todo += [] if u < n else [left[u], right[u]]
        return out

    # clusters: birth density, stability, children, dendrogram node
    birth, stable, children, top = [0.0], [0.0], [[]], [len(left) - 1]
    todo = [(len(left) - 1, 0)]
    while todo:
        v, c = todo.pop()
        if v < n:
            continue
        density = 1 / max(height[v], 1e-12)
        big = [u for u in (left[v], right[v]) if weight[u] >= min_cluster_size]
        if len(big) == 2:
            stable[c] += weight[v] * (density - birth[c])
            for u in big:
                children[c].append(len(birth))
                birth.append(density), stable.append(0.0), children.append([]), top.append(u)
                todo.append((u, len(birth) - 1))
        else:
            gone = weight[v] - sum(weight[u] for u in big)
            stable[c] += gone * (density - birth[c])
            todo += [(u, c) for u in big]
    chosen = [False] * len(birth)
    value = stable[:]
    for c in range(len(birth) - 1, -1, -1):
        below = sum(value[k] for k in children[c])
        if c and stable[c] >= below:
            chosen[c] = True
        else:
            value[c] = below
    if epsilon > 0:
        above = {k: c for c, below in enumerate(children) for k in below}
        for c in [c for c, one in enumerate(chosen) if one]:
            chosen[c] = False
            while above[c] and birth[c] * epsilon > 1:
                c = above[c]
            chosen[c] = True
    labels, todo, found = np.full(n, -1), [0], []
    while todo:
        c = todo.pop()
        if chosen[c]:
            found.append(c)
        else:
            todo += children[c]
    for label, c in enumerate(sorted(found, key=lambda c: min(leaves(top[c])))):
        # members that fell out at lower densities than the cluster's birth are not below its node
        labels[leaves(top[c])] = label
    return labels


def _moments(points: DataFrame) -> DataFrame:
    """(sid, mean, sd, basis): what standardises each stratum's vectors and, by the components rule, projects them."""

    def parts(batches):
        seen: dict = {}
        for rows in batches:
            for sid, some in rows.groupby("sid"):
                x = np.stack(some["x"].to_numpy()).astype(np.float64)
                n, total, cross = seen.get(sid, (0, 0.0, 0.0))
                seen[sid] = n + len(x), total + x.sum(axis=0), cross + x.T @ x
        for sid, (n, total, cross) in seen.items():
            yield pd.DataFrame({"sid": [sid], "n": [n], "total": [total.tolist()], "cross": [cross.ravel().tolist()]})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        n, total = int(rows["n"].sum()), np.stack(rows["total"].to_numpy()).sum(axis=0)
        d = len(total)
        mean = total / n
        cov = np.stack(rows["cross"].to_numpy()).sum(axis=0).reshape(d, d) / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-8 if n > 1 else np.ones(d)
        mean = mean if n > 1 else np.zeros(d)
        keep, basis = components_rule(n, d), np.zeros((d, 0))
        if keep:
            basis = np.linalg.eigh(cov / np.outer(sd, sd))[1][:, ::-1][:, :keep]
        return pd.DataFrame({"sid": [rows["sid"].iloc[0]], "mean": [mean.tolist()], "sd": [sd.tolist()], "basis": [basis.ravel().tolist()]})

    sums = points.select("sid", "x").mapInPandas(parts, "sid long, n long, total array<double>, cross array<double>")
    return sums.groupBy("sid").applyInPandas(whole, "sid long, mean array<double>, sd array<double>, basis array<double>")


def _scaled(key: tuple, rows: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
    if not len(rows):
        return rows
    x = (np.stack(rows["x"].to_numpy()).astype(np.float64) - by["mean"].iloc[0]) / by["sd"].iloc[0]
    if len(basis := by["basis"].iloc[0]):
        x = x @ np.asarray(basis).reshape(x.shape[1], -1)
    return rows.assign(x=list(x))


def _pair_cores(g: pd.DataFrame) -> pd.DataFrame:
    """Nearest distances to another block of the points that reach as far as that (``span``)."""
    x, vid, k = np.stack(g["x"].to_numpy()), g["vid"].to_numpy(), int(g["k"].iloc[0])
    a, far = (g["blk"] == g["t"]).to_numpy(), (g["reach"] > g["span"]).to_numpy()
    sides = [(p, q) for p, q in ((a & far, ~a), (~a & far, a)) if p.any() and q.any()]
    near = [row for p, q in sides for row in nearest_distances(x[p], x[q], k, False)]
    return pd.DataFrame({"vid": np.concatenate([vid[p] for p, _ in sides]) if sides else vid[:0], "near": near})


def _tile_tree(g: pd.DataFrame) -> pd.DataFrame:
    vid = g["vid"].to_numpy()
    a, b, d = mutual_tree(np.stack(g["x"].to_numpy()), g["core"].to_numpy())
    return pd.DataFrame({"sid": g["sid"].iloc[0], "a": vid[a], "b": vid[b], "d": d})


def _kept_edges(g: pd.DataFrame) -> pd.DataFrame:
    return g.iloc[shortest_tree(*(g[c].to_numpy() for c in "pqd"))][["sid", "a", "b", "d"]]


def cuts(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree (dim, at, below, above) of cuts across the widest dimension until a part has at most ``most`` places; leaves have dim -1."""
    dim, at, below, above, todo = [-1], [0.0], [0], [0], [(0, np.arange(len(x)), 0)]
    while todo:
        node, some, depth = todo.pop()
        if len(some) <= most:
            continue
        y = x[some]
        low, high = y.min(axis=0), y.max(axis=0)
        k = int(np.argmax(high - low))
        cut = low[k] / 2 + high[k] / 2 if depth < HALVES else np.median(y[:, k])
        under = y[:, k] <= cut
        if under.all() or not under.any():
            continue
        dim[node], at[node], below[node], above[node] = k, float(cut), len(dim), len(dim) + 1
        todo += [(len(dim), some[under], depth + 1), (len(dim) + 1, some[~under], depth + 1)]
        dim, at, below, above = dim + [-1, -1], at + [0.0, 0.0], below + [0, 0], above + [0, 0]
    return np.array(dim), np.array(at), np.array(below), np.array(above)


def leaves_of(x: np.ndarray, dim: np.ndarray, at: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The leaf of the tree of cuts that each place is in."""
    node = np.zeros(len(x), dtype=np.int64)
    live = np.flatnonzero(dim[node] >= 0)
    while len(live):
        on = node[live]
        node[live] = np.where(x[live, dim[on]] <= at[on], below[on], above[on])
        live = live[dim[node[live]] >= 0]
    return node


def _placed(key: tuple, rows: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(by):
        return rows
    tree = [np.asarray(by[c].iloc[0]) for c in ("dim", "at", "below", "above")]
    return rows.assign(blk=leaves_of(np.stack(rows["x"].to_numpy()), *tree))


def by_place(points: DataFrame, block: int) -> DataFrame:
    """Points with blocks of at most about ``block`` points by place, where there are several.

    The cuts are made from some of the points, which only decides how even the blocks are; a part that comes out larger is dealt
    into several blocks by a hash.
    """
    one_in = max(1, block // PLACES)
    most = max(1, int(0.8 * block / one_in))
    some = points.where((F.col("blocks") > 1) & (F.pmod(F.xxhash64("vid", F.lit("place")), F.lit(one_in)) == 0)).select("sid", "blocks", "x")

    def tree(g: pd.DataFrame) -> pd.DataFrame:
        dim, at, below, above = cuts(np.stack(g["x"].to_numpy()), most)
        return pd.DataFrame({"sid": [g["sid"].iloc[0]], "blocks": [g["blocks"].iloc[0]], "dim": [dim.tolist()], "at": [at.tolist()], "below": [below.tolist()], "above": [above.tolist()]})

    trees = some.groupBy("sid").applyInPandas(tree, "sid long, blocks int, dim array<int>, at array<double>, below array<int>, above array<int>")
    trees = trees.withColumn("blk", F.explode(F.expr("sequence(0, blocks - 1)")))
    held = written(points.groupBy("sid", "blk").cogroup(trees.groupBy("sid", "blk")).applyInPandas(_placed, points.schema), "placed")
    parts = held.groupBy("sid", "blk").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = F.shiftleft(F.col("blk").cast("long"), 32) + F.pmod(F.xxhash64("vid"), F.col("parts"))
    out = written(held.join(F.broadcast(parts), ["sid", "blk"]).withColumn("blk", dealt).select(*points.columns), "points")
    discard(held)
    return out


def _inside(g: pd.DataFrame) -> pd.DataFrame:
    """Nearest distances within a block; ``reach`` is how far others may be to count."""
    x, k = np.stack(g["x"].to_numpy()), int(g["k"].iloc[0])
    near = nearest_distances(x, x, k, True)
    reach = near[:, k - 1] if near.shape[1] >= k else np.full(len(x), np.inf)
    return g.assign(near=list(near), reach=reach)


def _shape(g: pd.DataFrame) -> pd.DataFrame:
    """The box and the ball around a block."""
    x = np.stack(g["x"].to_numpy())
    centre = x.mean(axis=0)
    radius = np.sqrt(((x - centre) ** 2).sum(axis=1).max())
    return pd.DataFrame({"sid": [g["sid"].iloc[0]], "blk": [g["blk"].iloc[0]], "low": [x.min(axis=0).tolist()], "high": [x.max(axis=0).tolist()], "centre": [centre.tolist()], "radius": [radius]})


class _Shapes:
    """The blocks of a stratum, in order of their numbers."""

    def __init__(self, g: pd.DataFrame):
        g = g.sort_values("blk")
        self.blk = g["blk"].to_numpy()
        self.low, self.high, self.centre = (np.stack(g[c].to_numpy()) for c in ("low", "high", "centre"))
        self.radius = g["radius"].to_numpy()

    def apart(self, i: int, rest: np.ndarray) -> np.ndarray:
        """Distances below which no point of block i and of the others can be."""
        gap = np.maximum(np.maximum(self.low[rest] - self.high[i], self.low[i] - self.high[rest]), 0)
        far = np.sqrt(((self.centre[rest] - self.centre[i]) ** 2).sum(axis=1))
        return np.maximum(np.sqrt((gap * gap).sum(axis=1)), far * (1 - 1e-12) - (self.radius[rest] + self.radius[i]) * (1 + 1e-12))

    def pairs(self, sid: int, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        i = np.repeat([i for i, _, _ in found], [len(j) for _, j, _ in found]).astype(int)
        j, span = (np.concatenate([x[k] for x in found]) if found else np.zeros(0) for k in (1, 2))
        return pd.DataFrame({"sid": sid, "t": self.blk[np.minimum(i, j.astype(int))], "u": self.blk[np.maximum(i, j.astype(int))], "span": span})


def _near_pairs(g: pd.DataFrame) -> pd.DataFrame:
    """Pairs of blocks of which one may hold neighbours of the other's points."""
    shapes, reach, found = _Shapes(g), g.sort_values("blk")["reach"].to_numpy(), []
    for i in range(len(g)):
        rest = np.arange(i + 1, len(g))
        apart = shapes.apart(i, rest)
        near = apart < np.maximum(reach[i], reach[rest])
        found.append((i, rest[near], apart[near]))
    return shapes.pairs(g["sid"].iloc[0], found)


def _links(g: pd.DataFrame) -> pd.DataFrame:
    """Pairs of blocks that join all of a stratum by ways that promise to be short (Prim); blocks with long edges inside come last."""
    shapes, g = _Shapes(g), g.sort_values("blk")
    width, least, every = g["width"].to_numpy(), g["least"].to_numpy(), np.arange(len(g))
    best, source, out, at, found = np.full(len(g), np.inf), np.zeros(len(g), dtype=int), np.zeros(len(g), dtype=bool), 0, []
    out[0] = True
    for _ in range(len(g) - 1):
        away = np.maximum(np.maximum(shapes.apart(at, every), np.maximum(width, least)), max(width[at], least[at]))
        closer = ~out & ((away < best) | np.isinf(best))
        best[closer], source[closer] = away[closer], at
        at = int(np.argmin(np.where(out, np.inf, best))) if not np.isinf(best[~out]).all() else int(np.flatnonzero(~out)[0])
        out[at] = True
        found.append((int(source[at]), np.array([at]), np.maximum(width[at], width[source[at]])[None]))
    return shapes.pairs(g["sid"].iloc[0], found)


def _open_pairs(key: tuple, g: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Pairs of blocks that may hold an edge shorter than the longest of the way that ``links`` and the blocks' own trees make."""
    shapes, g = _Shapes(g), g.sort_values("blk")
    width, least = g["width"].to_numpy(), g["least"].to_numpy()
    ways: list[list[tuple[float, int]]] = [[] for _ in range(len(g))]
    t, u = (np.searchsorted(shapes.blk, links[c].to_numpy()) for c in "tu")
    for i, j, d in zip(t.tolist(), u.tolist(), np.maximum(np.maximum(width[t], width[u]), links["d"].to_numpy()).tolist(), strict=True):
        ways[i].append((d, j)), ways[j].append((d, i))
    # in the order in which Prim's algorithm reaches blocks, the longest step between two is the longest of the way
    order, steps, seen, todo = [], [], np.zeros(len(g), dtype=bool), [(0.0, 0)]
    while todo:
        d, i = heapq.heappop(todo)
        if seen[i]:
            continue
        seen[i] = True
        order.append(i), steps.append(d)
        for way in ways[i]:
            heapq.heappush(todo, way)
    place, longest, found = np.array(order), np.array(steps), []
    for p, i in enumerate(order[:-1]):
        rest, way = place[p + 1 :], np.maximum.accumulate(longest[p + 1 :])
        apart = np.maximum(np.maximum(shapes.apart(i, rest), least[rest]), least[i])
        some = rest[(way > apart) & ~np.isin(rest, [j for _, j in ways[i]])]
        found.append((i, some, np.maximum(width[some], width[i])))
    return shapes.pairs(key[0], found)


def spread(rows: DataFrame, groups: int, *keys: str) -> GroupedData:
    """Rows grouped by keys, in a partition for every few groups: bytes tell little of how long the groups take."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(most, -(-groups // 4))), *keys).groupBy(*keys)


def members(pairs: DataFrame, points: DataFrame) -> GroupedData:
    """The points of both blocks of each pair (sid, t, u), grouped by pair."""
    return spread(pairs.withColumn("blk", F.explode(F.array("t", "u"))).join(points, ["sid", "blk"]), pairs.count(), "sid", "t", "u")


def _block_tree(g: pd.DataFrame) -> pd.DataFrame:
    return _tile_tree(g).assign(blk=g["blk"].iloc[0])


def _cross_edges(g: pd.DataFrame) -> pd.DataFrame:
    """The edges between two blocks of the tree of both: the shortest only, if none inside them is longer (``span``)."""
    first, x, core, vid = (g["blk"] == g["t"]).to_numpy(), np.stack(g["x"].to_numpy()), g["core"].to_numpy(), g["vid"].to_numpy()
    a, b = np.flatnonzero(first), np.flatnonzero(~first)
    reach = np.maximum(np.maximum(distances(x[a], x[b]), core[a][:, None]), core[b][None, :])
    i, j = np.unravel_index(int(np.argmin(reach)), reach.shape)
    if reach[i, j] >= g["span"].iloc[0]:
        out = pd.DataFrame({"sid": g["sid"].iloc[:1].to_numpy(), "a": vid[a[i]], "b": vid[b[j]], "d": reach[i, j]})
    else:
        home = pd.Series(first, index=vid)
        out = _tile_tree(g)
        out = out[home.loc[out["a"]].to_numpy() != home.loc[out["b"]].to_numpy()]
    return out.assign(t=g["t"].iloc[0], u=g["u"].iloc[0])


def _labels(g: pd.DataFrame, min_cluster_size: int, epsilon: float) -> pd.DataFrame:
    """(vid, cluster) of a stratum from the edges of its tree."""
    g = g.sort_values(["d", "a", "b"])
    ids = np.unique(np.concatenate([g["a"].to_numpy(), g["b"].to_numpy()]))
    a, b = np.searchsorted(ids, g["a"].to_numpy()), np.searchsorted(ids, g["b"].to_numpy())
    return pd.DataFrame({"vid": ids, "cluster": tree_clusters(len(ids), list(zip(a.tolist(), b.tolist(), g["d"].tolist(), strict=True)), max(2, min_cluster_size), epsilon)})


def strata_trees(points: DataFrame, reduce_to: int = spanning.REDUCE) -> DataFrame:
    """(sid, a, b, d): the spanning tree of each stratum of points (sid, vid, x, k, blocks, blk), one edge less than points."""
    points = points.select("sid", "blk", "vid", "x", "k").withColumn("blk", F.col("blk").cast("long"))
    n = points.select("sid", "blk").distinct().count()
    near = written(spread(points, n, "sid", "blk").applyInPandas(_inside, "sid long, blk long, vid long, x array<double>, k int, near array<double>, reach double"), "near")
    shapes = near.groupBy("sid", "blk").applyInPandas(_shape, "sid long, blk long, low array<double>, high array<double>, centre array<double>, radius double")
    shapes = written(shapes.join(near.groupBy("sid", "blk").agg(F.max("reach").alias("reach")), ["sid", "blk"]), "shapes")
    pairs = written(shapes.groupBy("sid").applyInPandas(_near_pairs, PAIRS), "pairs")
    found = members(pairs, near.drop("near")).applyInPandas(_pair_cores, "vid long, near array<double>")
    core = near.select("vid", "near").unionByName(found).groupBy("vid").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    core = core.join(near.select("vid", "k"), "vid").select("vid", F.col("near")[F.col("k") - 1].alias("core"))
    points = written(near.select("sid", "blk", "vid", "x").join(core, "vid"), "cores")
    own = written(spread(points, n, "sid", "blk").applyInPandas(_block_tree, "sid long, a long, b long, d double, blk long"), "edges")
    facts = points.groupBy("sid", "blk").agg(F.min("core").alias("least")).join(own.groupBy("sid", "blk").agg(F.max("d").alias("width")), ["sid", "blk"], "left")
    blocks = written(shapes.join(facts.fillna(0.0, ["width"]), ["sid", "blk"]), "blocks")
    cross = "sid long, a long, b long, d double, t long, u long"
    joining = written(blocks.groupBy("sid").applyInPandas(_links, PAIRS), "pairs")
    first = written(members(joining, points).applyInPandas(_cross_edges, cross), "edges")
    ways = first.groupBy("sid", "t", "u").agg(F.min("d").alias("d"))
    unsure = written(blocks.groupBy("sid").cogroup(ways.groupBy("sid")).applyInPandas(_open_pairs, PAIRS), "pairs")
    rest = written(members(unsure, points).applyInPandas(_cross_edges, cross), "edges")
    edges = own.drop("blk").unionByName(first.drop("t", "u")).unionByName(rest.drop("t", "u"))
    tree = written(spanning.forest(edges, _kept_edges, reduce_to), "trees")
    discard(near, shapes, pairs, points, own, blocks, joining, first, unsure, rest)
    return tree


def prepared(values: DataFrame, min_samples: int = 1, scale: bool = True, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Written tables of the distinct values under numbers, and of their points (sid, vid, stratum, x, n, k, blocks, blk), which are scaled."""
    one = values.groupBy("stratum", "value").agg(F.first("embedding", ignorenulls=True).alias("x"))
    rows = written(loaders.indexed(one, "stratum", "value").withColumnRenamed("row_idx", "vid"), "values")
    strata = rows.where("x is not null").groupBy("stratum").agg(F.min("vid").alias("sid"), F.count("*").alias("n"))
    strata = strata.withColumns({"blocks": F.ceil(F.col("n") / block).cast("int"), "k": F.least(F.lit(min_samples), F.col("n") - 1).cast("int")})
    of = strata.withColumnRenamed("stratum", "_s")
    points = rows.where("x is not null").join(of, F.col("stratum").eqNullSafe(F.col("_s"))).where("n > 1")
    points = points.select("sid", "vid", "stratum", F.col("x").cast("array<double>").alias("x"), "n", "k", "blocks", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int").alias("blk"))
    if scale:
        by = _moments(points).join(strata.select("sid", "blocks"), "sid").withColumn("blk", F.explode(F.expr("sequence(0, blocks - 1)")))
        points = points.groupBy("sid", "blk").cogroup(by.groupBy("sid", "blk")).applyInPandas(_scaled, points.schema)
    return rows, by_place(points, block)


def cluster_strata(values: DataFrame, min_cluster_size: int, min_samples: int = 1, scale: bool = True, block: int = BLOCK, epsilon: float = 0.0, reduce_to: int = spanning.REDUCE) -> DataFrame:
    """(stratum, value, cluster): density clusters of each stratum's distinct values (stratum, value, embedding); -1 is noise.

    All values take part, whatever their number. Clusters are numbered from 0 in order of their first value. A null stratum
    is a stratum of its own; values without an embedding are noise. Clusters that are closer than ``epsilon`` stay together;
    it is a distance of the standardised vectors if they are scaled.
    """
    rows, points = prepared(values, min_samples, scale, block)
    tree = strata_trees(points, reduce_to)
    labels = written(tree.groupBy("sid").applyInPandas(lambda g: _labels(g, min_cluster_size, epsilon), "vid long, cluster long"), "labels")
    discard(points, tree)
    return rows.join(labels, "vid", "left").select("stratum", "value", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def taxonomy_assigned(properties: DataFrame, taxonomy: DataFrame, category: str = "category") -> DataFrame:
    """Properties with the taxonomy's (label, id) of their trimmed category; unknown ones are Other, whose id follows the others."""
    known = taxonomy.select(F.col("label").alias("_label"), F.col("id").alias("_id"))
    other = taxonomy.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("_other"))
    out = properties.join(known, F.trim(F.col(category)) == F.col("_label"), "left").crossJoin(F.broadcast(other))
    return out.withColumns({"cluster_label": F.coalesce("_label", F.lit("Other")), "cluster_id": F.coalesce("_id", "_other")}).drop("_label", "_id", "_other")


def merged_labels(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with the merged name of their label (label, merged), and ids in order of the merged names."""
    out = rows.join(names, "label", "left").withColumn("label", F.coalesce("merged", "label")).drop("merged")
    ids = loaders.indexed(out.select("label").distinct(), "label").withColumnRenamed("row_idx", "cluster_id")
    return out.join(ids, "label")
