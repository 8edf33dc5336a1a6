"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find grouping.

1. One pass turns each document into its distinct word shingles, a digest of that set and a SuperMinHash signature: every
   shingle walks its own random permutation of the slots, and step j writes j plus a fraction, so once all slots are
   filled no later step can lower one and the walk stops early. Slots filled by one permutation are correlated, which
   gives the estimate a lower variance than independent minima.
2. Documents with equal sets are one class; only its smallest member goes on.
3. ``BANDS`` bands of ``ROWS`` slots put representatives into buckets. In each bucket all members are compared with the
   smallest one: first the signatures, with six deviations of slack, then the full sets.
4. Buckets whose members are still in several components are compared completely: those of a few members pair by pair,
   each pair once for all its buckets; larger ones in tiles inside tasks. A tile emits only a spanning forest of the exact
   links between components, never all pairs.

Links are confirmed on the texts themselves: shingles are numbered by their words, not hashed.

A pair at similarity 0.85 misses all bands with a probability of 4e-8; at 0.8, of 4e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrace.llm.common import IdFilter, PrimeRolling, discard, in_batches, joined, mix, one_a_text, text_hash, with_ids, with_text, word_hashes, words, written
from lumentrace.llm.components import components

BANDS, ROWS = 36, 6
SIZE = BANDS * ROWS
#: Members of a bucket up to which its pairs are compared one by one.
FEW = 8
#: Members of a larger bucket that are compared with each other in one task.
TILE = 1500
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FRACTION = np.uint64((1 << 48) - 1)
SIGNED = "doc_id long, n long, digest binary, marks binary, bands array<long>"
TEXTS = "doc_id long, text string"


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and where each text's begin (and end)."""
    data, starts = joined(text)
    begin, end, first = words(data, starts)
    h = PrimeRolling(word_hashes(data, begin, end, lower=True, prime=True))
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc]
    length = np.minimum(count, k)[doc]
    items = h.of(at, at + length) ^ mix(length.astype(np.uint64))
    order = np.lexsort((items, doc))
    items, doc = items[order], doc[order]
    fresh = np.ones(len(items), dtype=bool)
    fresh[1:] = (items[1:] != items[:-1]) | (doc[1:] != doc[:-1])
    items, doc = items[fresh], doc[fresh]
    return items, np.searchsorted(doc, np.arange(len(count) + 1))


def signatures(items: np.ndarray, edges: np.ndarray, size: int = SIZE) -> np.ndarray:
    """SuperMinHash of each set: a row of ``size`` 64-bit words, step number above a 48-bit fraction."""
    sets = len(edges) - 1
    empty = np.iinfo(np.uint64).max
    out = np.full(sets * size, empty, dtype=np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(edges))
    seeds = items
    places = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(items), 1))
    row = np.arange(len(items))
    left = np.full(sets, size, dtype=np.int64)
    left[np.diff(edges) == 0] = 0
    for j in range(size):
        if not len(owner):
            break
        draw = mix(seeds + np.uint64((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((draw >> np.uint64(48)) * np.uint64(size - j) >> np.uint64(16)).astype(np.int64)
        slot = places[row, k]
        places[row, k] = places[row, j]
        where = owner * size + slot
        new = out[where] == empty
        if j:
            new = out[where] >= np.uint64(j << 48)
        at, value = where[new], (draw[new] & _FRACTION) | np.uint64(j << 48)
        if len(at):
            order = np.lexsort((value, at))
            at, value = at[order], value[order]
            lead = np.ones(len(at), dtype=bool)
            lead[1:] = at[1:] != at[:-1]
            at, value = at[lead], value[lead]
            out[at] = value
            left -= np.bincount(at // size, minlength=sets)
        keep = left[owner] > 0
        if not keep.all():
            owner, seeds = owner[keep], seeds[keep]
            row = row[keep]
            if len(row) * 2 < len(places):
                places, row = places[row], np.arange(len(row))
    return out.reshape(sets, size)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, which differs between bands."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, rows.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key + rows[:, :, i])
    return key


def signed(docs: DataFrame, k: int) -> DataFrame:
    """Set size, digest, one byte of each slot, and band keys of every document."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        items, edges = shingle_sets(batch.column("text"), k)
        full = signatures(items, edges)
        n = np.diff(edges)
        keys = band_keys(full)
        marks = mix(full).astype(np.uint8)
        some = n > 0
        arrays = [
            batch.column("doc_id"),
            pa.array(n.astype(np.int64)),
            pa.array([xxhash.xxh3_128_digest(items[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
            pa.array([m.tobytes() if s else b"" for m, s in zip(marks, some, strict=True)], pa.binary()),
            pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32), pa.array(keys[some].ravel().view(np.int64))),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "digest", "marks", "bands"])

    return with_text(docs).mapInArrow(in_batches(step), SIGNED)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some documents; a filter of their ids spares the others' texts the shuffle."""
    wanted = IdFilter(ids).may_hold()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(wanted(x.column("doc_id").to_numpy(zero_copy_only=False)), pa.bool_()))

    return docs.mapInArrow(some, TEXTS).join(ids, "doc_id", "left_semi")


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Shingles:
    """Numbers the shingles of the texts given to it: equal numbers are equal words, lower-cased, in equal order."""

    def __init__(self, k: int):
        self.k, self.word = k, {}
        self.known: list[dict] = [{} for _ in range(k)]

    def __call__(self, text: str | None) -> np.ndarray:
        word = self.word
        ids = [word.setdefault(w, len(word)) for w in (text or "").encode().translate(_LOWER).split()]
        if len(ids) < self.k:
            # a whole sequence of fewer words never equals k words
            known = self.known[len(ids)]
            return np.array([-1 - known.setdefault(tuple(ids), len(known)) * self.k - len(ids)] if ids else [], dtype=np.int64)
        known = self.known[0]
        return np.fromiter({known.setdefault(x, len(known)) for x in zip(*(ids[i:] for i in range(self.k)), strict=False)}, dtype=np.int64)


def _alike(size: int, percent: int) -> float:
    p = percent / 100
    return p - 6 * (p * (1 - p) / size) ** 0.5


def near(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose signatures come near it."""
    a = marks.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ma"))
    b = marks.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("mb"))
    sized = pairs.join(b, "b").join(a, "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    least = _alike(SIZE, percent)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(x.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SIZE) for c in ("ma", "mb"))
            yield x.select(["a", "b"]).filter(pa.array((left == right).mean(axis=1) >= least))

    return sized.mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, u = None, Shingles(k), np.zeros(0, dtype=np.int64)
        for x in batches:
            good = []
            for a, p, q in zip(x.column("a").to_pylist(), x.column("ta"), x.column("tb"), strict=True):
                if a != last:  # rows with one left document follow each other
                    last, number = a, Shingles(k)
                    u = number(p.as_py())
                v = number(q.as_py())
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(100 * both >= percent * (len(u) + len(v) - both))
            yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(b, "b").join(a, "a").mapInArrow(check, "a long, b long")


def tile_hints(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The members of a tile that may be linked with one of another component, by sizes and signatures."""
    group = group.drop_duplicates("doc_id")
    comp, n = group["component"].to_numpy(), group["n"].to_numpy()
    marks = np.frombuffer(b"".join(group["marks"]), dtype=np.uint8).reshape(-1, SIZE)
    least, hit = _alike(SIZE, percent) * SIZE, np.zeros(len(n), dtype=bool)
    for i in range(len(n) - 1):
        rest = slice(i + 1, None)
        other = np.flatnonzero((comp[rest] != comp[i]) & (np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * percent)) + i + 1
        good = other[(marks[other] == marks[i]).sum(axis=1) >= least]
        if len(good):
            hit[i] = hit[good] = True
    return group.loc[hit, ["key", "doc_id", "component"]]


def tile_links(group: pd.DataFrame, k: int, percent: int) -> pd.DataFrame:
    """Exact links between components inside one tile: a spanning forest of them."""
    group = group.drop_duplicates("doc_id").sort_values("doc_id")
    ids, comp = group["doc_id"].to_numpy(), group["component"].to_numpy()
    none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    if len(np.unique(comp)) < 2:
        return none
    number = Shingles(k)
    sets = [number(t) for t in group["text"]]
    items, n = np.concatenate(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(ids)), n)
    _, word, uses = np.unique(items, return_inverse=True, return_counts=True)
    shared = uses[word] > 1
    owner, word = owner[shared], np.unique(word[shared], return_inverse=True)[1]
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    both = np.zeros((len(ids), len(ids)), dtype=np.float32)
    for low in range(0, int(word[-1]) + 1 if len(word) else 0, 2048):
        a, b = np.searchsorted(word, (low, low + 2048))
        block = np.zeros((len(ids), 2048), dtype=np.float32)
        block[owner[a:b], word[a:b] - low] = 1
        both += block @ block.T
    union = n[:, None] + n[None, :] - both
    x, y = np.nonzero(np.triu((100 * both >= percent * union) & (comp[:, None] != comp[None, :]), 1))
    parent = {int(c): int(c) for c in np.unique(comp)}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    found = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = find(int(comp[i])), find(int(comp[j]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            found.append((ids[i], ids[j]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64") if found else none


def tiled(members: DataFrame) -> DataFrame:
    """Rows (key, doc_id) of buckets with tile numbers t <= u, so that any two members of a bucket meet in some tile."""
    size = members.groupBy("key").count()
    out = members.join(size, "key").withColumn("tiles", F.ceil(F.col("count") / TILE).cast("int"))
    out = out.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    out = out.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    return out.select("key", "doc_id", "component", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"))


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Words are runs of bytes other than ASCII white space with A-Z read as a-z; a set holds the distinct ``k``-word
    shingles, or the whole sequence as one where there are fewer words. Documents are linked when
    100 * intersection >= ``percent`` * union of their full sets. Documents without words, null text among them, are
    linked with nothing. component_id is the smallest doc_id reachable, kept whether it is the document itself; a null
    doc_id counts as smaller than all others. Rows that repeat a doc_id each get a row; with different texts they are
    documents of their own, linked by what each of them says. Groups whose smallest document has no id all have a null
    component_id, so it does not tell them apart. Other columns are not read; an empty table gives an empty result.
    """
    rows = with_text(docs)
    own, keys = one_a_text(rows)
    found = _by_key(own, k, percent)
    if keys is not None:
        name = keys.select(F.col("row").alias("component_id"), F.col("doc_id").alias("component"))
        of = rows.select("doc_id", text_hash().alias("hash")).join(keys.select("doc_id", "hash", "row"), ["doc_id", "hash"])
        found = of.join(found.withColumnRenamed("doc_id", "row"), "row").join(name, "component_id").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return with_ids(found.withColumn("kept", F.col("doc_id") == F.col("component_id")), "doc_id", "component_id")


def _by_key(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows with unique ids."""
    table = written(signed(docs, k), "signed")
    classes = table.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    member = written(table.select("doc_id", "n", "digest").join(classes, "digest", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    reps = written(table.join(member.where("doc_id = rep and n > 0").select("doc_id"), "doc_id", "left_semi"), "reps")
    discard(table)
    marks = reps.select("doc_id", "n", "marks")
    bands = reps.select("doc_id", F.explode("bands").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("count")).where("count > 1").select("key", "hub")
    bucket = written(bands.join(hubs, "key"), "buckets")
    stars = bucket.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = written(near(stars, marks, percent), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = written(texts_of(docs, ends), "texts")
    links = written(verified(pairs, texts, k, percent), "star-links")
    group = written(components(links), "groups")
    # what the stars left apart inside a bucket
    inside = bucket.select("key", "doc_id").join(group.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    inside = placed = written(inside, "inside")
    apart = inside.groupBy("key").agg((F.min("component") != F.max("component")).alias("apart"), F.count("*").alias("count")).where("apart")
    inside = inside.join(apart.select("key", "count"), "key")
    few, many = inside.where(F.col("count") <= FEW), inside.where(F.col("count") > FEW).drop("count")
    left, right = (few.select("key", F.col("doc_id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    pairs_left = written(near(left.join(right, "key").where("a < b and ca <> cb").select("a", "b").distinct(), marks, percent), "pairs-left")
    tiles = tiled(many).join(marks, "doc_id")
    hints = written(tiles.groupBy("key", "t", "u").applyInPandas(lambda g: tile_hints(g, percent), "key long, doc_id long, component long").distinct(), "hints")
    needed = pairs_left.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(hints.select("doc_id")).distinct()
    lacking = written(needed.join(ends, "doc_id", "left_anti"), "lacking")
    rest = written(texts_of(docs, lacking), "texts")
    full = texts.unionByName(rest)
    more = tiled(hints).join(full, "doc_id").groupBy("key", "t", "u").applyInPandas(lambda g: tile_links(g, k, percent), "a long, b long")
    more = written(more.unionByName(verified(pairs_left, full, k, percent)).distinct(), "more-links")
    # the stars' components are known; only what links them is followed once more
    over = more.join(group.withColumnRenamed("id", "a").withColumnRenamed("component", "ca"), "a", "left").join(group.withColumnRenamed("id", "b").withColumnRenamed("component", "cb"), "b", "left")
    over = written(components(over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "joined")
    ids = group.unionByName(over.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
    ids = ids.join(over.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    last = written(ids.withColumnRenamed("id", "rep"), "components")
    discard(reps, bucket, pairs, placed, pairs_left, hints, lacking, texts, rest, links, group, more, over)
    return member.join(last, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
