"""A Merkle manifest of a dataset: one tree a language, one over their roots, and a proof for every row by pointer jumping.

Leaves stand in order of doc_id within a language; every ``RUN`` consecutive nodes become their hash, level by level, until one
remains, and the roots of the languages, in order of language, likewise.

A proof is the siblings of a leaf on all levels. A node holds the run of its children, once for all of them, in place of a
copy of the siblings for each child, and a pointer to its parent. Repeated self-joins let each node's pointer jump to where
the one it points at points, and put the runs of that one behind its own, so distances double and after a few joins every
node holds all runs up to the root. A leaf then meets its parent, and its siblings are the runs without the nodes of its path.
Trees are balanced, so no ancestor is met by more than its share; the upper levels, which all lower nodes meet, are few rows
and broadcast where their size is below ``BROADCAST``.

All of it is SQL functions on columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import discard, let, written

#: Children of a node, levels of a tree that one pass makes, and rows that one range numbers.
RUN, LEVELS, FEW = 8, 3, 1 << 15
#: Bytes of the ancestors of a join, as bounded by their number and that of the runs they hold, up to which they are broadcast.
BROADCAST = 8 << 20
_HEX = 64


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows give the same text; null is a dash."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value), F.lit(":"), value))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(F.concat(*(field(c) for c in (doc_id, source, lang, n_chars, text))))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``place``, from 0 by ``order`` within each group, and ``total``, the rows of the group; a written table.

    A group may hold most rows: ranges of (group, order) are sorted side by side, and only the count of each group in each
    range is summed along the ranges. Up to ``FEW`` rows are one range.
    """
    ranges = rows.coalesce(1) if rows.count() <= FEW else rows.repartitionByRange(group, *order)
    spots = written(ranges.sortWithinPartitions(group, *order).withColumn("spot", F.monotonically_increasing_id()), "spots")
    part = F.call_function("shiftright", F.col("spot"), F.lit(33)).alias("part")
    parts = spots.groupBy(group, part).agg(F.min("spot").alias("low"), F.count("*").alias("n"))
    along = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(along.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = parts.select(group, "part", (before - F.col("low")).alias("shift"), F.sum("n").over(along).alias("total"))
    out = written(spots.withColumn("part", part).join(parts, [group, "part"]).withColumn("place", F.col("spot") + F.col("shift")).drop("spot", "shift", "part"), "numbered")
    discard(spots)
    return out


def _runs(hashes: Column) -> Column:
    """The joined hashes of every ``RUN`` consecutive nodes."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(hashes) - 1), F.lit(RUN))
    return F.transform(starts, lambda i: F.array_join(F.slice(hashes, i + 1, F.lit(RUN)), ""))


def _above(hashes: Column, level: int, place: Column, total: Column, left: int = LEVELS) -> Column:
    """Nodes (level, place, total, hash, run) of the next ``left`` levels over consecutive nodes, the first of them at ``place``."""
    up, ends = F.floor(place / RUN).cast("long"), F.ceil(total / RUN).cast("long")

    def of(pair: Column) -> Column:
        node = lambda run, i: F.struct(F.lit(level).alias("level"), (up + i).alias("place"), ends.alias("total"), F.get(pair["hashes"], i).alias("hash"), run.alias("run"))
        here = F.filter(F.transform(pair["runs"], node), lambda n: total > 1)
        return here if left == 1 else F.concat(here, _above(pair["hashes"], level + 1, up, ends, left - 1))

    return let(_runs(hashes), lambda runs: let(F.struct(runs.alias("runs"), F.transform(runs, digest).alias("hashes")), of))


def grown(leaves: DataFrame, first: int = 1) -> list[DataFrame]:
    """Written tables (tree, level, place, total, hash, run) of the levels above ``leaves`` (tree, place, total, hash).

    ``total`` counts the nodes of a tree's level; a tree ends with the level that has one. ``run`` is the joined hashes of
    the children. A pass makes ``LEVELS`` levels: it groups the nodes that have an ancestor so far above, RUN ** LEVELS at most.
    """
    out, below, level = [], leaves, first
    most = leaves.agg(F.max("total")).first()[0] or 0
    while most > 1:
        part = F.expr(f"place div {RUN**LEVELS}").alias("part")
        groups = below.where("total > 1").groupBy("tree", part).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("nodes"))
        nodes = let(F.transform("nodes", lambda n: n["hash"]), lambda hashes: _above(hashes, level, F.col("part") * RUN**LEVELS, F.col("total")))
        made = written(groups.select("tree", F.inline(nodes)), "levels")
        out.append(made)
        for _ in range(LEVELS):
            most, level = -(-most // RUN), level + (most > 1)
        below = made.where(F.col("level") == level - 1)
    return out


def paths(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, level, place, path) of nodes (tree, level, place, own, up_tree, up_level, up_place): all steps up to the root.

    Each round joins every node that has not reached the root with the one it points at and doubles the distance.
    """
    reach, held = 1, written(nodes, "pointers")
    while reach <= levels:
        above = held.where(F.col("level") >= reach).select(*(F.col(c).alias(f"to_{c}") for c in ("tree", "level", "place", "path", "up_tree", "up_level", "up_place")))
        if above.count() * reach * (RUN * _HEX + 100) <= BROADCAST:
            above = F.broadcast(above)
        meet = (F.col("up_tree") == F.col("to_tree")) & (F.col("up_level") == F.col("to_level")) & (F.col("up_place") == F.col("to_place"))
        longer = F.when(F.col("to_path").isNull(), F.col("path")).otherwise(F.concat("path", "to_path")).alias("path")
        moved = written(held.join(above, meet, "left").select("tree", "level", "place", longer, *(F.col(f"to_{c}").alias(c) for c in ("up_tree", "up_level", "up_place"))), "pointers")
        discard(held)
        reach, held = 2 * reach, moved
    return held.select("tree", "level", "place", "path")


def folded(leaf: Column, digit: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    start = F.struct(leaf.alias("hash"), digit.cast("long").alias("digit"))

    def up(a: Column, step: Column) -> Column:
        at = (a["digit"] * _HEX).cast("int")
        run = F.concat(F.substring(step["run"], F.lit(1), at), a["hash"], F.substring(step["run"], at + 1 + _HEX, F.length(step["run"])))
        return F.struct(F.when(step["run"].isNull(), a["hash"]).otherwise(digest(run)).alias("hash"), step["digit"].alias("digit"))

    return F.aggregate(path, start, up)["hash"]


def siblings(digit: Column, path: Column) -> Column:
    """The joined hashes of all siblings from a leaf up, left to right."""

    def others(step: Column, i: Column) -> Column:
        at = (F.when(i == 0, digit).otherwise(F.get(path, i - 1)["digit"]) * _HEX).cast("int")
        return F.concat(F.substring(step["run"], F.lit(1), at), F.substring(step["run"], at + 1 + _HEX, F.length(step["run"])))

    return F.array_join(F.transform(path, others), "")


def manifest(docs: DataFrame, **also: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, digit, path) and what ``also`` names: one row for each row of ``docs``.

    ``also`` are columns computed from those of ``docs``. ``path`` are the steps to the root: the run that holds the node,
    ``digit`` of the next step, and the root of the language where the step ends there. Null languages are a tree of their
    own, the first. Rows that share a doc_id, or have none (first of all), stand in order of their leaves; rows equal in all
    columns have equal leaves and a proof each. An empty table gives no rows. Columns with other names than those of
    ``documents`` are not read.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    hashed = leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    # written first, as ranges are drawn from a pass of its own
    own = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), hashed.alias("hash"), *(c.alias(n) for n, c in also.items())), "hashes")
    rows = numbered(own, "tree", "doc_id", "hash")
    discard(own)
    levels = grown(rows.select("tree", "place", "total", "hash"))
    lone = rows.where("total = 1").select("tree", F.lit(0).alias("level"), "place", "total", "hash", F.lit(None).cast("string").alias("run"))
    inner = lone
    for level in levels:
        inner = inner.unionByName(level)
    height = inner.agg(F.max("level")).first()[0] or 0
    heads = numbered(inner.where("total = 1").select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash"), "tree", "of")
    over = grown(heads.select("tree", "place", "total", "hash"), height + 1)
    tops = [x.where("total = 1").select("level", "hash") for x in over] or [heads.where("total = 1").select(F.lit(height).alias("level"), "hash")]
    top = reduce(DataFrame.unionByName, tops).first()
    root, most = F.lit(top["hash"] if top else None), top["level"] if top else 0

    several = F.col("head_total") > 1
    is_head = F.col("total") == 1
    # a language's root goes on in the tree over the languages, if there is more than one
    inner = inner.join(heads.select(F.col("of").alias("tree"), F.col("place").alias("head"), F.col("total").alias("head_total")), "tree")
    own = F.when(is_head, F.col("head")).otherwise(F.col("place"))
    goes = F.when(is_head & several, F.struct(F.lit("").alias("tree"), F.lit(height + 1).alias("level"))).when(~is_head, F.struct(F.col("tree").alias("tree"), (F.col("level") + 1).alias("level")))
    inner = inner.select("tree", "level", "place", "run", own.alias("own"), F.when(is_head, F.col("hash")).alias("subroot"), goes.alias("goes"))
    for level in over:
        up = F.when(F.col("total") > 1, F.struct(F.lit("").alias("tree"), (F.col("level") + 1).alias("level")))
        inner = inner.unionByName(level.select("tree", "level", "place", "run", F.col("place").alias("own"), F.lit(None).cast("string").alias("subroot"), up.alias("goes")))
    step = F.struct("run", (F.col("own") % RUN).alias("digit"), "subroot")
    up_place = F.when(F.col("goes").isNotNull(), F.expr(f"own div {RUN}"))
    nodes = inner.select("tree", "level", "place", F.array(step).alias("path"), F.col("goes")["tree"].alias("up_tree"), F.col("goes")["level"].alias("up_level"), up_place.alias("up_place"))
    proofs = paths(nodes, most)
    discard(*levels, *over, heads)

    at = [F.when(F.col("total") > 1, 1).otherwise(0).alias("level"), F.when(F.col("total") > 1, F.expr(f"place div {RUN}")).otherwise(F.col("place")).alias("up")]
    found = rows.select("doc_id", "tree", F.col("hash").alias("leaf"), *also, (F.col("place") % RUN).alias("digit"), *at)
    found = found.join(proofs.withColumnRenamed("place", "up"), ["tree", "level", "up"])
    subroot = F.filter(F.transform("path", lambda s: s["subroot"]), lambda s: s.isNotNull())[0]
    return found.select("doc_id", "leaf", *also, subroot.alias("subroot"), root.alias("root"), "digit", "path")


def proved(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every row's proof, put to the test.

    Of the ids whose CRC-32 three divides the text is tampered with: A-Z in lower case. A text without A-Z stays what it is
    and verifies; so does a null one. A null id's decimal is null, so its row is not tampered with.
    """
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, tampered_leaf=F.when(tampered, leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), low)))
    given = F.coalesce("tampered_leaf", "leaf")
    proof = digest(siblings(F.col("digit"), F.col("path")))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(given, F.col("digit"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
