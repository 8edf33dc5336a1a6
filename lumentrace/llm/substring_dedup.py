"""Incremental substring deduplication over words with a log-structured fingerprint index.

The index is a folder of immutable runs. A run holds the fingerprints of the windows of some batches, one row for each
anchor node (module ``windows``) that was the first of its class, in buckets of its key and sorted by it. A new batch is
bucketed and sorted the same way and merge-joined with each run, so no run is ever shuffled or sorted again; only its rows
with a key of the batch are read on. Equality is verified by the hash of the whole node, and where nodes only share an
anchor, window by window on the texts. The batch's own first nodes become a new run; once there are more than ``max_runs``
they are compacted into one. A run's folder name tells the batches it covers, so an index can be opened again by its path,
also after a compaction that was cut short.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumentrace.llm.common import Buckets, bucketed, discard, in_batches, one_a_text, opened, own_ids, remove, shared_path, text_hash, with_ids, with_text, written
from lumentrace.llm.windows import NODES, Tokens, anchors_of, attach, covered, refine, texts_by_id
from lumentrace.session import setting

WINDOW = 20
OUT = "doc_id long, n_words long, n_removed long, kept string"
_COLUMNS = [x.split()[0] for x in NODES.split(", ")]
#: Batches in which ``remove_repeats`` feeds its documents: the third makes the runs too many, the fourth meets the compacted one.
BATCHES, RUNS = 4, 2


def word_tokens(window: int) -> Tokens:
    return Tokens("words", window, max(1, min(5, window)), (1,))


class FingerprintIndex:
    """Fingerprints of the documents seen so far, and the deduplication of new batches against them.

    Batches must come in increasing order of doc_id, since the occurrence with the smaller (doc_id, start) stays, and a
    doc_id must not repeat; ``remove_repeats`` sees to both. ``path`` holds the runs; runs that lie there are taken up.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, max_runs: int = RUNS, path: str | None = None):
        self.spark, self.tokens, self.max_runs = spark, word_tokens(window), max_runs
        self.path = path or shared_path(spark, "fingerprints")
        self.runs: list[tuple[int, int, Buckets]] = []
        self._take_up()

    def _take_up(self) -> None:
        """The complete runs at the path; ones whose batches a longer run covers are left over from its compaction and go."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        found = []
        for name in names:
            m = re.fullmatch(r"run-(\d+)-(\d+)-of-(\d+)", name)
            if m and files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")):
                found.append(tuple(map(int, m.groups())))
            elif m:
                remove(self.spark, f"{self.path}/{name}")
        for low, high, count in sorted(found):
            place = f"{self.path}/run-{low}-{high}-of-{count}"
            if any((a, b) != (low, high) and a <= low and high <= b for a, b, _ in found):
                remove(self.spark, place)
            else:
                self.runs.append((low, high, opened(self.spark, place, NODES, "core", ("uni",), count)))

    def _run(self, rows: DataFrame, low: int, high: int, count: int) -> tuple[int, int, Buckets]:
        return low, high, bucketed(rows.select(*_COLUMNS), "core", "run", ("uni",), f"{self.path}/run-{low}-{high}-of-{count}", count)

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Add ``batch`` (doc_id, text); returns its decided nodes and the earlier ones that have to be looked at again.

        ``hit`` marks nodes all of whose windows also start earlier, ``open`` those that ``refine`` must cut.
        """
        number = max((high for _, high, _ in self.runs), default=-1) + 1
        fresh = bucketed(batch.mapInArrow(anchors_of(self.tokens), NODES), "core", "fresh", ("uni",))
        live = fresh.rows.where("cnt > 0")
        met = [run.rows.join(live.select("core"), "core", "left_semi").select(*_COLUMNS) for _, _, run in self.runs]
        old = written(reduce(DataFrame.unionByName, met), "met") if met else self.spark.createDataFrame([], NODES)
        by, core = Window.partitionBy("core", "uni"), Window.partitionBy("core")
        rows = fresh.rows.withColumn("rank", F.row_number().over(by.orderBy("doc_id", "pos", F.col("cnt").desc())))
        rows = rows.withColumn("least", F.min("uni").over(core)).withColumn("most", F.max("uni").over(core))
        rows = rows.join(old.select("core", "uni", F.lit(True).alias("seen")), ["core", "uni"], "left")
        rows = rows.join(old.groupBy("core").agg(F.min("uni").alias("old_least"), F.max("uni").alias("old_most")), "core", "left")
        first = (F.col("cnt") > 0) & (F.col("rank") == 1) & F.col("seen").isNull()
        several = F.least("least", "old_least") != F.greatest("most", "old_most")
        # rows of a core lie together, which is all that joins on core and union need
        with setting(self.spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
            ranked = written(rows.select(*_COLUMNS, (~first).alias("hit"), (first & several).alias("open"), first.alias("first")), "ranked")
        of_batch = live.groupBy("core").agg(F.min("uni").alias("least"), F.max("uni").alias("most"))
        again = old.join(of_batch, "core").where("least <> uni or most <> uni").select(*_COLUMNS, F.lit(False).alias("hit"), F.lit(True).alias("open"))
        decided = written(ranked.where("hit or open").drop("first").unionByName(again), "decided")
        self.runs.append(self._run(ranked.where("first"), number, number, fresh.count))
        fresh.drop()
        discard(old, ranked) if met else discard(ranked)
        if len(self.runs) > self.max_runs:
            self.compact()
        return decided

    def spans(self, decided: list[DataFrame], texts: DataFrame) -> DataFrame:
        """(doc_id, spans) of the word windows that also start earlier; ``texts`` are all documents that were ingested."""
        nodes = reduce(DataFrame.unionByName, decided)
        # a node that several later batches met is one
        nodes = nodes.where("hit").unionByName(nodes.where("open").dropDuplicates(["doc_id", "anchor"]))
        return refine(texts, nodes, self.tokens, "earlier", "substring")[0]

    def compact(self) -> None:
        """Merge all runs into one; the old ones go once it is complete."""
        old = self.runs
        rows = reduce(DataFrame.unionByName, [run.rows for _, _, run in old])
        self.runs = [self._run(rows, old[0][0], old[-1][1], old[-1][2].count)]
        for _, _, run in old:
            run.drop()

    def close(self, keep: bool = False) -> None:
        """Let go of the runs, and delete them unless they are to be opened again."""
        for _, _, run in self.runs:
            run.forget() if keep else run.drop()
        self.runs = []


def in_id_order(docs: DataFrame, batches: int) -> list[DataFrame]:
    """The documents in ``batches`` parts of about equal size, each with larger ids than the one before."""
    if batches < 2:
        return [docs]
    at = [(i + 1) / batches for i in range(batches - 1)]
    cuts = docs.select(F.percentile_approx("doc_id", at, 1000)).first()[0]
    cuts = sorted({int(c) for c in cuts or ()})
    parts, low = [], None
    for cut in [*cuts, None]:
        part = docs
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if cut is not None:
            part = part.where(F.col("doc_id") <= cut)
        parts.append(part)
        low = cut
    return parts


def remove_repeats(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, rejoin: bool = True, once: bool = False) -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that also starts earlier in the corpus.

    Words are runs of bytes other than ASCII white space. Earlier means a smaller doc_id, or the same document and an
    earlier start; windows are judged on the input. Documents enter the index in ``batches`` parts in order of doc_id.
    Returns doc_id, n_words, n_removed, kept (words joined by one space;
    without ``rejoin`` null where nothing is removed). Null text has no words; a null doc_id counts as
    smaller than all others; rows that repeat a doc_id with the same text count once and get the same result; different
    texts under one doc_id are documents in order of a hash; other columns are not read; an empty table gives an empty
    result. With ``once`` each distinct (doc_id, text) gives one row, with the text's hash as a fifth column.
    """
    rows = with_text(docs)
    own, keys = one_a_text(rows)
    texts = texts_by_id(own).rows
    index = FingerprintIndex(docs.sparkSession, window)
    decided = [index.ingest(part) for part in in_id_order(texts, batches)]
    spans = index.spans(decided, texts)
    index.close()

    def cut(step: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for i, text in enumerate(step.column("text").to_pylist()):
            found = (text or "").encode().split()
            gone = covered(step, i, len(found), window)
            kept = [w for w, g in zip(found, gone.tolist(), strict=True) if not g] if gone.any() else found
            joined = b" ".join(kept).decode() if rejoin or gone.any() else None
            for to, x in zip(out, (len(found), int(gone.sum()), joined), strict=True):
                to.append(x)
        arrays = [step.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept"]
        return pa.RecordBatch.from_arrays([*arrays, step.column("text_hash")] if once else arrays, names=[*names, "text_hash"] if once else names)

    found = attach(texts, spans)
    if once:
        return with_ids(own_ids(found.withColumn("text_hash", text_hash()).mapInArrow(in_batches(cut), f"{OUT}, text_hash long"), keys))
    return with_ids(own_ids(found.mapInArrow(in_batches(cut), OUT), keys, rows))
