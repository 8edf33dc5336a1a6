"""Where answers of calls are kept: immutable runs, bucketed and sorted by key, and claims of those who are calling.

A run is a folder of Parquet files in buckets of the key, so a join with it moves and sorts only the other side. Runs that are
many are merged into one, which names those that it covers; they are left for frames that still read them until ``vacuum``.

Writers that share a cache claim keys before they call. Claims are laid down one writer at a time, behind a file that a
file system creates for one of them alone, so each key is called by one writer; others wait for its run.
"""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.session import discard, remove, written

SCHEMA = "key string, request string, response string"
#: Runs beyond which they are merged, seconds after which a lock or a claim counts as left behind, and between two looks.
MOST_RUNS, STALE, POLL = 4, 3600.0, 0.2


class Runs:
    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, stale: float = STALE):
        self.spark, self.path, self.stale = spark, path, stale
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._files = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, pattern: str) -> list:
        return list(self._files.globStatus(self._at(f"{self.path}/{pattern}")) or ())

    def names(self) -> list[str]:
        """The runs that count, oldest first: finished ones that no other covers. A name is time-buckets-id."""
        done = {f.getPath().getParent().getName() for f in self._listed("run-*/_SUCCESS")}
        covered = {f.getPath().getName().removeprefix("_covers-") for f in self._listed("run-*/_covers-*") if f.getPath().getParent().getName() in done}
        return sorted(done - covered)

    def run(self, name: str) -> DataFrame:
        """A run through the catalog, which knows its buckets."""
        table = "lumentrace_" + name.replace("-", "_")
        n = int(name.split("-")[2])
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {n} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(table)

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.run(n) for n in self.names()), self.spark.createDataFrame([], SCHEMA))

    def write(self, rows: DataFrame, covers: tuple[str, ...] = ()) -> str:
        name = f"run-{time.time_ns():020}-{self.buckets}-{uuid.uuid4().hex}"
        writer = rows.repartition(self.buckets, "key").write.option("path", f"{self.path}/{name}")
        writer.bucketBy(self.buckets, "key").sortBy("key").saveAsTable("lumentrace_" + name.replace("-", "_"))
        # until these are there the run and what it covers both count, which answers the same
        for old in covers:
            self._files.create(self._at(f"{self.path}/{name}/_covers-{old}")).close()
        return name

    def compact(self, most: int = MOST_RUNS) -> None:
        """Merge the runs into one if there are more than ``most``. Of answers to one key the oldest stays."""
        names = self.names()
        if len(names) > most:
            rows = reduce(DataFrame.unionByName, (self.run(n).withColumn("age", F.lit(i)) for i, n in enumerate(names)))
            self.write(rows.groupBy("key").agg(F.min_by(F.struct("request", "response"), "age").alias("r")).select("key", "r.*"), tuple(names))

    def vacuum(self) -> None:
        """Delete what merged runs cover; frames made before must not be read any more."""
        current = set(self.names())
        for f in self._listed("run-*"):
            name = f.getPath().getName()
            if name not in current and any(x.getPath().getName() == f"_covers-{name}" for n in current for x in self._listed(f"{n}/_covers-*")):
                self.spark.sql(f"DROP TABLE IF EXISTS lumentrace_{name.replace('-', '_')}")
                remove(self.spark, f"{self.path}/{name}")

    @contextmanager
    def _alone(self):
        """A section that one writer is in at a time; a lock that is older than ``stale`` seconds has been left behind."""
        lock = self._at(f"{self.path}/lock")
        while True:
            try:
                self._files.create(lock, False).close()
                break
            except Exception as e:  # it is there, which file systems tell in ways of their own
                found = self._listed("lock")
                if found and time.time() - found[0].getModificationTime() / 1000 > self.stale:
                    self._files.delete(lock, False)
                elif not found and "already exists" not in str(e).lower():
                    raise
                time.sleep(POLL)
        try:
            yield
        finally:
            self._files.delete(lock, False)

    def _claims(self) -> list[str]:
        """Paths of the claims that writers hold."""
        live = []
        for f in self._listed("claim-*/_SUCCESS"):
            if time.time() - f.getModificationTime() / 1000 <= self.stale:
                live.append(str(f.getPath().getParent()))
        return sorted(live)

    def claim(self, wanted: DataFrame) -> tuple[str, DataFrame, bool]:
        """(claim, own, others): the rows of ``wanted`` that this writer shall call, and whether other writers are calling some.

        Each run is left out by a join of its own, for which only ``wanted`` moves.
        """
        schema, wanted = "key string, request string", written(wanted, "wanted")
        with self._alone():
            todo = reduce(lambda rows, n: rows.join(self.run(n).select("key"), "key", "left_anti"), self.names(), wanted)
            held, name, others = self._claims(), f"{self.path}/claim-{uuid.uuid4().hex}", False
            if held:
                taken = self.spark.read.schema(schema).parquet(*held).select("key").distinct()
                others = not todo.join(taken, "key", "left_semi").isEmpty()
                todo = todo.join(taken, "key", "left_anti")
            todo.select("key", "request").write.parquet(name)
        discard(wanted)
        return name, self.spark.read.schema(schema).parquet(name), others

    def release(self, claim: str) -> None:
        """Give up a claim; nobody reads claims meanwhile."""
        with self._alone():
            remove(self.spark, claim)

    def wait(self) -> None:
        """Until the claims that others hold now are gone or left behind."""
        held = set(self._claims())
        while held & set(self._claims()):
            time.sleep(POLL)

    def answers(self, rows: DataFrame, key: str, to: str) -> DataFrame:
        """``rows`` with the response to each key, by a join with each run, for which the runs stay where they are."""
        found = []
        for i, n in enumerate(self.names()):
            found.append(f"_answer{i}")
            rows = rows.join(self.run(n).select(F.col("key").alias(key), F.col("response").alias(found[-1])), key, "left")
        return rows.withColumn(to, F.coalesce(*found) if found else F.lit(None).cast("string")).drop(*found)
