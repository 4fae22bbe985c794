"""Relations as runs of Parquet files in the shared folder.

A table has a column for each of its relation's columns (``c0``, ``c1``, ...) and ``gen``, the number of the
write that brought the row.  A write holds rows of many relations and is partitioned by relation, so that one
job serves a whole round, an existing partition means a non-empty delta, and a relation's table is one scan
over its partitions of all writes.  Nullary relations have one column, always 0.

A large run is not written anew when elements in it are merged: the merge is noted as one the run does not
know (``stale``), and its rows that hold a merged element are left out when it is read (a merge so noted is
small and broadcast), until the run is compacted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ir import Compiled


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; only where one machine does all may it be unset."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (where or "/tmp/checkpoints").rstrip("/")


#: Bytes of input for each shuffle partition; most bytes of a coalesced one, and of a scan's split; files a task has open.
PARTITION_BYTES, ADVISED_BYTES, SPLIT_BYTES, OPEN_FILES = 2 << 20, 4 << 20, 8 << 20, 16


@contextmanager
def bounded(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs inside work in tasks of bounded size, over ``size`` bytes of input as over few.

    The number of shuffle partitions follows the input, partitions are coalesced to little (what is moved is
    compressed; a task sorts and hashes it at ten times that size or more), and writes by relation do not
    sort, up to ``OPEN_FILES`` relations.  Settings of the session that are stricter stay.
    """
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    conf, want = spark.conf, {"spark.sql.shuffle.partitions": max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))}
    for name, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", ADVISED_BYTES), ("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)):
        want[name] = min(to_bytes(conf.get(name)), most)
    if int(conf.get("spark.sql.maxConcurrentOutputFileWriters", "0")) <= 0:
        want["spark.sql.maxConcurrentOutputFileWriters"] = OPEN_FILES
    before = {name: conf.get(name, None) for name in want}
    try:
        for name, value in want.items():
            conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            if value is None:
                conf.unset(name)
            else:
                conf.set(name, value)


def scanned(df: DataFrame) -> int:
    """Bytes of the tables that a DataFrame reads, as far as the planner knows them."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)  # what it does not know is about 2^63


class Store:
    def __init__(self, spark: SparkSession, theory: Compiled, root: str | None = None):
        self.spark, self.theory = spark, theory
        self.root = root or f"{shared_dir(spark)}/horncast-model-{uuid.uuid4().hex}"
        self.width = max([1, *(r.width for r in theory.relations.values())])
        self.runs: dict[str, list[str]] = {name: [] for name in theory.relations}
        self.span: dict[str, tuple[int, int]] = {}  # least and greatest gen in a run
        self.stale: dict[str, list[str]] = {}  # merges that a run does not know
        self.saved: set[str] = set()  # writes that the last saved state needs
        self.writes = 0
        jvm = spark._jvm
        self.path_of = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.live: set[str] = set()
        self.sizes: dict[str, int] = {}  # bytes of runs

    def columns(self, relation: str) -> list[str]:
        return [f"c{i}" for i in range(max(1, self.theory.relation(relation).width))]

    def schema(self, relation: str) -> T.StructType:
        return T.StructType([*[T.StructField(c, T.LongType()) for c in self.columns(relation)], T.StructField("gen", T.LongType())])

    def add(self, relation: str, path: str, first: int, last: int) -> None:
        """A run whose rows have first <= gen <= last."""
        self.runs[relation].append(path)
        self.span[path] = (first, last)

    def scan(self, relation: str, runs: list[str]) -> DataFrame:
        """Rows of runs, without those that hold elements merged since."""
        schema, columns = self.schema(relation), self.theory.relation(relation).columns
        by_merges: dict[tuple[str, ...], list[str]] = {}
        for p in runs:
            by_merges.setdefault(tuple(self.stale.get(p, ())), []).append(p)
        out = None
        for merges, paths in by_merges.items():
            rows = self.spark.read.schema(schema).parquet(*paths)
            if merges:
                gone = self.spark.read.schema("tag string, el bigint, root bigint").parquet(*merges)
                for i, t in enumerate(columns):
                    of_type = F.broadcast(gone.where(F.col("tag") == t).select(F.col("el").alias("_gone")))
                    rows = rows.join(of_type, F.col(f"c{i}") == F.col("_gone"), "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    def table(self, relation: str, after: int | None = None, until: int | None = None) -> DataFrame:
        """Rows of a relation with ``after`` < gen <= ``until``.

        Only runs that can have such rows are scanned, so that the planner sees the size of a delta and not
        that of the relation, and broadcasts it where it is small.
        """
        schema = self.schema(relation)
        low, high = -1 if after is None else after, float("inf") if until is None else until
        runs = self.within(relation, low, high)
        if not runs:
            return self.spark.range(0).select(*[F.lit(0).cast("long").alias(f.name) for f in schema])
        out = self.scan(relation, runs)
        if any(self.span[p][0] <= low for p in runs):
            out = out.where(F.col("gen") > low)
        if any(self.span[p][1] > high for p in runs):
            out = out.where(F.col("gen") <= high)
        return out

    def within(self, relation: str, after: float, until: float) -> list[str]:
        """Runs that can have rows with ``after`` < gen <= ``until``."""
        return [p for p in self.runs[relation] if self.span[p][1] > after and self.span[p][0] <= until]

    def bytes(self, paths: list[str]) -> int:
        for p in paths:
            if p not in self.sizes:
                self.sizes[p] = self.fs.getContentSummary(self.path_of(p)).getLength()
        return sum(self.sizes[p] for p in paths)

    def bounded(self, more: int = 0):
        """``bounded`` for jobs that read relations, and ``more`` bytes besides."""
        return bounded(self.spark, self.bytes([p for runs in self.runs.values() for p in runs]) + more)

    def wide(self, relation_tag: str, df: DataFrame, columns: list[str], gen) -> DataFrame:
        """A table's rows in the shape of a write; columns it does not have are 0."""
        have = [F.col(c).cast("long") for c in columns]
        have += [F.lit(0).cast("long")] * (self.width - len(have))
        return df.select(F.lit(relation_tag).alias("rel"), *[c.alias(f"c{i}") for i, c in enumerate(have)], F.lit(gen).cast("long").alias("gen") if isinstance(gen, int) else gen)

    def write(self, rows: DataFrame) -> dict[str, str]:
        """Writes (rel, c0, ..., gen); the folder of each relation that has rows."""
        self.writes += 1
        path = f"{self.root}/write-{self.writes:05d}"
        rows.write.partitionBy("rel").parquet(path)
        return self.parts(path)

    def parts(self, path: str) -> dict[str, str]:
        where = self.path_of(path)
        if not self.fs.exists(where):
            return {}
        names = [s.getPath().getName() for s in self.fs.listStatus(where)]
        out = {}
        for n in names:
            if n.startswith("rel="):
                out[unquote(n[4:])] = f"{path}/{n}"
        return out

    def names(self) -> list[str]:
        """What is in the model's folder."""
        where = self.path_of(self.root)
        return [x.getPath().getName() for x in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def collect_garbage(self) -> None:
        """Deletes writes of which no run is left, here or in the saved state."""
        used = {p[len(self.root) + 1 :].split("/", 1)[0] for runs in self.runs.values() for p in runs} | self.live | self.saved
        if not self.fs.exists(self.path_of(self.root)):
            return
        for s in self.fs.listStatus(self.path_of(self.root)):
            path = s.getPath()
            if path.getName().startswith(("write-", "arrows-")) and path.getName() not in used:
                self.fs.delete(path, True)

    def write_text(self, name: str, text: str) -> None:
        """A small file, complete as soon as it has its name."""
        part, whole = self.path_of(f"{self.root}/.{name}.part"), self.path_of(f"{self.root}/{name}")
        out = self.fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(whole, False)
        self.fs.rename(part, whole)

    def drop(self) -> None:
        self.fs.delete(self.path_of(self.root), True)
