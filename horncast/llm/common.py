"""Shared pieces: scratch tables in the cluster's shared folder, distributed ranks and prefix sums."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's own words for white space between words; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one task ranks in one window, on average.
RANK_BLOCK_ROWS = 1_000
#: Buckets whose totals one task sums up.
RUN_BUCKETS = 1_000


def by_value() -> None:
    """Executors get the functions of this subpackage inside the task, so they need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules["horncast.llm"])


def share(spark: SparkSession, thing: object) -> Broadcast:
    """A broadcast of what ``thing`` holds, as plain values: a class would have to be imported by executors."""
    return spark.sparkContext.broadcast(vars(thing))


def revive(kind: type, shared: Broadcast):
    """The thing again, on an executor."""
    thing = object.__new__(kind)
    thing.__dict__.update(shared.value)
    return thing


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; set only where it is unset and one machine does all (as in tests)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/horncast-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles() if "/horncast-" in x}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Shielded:
    """``rows``: a table under names of our own (``in_0``, ``in_1``, ...), so that no column can clash with an
    operator's.  Any name goes: with dots, in two spellings, or of two columns that are not asked for.

    ``new`` names the columns that the operator adds; input columns with such a name, in any case, are replaced.
    """

    def __init__(self, df: DataFrame, new: Sequence[str] = ()):
        self.names = list(df.columns)
        self.rows = df.toDF(*[f"in_{i}" for i in range(len(self.names))])
        added = {n.lower() for n in new}
        self.kept = [i for i, n in enumerate(self.names) if n.lower() not in added]

    def of(self, name: str) -> str:
        """Our name of a column: exactly so written or else, as Spark has it, in another case."""
        at = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if len(at) != 1:
            raise KeyError(f"{len(at)} columns are called {name!r}")
        return f"in_{at[0]}"

    def carried(self) -> list[str]:
        return [f"in_{i}" for i in self.kept]

    def restore(self, out: DataFrame, new: Sequence[str] = (), carry: Sequence[str] | None = None) -> DataFrame:
        """What is kept (or the columns ``carry``) under the names it came with, then ``new``."""
        held = [(self.names[i], f"in_{i}") for i in self.kept] if carry is None else [(n, self.of(n)) for n in carry]
        return out.select(*[c for _, c in held], *new).toDF(*[n for n, _ in held], *new)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def group_key(column: Column) -> Column:
    """A string that is never null and tells null from every value: plain equality keeps a shuffle's partitioning."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def bucket_heads(totals: DataFrame, group: list[str], bucket: str, counted: bool) -> DataFrame:
    """``_rk_before`` (and ``_rk_ahead``): sums of ``_sum`` (and ``_n``) over the buckets before each one of its group.

    Buckets are summed up in runs of ``RUN_BUCKETS`` first, so that no task sees more than that many of them
    and only one row for each run of a group, 1 for each million rows, is summed in one task.
    """
    totals = totals.withColumn("_rk_run", F.expr(f"`{bucket}` div {RUN_BUCKETS}"))
    sums = [("_sum", "_rk_before"), *([("_n", "_rk_ahead")] if counted else [])]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    run = before(Window.partitionBy(*group, "_rk_run").orderBy(bucket))
    line = before((Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_rk_run"))
    own = totals.select(*group, bucket, "_rk_run", *[F.coalesce(F.sum(c).over(run), F.lit(0)).alias(f"{to}_own") for c, to in sums])
    runs = totals.groupBy(*group, "_rk_run").agg(*[F.sum(c).alias(c) for c, _ in sums])
    runs = runs.select(*group, "_rk_run", *[F.coalesce(F.sum(c).over(line), F.lit(0)).alias(to) for c, to in sums])
    return own.join(runs, [*group, "_rk_run"]).select(*group, bucket, *[(F.col(to) + F.col(f"{to}_own")).alias(to) for _, to in sums])


def ranked(
    df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, offset: str, rank: str | None = None, totals_of: DataFrame | None = None
) -> DataFrame:
    """Adds ``offset``: the sum of ``value`` over the rows before this one in its group, in the order (bucket, order).

    ``bucket`` must be an integer column that is monotone in the wanted order and spreads a group's rows
    evenly, so that no task ever holds a whole group: per-bucket totals are aggregated first (map-side
    combine), their prefix sums (``bucket_heads``) are joined back on the same key the inner window is partitioned by.
    ``rank`` (if named) likewise becomes the 1-based row number in the group.  Group columns are not null.
    ``totals_of`` has the same groups, buckets and values where ``df`` is costly to evaluate twice.
    """
    key = [*group, bucket]
    counted = rank is not None
    totals = (df if totals_of is None else totals_of).groupBy(*key).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    heads = bucket_heads(totals, group, bucket, counted)
    inner = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("_rk_own", F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    if counted:
        rows = rows.withColumn("_rk_at", F.row_number().over(inner))
    out = rows.join(heads, key).withColumn(offset, (F.col("_rk_before") + F.col("_rk_own")).cast("long"))
    if counted:
        out = out.withColumn(rank, (F.col("_rk_ahead") + F.col("_rk_at")).cast("long"))
    return out.drop("_rk_own", "_rk_at", "_rk_before", "_rk_ahead")
