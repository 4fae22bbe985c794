"""Classes of an equality: each element's root is the least id of its class.

Few edges (their number is checked) are merged on the driver; more by alternating large-star and small-star
steps over distributed tables, written at each step, until every element has one edge, to one that has none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded, shared_dir

#: Edges that the driver merges itself.
DRIVER_EDGES = 50_000


class UnionFind:
    """Roots are minima; paths are halved."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while x in p:
            if p[x] in p:
                p[x] = p[p[x]]
            x = p[x]
        return x

    def merge(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def roots(edges: DataFrame) -> DataFrame:
    """(tag, el, root) for all elements that are not their class's root; ``edges``: (tag, a, b)."""
    spark = edges.sparkSession
    few = edges.select("tag", "a", "b").where("a != b").limit(DRIVER_EDGES + 1).collect()
    if len(few) <= DRIVER_EDGES:
        found: dict[str, UnionFind] = {}
        for tag, a, b in few:
            found.setdefault(tag, UnionFind()).merge(a, b)
        rows = [(tag, x, u.root(x)) for tag, u in found.items() for x in list(u.parent)]
        return spark.createDataFrame(rows, "tag string, el bigint, root bigint")
    return star_contraction(edges).select("tag", F.col("a").alias("el"), F.col("b").alias("root"))


def star_contraction(edges: DataFrame) -> DataFrame:
    """(tag, a, b) with b the least element of a's class."""
    spark = edges.sparkSession
    base = f"{shared_dir(spark)}/horncast-stars-{uuid.uuid4().hex}"
    step = 0
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def settle(df: DataFrame) -> DataFrame:
        nonlocal step
        step += 1
        df.write.parquet(f"{base}/{step}")
        return spark.read.schema(df.schema).parquet(f"{base}/{step}")

    def starred(df: DataFrame) -> bool:
        """Whether edges end where none begins, one from each element: then they end at the least of its class."""
        ends = F.inline(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))))
        seen = df.select("tag", ends).groupBy("tag", "x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        return seen.where("out > 1 or out = 1 and into = 1").isEmpty()

    def least_of(df: DataFrame) -> DataFrame:
        """Of each element with an edge to a lesser one, the least it has an edge to."""
        return df.groupBy("tag", "a").agg(F.min("b").alias("m"))

    now = settle(edges.select("tag", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"))
    with bounded(spark, fs.getContentSummary(path_of(f"{base}/{step}")).getLength()):
        while True:
            # Large star: what is above an element goes to the least it has an edge to.
            ends = least_of(now).select("tag", F.col("a").alias("b"), "m")
            now = settle(now.join(ends, ["tag", "b"], "left").select("tag", "a", F.coalesce("m", "b").alias("b")).distinct())
            if starred(now):
                return now
            far = now.join(settle(least_of(now)), ["tag", "a"])
            small = far.where("b != m").select("tag", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(far.select("tag", "a", F.col("m").alias("b")))
            now = settle(small.where("a != b").distinct())
