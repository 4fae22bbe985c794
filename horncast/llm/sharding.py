"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; row r of a source of n rows has the
fractional rank (r - 1/2) / n.  Sorted by fractional rank, the sources interleave in proportion, and the
sorted line is cut into shards whose row counts are at most one apart (law ``rows``).  Any run of the line,
hence any shard, has the mixture of the whole.

No task holds a source or the whole line: ranks are taken within hash buckets, places within ranges of the
fractional rank, each with prefix sums of bucket counts (``common.ranked``).

Defined results: a null source is a stratum of its own; a null text has size 1 and the checksum of no byte,
0; rows that agree in everything share their places in any order; an empty table gives an empty result.
``carry`` names columns of the input that the result has; a column called as a new one is not carried, other
names are free.  Equal texts are not kept together: the law is on rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RANK_BLOCK_ROWS, Shielded, group_key, ranked, settle, text_bytes

NEW = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_interleaved(
    docs: DataFrame, shards: int, *, source: str = "source", text: str = "text", id_column: str = "doc_id", seed: int = 29, carry: list[str] | None = None
) -> DataFrame:
    """(carried columns, size, text_crc32, law, shard, slot, grown_shard); ``carry``: the id only, unless named."""
    held, wanted = Shielded(docs), [id_column] if carry is None else carry
    wanted = [c for c in wanted if c.lower() not in NEW]
    keep = list(dict.fromkeys(held.of(c) for c in wanted))
    said, key = F.col(held.of(text)), F.col(held.of(id_column))
    rows = held.rows.select(
        *keep,
        (text_bytes(said) + 1).alias("size"),
        F.coalesce(F.crc32(said), F.lit(0)).cast("long").alias("text_crc32"),
        group_key(F.col(held.of(source))).alias("_stratum"),
        key.alias("_id"),
        F.xxhash64(key, F.lit(seed)).alias("_hash"),
        F.lit(1).cast("long").alias("_one"),
    )
    strata = settle(rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_rows")), "strata")
    facts = strata.agg(F.sum("_rows").alias("total"), F.max("_rows").alias("most")).first()
    total, most = facts["total"] or 0, facts["most"] or 0
    buckets = max(1, -(-most // RANK_BLOCK_ROWS))
    rows = rows.withColumn("_bucket", F.expr(f"cast(((_hash >> 32) + 2147483648) * {buckets} >> 32 as int)"))
    order = [F.col("_hash"), F.col("_id"), F.col("text_crc32"), F.col("size")]
    rows = ranked(rows, ["_stratum"], "_bucket", order, "_one", "_ahead_of")
    rows = rows.join(strata, "_stratum")
    spans = max(1, -(-total // RANK_BLOCK_ROWS))
    rows = rows.withColumn("_fraction", (F.col("_ahead_of") + 0.5) / F.col("_rows"))
    rows = rows.withColumn("_span", F.least(F.floor(F.col("_fraction") * spans), F.lit(spans - 1)).cast("int"))
    tie = [F.col("_fraction"), F.col("_stratum"), F.col("_ahead_of")]
    line = ranked(rows, [], "_span", tie, "_one", "_place")
    # Shard i begins at place floor(i * total / shards).
    shard = F.expr(f"((_place + 1) * {int(shards)} - 1) div {max(1, total)}")
    line = line.withColumns({"law": F.lit("rows"), "shard": shard.cast("int"), "grown_shard": F.lit(None).cast("int")})
    slot = F.col("_place") - F.expr(f"(cast(shard as bigint) * {total}) div {int(shards)}")
    return held.restore(line.withColumn("slot", slot.cast("long")), NEW, wanted)
