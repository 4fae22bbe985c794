"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Targets: every source has a weight; the total size is shared by weight, no source gets more than
   ``max_repeats`` times its own size, and the excess is shared again by weight until none is above.
2. Blocks: the total is cut into blocks of ``BLOCK_TOKENS`` tokens (fewer where the table is tiny), an equal
   number for each of ``shards``.  Seats (blocks) go to the sources with the highest quotients
   target / (2k - 1).  The first j x blocks_per_shard seats belong to the first j shards, so that a shard's
   quota of a source is the difference of two allotments; Sainte-Lague never takes a seat back as the house grows.
3. Selection: a source's documents are put in a seeded order and laid end to end, and this line is cut into its
   own blocks of the same size (the last one may be shorter).  A seeded permutation of the blocks is the order
   in which they are drawn, once through for each pass.  The first shard draws its quota of whole blocks, then
   the second one, and so on.  What is drawn in all is the source's target to the token: the rest of less than
   a block or so that whole blocks leave (or have too much) is added to, or taken from, the end of the draw, so
   that a source smaller than a block is not lost.

A document's ``taken`` tokens are those of it that were drawn, by any shard in any pass, and ``shard_taken``
says how many each shard drew.  ``copies`` counts the passes that drew the document's middle.

Everything that is handled per source is a table of one row per source (or source and shard); documents
move once, by (source, hash bucket), with their size and key columns.

Defined results: a null text has size 0; a null source is a source of its own, after all others; documents
of size 0 take 0 tokens and have no copy; repeated rows are taken row by row; an empty table gives an empty
result; a total of 0 gives targets of 0.  Columns of the input are kept, whatever their names, but for those
that are called as the new ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RANK_BLOCK_ROWS, Shielded, group_key, ranked, settle

NEW = ("size", "source_size", "target", "taken", "copies", "shard_taken")
#: Tokens of a block; more where a table has so many that their number would be too large to permute.
BLOCK_TOKENS, MOST_BLOCKS = 256, 1 << 36


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeats: float) -> DataFrame:
    """``sizes``: (source, source_size, n).  Adds ``place``, ``weight`` and ``target``."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    # One row per source.
    t = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", F.get(ws, (F.col("place") - 1) % len(weights)))
    t = settle(t.withColumn("cap", F.col("source_size") * float(max_repeats)), "sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    rate, full = None, -1
    while True:
        capped = (F.col("weight") * F.lit(rate) > F.col("cap")) if rate is not None else F.lit(False)
        got = t.agg(
            F.count(F.when(capped, 1)).alias("n"),
            F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if got["n"] == full or not got["open"]:
            break
        full, rate = got["n"], (total - got["fixed"]) / got["open"]
    return t.withColumn("target", F.least(F.col("weight") * F.lit(float(rate or 0.0)), F.col("cap"))).drop("cap")


def allot(sources: DataFrame, houses: Sequence[int]) -> DataFrame:
    """Sainte-Lague: (source, place, house, seats) for each house size.

    With S sources, a divisor of total / (house - S / 2) hands out no more seats than there are; those
    are certain.  Only the up to S seats that remain are dealt one by one, by highest quotient (ties:
    the earlier source), among at most 3 S + S candidates.
    """
    facts = sources.agg(F.sum("target").alias("total"), F.count(F.lit(1)).alias("s")).first()
    total, s = facts["total"] or 0.0, facts["s"]
    each = sources.select("source", "place", "target", F.explode(F.array(*[F.lit(int(h)) for h in houses])).alias("house"))
    if not total:
        return each.select("source", "place", "house", F.lit(0).cast("long").alias("seats"))
    share = F.col("target") / F.lit(float(total))
    sure = F.floor(share * F.greatest(F.col("house") - s / 2.0, F.lit(0.0)) + 0.5).cast("long")
    sure = F.when(F.col("target") > 0, F.greatest(sure, F.lit(0))).otherwise(F.lit(0))
    # A house smaller than half the sources has no certain seats.
    base = each.withColumn("sure", F.when(F.col("house") > s / 2.0, sure).otherwise(F.lit(0)).cast("long"))
    left = F.col("house") - F.sum("sure").over(Window.partitionBy("house"))
    more = F.ceil(share * (s + 2)).cast("long") + 2
    tries = base.withColumn("left", left).select("*", F.explode(F.sequence(F.lit(1).cast("long"), more)).alias("k")).where("target > 0")
    quotient = F.col("target") / (2 * (F.col("sure") + F.col("k")) - 1)
    order = Window.partitionBy("house").orderBy(quotient.desc(), "place")
    won = tries.withColumn("at", F.row_number().over(order)).where("at <= left").groupBy("place", "house").agg(F.count(F.lit(1)).alias("won"))
    return base.join(won, ["place", "house"], "left").select("source", "place", "house", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("seats"))


def shard_quotas(sources: DataFrame, shards: int, blocks_per_shard: int) -> DataFrame:
    """(source, place, shard, quota): whole blocks of each source for each shard."""
    seats = allot(sources, [(j + 1) * blocks_per_shard for j in range(shards)])
    before = F.lag("seats", 1, 0).over(Window.partitionBy("place").orderBy("house"))
    return seats.select("source", "place", (F.col("house") / blocks_per_shard - 1).cast("int").alias("shard"), (F.col("seats") - before).alias("quota"))


def next_primes(start: int, n: int) -> list[int]:
    """The first ``n`` primes from ``start`` on (of about 26 bits: trial division will do)."""
    out, x = [], start | 1
    while len(out) < n:
        if all(x % d for d in range(3, int(x**0.5) + 1, 2)):
            out.append(x)
        x += 2
    return out


def draw_plan(quotas: DataFrame, sources: DataFrame, shards: int, block: int, max_repeats: int, seed: int) -> DataFrame:
    """One row for each source: where each shard's draw ends, in tokens, and the permutation of its blocks.

    Block b of n whole ones is drawn as number (b * step + first) mod n; ``step`` is a prime that does not
    divide n (of three primes above 2**25, one does not).  A last block that is shorter is always drawn last.
    """
    per = quotas.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("quotas"))  # as many as shards
    drawn = F.least(F.round("target").cast("long"), F.col("source_size") * max_repeats)
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.aggregate(F.slice("quotas", 1, j), F.lit(0).cast("long"), lambda s, q: s + q["quota"]) * block)
    whole = F.expr(f"source_size div {block}")
    primes = next_primes((1 << 25) + seed % 1000 * 64, 3)
    step = F.when(whole % primes[0] != 0, primes[0]).when(whole % primes[1] != 0, primes[1]).otherwise(primes[2])
    plan = sources.join(per, "place").withColumns({"_drawn": drawn, "_whole": whole, "_ends": ends})
    last = lambda e, i: F.when(i == shards - 1, F.col("_drawn")).otherwise(F.least(e, F.col("_drawn")))
    return plan.select(
        group_key(F.col("source")).alias("_mix_key"), "source_size", "target", "_drawn", "_whole", F.transform("_ends", last).alias("_ends"),
        F.when(F.col("_whole") > 0, F.pmod(step, F.col("_whole"))).otherwise(0).cast("long").alias("_step"),
        F.when(F.col("_whole") > 0, F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.lit(seed + 1)), F.col("_whole"))).otherwise(0).cast("long").alias("_first"),
    )


def draws(block: int, max_repeats: int) -> Column:
    """The runs [lo, hi) of a source's draw, in tokens, that are a row's: of each block it lies in, in each pass."""
    at, end = F.col("_at"), F.col("_at") + F.col("size")
    blocks = F.when(F.col("size") > 0, F.sequence(F.expr(f"_at div {block}"), F.expr(f"(_at + size - 1) div {block}"))).otherwise(F.array().cast("array<bigint>"))
    number = lambda b: F.when(b < F.col("_whole"), F.pmod(b * F.col("_step") + F.col("_first"), F.greatest(F.col("_whole"), F.lit(1)))).otherwise(b)

    def runs(b: Column) -> Column:
        begin, stop = F.greatest(at, b * block), F.least(end, (b + 1) * block)
        lo = number(b) * block + begin - b * block
        return F.transform(
            F.array(*[F.lit(p).cast("long") for p in range(max_repeats)]),
            lambda p: F.struct((p * F.col("source_size") + lo).alias("lo"), F.least(p * F.col("source_size") + lo + stop - begin, F.col("_drawn")).alias("hi"), (b * block).alias("at")),
        )

    return F.filter(F.flatten(F.transform(blocks, runs)), lambda x: x["hi"] > x["lo"])


def mix_sources(
    docs: DataFrame,
    size: Column,
    *,
    source: str = "source",
    id_column: str = "doc_id",
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_repeats: int = 3,
    shards: int = 16,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (both of the row's source), ``taken``, ``copies`` and ``shard_taken``."""
    held = Shielded(docs, NEW)
    named = docs.select("*", size.cast("long")).toDF(*held.rows.columns, "size")
    of, key = F.col(held.of(source)), F.col(held.of(id_column))
    rows = named.select(*held.rows.columns, "size", of.cast("string").alias("_mix_source"), group_key(of).alias("_mix_key"), F.xxhash64(key, F.lit(seed)).alias("_mix_hash"))
    # All statistics come from a narrow table, so that sizes are not taken from the texts each time.
    narrow = settle(rows.select("size", "_mix_source", "_mix_key", "_mix_hash"), "sized")
    per = narrow.groupBy("_mix_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).withColumnRenamed("_mix_source", "source")
    sources = source_targets(per, weights, max_repeats)
    facts = sources.agg(F.sum("source_size").alias("total"), F.max("n").alias("n")).first()
    total, most = facts["total"] or 0, facts["n"] or 0
    block = max(1, min(block_tokens, total // shards), -(-total // MOST_BLOCKS))
    quotas = settle(shard_quotas(sources, shards, max(1, total // (shards * block))), "quotas")
    plan = settle(draw_plan(quotas, sources, shards, block, max_repeats, seed), "plan")
    buckets = max(1, -(-most // RANK_BLOCK_ROWS))
    bucket = F.expr(f"cast(((_mix_hash >> 32) + 2147483648) * {buckets} >> 32 as int)")
    order = [F.col("_mix_hash"), key, F.col("size")]
    dealt, counted = rows.withColumn("_mix_bucket", bucket), narrow.withColumn("_mix_bucket", bucket)
    placed = ranked(dealt, ["_mix_key"], "_mix_bucket", order, "size", "_at", totals_of=counted).join(plan, "_mix_key")
    drawn = placed.withColumn("_draws", draws(block, max_repeats))
    length = lambda s, x: s + x["hi"] - x["lo"]
    taken = F.aggregate("_draws", F.lit(0).cast("long"), length)
    # The middle token is drawn in a pass if the run of its block goes on until there.
    middle = F.col("_at") + F.expr("size div 2")
    reach = lambda x: middle - F.greatest(F.col("_at"), x["at"])
    copies = F.size(F.filter("_draws", lambda x: (x["at"] <= middle) & (middle < x["at"] + block) & (x["lo"] + reach(x) < x["hi"])))

    def of_shard(j: Column) -> Column:
        low, high = F.when(j == 0, F.lit(0).cast("long")).otherwise(F.get("_ends", j - 1)), F.get("_ends", j)
        return F.aggregate("_draws", F.lit(0).cast("long"), lambda s, x: s + F.greatest(F.lit(0).cast("long"), F.least(x["hi"], high) - F.greatest(x["lo"], low)))

    out = drawn.withColumns({
        "target": F.col("target").cast("double"), "source_size": F.col("source_size").cast("long"), "taken": taken, "copies": copies.cast("int"),
        "shard_taken": F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), of_shard),
    })
    return held.restore(out, NEW)
