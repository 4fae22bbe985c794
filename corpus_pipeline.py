"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes the documents that the stage before it left, as reread from Parquet.  All but the last
return exactly the columns of ``documents``, whatever these are called: the operators see every column under
a name that cannot clash with their own.

1. quality: documents that the line CRF scores below 0.3 go (also texts without a word: they score 0).
2. near_duplicates: one document of each class of near duplicates stays, that with the least id.
3. decontamination: documents that hold a benchmark item go.
4. mixing: each document is repeated as often as the mix takes it (0 to 3 times); sources get their targets.
5. sharding: rows get a shard and a slot, each shard with the mixture of the whole.

SQL can express none but the last two, so there is no ORACLE_SQL; the tests hold each stage against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horncast.llm import common, decontaminate, mixing, near_dup, quality_crf, sharding
from horncast.llm.queries import MIX_REPEATS, MIX_WEIGHTS, QUALITY_CUT, SHARDS

ID, TEXT, SOURCE = "doc_id", "text", "source"


def _shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names of our own, and name -> own name."""
    names = {c: f"doc_column_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _restored(rows: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()], *more)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _shielded(docs)
    labels = common.read(spark, sf_dir, "labels").where(~quality_crf.held_out("doc_id", 5, 0)).select(F.col("doc_id").alias(names[ID]), "quality")
    model = quality_crf.train(rows, labels, id_column=names[ID], text=names[TEXT], label="quality")
    scored = quality_crf.score_texts(rows, model, text=names[TEXT])
    return _restored(scored.where(F.col("score") >= QUALITY_CUT), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _shielded(docs)
    return _restored(near_dup.deduplicate(rows, text=names[TEXT], id_column=names[ID]), names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _shielded(docs)
    return _restored(decontaminate.decontaminate(rows, common.read(spark, sf_dir, "benchmark"), text=names[TEXT]), names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _shielded(docs)
    mixed = mixing.mix_sources(
        rows, common.word_count(F.col(names[TEXT])), source=names[SOURCE], id_column=names[ID], weights=MIX_WEIGHTS, max_repeats=MIX_REPEATS, shards=SHARDS
    )
    repeated = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return _restored(repeated, names)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _shielded(docs)
    placed = sharding.shard_interleaved(rows, SHARDS, source=names[SOURCE], text=names[TEXT], id_column=names[ID], carry=rows.columns)
    taken = {c.lower() for c in names}
    new = [c if c not in taken else f"shard_{c}" for c in ("size", "text_crc32", "law", "shard", "slot")]
    return placed.select(*[F.col(n).alias(c) for c, n in names.items()], *[F.col(c).alias(n) for c, n in zip(("size", "text_crc32", "law", "shard", "slot"), new, strict=True)])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("sharding", shard)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and reread."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
