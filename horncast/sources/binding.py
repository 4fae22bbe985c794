"""Natural keys and element ids.

``bind`` gives every distinct key an element, once: keys that are bound already keep theirs, and new ones are
added to the dictionary.  ``bind_ids`` takes integer keys as ids themselves, which saves the join.  ``encode`` and ``decode`` go from one to the other;
decoding a merged class gives its least key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Model


def read_table(spark: SparkSession, folder: str, name: str, kind: str = "parquet") -> DataFrame:
    """A table of a folder; ``kind`` is any format that Spark reads."""
    return spark.read.format(kind).load(f"{folder}/{name}.{kind}")


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.format(kind).mode(mode).save(path)


def bind_ids(model: Model, type_name: str, df: DataFrame, column: str) -> None:
    """Elements from a column of integers, which are the ids; nulls are left out."""
    model.load(type_name, df.select(F.col(column).cast("long").alias("c0")).distinct(), "c0")


def bind(model: Model, type_name: str, df: DataFrame, *keys: str) -> DataFrame:
    """An element for each distinct key; the whole dictionary (el, keys...).  A key with a null part has none."""
    spark, type_name = model.spark, model.type_name(type_name)
    known = model.dictionaries.get(type_name)
    if known is not None and len(known.columns) != len(keys) + 1:
        raise ValueError(f"keys of {type_name} have {len(known.columns) - 1} columns")
    if any(type_name in model.relation(n).columns for n, _ in model.frames):
        model.flush()  # their ids are taken
    model.engine.raise_ids({type_name})
    model.store.writes += 1
    path = f"{model.store.root}/keys-{model.store.writes:05d}"
    names = [f"key_{i}" for i in range(len(keys))]
    distinct = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).dropna().distinct()
    if known is not None:
        distinct = distinct.join(known.toDF("el", *names).drop("el"), names, "left_anti")
    distinct.withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{path}-raw")
    stored = spark.read.schema(distinct.schema.add("at", "long")).parquet(f"{path}-raw").withColumn("part", F.shiftright("at", 33))
    shifts, base = [], model.engine.next_id[type_name]
    for part, lo, n in sorted(map(tuple, stored.groupBy("part").agg(F.min("at"), F.count(F.lit(1))).collect())):
        shifts.append((part, base - lo))
        base += n
    files, schema = model.key_files.get(type_name, ([], None))
    if shifts:
        model.engine.next_id[type_name] = base
        shift = spark.createDataFrame(shifts, "part bigint, shift bigint")
        new = stored.join(F.broadcast(shift), "part").select((F.col("at") + F.col("shift")).alias("el"), *names)
        new.write.parquet(path)
        files, schema = [*files, path], schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
        model.load(type_name, spark.read.schema(schema).parquet(path), "el")
    if not files:
        return spark.createDataFrame([], T.StructType([T.StructField("el", T.LongType()), *[T.StructField(k, df.schema[k].dataType) for k in keys]]))
    model.key_files[type_name] = (files, schema)
    model.dictionaries[type_name] = spark.read.schema(schema).parquet(*files).toDF("el", *keys)
    return model.dictionaries[type_name]


def encode(df: DataFrame, dictionary: DataFrame, keys: list[str], into: str) -> DataFrame:
    """``df`` with the element of its keys; rows whose key is null or not bound are dropped."""
    names = [c for c in dictionary.columns if c != "el"]
    d = dictionary.select(F.col("el").alias(into), *[F.col(n).alias(f"_key{i}") for i, n in enumerate(names)])
    on = [F.col(k) == F.col(f"_key{i}") for i, k in enumerate(keys)]
    return df.join(d, on).drop(*[f"_key{i}" for i in range(len(names))])


def class_keys(model: Model, type_name: str, dictionary: DataFrame) -> DataFrame:
    """(el, keys...) with one row for each class: its root and its least key."""
    keys = [c for c in dictionary.columns if c != "el"]
    rooted = model.canonical(dictionary, "el", type_name)
    return rooted.groupBy("el").agg(F.min(F.struct(*keys)).alias("key")).select("el", *[F.col(f"key.{k}").alias(k) for k in keys])


def decode(model: Model, df: DataFrame, column: str, type_name: str, dictionary: DataFrame | None = None) -> DataFrame:
    """``df`` with a column of elements replaced by their class's least key."""
    names = class_keys(model, type_name, dictionary if dictionary is not None else model.dictionaries[type_name])
    key = [c for c in names.columns if c != "el"]
    joined = df.join(names.select(F.col("el").alias("_el"), *[F.col(k).alias(f"_key_{k}") for k in key]), F.col(column) == F.col("_el"))
    out = []
    for c in df.columns:
        out += [F.col(f"_key_{k}").alias(c if len(key) == 1 else f"{c}_{k}") for k in key] if c == column else [F.col(c)]
    return joined.select(*out)
