"""The corpus pipeline: each stage against a plain version of what it should leave."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from horncast.llm import common, decontaminate, near_dup
from horncast.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, what went in, what came out) of every stage at sf0.001."""
    docs, out = common.read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = common.settle(stage(spark, docs, SF), "test-stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_return_the_columns_of_documents(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes, name
    assert stages[-1][2].columns == [*stages[-1][1].columns, "size", "text_crc32", "law", "shard", "slot"]


def test_quality_drops_bad_documents_and_keeps_good_ones(stages, spark):
    _, before, after = stages[0]
    labels = common.read(spark, SF, "labels").join(before.select("doc_id"), "doc_id", "left_semi")
    kept = labels.join(after.select("doc_id"), "doc_id", "left_semi").groupBy("quality").count().collect()
    every = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    kept = {r["quality"]: r["count"] for r in kept}
    assert kept[1] == every[1] and kept.get(0, 0) <= 0.25 * every[0]  # 87 labels here, of which 11 are bad


def test_one_of_each_class_stays(stages):
    _, before, after = stages[1]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    sets = {i: near_dup.weights_of(t, 5) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and root(i) != root(j) and (texts[i] == texts[j] or near_dup.probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-9):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted({root(i) for i in texts})


def test_no_benchmark_item_is_left_and_nothing_else_goes(stages, spark):
    _, before, after = stages[2]
    items = [decontaminate.exact_shingles(r["text"], 5) for r in common.read(spark, SF, "benchmark").collect()]
    clean = [r["doc_id"] for r in before.collect() if not any(len(x & decontaminate.exact_shingles(r["text"], 5)) >= 0.8 * len(x) for x in items)]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(clean)


def test_mixture_and_shards(stages):
    _, before, after = stages[3]
    had = {r["doc_id"]: r["text"] for r in before.collect()}
    got = after.groupBy("doc_id").count().collect()
    assert all(1 <= r["count"] <= 3 and r["doc_id"] in had for r in got)
    words = lambda df: df.select(F.sum(common.word_count(F.col("text")))).first()[0]
    assert abs(words(after) - words(before)) < 0.2 * words(before)
    counts = [r["count"] for r in stages[4][2].groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1 and sum(counts) == after.count()


def test_run_is_the_stages(stages, spark):
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, stages[-1][2].select("doc_id", "shard", "slot").collect()))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_documents(spark, k):
    """Nulls in any column, empty and repeated rows, clashing names, and no rows at all."""
    rng = random.Random(k)
    good = lambda i: " ".join(f"Word{rng.randrange(500)}" for _ in range(40 + i))
    rows = [(i, good(i), "en", "src1", 10) for i in range(6)] + [(None, None, None, None, None), (7, "", None, None, 0), (7, "", None, None, 0), (8, "w " * 20_000, "en", None, None), (None, good(3), None, "src1", 1)]
    rows += [rows[2], rows[2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("mine") for c in ("score", "size", "shard", "key", "class_key", "copies", "a", "b", "id", "_at", "band")})
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SF).collect()
    assert len(out) <= 3 * len(rows) and all(r["score"] == "mine" and r["shard"] == "mine" for r in out), name
    if name == "near_duplicates":
        assert len(out) == len({r[1] for r in rows if r[1] is not None}) + 1
    assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


CONTRACT = {
    "op2_": ["doc_id:bigint", "held_out:boolean", "score:double", "predicted:int"],
    "op3_": ["page_id:bigint", "payload_bytes:bigint", "payload_digest:string", "record_type:string", "refers_to:bigint"],
    "op5_": ["doc_id:bigint", "held_out:boolean", "lang_pred:string", "score:double"],
    "op6_": ["doc_id:bigint", "size:bigint", "source_size:bigint", "target:double", "taken:bigint"],
    "op7_": ["query_id:bigint", "rank:int", "vec_id:bigint", "score:double"],
    "op8_": ["conv_id:bigint", "n_turns:bigint", "turns_sha256:string", "loss_chars:bigint", "loss_sha256:string", "formatted_chars:bigint"],
    "op9_": ["page_id:bigint", "host:string", "path:string", "rule:string", "verdict:string"],
    "op10_": ["doc_id:bigint", "size:bigint", "text_crc32:bigint", "law:string", "shard:int", "slot:bigint", "grown_shard:int"],
}


@pytest.mark.parametrize("prefix", sorted(CONTRACT))
def test_columns_of_the_contracts(spark, prefix):
    (name,) = [n for n in QUERIES if n.startswith(prefix)]
    got = [f"{c}:{t}" for c, t in QUERIES[name](spark, SF).dtypes]
    assert got[: len(CONTRACT[prefix])] == CONTRACT[prefix]
