"""Every operator beside columns called as its own are, in any case, with dots, or twice; and on workers without the package."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from horncast.llm import ann_tree, chat, common, decontaminate, language_id, mixing, near_dup, quality_crf, sharding, url_filter, warc

#: Names that operators use or used, besides those that they add.
CLASHES = (
    "key _key id _id at _at a b band n el row _row in_0 in_1 text_a leaf bucket _bucket size_ _run _start _passes _whole _drawn _draws _ends _first _step _host _path _keys _best keys best "
    "_mix_key _mix_hash _mix_bucket _stratum _hash _one _place _span _sum _n _rk_own _rk_run _turn _role _parts _alone digest length payload _digest _original of_key near_key won_id label order"
).split()


def crowd(df, *more):
    """``df`` with all of these columns; those it has stay."""
    have = {c.lower() for c in df.columns}
    out = df.withColumns({c: F.lit("mine") for c in (*CLASHES, *more) if c.lower() not in have})
    return out.withColumn("a.dot", F.lit("mine"))


def untouched(out, *names):
    rows = out.collect()
    assert rows
    for c in (*CLASHES, *names, "a.dot"):
        at = out.columns.index(c)
        assert all(r[at] == "mine" for r in rows), c
    lower = [c.lower() for c in out.columns]
    assert len(set(lower)) == len(lower)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [" ".join(f"Word{(i * 7 + j * (1 + i % 3)) % 97}" for j in range(40)) + "." for i in range(12)]
    rows = [(i, t, ("en", "de")[i % 2], ("s", "t", None)[i % 3]) for i, t in enumerate([*texts, texts[0], "", None])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_near_duplicates(docs):
    untouched(near_dup.with_classes(crowd(docs, "CLASS_ID", "Class_Rows")))
    untouched(near_dup.deduplicate(crowd(docs, "class_id")), "class_id")


def test_quality(spark, docs):
    labels = crowd(spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int"))
    model = quality_crf.train(crowd(docs, "quality"), labels, id_column="doc_id", text="text", label="quality")
    untouched(quality_crf.score_texts(crowd(docs, "Score", "N_LINES"), model))


def test_archive(spark):
    pages = crowd(spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x")], "page_id long, URL string, html string"), "record_type", "refers_to", "value")
    got = warc.read_archive(spark, warc.write_archive(pages)).collect()
    assert sorted((r["record_id"], r["url"], r["record_type"]) for r in got) == [("1", "http://a", "response"), ("2", "http://b", "revisit")]


def test_decontamination(spark, docs):
    items = crowd(spark.createDataFrame([("x", docs.where("doc_id = 3").first()["text"]), (None, "nothing of this kind is anywhere")], "ITEM_ID string, text string"))
    assert [tuple(r) for r in decontaminate.contained_items(crowd(docs), items).collect()] == [(3, "x", 1.0)]
    clean = decontaminate.decontaminate(crowd(docs, "containment"), items)
    untouched(clean, "containment")
    assert clean.count() == docs.count() - 1
    dates = spark.createDataFrame([(1,)], "n int").select(F.to_date(F.lit("2020-01-01")).alias("doc_id"), F.lit(docs.where("doc_id = 3").first()["text"]).alias("text"))
    assert decontaminate.contained_items(dates, dates, item_id="doc_id").columns == ["doc_id", "doc_id_item", "containment"]
    assert decontaminate.contained_items(dates, dates, item_id="doc_id").count() == 1


def test_language(docs):
    untouched(language_id.identify(crowd(docs, "Score", "LANG_PRED"), language_id.train(crowd(docs))))


def test_mixing(docs):
    untouched(mixing.mix_sources(crowd(docs, "Size", "TARGET", "copies", "_mix_source"), common.word_count(F.col("text"))), "_mix_source")


def test_vectors(spark):
    rows = crowd(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>"), "v", "query", "rank", "score")
    got = ann_tree.search(rows, lambda i: i % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 3), (20, 29), (20, 28), (20, 27)]


def test_chat(spark):
    turns = crowd(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id long, turn long, role string, text string"), "formatted", "spans", "kind")
    (r,) = chat.digests(chat.format_conversations(turns, chat.text_parts(F.col("text"))), "conv_id").collect()
    assert (r["n_turns"], r["loss_chars"]) == (2, 2)


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    untouched(url_filter.judge_urls(crowd(pages, "Host", "RULE", "verdict"), [("net", "/", "block")]))


def test_shards(docs):
    rows = crowd(docs, "Shard", "SLOT")
    untouched(sharding.shard_interleaved(rows, 4, carry=rows.columns))


def test_two_columns_of_one_name(docs):
    twice = docs.select("*", F.lit("mine").alias("other"), F.lit("mine").alias("other"))
    assert mixing.mix_sources(twice, common.word_count(F.col("text"))).columns.count("other") == 2
    with pytest.raises(KeyError):
        common.Shielded(twice).of("other")


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Run elsewhere, with the package on the driver's path alone."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
        import sys
        from pyspark.sql import SparkSession, functions as F
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        def there(_):
            try:
                import horncast
                return [True]
            except ImportError:
                return [False]
        assert spark.sparkContext.parallelize([0], 1).mapPartitions(there).collect() == [False]
        sys.path.insert(0, {root!r})
        from horncast.llm.queries import QUERIES
        for name in sorted(QUERIES):
            assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0, name
        print("all", len(QUERIES))
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all 10" in done.stdout, done.stderr[-3000:]
