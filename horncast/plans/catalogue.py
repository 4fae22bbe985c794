"""The registered queries of the deductive engine: a theory, tables bound to it, and DuckDB SQL for the same rows.

Results carry natural keys; a class is named by its least key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sugar import poset
from ..model import Model, Theory
from ..operators.store import shared_dir
from ..sources.binding import bind, bind_ids, decode, encode, read_table
from ..streaming.incremental import close_over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def start(spark: SparkSession, source: str, name: str = "theory", **options) -> Model:
    return Theory(source, name).model(spark, **options)


def named(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


# Scans, joins, projections ------------------------------------------------------------------------
@query("SELECT DISTINCT n_nationkey::BIGINT AS n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_scan_pred(spark, sf):
    m = start(spark, "type N; type R; pred in_region(N, R); pred region(R); pred placed(N);\nrule { if in_region(n, r); if region(r); then placed(n); }")
    m.load("in_region", read_table(spark, sf, "nation"), "n_nationkey", "n_regionkey")
    m.load("region", read_table(spark, sf, "region"), "r_regionkey")
    return named(m.close().table("placed"), "n_nationkey")


@query("SELECT c_custkey, n_regionkey::BIGINT AS r_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_func_compose(spark, sf):
    m = start(spark, """
        type C; type N; type R; func nation_of(C) -> N; func region_of(N) -> R; pred lives_in(C, R);
        rule { if r = region_of(nation_of(c)); then lives_in(c, r); }""")
    m.load("nation_of", read_table(spark, sf, "customer"), "c_custkey", "c_nationkey")
    m.load("region_of", read_table(spark, sf, "nation"), "n_nationkey", "n_regionkey")
    return named(m.close().table("lives_in"), "c_custkey", "r_regionkey")


@query("""SELECT DISTINCT c_custkey, s_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey""")
def q_multi_join(spark, sf):
    m = start(spark, """
        type O; type C; type S; type N;
        pred line(O, S); func customer_of(O) -> C; func nation_of(C) -> N; func home_of(S) -> N; pred local(C, S);
        rule { if line(o, s); if c = customer_of(o); if n = nation_of(c); if n = home_of(s); then local(c, s); }""")
    m.load("line", read_table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")
    m.load("customer_of", read_table(spark, sf, "orders"), "o_orderkey", "o_custkey")
    m.load("nation_of", read_table(spark, sf, "customer"), "c_custkey", "c_nationkey")
    m.load("home_of", read_table(spark, sf, "supplier"), "s_suppkey", "s_nationkey")
    return named(m.close().table("local"), "c_custkey", "s_suppkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def q_semi_guard(spark, sf):
    m = start(spark, """
        type O; type C; func customer_of(O) -> C; pred returned(O); pred bad(O);
        rule { if customer_of(o)!; if returned(o); then bad(o); }""")
    m.load("customer_of", read_table(spark, sf, "orders"), "o_orderkey", "o_custkey")
    m.load("returned", read_table(spark, sf, "lineitem").where("l_returnflag = 'R'"), "l_orderkey")
    return named(m.close().table("bad"), "o_orderkey")


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey = l_suppkey")
def q_diagonal(spark, sf):
    m = start(spark, "type K; pred sold(K, K); pred twin(K);\nrule { if sold(k, k); then twin(k); }")
    m.load("sold", read_table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")
    return named(m.close().table("twin"), "k")


@query("SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def q_eq_premise(spark, sf):
    m = start(spark, """
        type N; type R; func region_of(N) -> R; pred near(N, N);
        rule { if r = region_of(a); if s = region_of(b); if r = s; then near(a, b); }""")
    m.load("region_of", read_table(spark, sf, "nation"), "n_nationkey", "n_regionkey")
    return named(m.close().table("near"), "a", "b")


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem")
def q_wildcard(spark, sf):
    m = start(spark, "type P; type S; pred sold(P, S); pred known(P);\nrule { if sold(p, _); then known(p); }")
    m.load("sold", read_table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")
    return named(m.close().table("known"), "p_partkey")


@query("SELECT DISTINCT l_partkey AS p, l_suppkey AS s, 'either' AS how FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O' UNION ALL "
       "(SELECT l_partkey, l_suppkey, 'both' FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, l_suppkey, 'both' FROM lineitem WHERE l_linestatus = 'O')")  # fmt: skip
def q_union_intersect(spark, sf):
    m = start(spark, """
        type P; type S; pred returned(P, S); pred open(P, S); pred either(P, S); pred both(P, S);
        rule { if returned(p, s); then either(p, s); }
        rule { if open(p, s); then either(p, s); }
        rule { if returned(p, s); if open(p, s); then both(p, s); }""")
    lines = read_table(spark, sf, "lineitem")
    m.load("returned", lines.where("l_returnflag = 'R'"), "l_partkey", "l_suppkey")
    m.load("open", lines.where("l_linestatus = 'O'"), "l_partkey", "l_suppkey")
    m.close()
    return named(m.table("either"), "p", "s").withColumn("how", F.lit("either")).unionByName(named(m.table("both"), "p", "s").withColumn("how", F.lit("both")))


# Recursion ----------------------------------------------------------------------------------------
CHAIN = "type E; pred next(E, E); pred reach(E, E);\nrule { if next(x, y); then reach(x, y); }\nrule { if reach(x, y); if reach(y, z); then reach(x, z); }"
CHAIN_SQL = """
WITH RECURSIVE nxt AS (
  SELECT event_id AS x, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events WHERE event_type = 'error'
), reach AS (
  SELECT x, y FROM nxt WHERE y IS NOT NULL UNION SELECT r.x, n.y FROM reach r JOIN nxt n ON r.y = n.x WHERE n.y IS NOT NULL{0}
) SELECT x, y FROM reach"""


def error_chain(spark, sf) -> DataFrame:
    """Consecutive error events of each user."""
    errors = read_table(spark, sf, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return errors.select(F.col("event_id").alias("x"), after.alias("y")).where("y is not null")


@query(CHAIN_SQL.format(""))
def q_tc_chain(spark, sf):
    m = start(spark, CHAIN)
    m.load("next", error_chain(spark, sf))
    return named(m.close().table("reach"), "x", "y")


@query(CHAIN_SQL.format(""))
def q_incremental(spark, sf):
    m = start(spark, CHAIN)
    chain = error_chain(spark, sf)
    m.load("next", chain.where("x % 2 = 0"))
    m.close()
    m.load("next", chain.where("x % 2 = 1"))
    return named(m.close().table("reach"), "x", "y")


@query("""WITH RECURSIVE nxt AS (
  SELECT event_id AS x, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events WHERE event_type = 'error'
), reach AS (
  SELECT x, y, 1 AS n FROM nxt WHERE y IS NOT NULL UNION ALL SELECT r.x, n.y, r.n + 1 FROM reach r JOIN nxt n ON r.y = n.x WHERE n.y IS NOT NULL AND r.n < 4
) SELECT x, y FROM reach""")
def q_close_until(spark, sf):
    m = start(spark, CHAIN)
    m.load("next", error_chain(spark, sf))
    asked = []
    m.close_until(lambda model: asked.append(model.engine.rounds) or len(asked) > 3)  # paths of up to 1, 2 and 4 steps
    return named(m.table("reach"), "x", "y")


@query(CHAIN_SQL.format(""))
def q_stream_closure(spark, sf):
    m = start(spark, CHAIN)
    where = f"{shared_dir(spark)}/horncast-stream-{uuid.uuid4().hex}"
    chain = error_chain(spark, sf)
    for i in range(2):  # files that arrive one after the other
        chain.where(f"x % 2 = {i}").coalesce(1).write.mode("append").parquet(f"{where}/in")
    stream = spark.readStream.schema("x bigint, y bigint").option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    close_over(stream, m, lambda model, batch: model.load("next", batch), f"{where}/checkpoint").awaitTermination()
    return named(m.table("reach"), "x", "y")


@query("""WITH RECURSIVE node AS (SELECT n_nationkey::BIGINT AS k FROM nation UNION SELECT 1000 + r_regionkey FROM region UNION SELECT 2000),
edge AS (SELECT n_nationkey::BIGINT AS x, (1000 + n_regionkey)::BIGINT AS y FROM nation UNION SELECT 1000 + r_regionkey, 2000 FROM region),
below AS (SELECT k AS x, k AS y FROM node UNION SELECT b.x, e.y FROM below b JOIN edge e ON b.y = e.x) SELECT x, y FROM below""")
def q_refl_trans(spark, sf):
    m = start(spark, """
        type P; pred below(P, P);
        rule { if x: P; then below(x, x); }
        rule { if below(x, y); if below(y, z); then below(x, z); }""")
    nations = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("x"), (1000 + F.col("n_regionkey")).cast("long").alias("y"))
    regions = read_table(spark, sf, "region").select((1000 + F.col("r_regionkey")).cast("long").alias("x"), F.lit(2000).cast("long").alias("y"))
    edges = nations.unionByName(regions)
    bind_ids(m, "P", edges.select("x").union(edges.select("y")), "x")
    m.load("below", edges)
    return named(m.close().table("below"), "x", "y")


@query("""SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN nation n ON a.s_nationkey = n.n_nationkey
          JOIN nation o ON n.n_regionkey = o.n_regionkey JOIN supplier b ON b.s_nationkey = o.n_nationkey""")
def q_same_generation(spark, sf):
    m = start(spark, """
        type X; pred parent(X, X); pred top(X); pred same(X, X); pred leaf(X); pred pair(X, X);
        rule { if top(x); then same(x, x); }
        rule { if parent(x, u); if same(u, v); if parent(y, v); then same(x, y); }
        rule { if same(x, y); if leaf(x); if leaf(y); then pair(x, y); }""")
    base = 1_000_000_000
    suppliers = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("x"), (base + F.col("s_nationkey")).cast("long").alias("u"))
    nations = read_table(spark, sf, "nation").select((base + F.col("n_nationkey")).cast("long").alias("x"), (2 * base + F.col("n_regionkey")).cast("long").alias("u"))
    m.load("parent", suppliers.unionByName(nations))
    m.load("top", nations.select("u").distinct(), "u")
    m.load("leaf", suppliers, "x")
    return named(m.close().table("pair"), "x", "y")


# Equality -----------------------------------------------------------------------------------------
@query("""WITH RECURSIVE sold AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
link AS (SELECT DISTINCT a.s AS x, b.s AS y FROM sold a JOIN sold b USING (p)),
reach AS (SELECT DISTINCT s AS x, s AS y FROM sold UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT x AS s_suppkey, min(y) AS class_key FROM reach GROUP BY x""")
def q_components(spark, sf):
    """Suppliers of the same part are merged.  As the values of a function, they cost one edge each, not one for each pair."""
    m = start(spark, "type P; type S; func seller(P) -> S;")
    sold = read_table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    m.load("seller", sold)
    m.close()
    keys = sold.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_suppkey").alias("class_key")).distinct()
    return m.canonical(keys, "class_key", "S")


@query("""SELECT DISTINCT l_orderkey * 8 + l_linenumber AS line, min(l_orderkey * 8 + l_linenumber) OVER (PARTITION BY o_custkey) AS class_key
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q_merge_lines(spark, sf):
    """All lines of a customer are one: more equalities than the driver merges (from scale 0.01 on)."""
    m = start(spark, "type C; type L; type O; func line_of(C) -> L; func line_in(O) -> L;")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    lines = m.settled(read_table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", line.alias("line")).distinct())
    m.load("line_of", lines, "o_custkey", "line")
    m.load("line_in", lines, "o_orderkey", "line")
    m.close()
    return m.settled(m.canonical(lines.select("line", F.col("line").alias("class_key")), "class_key", "L"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS x, (n_nationkey * 2) % 25 AS y FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation WHERE n_nationkey % 5 = 1),
r AS (SELECT n_nationkey AS x, n_nationkey AS y FROM nation UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT a.x::BIGINT AS k, min(a.y)::BIGINT AS class_key FROM r a JOIN r b ON a.x = b.y AND a.y = b.x GROUP BY a.x""")
def q_scc_collapse(spark, sf):
    m = start(spark, "type P;" + poset("P", "le"))
    k = F.col("n_nationkey").cast("long")
    nations = read_table(spark, sf, "nation").select(k.alias("k"))
    bind_ids(m, "P", nations, "k")
    m.load("le", nations.select("k", (F.col("k") * 2 % 25).alias("to")).union(nations.where("k % 5 = 1").select("k", ((F.col("k") + 5) % 25).alias("to"))))
    m.close()
    return m.canonical(nations.withColumn("class_key", F.col("k")), "class_key", "P")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_key FROM documents WHERE text IS NOT NULL")
def q_doc_dedup(spark, sf):
    m = start(spark, "type T; type D; func holder(T) -> D;")
    docs = read_table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest")).where("digest is not null")
    texts = bind(m, "T", docs, "digest")
    m.load("holder", encode(docs, texts, ["digest"], "t"), "t", "doc_id")
    m.close()
    return m.canonical(docs.select("doc_id", F.col("doc_id").alias("class_key")), "class_key", "D")


@query("""WITH RECURSIVE link AS (SELECT DISTINCT a.source AS x, b.source AS y FROM
  (SELECT DISTINCT text, source FROM documents) a JOIN (SELECT DISTINCT text, source FROM documents) b ON a.text = b.text),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT x AS source, min(y) AS class_key FROM reach GROUP BY x""")
def q_congruence(spark, sf):
    """Equal texts make documents equal, and so, by congruence, their sources."""
    m = start(spark, "type T; type D; type S; func holder(T) -> D; func source_of(D) -> S;")
    docs = read_table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest")).where("digest is not null and source is not null")
    texts, sources = bind(m, "T", docs, "digest"), bind(m, "S", docs, "source")
    m.load("holder", encode(docs, texts, ["digest"], "t"), "t", "doc_id")
    m.load("source_of", encode(docs, sources, ["source"], "s"), "doc_id", "s")
    m.close()
    rows = sources.select("source", F.col("el").alias("class_key"))
    return decode(m, m.canonical(rows, "class_key", "S"), "class_key", "S")


# Definitions --------------------------------------------------------------------------------------
@query("SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a CROSS JOIN nation b")
def q_cross_total(spark, sf):
    m = start(spark, "type N; type P; func pair(N, N) -> P;\nrule { if x: N; if y: N; then pair(x, y)!; }")
    bind_ids(m, "N", read_table(spark, sf, "nation"), "n_nationkey")
    return named(m.close().table("pair"), "a", "b")


@query("SELECT c_nationkey::BIGINT AS n_nationkey, c_mktsegment, count(*) AS customers FROM customer GROUP BY ALL")
def q_define_group(spark, sf):
    m = start(spark, """
        type C; type N; type G; type S; func nation_of(C) -> N; func segment_of(C) -> S; func group(N, S) -> G; pred member(C, G);
        rule { if n = nation_of(c); if s = segment_of(c); then g := group(n, s)!; then member(c, g); }""")
    customers = read_table(spark, sf, "customer")
    segments = bind(m, "S", customers, "c_mktsegment")
    m.load("nation_of", customers, "c_custkey", "c_nationkey")
    m.load("segment_of", encode(customers, segments, ["c_mktsegment"], "s"), "c_custkey", "s")
    m.close()
    sizes = m.table("member").groupBy(F.col("c1").alias("g")).agg(F.count(F.lit(1)).alias("customers"))
    groups = named(m.table("group"), "n_nationkey", "c_mktsegment", "g").join(sizes, "g").drop("g")
    return decode(m, groups, "c_mktsegment", "S")


@query("""SELECT p_brand, count(*) FILTER (p_size < 25) = 0 AS made FROM part GROUP BY p_brand""")
def q_define_restricted(spark, sf):
    """Brands with a small part have a shelf; only the others get one made."""
    m = start(spark, "type B; type H; func shelf(B) -> H;\nrule { if b: B; then shelf(b)!; }")
    parts = read_table(spark, sf, "part").select("p_brand", "p_size")
    brands = bind(m, "B", parts, "p_brand")
    given = encode(parts.where("p_size < 25").select("p_brand").distinct(), brands, ["p_brand"], "b")
    bind_ids(m, "H", given, "b")
    m.load("shelf", given.select("b", F.col("b").alias("h")))
    m.close()
    shelves = named(m.table("shelf"), "p_brand", "h").join(given.select(F.col("b").alias("h"), F.lit(False).alias("made")), "h", "left")
    return decode(m, shelves.select("p_brand", F.coalesce("made", F.lit(True)).alias("made")), "p_brand", "B")


@query("SELECT least(a.r_regionkey, b.r_regionkey)::BIGINT AS meet, a.r_regionkey::BIGINT AS x, b.r_regionkey::BIGINT AS y FROM region a CROSS JOIN region b")
def q_meet_semilattice(spark, sf):
    m = start(spark, "type El; func meet(El, El) -> El;" + poset("El", "le") + """
        rule { if x: El; if y: El; then meet(x, y)!; }
        rule { if m = meet(x, y); then le(m, x); then le(m, y); }
        rule { if le(z, x); if le(z, y); if m = meet(x, y); then le(z, m); }""")
    regions = read_table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("k"))
    bind_ids(m, "El", regions, "k")
    m.load("le", regions.select("k", (F.col("k") + 1).alias("up")).join(regions.withColumnRenamed("k", "up"), "up", "left_semi"), "k", "up")
    return named(m.close().table("meet"), "x", "y", "meet")


@query("SELECT 1::BIGINT AS constants, count(*)::BIGINT AS regions FROM region")
def q_empty_premise(spark, sf):
    m = start(spark, "type R; func base() -> R; pred known();\nrule { then base()!; }\nrule { then known(); }")
    bind_ids(m, "R", read_table(spark, sf, "region"), "r_regionkey")
    m.close()
    return m.table("base").agg(F.count(F.lit(1)).alias("constants")).crossJoin(m.elements("R").agg((F.count(F.lit(1)) - 1).alias("regions")))


@query("""WITH node AS (SELECT n_nationkey::BIGINT AS k FROM nation UNION SELECT 100 + r_regionkey FROM region)
SELECT count(*) AS elements, count(DISTINCT k) AS named, (SELECT count(*) FROM nation) AS made, 0::BIGINT AS shared FROM node""")
def q_load_then_define(spark, sf):
    """Ids that only a fact names are elements, and those of made elements are none of them."""
    m = start(spark, "type V; type W; pred edge(V, V); func mark(V) -> W; func twin(V) -> V;\nrule { if edge(x, _); then y := twin(x)!; then mark(y)!; }")
    edges = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("x"), (100 + F.col("n_regionkey")).alias("y"))
    m.load("edge", edges)
    m.close()
    twins, seen = named(m.table("twin"), "x", "el"), edges.select("x").union(edges.select("y")).distinct().toDF("el")
    elements = m.elements("V").join(twins, "el", "left_anti")
    made = twins.agg(F.countDistinct("el").alias("made")).crossJoin(twins.join(seen, "el", "left_semi").agg(F.count(F.lit(1)).alias("shared")))
    return elements.agg(F.count(F.lit(1)).alias("elements"), F.countDistinct("el").alias("named")).crossJoin(made)


@query("SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 2 = 0")
def q_func_insert(spark, sf):
    """A conclusion gives a function its value."""
    m = start(spark, """
        type P; type L; type S; func part(L) -> P; func seller(L) -> S; pred even(P); pred back(L); func seen(P, S) -> S;
        rule { if p = part(l); if s = seller(l); if even(p); if back(l); then seen(p, s) = s; }""")
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("l")
    lines = read_table(spark, sf, "lineitem").select(line, "l_partkey", "l_suppkey", "l_returnflag")
    # Lines that share a number would make their parts equal: the key is made of all of the line.
    lines = lines.withColumn("l", F.abs(F.xxhash64("l", "l_partkey", "l_suppkey", "l_returnflag")))
    m.load("part", lines, "l", "l_partkey")
    m.load("seller", lines, "l", "l_suppkey")
    m.load("even", read_table(spark, sf, "part").where("p_partkey % 2 = 0"), "p_partkey")
    m.load("back", lines.where("l_returnflag = 'R'"), "l")
    return named(m.close().table("seen"), "p", "s", "same").select("p", "s")


@query("SELECT p_brand, min(p_partkey) AS part, count(*) AS parts FROM part GROUP BY p_brand")
def q_equate(spark, sf):
    """Equalities from a table, and single ones; roots and what they make equal."""
    m = start(spark, "type P; pred big(P);")
    parts = read_table(spark, sf, "part").select("p_partkey", "p_brand")
    first = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    pairs = parts.join(first, "p_brand")
    bind_ids(m, "P", parts, "p_partkey")
    one = pairs.where("p_partkey != first").orderBy("p_partkey").first()
    a, b = one["p_partkey"], one["first"]
    m.load_equal("P", pairs, "p_partkey", "first")
    m.equate("P", a, b)
    m.close()
    if not m.are_equal("P", a, b) or m.root("P", a) > a:
        return parts.limit(0)
    classes = m.canonical(parts.withColumn("part", F.col("p_partkey").cast("long")), "part", "P").groupBy("p_brand", "part").agg(F.count(F.lit(1)).alias("parts"))
    return classes.join(m.elements("P"), F.col("part") == F.col("el"), "left_semi").select("p_brand", "part", "parts")


@query("""SELECT o_orderkey, o_custkey AS customer, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned,
          (SELECT c_nationkey FROM customer WHERE c_custkey = o_custkey)::BIGINT AS nation FROM orders""")
def q_holds_eval(spark, sf):
    """Membership and values for a whole table of arguments."""
    m = start(spark, "type O; type C; type N; func customer_of(O) -> C; func nation_of(C) -> N; pred returned(O);")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    m.load("customer_of", orders)
    m.load("nation_of", read_table(spark, sf, "customer"), "c_custkey", "c_nationkey")
    m.load("returned", read_table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey"))
    m.close()
    out = m.eval_all("customer_of", orders.select("o_orderkey"), "o_orderkey", into="customer")
    return m.eval_all("nation_of", m.holds_all("returned", out, "o_orderkey", into="returned"), "customer", into="nation")


@query("""SELECT DISTINCT c_custkey AS c, l_partkey AS p FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
          JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' AND p_size > 40""")
def q_query(spark, sf):
    """Matches of premises that are no rule."""
    m = start(spark, "type O; type C; type P; func customer_of(O) -> C; pred line(O, P); pred big(P); pred builder(C);")
    m.load("customer_of", read_table(spark, sf, "orders"), "o_orderkey", "o_custkey")
    m.load("line", read_table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    m.load("big", read_table(spark, sf, "part").where("p_size > 40"), "p_partkey")
    m.load("builder", read_table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey")
    return m.query("if line(o, p); if c = customer_of(o); if big(p); if builder(c);", ["c", "p"])


@query("SELECT event_type, CASE WHEN event_type = 'error' THEN 'Bad' ELSE 'Named' END AS made, count(*) AS events FROM events GROUP BY ALL")
def q_cases(spark, sf):
    """Elements of an enum made at once and taken apart again."""
    m = start(spark, "type Name; enum Kind { Bad(), Named(Name) } type E; func kind_of(E) -> Kind;")
    events = read_table(spark, sf, "events").select("event_id", "event_type")
    names = bind(m, "Name", events, "event_type")
    kinds = m.define_all("Named", names.where("event_type != 'error'"), "el", into="k").select("event_type", "k")
    m.define("Bad")
    bad = m.define_all("Bad", events.where("event_type = 'error'").select("event_type").distinct(), into="k")
    m.load("kind_of", events.join(kinds.unionByName(bad), "event_type").select("event_id", "k"))
    m.close()
    sizes = m.table("kind_of").groupBy(F.col("c1").alias("el")).agg(F.count(F.lit(1)).alias("events"))
    cases = m.all_cases("Kind").join(sizes, "el")
    labels = names.select(F.col("el").alias("name"), "event_type")
    out = cases.join(labels, F.get("args", F.lit(0)) == F.col("name"), "left")
    return out.select(F.coalesce("event_type", F.lit("error")).alias("event_type"), F.col("case").alias("made"), "events")


# Branches -----------------------------------------------------------------------------------------
@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 OR c_mktsegment = 'BUILDING'")
def q_branch_or(spark, sf):
    m = start(spark, """
        type C; pred rich(C); pred builder(C); pred customer(C); pred chosen(C);
        rule { if customer(c); branch { if rich(c); } along { if builder(c); } then chosen(c); }""")
    customers = read_table(spark, sf, "customer")
    m.load("customer", customers, "c_custkey")
    m.load("rich", customers.where("c_acctbal > 5000"), "c_custkey")
    m.load("builder", customers.where("c_mktsegment = 'BUILDING'"), "c_custkey")
    return named(m.close().table("chosen"), "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F')")
def q_branch_local(spark, sf):
    """A block's variable is not known after it: any order is seen once some order is final."""
    m = start(spark, """
        type O; pred final(O); pred order(O); pred seen(O);
        rule { branch { if final(x); then x = x; } if order(x); then seen(x); }""")
    orders = read_table(spark, sf, "orders")
    m.load("order", orders, "o_orderkey")
    m.load("final", orders.where("o_orderstatus = 'F'"), "o_orderkey")
    return named(m.close().table("seen"), "o_orderkey")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'light' WHEN event_type = 'purchase' THEN 'heavy' ELSE 'other' END AS weight FROM events")
def q_match_enum(spark, sf):
    m = start(spark, """
        type E; type Name;
        enum Kind { Click(), View(), Purchase(), Other(Name) }
        func kind_of(E) -> Kind; pred light(E); pred heavy(E); pred other(E);
        rule {
            if k = kind_of(e);
            match k { Click() => { then light(e); } View() => { then light(e); } Purchase() => { then heavy(e); } Other(_) => { then other(e); } }
        }""")
    events = read_table(spark, sf, "events").select("event_id", "event_type")
    names = bind(m, "Name", events.where("event_type not in ('click', 'view', 'purchase')"), "event_type")
    constants = {t: m.define(c) for t, c in (("click", "Click"), ("view", "View"), ("purchase", "Purchase"))}
    others = m.define_all("Other", names, "el", into="k")
    kind = F.create_map(*[F.lit(x) for pair in constants.items() for x in pair])
    m.load("kind_of", events.select("event_id", kind[F.col("event_type")].alias("k")))
    m.load("kind_of", events.join(others.select("event_type", "k"), "event_type").select("event_id", "k"))
    m.close()
    found = [named(m.table(w), "event_id").withColumn("weight", F.lit(w)) for w in ("light", "heavy", "other")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""WITH big AS (SELECT p_partkey AS p FROM part WHERE p_size > 40), sold AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT p, -1::BIGINT AS s FROM big UNION ALL SELECT p, s FROM big JOIN sold USING (p)""")
def q_interleaved(spark, sf):
    m = start(spark, """
        type P; type S; pred big(P); pred sold(P, S); pred listed(P); pred offer(P, S);
        rule { if big(p); then listed(p); if sold(p, s); then offer(p, s); }""")
    m.load("big", read_table(spark, sf, "part").where("p_size > 40"), "p_partkey")
    m.load("sold", read_table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")
    m.close()
    return named(m.table("listed"), "p").withColumn("s", F.lit(-1).cast("long")).unionByName(named(m.table("offer"), "p", "s"))


# Models and morphisms -----------------------------------------------------------------------------
TWO_MODELS = """
type C; type S; pred rich(C);
model Country { type Who; pred has(C); pred rich(C); rule { if has(c); if rich(c); then rich(c); } }
model Market { type Who; pred has(S, C); pred big(S); rule { if has(s, c); if has(s, d); if c = d; then big(s); } }
rule { if n: Country; if n.rich(c); if m: Market; if m.has(_, c); then rich(c); }
"""


@query("""SELECT 'country' AS model, c_nationkey::BIGINT AS place, c_custkey AS who FROM customer UNION ALL
          SELECT 'market', dense_rank() OVER (ORDER BY c_mktsegment) - 1, c_custkey FROM customer UNION ALL
          SELECT 'both', -1, c_custkey FROM customer WHERE c_acctbal > 5000""")
def q_two_models(spark, sf):
    """Two models whose members have the same names, of different shapes."""
    m = start(spark, TWO_MODELS)
    customers = read_table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("n"), F.col("c_mktsegment").alias("s"), "c_acctbal")
    ranks = customers.select("s").distinct().withColumn("k", (F.row_number().over(Window.orderBy("s")) - 1).cast("long"))  # a handful of segments
    sold = customers.join(ranks, "s")
    m.load("Country.has", customers, "n", "c_custkey")
    m.load("Country.rich", customers.where("c_acctbal > 5000"), "n", "c_custkey")
    m.load("Market.has", sold.withColumn("seller", F.lit(7)), "k", "seller", "c_custkey")
    m.close()
    place = lambda df, model, *names: named(df, *names).select(F.lit(model).alias("model"), "place", "who")
    both = named(m.table("rich"), "who").select(F.lit("both").alias("model"), F.lit(-1).cast("long").alias("place"), "who")
    return place(m.table("Country.has"), "country", "place", "who").unionByName(place(m.table("Market.has"), "market", "place", "seller", "who")).unionByName(both)


@query("""WITH sold AS (SELECT DISTINCT s_nationkey AS n, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
          SELECT n::BIGINT AS area, p, TRUE AS wide FROM sold WHERE p % 2 = 1 UNION ALL SELECT n, p, FALSE FROM sold WHERE p % 2 = 0""")
def q_ambient_own(spark, sf):
    """Members without a prefix mean those of the model's own element; ``own`` leaves out what arrows bring."""
    m = start(spark, "type Part; model Area { pred has(part: Part); pred odd(part: Part); pred wide(part: Part); rule { if has(p); if odd(p); then wide(p); } }")
    areas(spark, sf, m)
    sold = sold_in(spark, sf)
    m.load("has", sold)
    m.load("odd", sold.where("p % 2 = 1"))
    m.close()
    own = lambda name: named(m.own(name), "area", "p")
    return own("has").join(own("wide").withColumn("wide", F.lit(True)), ["area", "p"], "left").select("area", "p", F.coalesce("wide", F.lit(False)).alias("wide"))


AREAS = "model Area { type Who; pred has(part: Part); }"


def areas(spark, sf, m: Model, world: bool = False) -> None:
    """Area elements: nations as they are, regions from 1000 on, the world 2000; arrows from part to whole."""
    nations = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("a"), (1000 + F.col("n_regionkey")).cast("long").alias("b"))
    arrows = nations.withColumn("f", F.col("a"))
    if world:
        regions = read_table(spark, sf, "region").select((1000 + F.col("r_regionkey")).cast("long").alias("a"), F.lit(2000).cast("long").alias("b"))
        arrows = arrows.unionByName(regions.withColumn("f", F.col("a")))
    bind_ids(m, "Area", arrows.select("a").union(arrows.select("b")), "a")
    bind_ids(m, "AreaMor", arrows, "f")
    m.load("area_mor_dom", arrows, "f", "a")
    m.load("area_mor_cod", arrows, "f", "b")


def sold_in(spark, sf) -> DataFrame:
    """(nation, part) for suppliers' parts."""
    home = read_table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("a"))
    return read_table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().join(home, F.col("l_suppkey") == F.col("s_suppkey")).select("a", F.col("l_partkey").alias("p")).distinct()


@query("SELECT s_nationkey::BIGINT AS area, s_suppkey FROM supplier")
def q_model_member(spark, sf):
    m = start(spark, "type Part;" + AREAS + " pred lives(Area, Area); rule { if a: Area; if w: a.Who; then lives(a, a); then w = w; }")
    suppliers = read_table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("a"))
    bind_ids(m, "Who", suppliers, "s_suppkey")
    bind_ids(m, "Area", suppliers, "a")
    m.load("area_member_who", suppliers, "a", "s_suppkey")
    m.close()
    inside = named(m.table("area_member_who"), "area", "s_suppkey")
    return inside.join(named(m.table("lives"), "area", "same"), "area", "left_semi")


INHERIT_SQL = """WITH sold AS (SELECT DISTINCT s_nationkey AS n, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT n::BIGINT AS area, p FROM sold UNION SELECT 1000 + n_regionkey, p FROM sold JOIN nation ON n = n_nationkey"""


@query(INHERIT_SQL)
def q_morphism_inherit(spark, sf):
    m = start(spark, "type Part;" + AREAS)
    areas(spark, sf, m)
    m.load("has", sold_in(spark, sf))
    return named(m.close().table("has"), "area", "p")


@query(INHERIT_SQL + " UNION SELECT 2000, p FROM sold")
def q_morphism_compose(spark, sf):
    m = start(spark, "type Part;" + AREAS)
    areas(spark, sf, m, world=True)
    m.load("has", sold_in(spark, sf))
    return named(m.close().table("has"), "area", "p")


@query("SELECT (1000 + n_regionkey)::BIGINT AS area, count(*) AS members FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def q_mor_app(spark, sf):
    """Every customer has an image in the region of its nation."""
    m = start(spark, "type Part;" + AREAS + """
        rule { if a: Area; if x: a.Who; if dom(f) = a; if cod(f)!; then f@(x)!; }""")
    areas(spark, sf, m)
    customers = read_table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    bind_ids(m, "Who", customers, "c_custkey")
    m.load("area_member_who", customers, "a", "c_custkey")
    m.close()
    members = named(m.table("area_member_who"), "area", "who").where("area >= 1000")
    return members.groupBy("area").agg(F.count(F.lit(1)).alias("members"))
