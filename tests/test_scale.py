"""Work and memory that must not grow faster than the tables."""

from pyspark.sql import functions as F

from horncast import Theory
from horncast.operators import premise

SAME = """type X; pred parent(X, X); pred top(X); pred same(X, X); pred leaf(X); pred pair(X, X);
    rule { if top(x); then same(x, x); }
    rule { if parent(x, u); if same(u, v); if parent(y, v); then same(x, y); }
    rule { if same(x, y); if leaf(x); if leaf(y); then pair(x, y); }"""


def same_generation(spark, parents):
    m = Theory(SAME, "same").model(spark)
    m.load("parent", spark.createDataFrame(parents, "a long, b long"))
    m.load("top", spark.createDataFrame([(100,), (101,)], "a long"))
    m.load("leaf", spark.createDataFrame([(x,) for x in range(10)], "a long"))
    return m


def test_matches_of_small_tables_are_dealt_out_and_not_made_distinct(spark, monkeypatch):
    monkeypatch.setattr(premise, "MANY_ROWS", 1)
    parents = [(x, 100 + x % 2) for x in range(10)]
    for more in ([], [(0, 101)]):  # a child of two parents: matches repeat
        m = same_generation(spark, parents + more)
        m.flush(merge=True)
        m.engine.take(*m.engine.rules_round())
        rule = next(r for r in m.engine.plain if len(r.premise) == 3 and len({a.relation for a in r.premise}) == 2 and r.insert.relation == "same")
        assert m.engine.one_to_one(rule) is (not more)
        (tag, sole, rows) = next(f for f in m.engine.conclusions() if f[0] == "same")
        assert (sole is rule) is (not more)
        assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        up = {}
        for x, u in parents + more:
            up.setdefault(x, set()).add(u)
        got = sorted(map(tuple, m.close().table("pair").collect()))
        assert got == [(x, y) for x in range(10) for y in range(10) if up[x] & up[y]]


def test_only_relations_with_new_rows_are_compared_with_what_is_known(spark, monkeypatch):
    from horncast.operators import engine

    monkeypatch.setattr(engine, "MUCH_BYTES", 0)
    m = same_generation(spark, [(x, 100 + x % 2) for x in range(10)])
    compared, known_rows = [], m.engine.known_rows
    monkeypatch.setattr(m.engine, "known_rows", lambda names: compared.append(names) or known_rows(names))
    assert m.close().table("pair").count() == 50
    assert compared == [["same"]]  # and not again when the pairs are made


def test_much_that_is_known_is_not_derived_again(spark, monkeypatch):
    from horncast.operators import engine

    monkeypatch.setattr(engine, "MUCH_BYTES", 0)
    for few in (0, 4 << 20):
        monkeypatch.setattr(engine, "FEW_BYTES", few)
        m = Theory("type V; pred e(V, V); pred r(V, V);\nrule { if e(x, y); then r(x, y); }\nrule { if r(x, y); if r(y, z); then r(x, z); }", "tc").model(spark)
        m.load("e", spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)], "a long, b long"))
        assert sorted(map(tuple, m.close().table("r").collect())) == [(a, b) for a in range(6) for b in range(6)]


def test_stars_of_functions_are_merged_in_one_pass(spark, monkeypatch):
    from horncast.operators import components

    monkeypatch.setattr(components, "DRIVER_EDGES", 0)
    passes, union = [], components.F.coalesce
    monkeypatch.setattr(components.F, "coalesce", lambda *c: passes.append(c) or union(*c))
    # Orders 1..4 of lines, merged in orders and in customers: the least of an order has an edge to the least of its customer.
    rows = [("L", x, x - x % 10) for x in range(100) if x % 10] + [("L", x, x - x % 50) for x in range(100) if x % 50]
    got = components.roots(spark.createDataFrame(rows, "tag string, a long, b long")).collect()
    assert sorted(map(tuple, got)) == [("L", x, x - x % 50) for x in range(100) if x % 50]
    assert len(passes) == 1


def test_stars_agree_with_the_driver(spark, monkeypatch):
    import random

    from horncast.operators import components

    r = random.Random(1)
    rows = [(t, r.randrange(60), r.randrange(60)) for t in "AB" for _ in range(45)] + [("C", i, i + 1) for i in range(40)] + [("C", 3, 3), ("D", 5, 5)]
    edges = spark.createDataFrame(rows, "tag string, a long, b long")
    want = sorted(map(tuple, components.roots(edges).collect()))
    monkeypatch.setattr(components, "DRIVER_EDGES", 0)
    assert sorted(map(tuple, components.roots(edges).collect())) == want


def test_tables_come_in_by_tasks_of_bounded_size(spark, monkeypatch):
    from horncast import model
    from horncast.operators import store

    monkeypatch.setattr(store, "PARTITION_BYTES", 100)
    monkeypatch.setattr(model, "SETTLED_BYTES", 1)
    seen, write = [], store.Store.write
    settings = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.maxConcurrentOutputFileWriters")
    before = [spark.conf.get(s, None) for s in settings]
    monkeypatch.setattr(store.Store, "write", lambda self, rows: seen.append([spark.conf.get(s) for s in settings]) or write(self, rows))
    m = Theory("type O; type C; func of(O) -> C; pred big(C);", "t").model(spark)
    m.load("of", spark.range(1000).selectExpr("id a", "id % 7 b"))
    m.load("big", spark.range(3))
    found = m.query("if c = of(o); if big(c);", ["o", "c"])
    partitions, advised, files = seen[0]
    assert int(partitions) >= 80 and int(advised) == store.ADVISED_BYTES and int(files) == store.OPEN_FILES
    assert "settled-" in found.inputFiles()[0]  # and does not depend on who reads it
    assert sorted(map(tuple, found.collect())) == [(i, i % 7) for i in range(1000) if i % 7 < 3]
    assert [spark.conf.get(s, None) for s in settings] == before


def test_a_task_scans_little_of_a_table_that_comes_in(spark, tmp_path):
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    n, draw = 1_200_000, random.Random(1)
    a, b = (pa.array([draw.getrandbits(62) for _ in range(n)], pa.int64()) for _ in range(2))
    pq.write_table(pa.table({"a": a, "b": b}), f"{tmp_path}/t.parquet", row_group_size=100_000, use_dictionary=False, compression="none")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # else so small a file is dealt to all cores
    try:
        m = Theory("type X; pred p(X, X, X);", "t").model(spark)
        m.load("p", spark.read.parquet(f"{tmp_path}/t.parquet").select("a", "b", F.spark_partition_id().alias("task")))
        tasks = m.table("p").groupBy("c2").count().collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(t["count"] for t in tasks) == n
    assert max(t["count"] for t in tasks) * 16 <= (8 << 20) + 100_000 * 16  # a split, and what is left of its last row group


def test_rows_that_come_in_are_dealt_out_before_they_are_made_distinct(spark, monkeypatch, tmp_path):
    from horncast import model
    from horncast.operators import store

    spark.range(3000).selectExpr("id % 1000 a", "id % 7 b").write.parquet(f"{tmp_path}/t")
    table, write = spark.read.parquet(f"{tmp_path}/t"), store.Store.write
    for least, dealt in ((1, True), (1 << 40, False)):
        monkeypatch.setattr(model, "SETTLED_BYTES", least)
        plans = []
        monkeypatch.setattr(store.Store, "write", lambda self, rows, plans=plans: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(self, rows))
        m = Theory("type X; pred p(X, X);", "t").model(spark)
        for a in (900, 400, 1000):  # what is known does not come in again, nor what comes twice
            m.load("p", table.where(F.col("a") < a))
            m.insert("p", 5, 5)
            m.flush()
        assert ("Aggregate" in plans[0].rsplit("Exchange", 1)[1]) is not dealt
        rows = sorted(map(tuple, m.table("p").collect()))
        assert rows == sorted({(i % 1000, i % 7) for i in range(3000)} | {(5, 5)})
