"""Approximate nearest neighbours by largest inner product, with a hierarchical k-means tree.

Largest inner product becomes smallest distance by one more component: with M the largest norm of all
vectors, x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0), scaled to norm M.  The tree is fitted in that
space on a sample of at most ``FIT_ROWS`` vectors (``BRANCHES`` children a node, until a node's sample is
small enough); every row of the table is then put into its leaf.

A query walks the tree best bin first: a priority queue holds the children passed over, by distance to
their centres; the next leaf is below the nearest of them.  How many leaves a query visits is calibrated:
``CALIBRATION`` queries are searched exactly over all rows; visits are widened until the share ``SURE`` of them
finds at least ``TARGET_RECALL`` of its k nearest, each by itself, and all of them together ``MEAN_RECALL``.
The number is chosen on one half of these queries and widened further if the other half, which had no part in
the choice, falls short of it.  A query also goes on until it has seen more than k ids.

Leaves are met in blocks of at most about ``BLOCK_ROWS`` rows and as many queries, dealt by hash, so a leaf
that holds a third of all rows (copies of one vector) is many groups.  Each group is one matrix product in
double precision that chooses candidates; their scores are summed afresh in one fixed order, so that equal
vectors have equal scores.  A group returns at most k ids a query.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another dimension
than most, take no part, nor do rows with a null id.  Rows that share an id are one candidate, with the best
of their scores, and one query, with the least of their vectors; a query's own rows are all rows with its id.
Equal scores are ranked by smaller id.  A query gets fewer than k rows only if there are fewer candidates; an
empty table gives an empty result.  Other columns of the input may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shielded, by_value, revive, settle, share

FIT_ROWS, BRANCHES = 20_000, 8
LEAF_ROWS, MAX_LEAVES = 4000, 2048
BLOCK_ROWS = 4096
#: Queries with known answers; the recall each is to reach, the share of them that has to, and the recall of all.
CALIBRATION, TARGET_RECALL, SURE, MEAN_RECALL = 256, 0.9, 0.98, 0.96


@dataclass
class Tree:
    top: float  # the largest norm
    centres: list[np.ndarray] = field(default_factory=list)  # of each node's children
    children: list[list[int]] = field(default_factory=list)  # node numbers, or -1 - leaf
    leaves: int = 0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def query(self, q: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(q, axis=1)[:, None]
        return np.concatenate([q * (self.top / norm), np.zeros((len(q), 1))], axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of original vectors."""
        lifted, out = self.lifted(x), np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))] if self.children else []
        while todo:
            node, rows = todo.pop()
            near = nearest(lifted[rows], self.centres[node])
            for c, child in enumerate(self.children[node]):
                part = rows[near == c]
                if len(part):
                    if child < 0:
                        out[part] = -1 - child
                    else:
                        todo.append((child, part))
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves for one lifted query, best bin first."""
        if not self.children:
            yield 0
            return
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while node >= 0:
                gap = ((self.centres[node] - q) ** 2).sum(axis=1)
                best = int(np.argmin(gap))
                for c, child in enumerate(self.children[node]):
                    if c != best:
                        heapq.heappush(queue, (float(gap[c]), child))
                node = self.children[node][best]
            yield -1 - node


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2.0 * x @ centres.T, axis=1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centres (no more than there are different points) and each point's centre; seeded as in k-means++."""
    centres = [x[rng.integers(len(x))]]
    gap = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and gap.max() > 1e-12:
        centres.append(x[rng.choice(len(x), p=gap / gap.sum())])
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    near = nearest(x, c)
    for _ in range(rounds):
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        after = nearest(x, c)
        if (after == near).all():
            break
        near = after
    used = np.unique(near)
    return c[used], np.searchsorted(used, near)


def fit_tree(sample: np.ndarray, top: float, leaves: int, seed: int = 5) -> Tree:
    """Splits the node with the largest sample until there are ``leaves`` leaves or none can be split."""
    tree, rng = Tree(top), np.random.default_rng(seed)
    lifted = tree.lifted(sample)
    heap: list[tuple[int, int, tuple | None, np.ndarray]] = [(-len(lifted), 0, None, np.arange(len(lifted)))]
    count, ticket, closed = 1, 0, []
    while heap and count < leaves:
        _, _, home, rows = heapq.heappop(heap)
        k = min(BRANCHES, leaves - count + 1)
        centres, near = kmeans(lifted[rows], k, rng) if len(rows) > 1 else (None, None)
        if centres is None or len(centres) < 2:
            closed.append((home, rows))
            continue
        node = len(tree.children)
        tree.centres.append(centres)
        tree.children.append([0] * len(centres))
        if home:
            tree.children[home[0]][home[1]] = node
        for c in range(len(centres)):
            ticket += 1
            part = rows[near == c]
            heapq.heappush(heap, (-len(part), ticket, (node, c), part))
        count += len(centres) - 1
    ends = [(h, r) for _, _, h, r in heap] + closed
    for leaf, (home, _) in enumerate(ends):
        if home:
            tree.children[home[0]][home[1]] = -1 - leaf
    tree.leaves = len(ends)
    return tree


def best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, score) of the k best ids of each query; ties to smaller ids."""
    at_q, at_x, score = [], [], []
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1])) if len(ids) else np.zeros(0, np.int64)
    repeated = len(starts) < len(ids)
    for a in range(0, len(q), 512):
        rough = q[a : a + 512] @ x.T
        rough[q_ids[a : a + 512, None] == ids[None, :]] = -np.inf
        for i, r in enumerate(rough, start=a):
            best, floor = np.maximum.reduceat(r[order], starts) if repeated else r, -np.inf  # of each id
            if len(best) > k:
                kth = np.partition(best, len(best) - k)[len(best) - k]
                floor = kth - 1e-9 * (1.0 + abs(kth)) if np.isfinite(kth) else -np.inf
            near = np.flatnonzero((r >= floor) & (r > -np.inf))
            exact = (x[near] * q[i]).sum(axis=1)
            top = np.lexsort((ids[near], -exact))
            if repeated:
                top = top[np.sort(np.unique(ids[near][top], return_index=True)[1])]
            top = top[:k]
            at_q.append(np.full(len(top), i))
            at_x.append(near[top])
            score.append(exact[top])
    join = lambda p, t: np.concatenate(p) if p else np.zeros(0, t)
    return join(at_q, np.int64), join(at_x, np.int64), join(score, np.float64)


def top_ids(found: DataFrame, query: str, k: int) -> DataFrame:
    """The k best (``id``, ``score``) of each query, with their rank; an id found twice counts once."""
    once = found.groupBy(query, "id").agg(F.max_by(F.struct(*[c for c in found.columns if c not in (query, "id")]), "score").alias("of"))
    order = Window.partitionBy(query).orderBy(F.desc("of.score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, "id", "rank", "of.*")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else np.zeros((0, 0))


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v, held = F.col("v"), Shielded(vectors)
    sound = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))) & F.exists("v", lambda e: e != 0)
    rows = held.rows.select(F.col(held.of(id_column)).cast("long").alias("id"), F.col(held.of(vector)).alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size("v") > 0))
    rows = rows.where(sound)
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def search(vectors: DataFrame, is_query: Callable[[Column], Column], *, id_column: str = "vec_id", vector: str = "embedding", k: int = 20, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``is_query`` says yes to, the k nearest found."""
    by_value()
    rows = usable(vectors, id_column, vector)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).first()
    n, empty = facts["n"], "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], empty)
    picked = min(2**63 - 1, int(0.9 * FIT_ROWS / n * 2**63))
    mark = F.xxhash64("id", "v", F.lit(seed))
    sample = rows.where(mark.bitwiseAND(F.lit(2**63 - 1)) <= picked).orderBy(mark, "id", "v").limit(FIT_ROWS).toArrow()
    points = matrix(sample.column("v")) if sample.num_rows else np.zeros((0, 1))
    tree = fit_tree(points, facts["top"], min(MAX_LEAVES, max(1, n // LEAF_ROWS, min(16, n // 64)))) if len(points) else Tree(facts["top"], leaves=1)
    shape, spark = rows.schema["v"].dataType.simpleString(), vectors.sparkSession
    shared = share(spark, tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = revive(Tree, shared)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.assign(matrix(batch.column(1))))], names=["id", "v", "leaf"])

    placed = settle(rows.mapInArrow(place, f"id bigint, v {shape}, leaf int"), "placed")
    counts = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MAX_LEAVES
    # Different ids of each leaf, an id in several of them counted in one: what a walk has seen at least.
    homes = placed.groupBy("id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    ids_of = {r["leaf"]: r["n"] for r in homes.collect()}
    seekers = settle(placed.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")), "seekers")
    visits = calibrate(placed, seekers, tree, counts, k)
    pairs = settle(walks(seekers, tree, counts, ids_of, visits, k, shape), "walks")
    asked = {r["leaf"]: r["n"] for r in pairs.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Blocks of rows and of queries of each leaf; each side is repeated for the blocks of the other.
    blocks = [(leaf, -(-c // BLOCK_ROWS), -(-asked.get(leaf, 0) // BLOCK_ROWS)) for leaf, c in counts.items() if asked.get(leaf)]
    if not blocks:
        return spark.createDataFrame([], empty)
    row_blocks = F.create_map(*[F.lit(x) for leaf, v, _ in blocks for x in (leaf, v)])
    query_blocks = F.create_map(*[F.lit(x) for leaf, _, q in blocks for x in (leaf, q)])
    deal = lambda of, blocks_: F.pmod(F.xxhash64(of, F.lit(seed)), blocks_[F.col("leaf")]).cast("int")
    each = lambda blocks_: F.explode(F.sequence(F.lit(0), blocks_[F.col("leaf")] - 1))
    left = placed.where(row_blocks[F.col("leaf")].isNotNull()).select("leaf", deal("id", row_blocks).alias("vb"), each(query_blocks).alias("qb"), "id", "v")
    right = pairs.where(row_blocks[F.col("leaf")].isNotNull()).select("leaf", deal("query", query_blocks).alias("qb"), each(row_blocks).alias("vb"), "query", "v")

    def meet(have: pa.Table, ask: pa.Table) -> pa.Table:
        if not have.num_rows or not ask.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, q_ids = have.column("id").to_numpy(), ask.column("query").to_numpy()
        at_q, at_x, score = best_of(q_ids, matrix(ask.column("v")), ids, matrix(have.column("v")), k)
        return pa.table({"query_id": q_ids[at_q], "id": ids[at_x], "score": score})

    found = left.groupBy("leaf", "vb", "qb").cogroup(right.groupBy("leaf", "vb", "qb")).applyInArrow(meet, "query_id bigint, id bigint, score double")
    return top_ids(found, "query_id", k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def walks(seekers: DataFrame, tree: Tree, counts: dict[int, int], ids_of: dict[int, int], visits: int, k: int, shape: str) -> DataFrame:
    """(leaf, query, v): the leaves each query visits."""
    shared, by_leaf = share(seekers.sparkSession, tree), seekers.sparkSession.sparkContext.broadcast((counts, ids_of))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, (counts, ids_of) = revive(Tree, shared), by_leaf.value
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, row = [], []
            for i, q in enumerate(tree.query(matrix(batch.column(1)))):
                seen = went = 0
                for x in tree.walk(q):
                    if went >= visits and seen > k:
                        break
                    if counts.get(x):
                        leaf.append(x)
                        row.append(i)
                        seen, went = seen + ids_of.get(x, 0), went + 1
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], names=["leaf", "query", "v"])

    return seekers.mapInArrow(work, f"leaf int, query bigint, v {shape}")


def enough(needed: list[np.ndarray], k: int) -> int:
    """Visits with which queries find their share; ``needed``: of each, in order, how many leaves it takes to see its nearest."""
    each = sorted(int(n[min(len(n), int(np.ceil(TARGET_RECALL * len(n)))) - 1]) for n in needed if len(n))
    if not each:
        return 1
    every = np.sort(np.concatenate(needed))
    return max(each[int(np.ceil(SURE * len(each))) - 1], int(every[int(np.ceil(MEAN_RECALL * len(every))) - 1]))


def calibrate(placed: DataFrame, seekers: DataFrame, tree: Tree, counts: dict[int, int], k: int) -> int:
    """The least number of visited leaves with which queries whose answers are known find enough of them."""
    some = seekers.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(CALIBRATION).toArrow()
    if not some.num_rows or len(counts) < 2:
        return len(counts)
    q_ids, q = some.column("id").to_numpy(), matrix(some.column("v"))
    held = placed.sparkSession.sparkContext.broadcast((q_ids, q))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = held.value
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                at_q, at_x, score = best_of(q_ids, q, ids, matrix(batch.column(1)), k)
                yield pa.RecordBatch.from_arrays([pa.array(at_q), pa.array(ids[at_x]), batch.column(2).take(pa.array(at_x)), pa.array(score)], names=["q", "id", "leaf", "score"])

    best = placed.mapInArrow(work, "q bigint, id bigint, leaf int, score double")
    true = top_ids(best, "q", k).select("q", "leaf").collect()  # CALIBRATION * k rows
    place = [{leaf: i for i, leaf in enumerate(x for x in tree.walk(v) if counts.get(x))} for v in tree.query(q)]
    needed: list[list[int]] = [[] for _ in q_ids]
    for r in true:
        needed[r["q"]].append(place[r["q"]][r["leaf"]] + 1)
    ordered = [np.sort(np.array(n, dtype=np.int64)) for n in needed]
    half = len(ordered) // 2
    # Chosen on one half; the other, which is new to it, may only widen it.
    return max(enough(ordered[:half] or ordered, k), enough(ordered[half:], k))
