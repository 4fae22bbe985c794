"""Near duplicates by ProbMinHash.

A text is the weighted set of its five-word shingles, a weight being how often the shingle occurs.  The
similarity of two texts is the probability Jaccard similarity J_P of these weights (Moulton and Jiang);
without repeated shingles it is the plain Jaccard similarity.

Signature (Ertl's ProbMinHash with Poisson arrivals): every shingle is a Poisson process whose rate is its
weight and whose arrivals, times and registers alike, are derived from the shingle's hash.  An arrival
lowers the register it falls on; a register keeps the shingle that came first.  A shingle is given up as
soon as its next arrival is later than every register of its text (early termination).  Two texts agree in
a register with probability J_P.

Search: ``BANDS`` bands of ``ROWS`` registers.  Texts that are equal are one node (the key is a hash of the
text), so copies are collapsed by one aggregation and cost nothing later.  Texts that agree in a band are
candidates.  A bucket is never expanded into its pairs: it has a leader, and each member is tested against
that one only.  The verified links are merged into classes; a bucket whose members are all of one class is
done, which leaves texts that are close to others, but not close enough, and those that only another member
than the leader links.  For these (``leftover_links``) the exact similarity is computed in blocks: a text is at
home in the largest of its open buckets, and the texts at home there are dealt to blocks of about ``BLOCK_ROWS``
texts and ``BLOCK_BYTES``, those of a large class to blocks of their own.  Two blocks meet, in one task, if some
open bucket has texts of both, unless both are of one class; there, matrix products over the shingles that both
have count all overlaps at once.  Only links come out.  So no pair of candidates of different classes is left
without an exact test, no task holds a bucket, and texts of a large class never meet each other again.

Verification: a pair's texts are joined to it and J_P is computed exactly from their shingles.

Everything is keyed by text hash and goes through shuffles that Spark can split; links, classes and
signatures stay distributed, lineage is cut by tables in the shared folder.

Defined results: one row per input row.  A null text is a class of its own (class_id null if its id is).  A
text without a word is equal only to texts that are the same character by character.  A text of one to four
words has one shingle: all its words.  ``class_id`` is the least id among the rows of the class (ids may
repeat or be null; nulls count only if there is no other).  ``keep`` marks one row of each class: the one
with the least id, ties broken by a hash of all columns and then arbitrarily among equal rows.  Columns of the input are
kept, whatever their names, but for those that are called as the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkern
from .common import Shielded, by_value, drop_scratch, settle

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 6
BLOCK_ROWS, BLOCK_BYTES, SHINGLES_AT_ONCE = 256, 1 << 20, 4096
U = np.uint64


def prob_minhash(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Winner of each register of each row, (n_docs, registers); 0 where a row has no element."""
    time_of = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, dtype=U)
    single = np.bincount(doc, minlength=n_docs) == 1
    if single.any():  # with one element, it wins everywhere
        at = single[doc]
        winner.reshape(n_docs, registers)[doc[at]] = h[at][:, None]
        h, doc, weight = h[~at], doc[~at], weight[~at]
    t = np.zeros(len(h))
    step = 0
    while len(h):
        step = (step + 0x9E3779B97F4A7C15) % 2**64
        r = textkern.mix(h + U(step))
        t = t - np.log((r >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight
        register = ((textkern.mix(r + U(0xD6E8FEB86659FD93)) >> U(32)) * U(registers) >> U(32)).astype(np.int64)
        slot = doc * registers + register
        np.minimum.at(time_of, slot, t)
        won = time_of[slot] == t
        winner[slot[won]] = h[won]
        rows = np.unique(doc) if len(doc) < n_docs * 4 else np.arange(n_docs)
        latest = np.zeros(n_docs)
        latest[rows] = time_of.reshape(n_docs, registers)[rows].max(axis=1)
        alive = t < latest[doc]
        h, doc, weight, t = h[alive], doc[alive], weight[alive], t[alive]
    return winner.reshape(n_docs, registers)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0xE7037ED1A0B428DB), s.shape[:2]).copy()
    for r in range(rows):
        out = textkern.mix(out * U(0x2545F4914F6CDD1D) + s[:, :, r])
    return out


def weights_of(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    h, d = textkern.shingles(textkern.Words(data, np.array([0, len(data)])), size)
    h, _, w = textkern.distinct_weighted(h, d)
    return h, w


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P = sum over common i of 1 / sum over all j of max(x_j / x_i, y_j / y_i); hashes are sorted."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio, inverse = np.unique(y / x, return_inverse=True)
    if len(ratio) > 64:  # sorted by ratio, sums of max() are sums of a head and a tail
        order = np.argsort(y / x, kind="stable")
        head_y, tail_x = np.concatenate([[0], np.cumsum(y[order])]), np.concatenate([np.cumsum(x[order][::-1])[::-1], [0]])
        at = np.searchsorted((y / x)[order], ratio, side="right")
        # x_j >= y_j / r where y_j / x_j <= r
        both = (x.sum() - tail_x[at]) + (y.sum() - head_y[at]) / ratio
    else:
        both = np.array([np.maximum(x, y / r).sum() for r in ratio])
    per = x * 1.0 / (only_a + only_b / ratio[inverse] + both[inverse])
    return float(per.sum())


def signatures(docs: DataFrame, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(key, bands array<long>) for each row with a text that has a word."""
    by_value()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for row, data, offsets in textkern.slices(texts):
                words = textkern.Words(data, offsets)
                h, d, w = textkern.distinct_weighted(*textkern.shingles(words, shingle))
                some = np.flatnonzero(np.diff(words.first) > 0)
                if not len(some):
                    continue
                back = np.zeros(len(offsets) - 1, dtype=np.int64)
                back[some] = np.arange(len(some))
                found = band_hashes(prob_minhash(h, back[d], w, len(some), bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(np.arange(0, (len(some) + 1) * bands, bands, dtype=np.int32), pa.array(found.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(some + row)), lists], names=["key", "bands"])

    return docs.select("key", text).mapInArrow(work, "key binary, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of keys with J_P of at least ``threshold``."""
    by_value()
    with_a = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ("", None)
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                left, right = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                if right != last[0]:
                    last = (right, weights_of(right, shingle))
                good.append(probability_jaccard(weights_of(left, shingle), last[1]) >= threshold - 1e-9)  # sums of rounded terms
            yield batch.select([0, 1]).filter(pa.array(good, type=pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(work, "a binary, b binary")


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every key points to one other, which points to none: then the edges are the classes."""
    twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    through = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return twice.unionByName(through).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Alternating large-star and small-star (Kiveris et al.): (a, b), b the least key of a's class; only for keys with links."""
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while not _is_star_forest(edges):
        for large in (True, False):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
            least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m")), "least")
            far = both.join(least, F.col("a") == F.col("c"))
            if large:
                star = far.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            else:
                star = far.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(far.select("a", F.col("m").alias("b")))
            step = settle(star.where("a != b").distinct(), "edges")
            drop_scratch(edges, least)
            edges = step
    return edges


def _pairs(led: DataFrame) -> DataFrame:
    return led.where("key != leader").select(F.greatest("key", "leader").alias("a"), F.least("key", "leader").alias("b")).distinct()


def unresolved(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(band, n, key, class) of the buckets whose members are of more than one class."""
    named = members.join(classes, F.col("key") == F.col("a"), "left").select("band", "n", "key", F.coalesce("b", "key").alias("class"))
    open_ = settle(named.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("band"), "bands")
    return named.join(open_, "band", "left_semi")


def leftover_blocks(held: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, key, class, text) of the texts of open buckets, and the pairs (i, j) of blocks that meet, i <= j."""
    at_home = held.groupBy("key", "class").agg(F.max_by("band", F.struct("n", "band")).alias("home"))
    rows = settle(at_home.join(texts, "key"), "leftover")
    per = rows.groupBy("home", "class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    labelled = settle(per.withColumn("label", F.when(F.col("n") >= BLOCK_ROWS // 2, F.hex("class")).otherwise("")), "labels")
    shape = labelled.groupBy("home", "label").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"))
    dealt = labelled.select("home", "class", "label").join(shape, ["home", "label"])
    chunk = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    rows = rows.join(dealt, ["home", "class"]).select(F.concat_ws(" ", "home", "label", chunk).alias("block"), "label", "key", "class", "text")
    rows = settle(rows, "blocks")
    seen = held.select("band", "key").join(rows.select("key", "block", "label"), "key").select("band", "block", "label").distinct()
    seen = settle(seen, "seen")
    other = seen.select("band", F.col("block").alias("j"), F.col("label").alias("other"))
    pairs = seen.withColumnRenamed("block", "i").join(other, "band").where("i <= j and not (label = other and label != '')")
    return rows.drop("label"), settle(pairs.select("i", "j").distinct(), "meetings")


def block_links(left: list, right: list, shingle: int, threshold: float, same: bool) -> list[tuple[bytes, bytes]]:
    """Links between two blocks of (key, class, text) whose classes differ."""
    if not left or not right:
        return []
    sets = [[weights_of(t, shingle) for _, _, t in side] for side in (left, right)]
    flat = [(np.concatenate([h for h, _ in s]), np.repeat(np.arange(len(s)), [len(h) for h, _ in s]), np.concatenate([w for _, w in s])) for s in sets]
    total = [np.array([w.sum() for _, w in s]) for s in sets]
    plain = [np.array([(w == 1).all() for _, w in s]) for s in sets]
    both = np.intersect1d(flat[0][0], flat[1][0])
    inside = [np.isin(f[0], both) for f in flat]
    place = [np.searchsorted(both, f[0][m]) for f, m in zip(flat, inside, strict=True)]
    row = [f[1][m] for f, m in zip(flat, inside, strict=True)]
    weight = [f[2][m] for f, m in zip(flat, inside, strict=True)]
    # What of a left text's weight the right text also has, and the other way round.
    of_left, of_right = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)))
    for a in range(0, len(both), SHINGLES_AT_ONCE):
        held, weighed = [], []
        for s, n in ((0, len(left)), (1, len(right))):
            m = (place[s] >= a) & (place[s] < a + SHINGLES_AT_ONCE)
            x, y = (np.zeros((n, min(SHINGLES_AT_ONCE, len(both) - a)), np.float32) for _ in "xy")
            x[row[s][m], place[s][m] - a] = 1
            y[row[s][m], place[s][m] - a] = weight[s][m]
            held.append(x)
            weighed.append(y)
        of_left += weighed[0] @ held[1].T
        of_right += held[0] @ weighed[1].T
    share = np.minimum(of_left / np.maximum(total[0], 1)[:, None], of_right / np.maximum(total[1], 1)[None, :])  # J_P is at most this
    apart = np.array([c for _, c, _ in left], dtype=object)[:, None] != np.array([c for _, c, _ in right], dtype=object)[None, :]
    near = (share >= threshold - 1e-6) & apart
    if same:
        near = np.triu(near, 1)
    simple = plain[0][:, None] & plain[1][None, :]
    near &= ~simple | (of_left / np.maximum(total[0][:, None] + total[1][None, :] - of_left, 1) >= threshold - 1e-6)
    return [(left[i][0], right[j][0]) for i, j in zip(*np.nonzero(near), strict=True) if probability_jaccard(sets[0][i], sets[1][j]) >= threshold - 1e-9]


def leftover_links(rows: DataFrame, meetings: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links (a, b) between texts of different classes in blocks that meet, all of them."""
    by_value()

    def meet(table: pa.Table) -> pa.Table:
        rows = list(zip(*[table.column(c).to_pylist() for c in ("side", "key", "class", "text")], strict=True))
        left, right = [r[1:] for r in rows if r[0] in "lb"], [r[1:] for r in rows if r[0] in "rb"]
        found = block_links(left, right, shingle, threshold, rows[0][0] == "b")
        pairs = [(max(p), min(p)) for p in found]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    columns = ["i", "j", "side", "key", "class", "text"]
    left = rows.join(meetings, F.col("block") == F.col("i")).withColumn("side", F.when(F.col("i") == F.col("j"), "b").otherwise("l"))
    right = rows.join(meetings.where("i < j"), F.col("block") == F.col("j")).withColumn("side", F.lit("r"))
    return left.select(columns).unionByName(right.select(columns)).groupBy("i", "j").applyInArrow(meet, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> tuple[DataFrame, DataFrame]:
    """(membership, links): membership has (key, class_key, class_id, class_rows) for each distinct text, links
    the verified pairs (a, b) of keys.  Join membership to rows by ``text_key``."""
    held = Shielded(docs)
    said = F.col(held.of(text))
    keyed = held.rows.select(text_key(said).alias("key"), said.alias("text"), F.col(held.of(id_column)).alias("id")).where("text is not null")
    signed = settle(signatures(keyed, "text", shingle, bands, rows).groupBy("key").agg(F.first("bands").alias("bands")), "signed")
    spread = signed.select("key", F.explode("bands").alias("band"))
    # Tables of one row per key are written before they are joined, so that Spark can split a hot key's rows.
    shared = settle(spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    members = settle(spread.join(shared, "band"), "buckets")
    drop_scratch(signed, shared)
    # Only texts that are candidates are ever moved; each once.
    wanted = members.select("key").distinct()
    texts = settle(keyed.select("key", "text").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "texts")
    # Round 0: a bucket's leader is the text with most company in all its buckets (it tends to be what the others
    # were made from) or, in every other bucket, any text.
    company = settle(members.groupBy("key").agg(F.sum("n").alias("company")), "company")
    rank = F.when(F.col("band") % 2 == 0, F.col("company")).otherwise(F.xxhash64("key", "band"))
    led = settle(members.join(company, "key").groupBy("band").agg(F.max_by("key", F.struct(rank, F.xxhash64("key", "band"))).alias("leader")), "leaders")
    pairs = settle(_pairs(members.join(led, "band")), "pairs")
    links = settle(verified(pairs, texts, shingle, threshold), "links")
    classes = components(links)
    held = settle(unresolved(members, classes), "open")
    leftover, meetings = leftover_blocks(held, texts)
    more = settle(leftover_links(leftover, meetings, shingle, threshold), "links")
    drop_scratch(members, company, led, pairs, held, leftover, meetings, texts)
    if not more.isEmpty():
        links = links.unionByName(more)
        classes = components(links)
    ids = keyed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    named = ids.join(classes, F.col("key") == F.col("a"), "left").select("key", F.coalesce("b", "key").alias("class_key"), "id", "n")
    named = settle(named, "named")
    whole = named.groupBy("class_key").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_rows"), F.count(F.lit(1)).alias("class_texts"))
    return settle(named.select("key", "class_key").join(whole, "class_key"), "membership"), links


def text_key(text):
    """Identity of a text: 16 bytes of its SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def with_classes(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", **how) -> DataFrame:
    """``docs`` with class_key, class_id, class_rows and class_texts (replaced if they are there)."""
    membership, _ = near_duplicates(docs, text=text, id_column=id_column, **how)
    new = ("class_key", "class_id", "class_rows", "class_texts")
    held = Shielded(docs, new)
    rows = held.rows.withColumn("of_key", text_key(F.col(held.of(text))))
    out = rows.join(membership, F.col("of_key") == F.col("key"), "left")
    alone = F.col("key").isNull()
    out = out.withColumns({
        "class_id": F.when(alone, F.col(held.of(id_column))).otherwise(F.col("class_id")),
        "class_rows": F.coalesce("class_rows", F.lit(1)).cast("long"), "class_texts": F.coalesce("class_texts", F.lit(1)).cast("long"),
    })
    return held.restore(out, new)


def deduplicate(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", **how) -> DataFrame:
    """One row of each class: the one with the least id.  Rows with a null text all stay."""
    membership, _ = near_duplicates(docs, text=text, id_column=id_column, **how)
    # The winner is chosen among narrow rows: (class, id, hash of the whole row).
    held = Shielded(docs)
    said, key = F.col(held.of(text)), F.col(held.of(id_column))
    rows = held.rows.select("*", text_key(said).alias("near_key"), key.alias("near_id"), F.xxhash64(*held.rows.columns).alias("near_row"))
    of = membership.select(F.col("key").alias("near_of"), F.col("class_key").alias("near_class"))
    narrow = rows.select("near_key", "near_id", "near_row").join(of, F.col("near_key") == F.col("near_of"))
    first = F.min(F.struct(F.col("near_id").isNull().alias("none"), "near_id", "near_row", "near_key")).alias("w")
    won = settle(narrow.groupBy("near_class").agg(first).select(F.col("w.near_key").alias("won_key"), F.col("w.near_row").alias("won_row"), F.col("w.near_id").alias("won_id")), "winners")
    same = (F.col("near_key") == F.col("won_key")) & (F.col("near_row") == F.col("won_row")) & F.col("near_id").eqNullSafe(F.col("won_id"))
    kept = rows.join(won, same)
    # Rows that repeat a winner in every column: one of them stays.
    twins = narrow.groupBy("near_key", "near_id", "near_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twins.isEmpty():
        kept = kept.dropDuplicates(["near_key"])
    return held.restore(kept.select(*held.rows.columns).unionByName(held.rows.where(said.isNull())))
