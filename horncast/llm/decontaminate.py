"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document if the document holds at least ``THRESHOLD`` of the item's distinct
five-word shingles, wherever they are (words are runs of letters, digits and non-ASCII characters, in lower case).

Search: an item is short and a document may be long, so that their Jaccard similarity says nothing.  Sizes are
therefore partitioned in powers of two: an item of n shingles belongs to the class of blocks of 2**c
shingles, 2**c >= n.  A document's shingles are cut into such blocks for every class, and two neighbouring
blocks make a window; a passage of up to 2**c shingles lies in a window, whose size is at most four times
its own.  Blocks of a class are pairs of blocks of the class below, so that the MinHash registers of all
classes cost one pass over the shingles: minima of minima.  A document is a candidate for an item if any
window of the item's class agrees with it in any of ``REGISTERS`` registers.  A document of one window or less
is one window.

What windows may miss: items of few shingles, an item whose shingles a document holds scattered, and the share
below 1e-4 of passages with which no register agrees.  These are exact lookups: of an item's n shingles, of
which a document must hold m, it holds at least one of any n - m + 1; of each item, those that are rarest among
the items (a fifth of them) are looked up for every shingle of a text.  So no item is ever missed.

Verification: the exact shingles, as words, are counted over the whole document, in one pass for all its
candidates; memory holds the candidates' shingles, not the document's.

The items are a stated query set.  They are written once, dealt to small buckets by hash, and read in blocks of
neighbouring buckets of at most ``BLOCK_BYTES`` of text (one bucket, at least: a larger item is a block); each
block is broadcast to one pass over the documents.  Documents are never shuffled; a passage that a third of all
documents share costs no more than any other.

Defined results: a null or empty document holds no item.  An item without five words has no shingle and is
never found (a run of one to four words proves no leak).  Repeated items and repeated documents are found
row by row; ids may be of any type, also null.  Empty tables give an empty result.  Other columns of both
tables may have any name; columns of the result are named after the two ids (``_item`` is added to the item's
where they are the same but for case).
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkern
from .common import Shielded, by_value, revive, settle, share

SHINGLE, THRESHOLD = 5, 0.8
REGISTERS, SMALLEST = 48, 3
#: Items of so many shingles at most have no windows: lookups alone find them.
EXACT = 4
BLOCK_BYTES = 8 << 20
#: What ``textkern`` takes for a word, for exact verification.
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
U = np.uint64


def exact_shingles(text: str, size: int) -> set[str]:
    """Runs of ``size`` words, as strings."""
    words = WORD.findall(text.lower())
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def held_shingles(text: str, size: int, wanted: set[str]) -> set[str]:
    """Those of the ``wanted`` shingles that a text has."""
    last: deque[str] = deque(maxlen=size)
    found = set()
    for m in WORD.finditer(text.lower()):
        last.append(m[0])
        if len(last) == size and (run := " ".join(last)) in wanted:
            found.add(run)
    return found


def size_class(n: int) -> int:
    return max(SMALLEST, int(n - 1).bit_length())


def register(hashes: np.ndarray, k: int) -> np.ndarray:
    """Value of the shingles in register ``k``: its own permutation of 64-bit values."""
    return (hashes ^ (hashes >> U(29))) * U(((2 * k + 3) * 0xBF58476D1CE4E5B9 + 2 * k) % 2**64 | 1) ^ U(k * 0x94D049BB133111EB % 2**64)


def collect(found: set[tuple[int, int]], values: np.ndarray, items: np.ndarray, wanted: np.ndarray, row_of: Callable[[np.ndarray], np.ndarray]) -> None:
    """Adds (row, item) to ``found`` wherever ``wanted`` has one of the sorted ``values``; ``row_of`` gives the rows of places in ``wanted``."""
    p = np.searchsorted(values, wanted)
    hit = np.flatnonzero(values[np.minimum(p, len(values) - 1)] == wanted)
    if len(hit):
        # A row that repeats a value has it once.
        pairs = np.unique(np.stack([row_of(hit), p[hit]]), axis=1)
        ends = np.searchsorted(values, values[pairs[1]], side="right")
        for r, i, j in zip(pairs[0].tolist(), pairs[1].tolist(), ends.tolist(), strict=True):
            found.update((r, x) for x in items[i:j].tolist())


class Items:
    """A block of items: registers of each, and exact shingles for lookups and verification.  Items are numbered as they come."""

    def __init__(self, texts: list[str | None], size: int, threshold: float, registers: int):
        self.size, self.registers, self.threshold = size, registers, threshold
        self.sets = [exact_shingles(text or "", size) for text in texts]
        hashes = []
        for text in texts:
            data = np.frombuffer(pc.utf8_lower(pa.scalar(text or "")).as_py().encode(), dtype=np.uint8)
            words = textkern.Words(data, np.array([0, len(data)]), "alnum")
            hashes.append(textkern.shingles(words, size)[0] if len(words.hash) >= size else np.zeros(0, U))
        some = [i for i, s in enumerate(self.sets) if s]
        often = Counter(h for i in some for h in set(hashes[i].tolist()))
        keys = []
        for i in some:
            own = sorted(set(hashes[i].tolist()), key=lambda h: (often[h], h))
            must = next((k for k in range(1, len(own)) if k / len(own) >= threshold), len(own))
            keys += [(h, i) for h in own[: len(own) - must + 1]]
        keys.sort()
        #: sorted shingles of which a document that holds an item has one, and the items
        self.exact = np.array([h for h, _ in keys], dtype=U), np.array([i for _, i in keys], dtype=np.int64)
        classes = np.array([size_class(len(s)) if len(s) > EXACT else -1 for s in self.sets], dtype=np.int64)
        self.classes = sorted(set(classes.tolist()) - {-1})
        #: (class, register) -> sorted values and the items that have them
        self.index = {}
        for c in self.classes:
            of = np.flatnonzero(classes == c)
            for k in range(registers):
                values = np.array([register(hashes[i], k).min() for i in of], dtype=U)
                order = np.argsort(values, kind="stable")
                self.index[c, k] = (values[order], of[order])

    def found(self, texts: pa.Array) -> Iterator[tuple[int, int, float]]:
        """(row, item, containment) of all items that the rows of a column hold, by row and item."""
        for row, data, offsets in textkern.slices(pc.utf8_lower(texts)):
            words = textkern.Words(data, offsets, "alnum")
            hashes, doc = textkern.shingles(words, self.size)
            first = np.searchsorted(doc, np.arange(len(offsets)))
            of_row: dict[int, list[int]] = {}
            for r, i in sorted(self.candidates(hashes, first)):
                of_row.setdefault(r, []).append(i)
            for r, items in of_row.items():
                held = held_shingles(texts[row + r].as_py(), self.size, set().union(*[self.sets[i] for i in items]))
                for i in items:
                    part = len(self.sets[i] & held) / len(self.sets[i])
                    if part >= self.threshold:
                        yield row + r, i, part

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs for rows whose shingles are hashes[first[row]:first[row + 1]]."""
        found: set[tuple[int, int]] = set()
        counts = np.diff(first)
        rows = np.flatnonzero(counts > 0)
        if not len(rows):
            return found
        if len(self.exact[0]):
            collect(found, *self.exact, hashes, lambda hit: np.searchsorted(first, hit, side="right") - 1)
        if not self.classes:
            return found
        # Block edges of the smallest class: every 2**SMALLEST shingles from a row's first one.
        step = 1 << SMALLEST
        blocks = -(-counts[rows] // step)
        base = np.concatenate([[0], np.cumsum(blocks)])
        at = np.arange(base[-1]) - np.repeat(base[:-1], blocks)
        edges = np.repeat(first[:-1][rows], blocks) + at * step
        for k in range(self.registers):
            low = np.minimum.reduceat(register(hashes, k), edges)
            begin, n = base, blocks
            for c in range(SMALLEST, self.classes[-1] + 1):
                if c > SMALLEST:  # blocks of this class are pairs of blocks of the one below
                    n2 = -(-n // 2)
                    begin2 = np.concatenate([[0], np.cumsum(n2)])
                    a = np.repeat(begin[:-1], n2) + 2 * (np.arange(begin2[-1]) - np.repeat(begin2[:-1], n2))
                    b = np.minimum(a + 1, np.repeat(begin[1:], n2) - 1)
                    low, begin, n = np.minimum(low[a], low[b]), begin2, n2
                if (c, k) not in self.index:
                    continue
                values, items = self.index[c, k]
                # Windows are neighbouring blocks; a row's last block goes with itself.
                after = np.minimum(np.arange(len(low)) + 1, np.repeat(begin[1:], n) - 1)
                window = np.minimum(low, low[after])
                collect(found, values, items, window, lambda hit, begin=begin: rows[np.searchsorted(begin, hit, side="right") - 1])
        return found


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[pa.Table]:
    """The items (id, text) in blocks of about ``BLOCK_BYTES`` at most."""
    held = Shielded(items)
    own = held.rows.select(F.col(held.of(item_id)).alias("id"), F.col(held.of(text)).alias("text")).where("text is not null")
    size = (F.octet_length("text") + 64).cast("long")
    total = own.agg(F.sum(size)).first()[0] or 0
    if not total:
        return
    if total <= BLOCK_BYTES:
        yield own.toArrow()
        return
    # Buckets of an eighth of a block, on average, are written in order, so that a block is a scan of few row groups.
    n = int(-(-total * 8 // BLOCK_BYTES))
    bucket = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    dealt = settle(own.withColumn("bucket", bucket).repartitionByRange("bucket").sortWithinPartitions("bucket"), "items")
    begin, held_bytes = 0, 0
    for b, m in [*sorted(map(tuple, dealt.groupBy("bucket").agg(F.sum(size)).collect())), (n, BLOCK_BYTES)]:
        if held_bytes and held_bytes + m > BLOCK_BYTES:
            yield dealt.where((F.col("bucket") >= begin) & (F.col("bucket") < b)).select("id", "text").toArrow()
            begin, held_bytes = b, 0
        held_bytes += m


def contained_items(
    docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    shingle: int = SHINGLE, threshold: float = THRESHOLD, registers: int = REGISTERS,
) -> DataFrame:
    """(id, item id, containment) for every document that holds an item."""
    by_value()
    held, asked, spark = Shielded(docs), Shielded(items), docs.sparkSession
    rows = held.rows.select(F.col(held.of(id_column)).alias("row"), F.col(held.of(text)).alias("text"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("item", asked.rows.schema[asked.of(item_id)].dataType), T.StructField("containment", T.DoubleType())])
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items, item_id, item_text):
        out = out.unionByName(_scan(rows, block, schema, shingle, threshold, registers))
    return out.toDF(id_column, item_id if item_id.lower() != id_column.lower() else f"{item_id}_item", "containment")


def _scan(rows: DataFrame, block: pa.Table, schema: T.StructType, size: int, threshold: float, registers: int) -> DataFrame:
    spark = rows.sparkSession
    shared = share(spark, Items(block.column("text").to_pylist(), size, threshold, registers))
    ids = spark.sparkContext.broadcast(pa.concat_arrays(block.column("id").chunks))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = revive(Items, shared)
        for batch in batches:
            hits = list(items.found(batch.column(1)))
            if hits:
                at, item, part = zip(*hits, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ids.value.take(pa.array(item)), pa.array(part, type=pa.float64())], names=["row", "item", "containment"])

    return rows.mapInArrow(work, schema)


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no item, in one pass over them for each block of items."""
    by_value()
    held = Shielded(docs)
    out, column = held.rows, held.rows.columns.index(held.of(text))
    for block in item_blocks(items, item_id, item_text):
        out = _filter(out, block, column, how.get("shingle", SHINGLE), how.get("threshold", THRESHOLD), how.get("registers", REGISTERS))
    return held.restore(out)


def _filter(rows: DataFrame, block: pa.Table, column: int, size: int, threshold: float, registers: int) -> DataFrame:
    shared = share(rows.sparkSession, Items(block.column("text").to_pylist(), size, threshold, registers))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = revive(Items, shared)
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[r for r, _, _ in items.found(batch.column(column))]] = False
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(work, rows.schema)
