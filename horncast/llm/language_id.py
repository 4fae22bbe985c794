"""Language identification: words first, then ever shorter character n-grams.

A word (a run of letters, lower-cased) that the model knows adds its log frequency in each language.  An
unknown word backs off: its character n-grams of the longest length of which any is known (``NGRAMS``,
longest first; the word's edges count as characters) add the mean of their log frequencies.  A word without
a known n-gram adds nothing.  The sums over all words of the whole text, with the languages' prior, give
posterior probabilities; the best language and its probability are returned.

The model counts words and n-grams of a bounded sample: about ``TRAIN_DOCS`` labelled documents at most, those
with the least hash of text and language; equal texts of a language are learned from once.  It knows the
``WORDS`` most frequent words and the ``GRAMS`` most frequent n-grams of each language, and of each of them the
counts in all languages, so that a rare language keeps its words beside a frequent one; this bounds what is
collected and broadcast.

Texts are worked through in slices of a few MB: Arrow splits them to words, each different word of a slice is
looked up once, and sums for all texts are matrix operations.  A text longer than ``PIECE`` characters is cut
into pieces of that length, behind a word if it can be (a longer run of letters is cut into several).

Defined results: ``lang_pred`` is ``und`` with score 0.0 for a null text, a text without a letter, and
where nothing was learned.  Ties go to the language that sorts first.  Repeated rows are judged alike.  Columns
of the input are kept, whatever their names, but for those that are called as the new ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkern
from .common import Shielded, by_value, revive, settle, share

TRAIN_DOCS, WORDS, GRAMS = 20_000, 50_000, 50_000
NGRAMS = (4, 3, 2, 1)
UNKNOWN = "und"
#: What stands between words, in Arrow's own expressions.
NO_LETTERS = r"[^\pL]+"
MEMO = 100_000
#: Characters of a text that are split at once; tasks that learn.
PIECE, TRAIN_TASKS = 1 << 20, 32


def parted(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts with those longer than PIECE in pieces, and the row of each piece."""
    if not len(texts) or (pc.max(pc.utf8_length(texts)).as_py() or 0) <= PIECE:
        return texts, np.arange(len(texts))
    out, row = [], []
    for i, t in enumerate(texts.to_pylist()):
        at = 0
        while t is not None and len(t) - at > PIECE:
            cut = at + PIECE
            while cut > at + PIECE // 2 and t[cut - 1].isalpha():
                cut -= 1
            cut = cut if cut > at + PIECE // 2 else at + PIECE
            out.append(t[at:cut])
            row.append(i)
            at = cut
        out.append(t if t is None else t[at:])
        row.append(i)
    return pa.array(out, pa.large_string()), np.array(row)


def words_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(row of each word, its number in the list, different words) for slices of a column of texts."""
    for row, data, offsets in textkern.slices(texts):
        part, of = parted(texts.slice(row, len(offsets) - 1))
        rows, tokens = [], []
        for i in range(len(part)) if len(part) != len(offsets) - 1 else (None,):
            split = pc.split_pattern_regex(pc.utf8_lower(part if i is None else part.slice(i, 1)), pattern=NO_LETTERS)
            tokens.append(pc.list_flatten(split))
            where = pc.list_parent_indices(split).to_numpy()
            rows.append(of[where if i is None else where + i])
            if i is not None:  # one piece of a long text at a time
                yield row + rows.pop(), *_coded(tokens.pop())
        if tokens:
            yield row + rows[0], *_coded(tokens[0])


def _coded(tokens: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = tokens.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def grams(word: str, n: int) -> list[str]:
    padded = f"\x02{word}\x03"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None  # (tokens, languages) log frequencies

    def back_off(self, word: str) -> tuple[int, ...]:
        """Rows of the word's known n-grams, of the longest length of which there are any."""
        known = self.grams
        for n in NGRAMS:
            at = tuple(known[g] for g in grams(word, n) if g in known)
            if at:
                return at
        return ()

    def weigh(self, words: list[str], memo: dict[str, np.ndarray]) -> np.ndarray:
        """(words, languages) what each word adds; the empty word, between two separators, adds nothing."""
        out = np.zeros((len(words), len(self.langs)))
        known = np.array([self.words.get(w, -1) for w in words], dtype=np.int64)
        out[known >= 0] = self.table[known[known >= 0]]
        for i in np.flatnonzero(known < 0).tolist():
            w = words[i]
            if not w:
                continue
            got = memo.get(w)
            if got is None:
                if len(memo) >= MEMO:
                    memo.clear()
                at = self.back_off(w)
                got = memo[w] = self.table[list(at)].mean(axis=0, dtype=np.float64) if at else np.zeros(len(self.langs))
            out[i] = got
        return out

    def judge(self, texts: pa.Array, memo: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n, k = len(texts), len(self.langs)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        total, letters = np.zeros((n, k)), np.zeros(n, dtype=np.int64)
        for row, word, words in words_of(texts):
            each = self.weigh(words, memo)
            some = np.array([bool(w) for w in words], dtype=bool)[word]
            letters += np.bincount(row[some], minlength=n)
            for j in range(k):
                total[:, j] += np.bincount(row, each[word, j], n)
        total += self.prior
        best = np.argmax(total, axis=1)
        score = 1.0 / np.exp(np.maximum(total - total[np.arange(n), best][:, None], -700)).sum(axis=1)
        return [self.langs[b] if x else UNKNOWN for b, x in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters > 0, score, 0.0)


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS, words: int = WORDS, n_grams: int = GRAMS) -> Model:
    """Learns from rows with a text and a language."""
    by_value()
    held = Shielded(docs)
    rows = held.rows.select(F.col(held.of(text)).alias("text"), F.col(held.of(lang)).cast("string").alias("lang")).where("text is not null and lang is not null")
    n = rows.count()
    if n > train_docs:
        rows = rows.where(F.xxhash64("text", "lang").bitwiseAND(F.lit(2**63 - 1)) < int(train_docs / n * 2**63))
    rows = rows.dropDuplicates(["text", "lang"]).repartition(TRAIN_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, names = _coded(batch.column(1))
            held: Counter = Counter()
            for number in numbers.tolist():
                held[names[number], 0, ""] += 1
            for row, word, tokens in words_of(batch.column(0)):
                pair, often = np.unique(numbers[row].astype(np.int64) * len(tokens) + word, return_counts=True)
                for p, c in zip(pair.tolist(), often.tolist(), strict=True):
                    name, w = names[p // len(tokens)], tokens[p % len(tokens)]
                    if w:
                        held[name, 1, w] += c
            for (name, kind, w), c in list(held.items()):
                if kind == 1:
                    for k in NGRAMS:
                        for g in grams(w, k):
                            held[name, 2, g] += c
            names, kinds, tokens = zip(*held, strict=True) if held else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(kinds, pa.int32()), pa.array(tokens, pa.string()), pa.array(list(held.values()), pa.int64())],
                names=["lang", "kind", "token", "n"],
            )

    counts = rows.mapInArrow(count, "lang string, kind int, token string, n bigint").groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))
    counts = settle(counts, "counts")
    # Languages are as many as labels; what is collected of tokens is bounded by ``words`` and ``n_grams`` of each.
    docs_of = {r["lang"]: r["n"] for r in counts.where("kind = 0").collect()}
    sums = {(r["lang"], r["kind"]): r["s"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("s")).collect()}
    langs = sorted(docs_of)
    if not langs:
        return Model([], np.zeros(0))
    model = Model(langs, np.log(np.array([docs_of[x] for x in langs]) / sum(docs_of.values())))
    place = F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "token"))
    most = F.when(F.col("kind") == 1, words).when(F.col("kind") == 2, n_grams).otherwise(0)
    chosen = counts.withColumn("place", place).where(F.col("place") <= most).select("kind", "token").distinct()
    kept = counts.join(chosen, ["kind", "token"], "left_semi").select("kind", "token", "lang", "n").toArrow()
    parts, at = [], {x: i for i, x in enumerate(langs)}
    for kind, index in ((1, model.words), (2, model.grams)):
        top = kept.filter(pc.equal(kept.column("kind"), kind)).to_pydict()
        base = sum(len(p) for p in parts)
        for token in sorted(set(top["token"])):
            index[token] = base + len(index)
        table = np.full((len(index), len(langs)), 0.5)
        for token, name, c in zip(top["token"], top["lang"], top["n"], strict=True):
            table[index[token] - base, at[name]] += c
        totals = np.array([sums.get((x, kind), 0) for x in langs]) + 0.5 * (len(index) + 1)
        parts.append(np.log(table / totals).astype(np.float32))
    model.table = np.concatenate(parts)
    return model


def identify(docs: DataFrame, model: Model, *, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with ``lang`` and ``score`` (replaced if they are there)."""
    by_value()
    held, shared = Shielded(docs, (lang, score)), share(docs.sparkSession, model)
    column = held.rows.columns.index(held.of(text))
    schema = T.StructType([*held.rows.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, memo = revive(Model, shared), {}
        for batch in batches:
            langs, scores = judge.judge(batch.column(column), memo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return held.restore(held.rows.mapInArrow(work, schema), (lang, score))
