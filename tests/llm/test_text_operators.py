"""Dealt operators on texts: against brute force, and on the odd cases that their docstrings define."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from horncast.llm import common, decontaminate, language_id, near_dup, quality_crf, textkern
from horncast.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOC)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingles(text, n=5):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


# Kernels ---------------------------------------------------------------------------------------
def test_words_are_runs_between_ascii_space():
    texts = ["a bc  d", "", None, " x\ty\n", "no-break space é", "\x1cz"]
    column = pa.array(texts)
    for limit in (1, 4, 1000):
        found = [[] for _ in texts]
        for row, data, offsets in textkern.slices(column, limit):
            w = textkern.Words(data, offsets)
            for s, e, d in zip(w.start, w.end, w.doc, strict=True):
                found[row + d].append(bytes(data[s:e]).decode())
        assert found == [["a", "bc", "d"], [], [], ["x", "y"], ["no-break space", "é"], ["\x1cz"]]


def test_equal_words_hash_alike_wherever_they_are():
    data = np.frombuffer(b"abc x abc y", np.uint8)
    w = textkern.Words(data, np.array([0, 11]))
    assert w.hash[0] == w.hash[2] and len(set(w.hash.tolist())) == 3


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(40):
        a = {int(x): float(rng.integers(1, 5)) for x in rng.choice(60, 40, replace=False)}
        b = {k: v for k, v in a.items() if rng.random() < 0.8} | {int(x): float(rng.integers(1, 5)) for x in rng.choice(60, 8)}
        sides = [(textkern.mix(np.array(sorted(z), dtype=np.uint64)), np.array([z[k] for k in sorted(z)])) for z in (a, b)]
        s = [near_dup.prob_minhash(h, np.zeros(len(h), np.int64), w, 1, 600)[0] for h, w in sides]
        sides = [(h[np.argsort(h)], w[np.argsort(h)]) for h, w in sides]
        exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
        assert near_dup.probability_jaccard(*sides) == pytest.approx(exact)
        gaps.append((s[0] == s[1]).mean() - exact)
    assert abs(np.mean(gaps)) < 0.01 and np.max(np.abs(gaps)) < 0.1


# Near duplicates ---------------------------------------------------------------------------------
def brute_classes(texts):
    sets, parent = {}, {}
    for i, t in enumerate(texts):
        if t is not None:
            sets[i], parent[i] = near_dup.weights_of(t, 5), i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (texts[i] == texts[j] or near_dup.probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-9):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def planted_texts():
    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.randrange(30, 200))) for _ in range(30)]
    for base in range(4):
        for _ in range(25):  # from almost equal to far, so that many pairs lie around the threshold
            w = texts[base].split()
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[5], texts[6] + "  ", "one two", "one two", "one  two", "three", "", "", None, None, "x " * 50, "x " * 80]
    return texts


def test_near_duplicates_are_the_classes_of_brute_force(spark):
    texts = planted_texts()
    got = {r["doc_id"]: r for r in near_dup.with_classes(docs_of(spark, texts).repartition(5)).collect()}
    want = brute_classes(texts)
    assert {i: got[i]["class_id"] for i in want} == want
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["class_id"] == i and got[i]["class_rows"] == 1 and got[i]["class_key"] is None
    assert got[0]["class_rows"] == sum(v == want[0] for v in want.values())
    empty = [i for i, t in enumerate(texts) if t == ""]
    assert {got[i]["class_id"] for i in empty} == {empty[0]}


def test_blocks_find_what_leaders_leave(monkeypatch, spark):
    """Small blocks, many of them, and a chain in which no text is linked to all others."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 4)
    rng = random.Random(9)
    w = words(rng, 120)
    texts = []
    for i in range(30):
        w[(i * 4) % 120] = f"step{i}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.with_classes(docs_of(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_block_links_equal_single_tests():
    rng = random.Random(5)
    base = words(rng, 60, 50)  # few different words: shingles repeat
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"n{rng.randrange(99)}"
        rows.append((bytes([i]), bytes([i % 7]), " ".join(w + w[: rng.randrange(0, 20)])))
    found = set(near_dup.block_links(rows, rows, 5, 0.8, True))
    want = {
        (a[0], b[0])
        for i, a in enumerate(rows)
        for b in rows[i + 1 :]
        if a[1] != b[1] and near_dup.probability_jaccard(near_dup.weights_of(a[2], 5), near_dup.weights_of(b[2], 5)) >= 0.8 - 1e-9
    }
    assert found == want and want


def test_deduplicate_keeps_one_row_of_each_class(spark):
    texts = planted_texts()
    docs = docs_of(spark, texts)
    docs = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 30").withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.withColumn("class_id", F.lit("kept")).withColumn("key", F.lit(1))  # names that the operator uses, too
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["text"] is not None)
    assert ids == sorted(set(brute_classes(texts).values())) and kept.where("text is null").count() == 2


def test_near_duplicates_of_nothing(spark):
    assert near_dup.with_classes(docs_of(spark, [])).count() == 0
    assert near_dup.deduplicate(docs_of(spark, [None])).count() == 1


# Decontamination -----------------------------------------------------------------------------------
def brute_leaks(texts, items, threshold=0.8):
    out = set()
    for i, t in enumerate(texts):
        have = decontaminate.exact_shingles(t or "", 5)
        for j, x in enumerate(items):
            want = decontaminate.exact_shingles(x or "", 5)
            if want and len(want & have) / len(want) >= threshold:
                out.add((i, j))
    return out


def test_items_are_found_wherever_they_are(spark):
    rng = random.Random(4)
    items = [" ".join(words(rng, rng.choice((5, 6, 9, 15, 33, 60, 200)))) for _ in range(40)] + ["too short here", "", None]
    items.append(items[0])
    texts = [" ".join(words(rng, rng.randrange(0, 900))) for _ in range(60)]
    for k in range(50):
        i, x = rng.randrange(60), items[k % 40].split()
        for _ in range(rng.randrange(0, 3)):
            x[rng.randrange(len(x))] = "changed"
        cut = texts[i].split()
        at = rng.randrange(len(cut) + 1)
        x = [w.upper() if k % 3 == 0 else w + "," if k % 3 == 1 else w for w in x]  # case and punctuation do not hide an item
        texts[i] = " ".join(cut[:at] + x + cut[at:])
    texts += [None, "", items[5], " ".join(words(rng, 30000)) + " " + items[6]]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r[0], r[1]) for r in decontaminate.contained_items(docs_of(spark, texts), table).collect()}
    want = brute_leaks(texts, items)
    assert got == want and len(want) > 25
    clean = decontaminate.decontaminate(docs_of(spark, texts), table)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(set(range(len(texts))) - {i for i, _ in want})


def test_items_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    items = [" ".join(words(rng, 20)) for _ in range(30)]
    texts = [items[i] + " " + " ".join(words(rng, 50)) for i in range(30)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    assert {tuple(r)[:2] for r in decontaminate.contained_items(docs_of(spark, texts), table).collect()} == {(i, i) for i in range(30)}


def test_shortest_items_are_never_missed(spark):
    rng = random.Random(12)
    items = [" ".join(words(rng, 5 + i % 4, 10**9)) for i in range(2000)]  # 1 to 4 shingles
    texts = [" ".join([*words(rng, 20, 10**9), x, *words(rng, 20, 10**9)]) for x in items]
    # An item whose shingles are all there, but apart; one that lacks a shingle; a text that repeats an item.
    a = items[1].split()
    texts += [" ".join([*a[:5], *words(rng, 300), *a[1:]]), " ".join([*a[:5], "other"]), " ".join(items[:1] * 50)]
    table = spark.createDataFrame(list(enumerate([*items, items[0]])), "item_id long, text string")
    got = sorted(tuple(r)[:2] for r in decontaminate.contained_items(docs_of(spark, texts), table).collect())
    assert got == sorted([(i, i) for i in range(2000)] + [(0, 2000), (2000, 1), (2002, 0), (2002, 2000)])
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs_of(spark, texts), table).collect()] == [2001]


def test_no_items_no_leaks(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(docs_of(spark, ["a b c d e f"]), none).count() == 0
    assert decontaminate.decontaminate(docs_of(spark, ["a b c d e f"]), none).count() == 1
    assert decontaminate.contained_items(docs_of(spark, []), none).columns == ["doc_id", "item_id", "containment"]


# Quality -------------------------------------------------------------------------------------------
def brute_marginals(unary, step):
    """Probability of label 1 at each place, by summing over all labellings."""
    n, total, ones = len(unary), 0.0, np.zeros(len(unary))
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        p = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(step[y[i], y[i + 1]] for i in range(n - 1)))
        total += p
        ones += p * np.array(y)
    return ones / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    row = np.repeat([0, 1, 3, 4], [4, 1, 7, 2])
    unary, step = rng.normal(size=(len(row), 2)), rng.normal(size=(2, 2))
    alpha, beta, _ = quality_crf.Chains(row).forward_backward(unary, step)
    both = alpha + beta
    p = 1 / (1 + np.exp(both[:, 0] - both[:, 1]))
    for r in set(row.tolist()):
        assert np.allclose(p[row == r], brute_marginals(unary[row == r], step))


def quality_rows(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(240):
        lines = [" ".join(words(rng, rng.randrange(5, 15))).capitalize() + "." for _ in range(rng.randrange(2, 7))]
        bad = i % 4 == 0
        if bad:
            lines = [x if k == 0 else " ".join(w.upper() + "!!" for w in x.split()) for k, x in enumerate(lines)]
        texts.append("\n".join(lines))
        labels.append((i, 0 if bad else 1))
    return docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_quality_on_held_out_documents(spark):
    docs, labels, truth = quality_rows(spark)
    held = quality_crf.held_out("doc_id", 5, 0)
    model = quality_crf.train(docs, labels.where(~held), id_column="doc_id", text="text", label="quality")
    again = quality_crf.train(docs.repartition(7), labels.where(~held), id_column="doc_id", text="text", label="quality")
    assert np.allclose(model.weights, again.weights)
    got = {r["doc_id"]: r["score"] for r in quality_crf.score_texts(docs, model).where(held).collect()}
    assert len(got) > 20 and np.mean([(s >= 0.3) == truth[i] for i, s in got.items()]) > 0.95


def test_quality_of_odd_texts(spark):
    docs, labels, _ = quality_rows(spark)
    model = quality_crf.train(docs, labels, id_column="doc_id", text="text", label="quality")
    odd = docs_of(spark, [None, "", " \n\n ", "x", "\n".join(["A line of words."] * 3000), "word " * 100_000, "a\n\n\nb"]).withColumn("score", F.lit("old"))
    got = [tuple(r) for r in quality_crf.score_texts(odd, model).orderBy("doc_id").select("score", "n_lines").collect()]
    assert [g[0] for g in got[:3]] == [0.0] * 3 and [g[1] for g in got] == [0, 0, 0, 1, 3000, 1, 2]
    assert all(0 <= g[0] <= 1 for g in got)
    assert quality_crf.score_texts(docs_of(spark, []), model).count() == 0


def test_quality_learns_from_every_line(spark, monkeypatch):
    rng = random.Random(9)
    good = lambda n: [" ".join(words(rng, rng.randrange(5, 15))).capitalize() + "." for _ in range(n)]
    junk = lambda n: [" ".join(w.upper() + "!!" for w in words(rng, 8)) for _ in range(n)]
    texts = ["\n".join(good(230) if i % 2 else good(200) + junk(200)) for i in range(24)]
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    new = docs_of(spark, ["\n".join(junk(20)), "\n".join(good(20))])
    train = lambda: quality_crf.train(docs, labels, id_column="doc_id", text="text", label="quality")
    bad, fine = [r["score"] for r in quality_crf.score_texts(new, train()).orderBy("doc_id").collect()]
    assert bad < 0.3 and fine > 0.7
    fitted, fit = [], quality_crf.fit
    monkeypatch.setattr(quality_crf, "TRAIN_LINES", 1000)
    monkeypatch.setattr(quality_crf, "fit", lambda own, row, size, y: fitted.append(row) or fit(own, row, size, y))
    train()
    lines = np.bincount(fitted[0])
    assert 700 < lines.sum() <= 1000 and set(lines.tolist()) <= {230, 400}  # whole documents


def test_quality_without_both_labels(spark):
    docs, labels, _ = quality_rows(spark)
    for some in (labels.where("quality = 1"), labels.where("false"), labels.withColumn("quality", F.lit(None).cast("int"))):
        model = quality_crf.train(docs, some, id_column="doc_id", text="text", label="quality")
        assert {r["score"] for r in quality_crf.score_texts(docs_of(spark, ["a b", ""]), model).collect()} == {0.5, 0.0}


# Languages -----------------------------------------------------------------------------------------
LANGS = {"en": "the of and to in that is was with for", "de": "der die und zu den mit von für ist nicht", "fr": "le la les et des que dans pour une être"}


def language_rows(spark, n=90):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = list(LANGS)[i % 3]
        common, syllables = LANGS[lang].split(), {"en": ["th", "er", "ing"], "de": ["sch", "ung", "ü"], "fr": ["eau", "é", "oi"]}[lang]
        text = " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice(syllables) for _ in range(3)) for _ in range(20))
        rows.append((i, text, lang, "s", len(text)))
    return spark.createDataFrame(rows, DOC)


def test_language_of_held_out_texts_and_of_unknown_words(spark):
    docs = language_rows(spark)
    held = quality_crf.held_out("doc_id", 3, 1)
    model = language_id.train(docs.where(~held))
    got = language_id.identify(docs.where(held), model).collect()
    assert got and all(r["lang_pred"] == r["lang"] and 0 < r["score"] <= 1 for r in got)
    unseen = docs_of(spark, ["schungüschung", "eauéoieauoi", "thinger ingthering"])
    assert [r["lang_pred"] for r in language_id.identify(unseen, model).orderBy("doc_id").collect()] == ["de", "fr", "en"]


def test_back_off_takes_the_longest_known_grams():
    model = language_id.Model(["a", "b"], np.log([0.5, 0.5]), {"known": 0}, {"wxyz"[:2]: 1, "q": 2}, np.array([[-1, -9], [-2, -8], [-3, -7]], np.float32))
    assert model.back_off("wx") == (1,) and model.back_off("q") == (2,) and model.back_off("qq") == (2, 2) and model.back_off("zz") == ()
    memo: dict = {}
    langs, scores = model.judge(pa.array(["known", "wx wx 12 ²", None, "12 ²", "known qq zz wxq"]), memo)
    assert langs == ["a", "a", "und", "und", "a"] and scores[2:4].tolist() == [0.0, 0.0]
    # Log odds 8, then 4, none, and 6 (of wx, since no longer gram of wxq is known).
    assert scores[4] == pytest.approx(1 / (1 + np.exp(-18))) and set(memo) == {"wx", "qq", "zz", "wxq"}


def plain_judge(model, text):
    """The back-off, word by word."""
    total, letters = model.prior.copy(), False
    for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        letters = True
        if w in model.words:
            total = total + model.table[model.words[w]]
            continue
        for n in (4, 3, 2, 1):
            padded = f"\x02{w}\x03" if n > 1 else w
            known = [model.grams[g] for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g in model.grams]
            if known:
                total = total + model.table[known].mean(axis=0, dtype=np.float64)
                break
    return model.langs[int(np.argmax(total))] if letters else "und"


def test_query_judges_as_a_plain_back_off_does(spark):
    """op5 over the whole table, against the same model applied word by word, and on its held-out third."""
    docs = common.read(spark, SF, "documents")
    held = quality_crf.held_out("doc_id", 3, 1)
    model = language_id.train(docs.where(~held))
    got = {r["doc_id"]: r for r in QUERIES["op5_word_first_language"](spark, SF).collect()}
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out")).collect()
    assert len(rows) == len(got) and all(got[r["doc_id"]]["lang_pred"] == plain_judge(model, r["text"]) and got[r["doc_id"]]["held_out"] == r["held_out"] for r in rows)
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if r["held_out"] and r["lang"] and got[r["doc_id"]]["lang_pred"] != "und"]
    assert np.mean(right) > 0.95


def test_long_texts_are_judged_in_pieces(spark, monkeypatch):
    model = language_id.train(language_rows(spark))
    texts = pa.array(["the and of with " * 50, None, "der die und " * 40 + "x" * 99, "", "12"])
    whole = model.judge(texts, {})
    monkeypatch.setattr(language_id, "PIECE", 64)
    cut = model.judge(texts, {})
    assert whole[0] == cut[0] == ["en", "und", "de", "und", "und"] and np.allclose(whole[1], cut[1], atol=1e-6)


def test_language_of_odd_texts(spark):
    model = language_id.train(language_rows(spark))
    odd = docs_of(spark, [None, "", "123 --- ²", "ЖЖ 漢字", "the " * 50_000]).withColumn("score", F.lit("old"))
    got = [tuple(r) for r in language_id.identify(odd, model).orderBy("doc_id").select("lang_pred", "score").collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[3][0] in LANGS and got[4] == ("en", 1.0)
    nothing = language_id.train(docs_of(spark, []))
    assert language_id.identify(docs_of(spark, ["the"]), nothing).first()["lang_pred"] == "und"


def test_language_training_is_bounded_and_repeatable(spark):
    docs = language_rows(spark)
    a, b = (language_id.train(docs.repartition(n), train_docs=40, words=10, n_grams=15) for n in (1, 6))
    assert 10 < len(a.words) <= 30 and len(a.grams) <= 45 and a.words == b.words and np.array_equal(a.table, b.table)


def test_a_rare_language_keeps_its_words(spark):
    """Three documents of one language beside many of others: the cut is for each language, and copies count once."""
    docs = language_rows(spark).where("lang != 'fr'")
    docs = docs.unionByName(docs_of(spark, ["le la les et des"] * 3, 1000).withColumn("lang", F.lit("fr")))
    model = language_id.train(docs, words=12, n_grams=200)
    assert {"le", "la", "les", "et", "des"} <= set(model.words)
    assert model.prior[model.langs.index("fr")] == pytest.approx(np.log(1 / (1 + docs.where("lang != 'fr'").select("text").distinct().count())))
    assert language_id.identify(docs_of(spark, ["les des la"]), model).first()["lang_pred"] == "fr"
