"""Dealt operators on archives, mixtures, shards, urls, chats and vectors: brute force, round trips, odd cases."""

import base64
import gzip
import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from horncast.llm import ann_tree, chat, common, mixing, sharding, url_filter, warc
from horncast.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC)


# WARC ----------------------------------------------------------------------------------------------
def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


PAGES = [
    (5, "http://a.org/1", "<p>same</p>"), (2, "http://a.org/2", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://a b.org/\r\nX: y", ""), (3, "u", None),
    (7, "http://b.org/é", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"), (8, "http://b.org", "ü漢\n\r\n\r\n"), (4, "", "long " * 200_000), (2, "http://a.org/2", "<p>same</p>"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_give_back_what_went_in(spark, least):
    pages = pages_of(spark, PAGES)
    path = warc.write_archive(pages, least_bytes=least)
    got = warc.read_archive(spark, path)
    rows = [tuple(r)[:6] for r in got.collect()]
    first = {}
    for i, _, html in PAGES:
        first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, url, html in PAGES:
        body = (html or "").encode()
        again = len(body) >= least and first[html or ""] != i
        target = None if url is None else "".join("%20" if ord(c) <= 32 else c for c in url)
        want.append((str(i), "revisit" if again else "response", target, base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body), str(first[html or ""]) if again else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted(want, key=key)
    texts = {(r["record_id"], bytes(r["payload"])) for r in warc.restore(got).collect()}
    assert texts == {(str(i), (html or "").encode()) for i, _, html in PAGES}


def test_damaged_archives_are_refused():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:%s\r\nWARC-Payload-Length: 1\r\nContent-Type: application/http\r\nContent-Length: 5\r\n\r\n\r\n\r\nx\r\n\r\n"
    digest = base64.b32encode(hashlib.sha1(b"x").digest())
    assert [r[0] for r in warc.Parser().feed(good % digest)] == ["1"]
    for bad in (good % digest[::-1], (good % digest).replace(b"WARC/1.1", b"HTTP/1.1"), (good % digest).replace(b"Length: 5", b"Length: 4")):
        with pytest.raises(ValueError):
            list(warc.Parser().feed(bad + b"\r\n\r\n"))


def test_parser_takes_any_pieces(spark):
    path = warc.write_archive(pages_of(spark, PAGES))
    files = [r["content"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()]
    for content in files:
        data = zlib.decompress(content, wbits=31)
        parser, found = warc.Parser(), []
        for i in range(0, min(len(data), 3000), 7):
            found += parser.feed(data[i : i + 7])
        found += parser.feed(data[i + 7 :] if data else b"")
        assert len(found) == data.count(b"WARC-Type:") and not parser.held


def foreign(kind, body, more=b"", type_=b"text/plain"):
    return b"WARC/1.0\r\nwarc-type: %s\r\nWARC-Record-ID: <urn:uuid:%s-%d>\r\n%sContent-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, kind, len(body), more, type_, len(body), body)


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n"
    digest = base64.b32encode(hashlib.sha1(b"abcde").digest())
    records = [
        foreign(b"warcinfo", b"software: x\r\n"), foreign(b"response", http, b"WARC-Payload-Digest: sha1:%s\r\n" % digest.lower(), b"application/http; msgtype=response"),
        foreign(b"revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", b"WARC-Refers-To: <urn:uuid:1>\r\nWARC-Target-URI:\r\n http://a\r\n", b"application/http"), foreign(b"resource", b"\xff\x00" * 200_000), foreign(b"metadata", b"", b"WARC-Payload-Digest: md5:00\r\n"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records * 40) + b"\0" * 9)  # a member for each record
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    got = warc.read_archive(spark, str(tmp_path)).collect()
    assert Counter(r["record_type"] for r in got) == dict.fromkeys(("warcinfo", "response", "revisit", "resource", "metadata"), 41)
    one = {r["record_type"]: r for r in got}
    assert bytes(one["response"]["payload"]) == b"abcde" and one["response"]["payload_bytes"] == 5 and one["response"]["payload_digest"] == digest.decode().lower()
    assert (one["revisit"]["payload"], one["revisit"]["refers_to"], one["revisit"]["url"], one["revisit"]["payload_bytes"]) == (None, "urn:uuid:1", "http://a", None)
    assert bytes(one["resource"]["payload"]) == b"\xff\x00" * 200_000 and one["metadata"]["payload_digest"] == "md5:00"
    whole = b"".join(gzip.compress(r) for r in records)
    for bad in (whole[:-30], whole + b"more", whole + gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nx")):
        (tmp_path / "a.warc.gz").write_bytes(bad)
        with pytest.raises(Exception, match="archive"):
            warc.read_archive(spark, str(tmp_path)).count()


def test_ids_of_other_types(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)  # the way for very many originals
    rows = [("a b>\r\nX: 1", "u", "same"), ("é%", "u", "same"), ("c", "u", "other"), ("c2", "u", "other"), ("c", "u", "other")]
    got = warc.read_archive(spark, warc.write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"))).collect()
    assert sorted((r["record_id"], r["refers_to"] or "") for r in got) == sorted([(rows[0][0], ""), ("é%", rows[0][0]), ("c", ""), ("c", ""), ("c2", "c")])


def test_empty_archive(spark):
    assert warc.read_archive(spark, warc.write_archive(pages_of(spark, []))).count() == 0


def test_null_page_ids(spark):
    got = warc.read_archive(spark, warc.write_archive(pages_of(spark, [(None, "u", "x"), (3, "u", "x"), (None, "u", "y")]))).collect()
    assert sorted((str(r["record_id"]), r["record_type"], r["refers_to"]) for r in got) == [("3", "response", None), ("None", "response", None), ("None", "revisit", "3")]


# Mixing --------------------------------------------------------------------------------------------
def brute_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rate = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * rate > most * sizes[s]]
        if not over:
            return fixed | {s: w[s] * rate for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def brute_seats(targets, house):
    seats = dict.fromkeys(targets, 0)
    queue = [(-t, i, s) for i, (s, t) in enumerate(targets.items()) if t > 0]
    heapq.heapify(queue)
    for _ in range(house if queue else 0):
        _, i, s = heapq.heappop(queue)
        seats[s] += 1
        heapq.heappush(queue, (-targets[s] / (2 * seats[s] + 1), i, s))
    return seats


def mix_rows(seed=0, n=400):
    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", "", None, "\U0001f600", "c", "d"]
    return [(i, " ".join("w" for _ in range(rng.choice((0, 1, 5, 40, 300)))) if rng.random() > 0.02 else None, names[min(8, int(rng.expovariate(0.5)))]) for i in range(n)]


def brute_selection(docs, targets, sizes, hashes, block, shards, seed=17):
    """{row: (taken by each shard, copies)}: blocks are lists of (row, token), dealt to the shards one after the other."""
    per_shard = max(1, sum(sizes.values()) // (shards * block))
    order = sorted(targets, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    before, quotas = dict.fromkeys(order, 0), []
    for j in range(shards):
        seats = brute_seats({s: targets[s] for s in order}, (j + 1) * per_shard)
        quotas.append({s: seats[s] - before[s] for s in order})
        before = seats
    assert all(sum(q.values()) == per_shard and min(q.values()) >= 0 for q in quotas)
    out = {}
    for s in order:
        line = [(k, t) for k in sorted((k for k in range(len(docs)) if docs[k][2] == s), key=lambda k: hashes[k]) for t in range(docs[k][1])]
        blocks = [line[i : i + block] for i in range(0, len(line), block)]
        n, primes = len(line) // block, mixing.next_primes((1 << 25) + seed * 64, 3)
        step, first = next((p for p in primes if n and n % p), 1), hashes["first", s] % n if n else 0
        drawn = sorted(range(n), key=lambda b: (b * step + first) % n) + list(range(n, len(blocks)))
        tokens = [x for _ in range(3) for b in drawn for x in blocks[b]][: round(targets[s])]
        ends = np.cumsum([q[s] * block for q in quotas])
        for i, (k, t) in enumerate(tokens):
            shard = min(shards - 1, int(np.searchsorted(ends, i, side="right")))
            row = out.setdefault(k, ([0] * shards, [0]))
            row[0][shard] += 1
            row[1][0] += t == docs[k][1] // 2
    return {k: (tuple(out[k][0]), out[k][1][0]) if k in out else ((0,) * shards, 0) for k in range(len(docs))}


@pytest.mark.parametrize("block, shards", [(64, 4), (7, 5), (100_000, 3)])
def test_selection_is_that_of_whole_blocks_drawn_by_quota(spark, block, shards):
    rows = [(i, t, s) for i, t, s in mix_rows()]
    docs = docs_of(spark, rows)
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs.repartition(5), common.word_count(F.col("text")), shards=shards, block_tokens=block).collect()}
    plain = [(i, len((t or "").split()), s) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, n, s in plain:
        sizes[s] += n
    hashes = {r["doc_id"]: (r["h"], r["doc_id"]) for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()}
    for r in docs.select("source", F.xxhash64(F.coalesce("source", F.lit("")), F.lit(18)).alias("h")).distinct().collect():
        hashes["first", r["source"]] = r["h"]
    block = min(block, sum(sizes.values()) // shards)
    want = brute_selection(plain, brute_targets(sizes, (5, 2, 1), 3), sizes, hashes, block, shards)
    assert {i: (tuple(r["shard_taken"]), r["copies"]) for i, r in got.items()} == want
    assert all(r["taken"] == sum(r["shard_taken"]) for r in got.values())


def test_targets_quotas_and_taken_words(spark):
    rows = mix_rows() + [(7, "again " * 50, "a"), (7, "again " * 50, "a"), (None, "no id", "b")]
    docs = docs_of(spark, rows).repartition(3)
    mix = lambda d: mixing.mix_sources(d, common.word_count(F.col("text")), shards=4, block_tokens=64)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = brute_targets(sizes, (5, 2, 1), 3)
    taken, whole, of_shard = Counter(), Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["size"] == len((r["text"] or "").split())
        assert r["copies"] <= 3 and (r["taken"] == 0) == (sum(r["shard_taken"]) == 0)
        taken[r["source"]] += r["taken"]
        whole[r["source"]] += r["copies"] * r["size"]
        for j, n in enumerate(r["shard_taken"]):
            of_shard[r["source"], j] += n
    for s, t in targets.items():
        assert taken[s] == round(t) and abs(whole[s] - t) <= 3 * 300
    # Quotas bind: every shard but the last draws whole blocks of every source, as many as it has seats.
    per_shard = sum(sizes.values()) // (4 * 64)
    for s, t in targets.items():
        for j in range(3):
            assert of_shard[s, j] % 64 == 0 or of_shard[s, j + 1] == 0
    for j in range(3):
        assert abs(sum(of_shard[s, j] for s in targets) - 64 * per_shard) <= 64 * len(targets)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], r["shard_taken"])
    assert sorted(map(key, got)) == sorted(map(key, mix(docs.repartition(7)).collect()))


@pytest.mark.parametrize("targets", [[5.0, 2.0, 1.0], [1.0], [100.0, 1.0, 1.0, 1.0, 0.0], [3.3, 3.3, 3.3], [0.0, 0.0], [7.0 + i % 5 for i in range(40)]])
def test_seats_are_those_of_the_highest_quotients(spark, targets):
    sources = spark.createDataFrame([(f"s{i:03d}", i + 1, t) for i, t in enumerate(targets)], "source string, place int, target double")
    houses = [1, 2, 7, 30, 101]
    got = {(r["house"], r["source"]): r["seats"] for r in mixing.allot(sources, houses).collect()}
    for h in houses:
        want = brute_seats({f"s{i:03d}": t for i, t in enumerate(targets)}, h)
        assert {s: got[h, s] for s in want} == want, h


def test_quotas_fill_every_shard(spark):
    sources = spark.createDataFrame([(f"s{i}", i + 1, t) for i, t in enumerate([5.0, 2.5, 0.1])], "source string, place int, target double")
    rows = mixing.shard_quotas(sources, 6, 50).collect()
    per = Counter()
    for r in rows:
        assert r["quota"] >= 0
        per[r["shard"]] += r["quota"]
    assert per == dict.fromkeys(range(6), 50)


def test_a_tiny_source_beside_a_huge_one_gets_its_target(spark):
    rows = [(i, "huge", 2_000_000 + i) for i in range(20)] + [(1000 + i, "large", 200_000) for i in range(20)]
    rows += [(2000 + i, None, 7 + i) for i in range(10)] + [(3000, "one", 1), (3001, "two", 90_001)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix_sources(docs, F.col("n")).collect()
    sizes, taken = defaultdict(int), Counter()
    for _, s, n in rows:
        sizes[s] += n
    targets = brute_targets(sizes, (5, 2, 1), 3)
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in targets.items()), (taken, targets)
    assert all(r["copies"] == 3 for r in got if r["source"] in ("one", "two")) and all(r["copies"] >= 2 for r in got if r["source"] is None)


def test_mixing_odd_tables(spark):
    size = common.word_count(F.col("text"))
    assert mixing.mix_sources(docs_of(spark, []), size).count() == 0
    (r,) = mixing.mix_sources(docs_of(spark, [(1, None, None)]), size).collect()
    assert (r["size"], r["target"], r["taken"], r["copies"]) == (0, 0.0, 0, 0)
    clash = docs_of(spark, mix_rows(2, 40)).withColumn("size", F.lit("x")).withColumn("target", F.lit("y"))
    assert mixing.mix_sources(clash, size).where("taken > 3 * size").count() == 0


def test_words_are_counted_as_the_contract_says(spark):
    texts = ["a b", "", None, "\x0b\x0c", "a\u00a0b c", "\x1c", " x "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(common.word_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [2, 0, 0, 0, 2, 1, 1]


# Sharding ------------------------------------------------------------------------------------------
def brute_line(rows):
    """Ids in order of fractional rank, given each source's order."""
    by = defaultdict(list)
    for i, s, order in rows:
        by[s].append((order, i))
    line = []
    for s, xs in by.items():
        line += [((k + 0.5) / len(xs), "null" if s is None else "=" + s, k, i) for k, (_, i) in enumerate(sorted(xs))]
    return [x[3] for x in sorted(line)]


def test_shards_match_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANK_BLOCK_ROWS", 37)  # many buckets
    rng = random.Random(0)
    rows = [(i, f"text {i % 50}", rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(700)]
    docs = docs_of(spark, rows).repartition(5)
    got = sharding.shard_interleaved(docs, 16, carry=["doc_id", "source"]).collect()
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(29)).alias("h")).collect()}
    want = brute_line([(i, s, (hashes[i], i)) for i, _, s in rows])
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == want
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(16):
        mine = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        for s, n in Counter(s for _, _, s in rows).items():
            assert abs(sum(r["source"] == s for r in mine) - n * len(mine) / 700) < 2.5


def test_shard_digests_and_odd_rows(spark):
    rows = [(1, "é", "a"), (2, None, "a"), (None, "", None), (1, "é", "a"), (1, "é", "a")]
    docs = docs_of(spark, rows).withColumn("shard", F.lit("x")).withColumn("size", F.lit(0))
    got = sharding.shard_interleaved(docs, 4, carry=docs.columns).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert sorted(Counter(r["shard"] for r in got).values()) == [1, 1, 1, 2]
    assert sharding.shard_interleaved(docs_of(spark, []), 4).count() == 0
    assert sorted(r["shard"] for r in sharding.shard_interleaved(docs_of(spark, rows[:2]), 4).collect()) == [1, 3]


# URLs ----------------------------------------------------------------------------------------------
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def brute_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(h + p, a) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, best[0], best[1]


URLS = [
    None, "", "no scheme", "http://", "http://net/", "http://net", "http://a.net/x", "HTTP://A.NET/x", "http://internet/", "https://m.example.net/en/1?x#y", "http://example.net/en", "http://x.example.com/de/",
    "http://example.com/dee", "http://example.com/de/a://b", "http://f.org/fr/", "http://org/fr/#", "http://.net/", "http://a..net/", "http://É.Net/é", "x://y.net?q/en/", "http://h.net:80/", "http://a\nb.net/\n",
]


def test_urls_are_judged_by_the_longest_rule(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    got = url_filter.judge_urls(pages, RULES).orderBy("page_id").collect()
    assert [tuple(r)[2:] for r in got] == [brute_judge(u, RULES) for u in URLS * 2]


def test_many_rules_and_keys_need_several_levels(spark):
    rng = random.Random(2)
    rules = [(f"h{i}.com", "/", "block") for i in range(300)] + [(f"h{i}.com", f"/p{i % 9}", "allow") for i in range(0, 300, 3)]
    urls = [f"http://{rng.choice(['', 'www.', 'a.b.'])}h{rng.randrange(3000)}.com/p{rng.randrange(9)}/x" for _ in range(4000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge_urls(pages, rules).orderBy("page_id").collect()
    assert [tuple(r)[2:] for r in got] == [brute_judge(u, rules) for u in urls]


@pytest.mark.parametrize("part", [1 << 18, 4])
def test_cascades_are_exact_over_their_universe(spark, monkeypatch, part):
    monkeypatch.setattr(url_filter, "PART_WORDS", part)  # levels of many parts
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")).unionByName(spark.range(500).select(F.lit("k7").alias("key")))
    lists = {"a": [f"k{i}" for i in range(0, 2000, 40)] + ["not there"], "b": [f"k{i}" for i in range(3, 20_000, 200)], "c": []}
    found = url_filter.build_cascades(lists, universe, "key", 3_000)  # too low an estimate
    assert len(found["a"].levels) > 2
    for name, keys in lists.items():
        wrong = universe.where(found[name].contains(F.col("key")) != F.col("key").isin(keys))
        assert wrong.count() == 0, name


def test_of_equally_long_rules_the_longer_host_wins(spark):
    pages = spark.createDataFrame([(1, "http://a.bc/de/x"), (2, "http://x.bc/de/x")], "page_id long, url string")
    got = url_filter.judge_urls(pages, [("bc", "/de/x", "block"), ("a.bc", "/de", "allow")]).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("a.bc/de", "allow"), ("bc/de/x", "block")]


def test_url_filter_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string").withColumn("host", F.lit("old"))
    assert tuple(url_filter.judge_urls(pages, []).first()) == (1, "http://a.net/", "a.net", "/", None, "allow")
    assert url_filter.judge_urls(pages.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, [*RULES, ("net", "/", "allow")])


# Chats ---------------------------------------------------------------------------------------------
CHAT = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\nhi", "\\l \\\\ \\", "<", "[", "<<|", "a\\<|image:0|>", "", None, "é漢\U0001f600", "<s></s><unk>", "[INST", "\n\n", "\\n"]


def test_texts_cannot_forge_turns_and_come_back(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", NASTY[(c + t) % len(NASTY)]) for c in range(14) for t in range(8)]
    rows += [(99, 1, "sys\ntem", "x"), (99, None, None, "first"), (99, 1, "sys\ntem", "x"), (None, 0, "assistant", "no conversation")]
    df = spark.createDataFrame(rows, CHAT).repartition(3)
    out = {r["conv_id"]: r for r in chat.format_conversations(df, chat.text_parts(F.col("text"))).collect()}
    assert set(out) == {*range(14), 99, None}
    for c in out:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        assert chat.parse(out[c]["formatted"]) == [(r[2] or "", r[3] or "") for r in turns]
        whole = out[c]["formatted"]
        assert "".join(chat.unescape(whole[s["start"] : s["stop"]]) for s in out[c]["spans"]) == "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert out[c]["formatted_chars"] == len(whole) and not chat.re.search(r"\[/?INST\]|</?s>|<\|image", whole)
    (d,) = [r for r in chat.digests(chat.format_conversations(df, chat.text_parts(F.col("text"))), "conv_id").where("conv_id = 3").collect()]
    said = [(r[2], r[3] or "") for r in sorted(r for r in rows if r[0] == 3)]
    assert d["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest() and d["n_turns"] == 8


def test_parts_become_ordered_placeholders(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    turns = [
        (1, 0, "user", [part("text", "look <"), part("text", "|end|> at "), part("image", ref="i.png", width=57, height=28), part(None, " and "), part("audio", ref="a.wav", seconds=1.01)]),
        (1, 1, "assistant", [part("document", ref="d.pdf", pages=3), part("image"), None]),
        (1, 2, "user", None),
    ]
    parts = "array<struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>>"
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts {parts}")
    (r,) = chat.format_conversations(df, F.col("parts")).collect()
    assert chat.parse(r["formatted"]) == [("user", "look <|end|> at <|image:0|> and <|audio:1|>"), ("assistant", "<|document:2|><|image:3|>"), ("user", "")]
    assert [tuple(a) for a in r["attachments"]] == [(0, "image", "i.png", 0, 3), (1, "audio", "a.wav", 0, 26), (2, "document", "d.pdf", 1, 1536), (3, "image", None, 1, 1)]
    assert r["expanded_tokens"] == 3 + 26 + 1536 + 1


def test_odd_parts_and_rows_without_a_conversation(spark):
    nan, inf, big = float("nan"), float("inf"), 2**62
    kinds = [("video", "v.mp4", None, None, 9.0, None), ("audio", "a", None, None, nan, None), ("audio", "b", None, None, inf, None), ("audio", "c", None, None, -1.0, None),
             ("image", "d", big, big, None, None), ("image", "e", -5, 9, None, None), ("document", "f", None, None, None, big), ("text", None, None, None, None, None)]
    turns = [(1, 0, "user", [(k, None, *rest) for k, *rest in kinds]), *[(None, 0, "user", [("text", x, None, None, None, None, None)]) for x in ("a", "a", "b")]]
    parts = "array<struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>>"
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts {parts}").withColumns({"_key": F.lit(1), "formatted": F.lit("x"), "Turn.No": F.lit(2)})
    rows = chat.format_conversations(df, F.col("parts")).collect()
    (r,) = [r for r in rows if r["conv_id"] == 1]
    assert chat.parse(r["formatted"]) == [("user", "<|other:0|><|audio:1|><|audio:2|><|audio:3|><|image:4|><|image:5|><|document:6|>")]
    most = chat.MOST_TOKENS
    assert [(a["kind"], a["tokens"]) for a in r["attachments"]] == [("video", 1), ("audio", 1), ("audio", most), ("audio", 1), ("image", most), ("image", 1), ("document", most)]
    assert r["expanded_tokens"] == most
    assert sorted(chat.parse(x["formatted"])[0][1] for x in rows if x["conv_id"] is None) == ["a", "a", "b"]


def test_a_long_conversation_and_no_conversation(spark):
    df = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    (r,) = chat.digests(chat.format_conversations(df, chat.text_parts(F.col("text"))), "conv_id").collect()
    assert r["n_turns"] == 30_000 and r["loss_sha256"] == hashlib.sha256("".join(map(str, range(30_000))).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0), chat.text_parts(F.col("text"))).count() == 0


# Vectors -------------------------------------------------------------------------------------------
def brute_search(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if i % every == 0:
            s = (x * np.array(v)).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def vectors(n, d, seed=0, same=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[rng.random(n) < 0.3] *= 3  # inner product is not cosine
    x[n - same :] = x[0]
    return [(i, v.tolist()) for i, v in enumerate(x)]


def recalls(got, want, k=20):
    return np.array([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / min(k, len(want[q])) for q in want])


@pytest.mark.parametrize("same", [0, 700])
def test_recall_and_ranking(spark, monkeypatch, same):
    monkeypatch.setattr(ann_tree, "LEAF_ROWS", 100)
    monkeypatch.setattr(ann_tree, "BLOCK_ROWS", 256)  # so that copies of one vector fill several blocks
    monkeypatch.setattr(ann_tree, "CALIBRATION", 64)
    rows = vectors(2000, 16, same=same)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(list)
    for r in ann_tree.search(df, lambda i: i % 10 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute_search(rows, 20, 10)
    assert set(got) == set(want)
    exact = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, found in got.items():
        assert len(found) == 20 and [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)
        assert all(s == pytest.approx((exact[q] * exact[i]).sum(), abs=1e-12) and i != q for i, s in found)
    found = recalls(got, want)
    assert found.mean() >= 0.95 and (found >= 0.9).mean() >= 0.93, (found.mean(), (found >= 0.9).mean())


def test_query_reaches_the_recall_of_the_contract(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in common.read(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    got = defaultdict(list)
    for r in QUERIES["op7_kmeans_tree_search"](spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    found = recalls(got, brute_search(rows, 20, 20))
    assert found.mean() >= 0.95 and (found < 0.9).mean() <= 0.05, (found.mean(), found.min(), (found < 0.9).mean())


def test_ids_that_repeat_are_one_query_and_one_candidate(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "LEAF_ROWS", 20)
    monkeypatch.setattr(ann_tree, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=6).round(2).tolist()) for i in np.repeat(np.arange(60), 3)] + [(7, [9.0] * 6)] * 80
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"leaf": F.lit("x"), "ID": F.lit(1), "a.b": F.lit(2)})
    got = defaultdict(list)
    for r in ann_tree.search(df, lambda i: i % 20 == 0, k=59).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (0, 20, 40):
        own = np.array(min(v for i, v in rows if i == q))
        best = {i: max(float((np.array(v) * own).sum()) for j, v in rows if j == i) for i in range(60) if i != q}
        assert [i for i, _ in got[q]] == [i for i, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))]
        assert [s for _, s in got[q]] == pytest.approx([best[i] for i, _ in got[q]])
    assert set(got) == {0, 20, 40}


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (7, []), (8, [1.0, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann_tree.search(df, lambda i: i % 20 == 0, k=20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 1.0), (0, 2, 9, 1.0), (0, 3, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 8, 1.0), (20, 3, 9, 1.0)]
    assert ann_tree.search(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert ann_tree.search(df.where("vec_id = 0"), lambda i: i % 20 == 0).count() == 0


def test_best_bins_come_first_and_every_leaf_once():
    x = np.array([v for _, v in vectors(600, 8)], dtype=np.float64)
    tree = ann_tree.fit_tree(x, np.linalg.norm(x, axis=1).max(), 24)
    assert tree.leaves == 24 and set(tree.assign(x).tolist()) <= set(range(24))
    for i, q in enumerate(tree.query(x[:20])):
        walk = list(tree.walk(q))
        assert sorted(walk) == list(range(24)), i
    same = ann_tree.fit_tree(np.ones((50, 3)), np.sqrt(3), 8)
    assert same.leaves == 1 and list(same.walk(np.ones(4))) == [0]
