"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexforge.llm import balltree, decontamination, factorisation, jaccard, resampling, secrets, substring, warc
from tests.llm import brute

FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return FOLDED.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# ---- 12


def plain_report(docs, items, window=10):
    owners = {}
    for key, text in items:
        w = folded(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            owners.setdefault(tuple(w[i : i + window]), set()).add(key)
    out = []
    for key, text in docs:
        w, hit, found = folded(text), set(), set()
        for n in range(1, window + 1):
            for i in range(len(w) - n + 1):
                keys = owners.get(tuple(w[i : i + n]))
                if keys is not None:
                    hit |= set(range(i, i + n))
                    found |= {str(k) for k in keys if k is not None}
        out.append((key, len(w), len(hit), sorted(found)))
    return out


def benchmark_case(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["Éa", "É", "x1", "B"]
    run = lambda a, b: " ".join(r.choices(vocabulary, k=r.randint(a, b)))
    items = [(k, run(1, 25)) for k in range(20)] + [(20, None), (21, " .,; "), (22, "zz"), (23, "only these two"), (None, run(12, 14)), (3, run(15, 20))]
    items += [(30 + k, items[0][1]) for k in range(5)] + [(9, "b B b"), (40, "a a a a a a a a a a a a")]
    docs = [(0, None), (1, ""), (2, "  ,\n"), (3, "a " * 5000), (4, "ZZ, zz"), (None, items[2][1]), (None, "nothing at all"), (7, "x" * 100_000)]
    for k in range(10, 60):
        parts = [run(0, 60)] + [r.choice(items)[1] or "" for _ in range(r.randint(0, 2))]
        r.shuffle(parts)
        docs.append((k, " ".join(parts)))
    return docs + docs[8:12] + [(8, docs[20][1])], items


@pytest.mark.parametrize(("seed", "most"), [(1, 200_000), (2, 0)])
def test_benchmark_decontamination(spark, monkeypatch, seed, most):
    """Also where windows are too many for a broadcast."""
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", most)
    docs, items = benchmark_case(seed)
    table = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in docs], "doc_id long, text string, win string, n int, item string").repartition(3)
    ours = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, key int")
    got = decontamination.report(table, ours)
    order = lambda rows: sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2], x[3]))
    rows = got.collect()
    assert order((r["key"], r["n_words"], r["n_hit"], r["items"]) for r in rows) == order(plain_report(docs, items))
    assert all(sum(1 for _ in {j for s in r["spans"] for j in range(s["start"], s["start"] + s["size"])}) == r["n_hit"] for r in rows)
    clean = decontamination.clean(table, ours)
    want = sorted((k is None, k or 0, t or "") for (k, t), x in zip(docs, plain_report(docs, items), strict=True) if not x[2])
    assert clean.columns == table.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in clean.collect()) == want


def test_benchmark_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontamination.report(docs.limit(0), items).count() == 0
    assert {(r["key"], r["n_words"], r["n_hit"]) for r in decontamination.report(docs, items.limit(0)).collect()} == {(1, 2, 0), (None, 0, 0)}


def test_a_prefix_is_the_rarest_shingle(spark):
    docs = spark.createDataFrame([(k, "common words here " * 20 + ("rare thing now" if k == 3 else "")) for k in range(6)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "common words here rare thing now"), (2, "never seen at all")], "item_id long, text string")
    wins, _ = decontamination.windows(items)
    exploded = decontamination._exploded(docs, "doc_id", "text", [3])
    for few in (True, False):
        got = decontamination.prefixes(exploded, wins, 2, few).collect()
        assert [(r["at"], r["size"]) for r in got] == [(1, 6)]  # the first of those that occur once


# ---- 13


def plain_draw(docs, target, min_words=20, percent=5):
    def buckets(text):
        w = folded(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own, theirs = [0] * 10_000, [0] * 10_000
    for table, counts in ((docs, own), (target, theirs)):
        for _, text in table:
            for b in buckets(text)[1]:
                counts[b] += 1
    s, t = sum(own), sum(theirs)
    gain = [math.floor(1000 * math.log((y + 1) * (s + 10_000) / ((x + 1) * (t + 10_000)))) for x, y in zip(own, theirs, strict=True)]
    rows = []
    for key, text in docs:
        n, own_buckets = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own_buckets)
        rows.append([key, n, len(own_buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    place = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return [(*r, place.get(id(r))) for r in rows]


@pytest.mark.parametrize("percent", [5, 60])
def test_importance_resampling(spark, percent):
    r = random.Random(7)
    words = ["a", "B", "cd", "É", "é1", "x9" * 40, "the", "of"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    docs = [(0, None), (1, ""), (2, "..."), (3, "y" * 200_000), (None, text(30)), (None, text(3)), *((k, text(r.randint(0, 60))) for k in range(10, 200))]
    target = [(0, "the of the of a"), (1, None), (2, text(10))]
    table = spark.createDataFrame([(k, t, 1, "z") for k, t in docs], "doc_id long, text string, n_words int, score string").repartition(5)
    got = resampling.resample(table, spark.createDataFrame(target, "item_id long, text string"), percent=percent).collect()
    order = lambda rows: sorted(map(tuple, rows), key=lambda x: (x[0] is None, x[0] or 0, *x[1:5]))
    assert order(got) == order(plain_draw(docs, target, percent=percent))


def test_importance_resampling_of_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(5, "w " * 25)] * 40 + [(6, "v " * 30)] * 40, "doc_id long, text string").repartition(4)
    none = spark.createDataFrame([], "item_id long, text string")
    got = resampling.resample(docs, none, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 41)) and len({r["key"] for r in got if r["rank"]}) == 1
    assert resampling.resample(docs.limit(0), none).count() == 0


def test_crc_of_any_length():
    import numpy as np

    sizes = np.array([0, 1, 63, 64, 65, 1000, 70_000])
    crc = np.full(len(sizes), zlib.crc32(b"ab"), np.uint32)
    # moving past n bytes and adding the CRC of these bytes is the CRC of both
    assert [int(x) ^ zlib.crc32(b"q" * n) for x, n in zip(resampling.past(crc, sizes), sizes.tolist(), strict=True)] == [zlib.crc32(b"ab" + b"q" * n) for n in sizes.tolist()]


def test_hot_key_of_a_window(spark):
    """A window that most items and most documents have is joined once for each document and item."""
    passage = "one two three four five six seven eight nine ten"
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(f"{passage} tail {passage}").alias("text"))
    items = spark.range(50).select(F.col("id").alias("item_id"), F.concat(F.lit(f"{passage} item "), F.col("id").cast("string")).alias("text"))
    got = decontamination.report(docs, items).groupBy("n_hit", F.size("items").alias("n")).count().collect()
    assert [tuple(r) for r in got] == [(20, 50, 400)]


# ---- 11


def plain_negatives(rows, positives=5, negatives=3):
    """rows: (key, label, whole numbers)."""
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for key, label, v in rows:
        if key % 50 == 0:
            all_ = sorted(((score(v, w), -k, m) for k, m, w in rows if k != key), reverse=True)
            for s, k, _ in [x for x in all_ if x[2] == label][:positives]:
                own = [x for x in all_ if x[2] != label and 50 * s <= 100 * x[0] <= 95 * s]
                out += [(key, -k, n, -x[1], s, x[0]) for n, x in enumerate(own[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "block", "chunk", "leaf"), [(1, 16_384, 1024, 64), (2, 60, 3, 8)])
def test_hard_negatives(spark, monkeypatch, seed, block, chunk, leaf):
    """Clusters, ties, repeated rows, odd rows, vectors of other lengths and very large ones; blocks of several trees."""
    for name, x in (("BLOCK", block), ("CHUNK", chunk), ("LEAF", leaf)):
        monkeypatch.setattr(balltree, name, x)
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for k in range(0, 1500, 2):
        c = r.choice(centres)
        v = [r.choice([x, float(round(x)), x + r.gauss(0, 0.4)]) for x in c]
        rows.append((k, r.choice([0, 0, 0, 1, 2, 7, -1]), v[: r.choice([6, 6, 6, 4])]))
    rows += [(50_000, 1, [2e5, -4e5, 6e4]), (50_050, 1, [2e5, -4e5, 1.0]), (50_051, 2, [1.6e5, -3.4e5, 9.0]), (50_052, 2, [1.8e5, -3.4e5]), (50_100, 3, []), (50_150, 9, [0.0] * 6)]
    odd = [(51_000, None, [1.0]), (51_050, 1, None), (51_100, 1, [1.0, None]), (51_150, 1, [float("nan")]), (51_200, 1, [float("inf"), 1.0]), (None, 1, [1.0]), (51_250, 1, [1e30])]
    table = spark.createDataFrame([(*x, "x", 1) for x in rows + odd + rows[:40]], "vec_id long, label int, embedding array<double>, key string, block int").repartition(3)
    got = sorted(tuple(x) for x in balltree.mine(table, F.col("key") % 50 == 0).collect())
    want = plain_negatives([(k, m, [math.floor(256 * x) for x in v]) for k, m, v in rows])
    assert got == want and len(got) > 60 and any(x[0] == 50_000 for x in got)


def test_hard_negatives_of_few_rows(spark):
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.75, 0.75]), (3, 2, [0.75, 0.75]), (50, 5, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(x)[:4] for x in balltree.mine(table, F.col("key") % 50 == 0).collect()) == [(0, 1, 1, 2), (0, 1, 2, 3), (0, 1, 3, 50)]
    assert balltree.mine(table.limit(0), F.col("key") % 50 == 0).count() == 0
    # a key names one row: the least label and vector counts
    twice = table.union(spark.createDataFrame([(2, 1, [0.5, 0.5])], table.schema))
    assert sorted(tuple(x)[:4] for x in balltree.mine(twice, F.col("key") % 50 == 0).collect()) == [(0, 1, 1, 3), (0, 1, 2, 50)]


def test_ball_tree_prunes_and_is_exact():
    import numpy as np

    r = np.random.default_rng(5)
    rows = np.concatenate([r.normal(c, 0.05, (400, 8)) for c in r.normal(0, 1, (20, 8))])
    whole = np.floor(256 * rows).astype(np.int64)
    tree = balltree.BallTree.build(np.arange(len(whole)), whole)
    again = balltree.BallTree.of_row(*tree.row().values())
    q = whole[::97]
    s = q @ whole.T
    low, high = np.percentile(s, 40, axis=1).astype(np.int64)[:, None], np.percentile(s, 90, axis=1).astype(np.int64)[:, None]
    scored = []
    held = balltree.Best.add
    balltree.Best.add = lambda self, a, *rest: (scored.append(len(a)), held(self, a, *rest))[1]
    try:
        best = again.search(q, low, high, 3)
    finally:
        balltree.Best.add = held
    for k in range(len(q)):
        own = sorted((-x, i) for i, x in enumerate(s[k].tolist()) if low[k, 0] <= x <= high[k, 0])[:3]
        assert [(-x, i) for x, i in zip(best.score[k].tolist(), best.key[k].tolist(), strict=True)] == own
    assert sum(scored) < s.size / 10


# ---- names of words


def thue_morse(n):
    """Two words of n letters that a polynomial modulo 2^64 of any base can't tell apart, if n is 1,024 or more."""
    return tuple("".join("ab"[(k.bit_count() + flip) % 2] for k in range(n)) for flip in (0, 1))


def test_long_words_that_polynomials_confuse(spark):
    for n in (8, 32, 33, 64, 1024, 2048, 4096):
        one, two = thue_morse(n)
        for names in substring.names_twice([one, two, f"{one} {two}\n"])[:2]:
            assert names[0] == names[2] and names[1] == names[3] and names[0] != names[1]
    words = " ".join(f"w{k}" for k in range(24))
    for n in (1024, 4096):
        one, two = thue_morse(n)
        docs = spark.createDataFrame([(1, f"{words} {one} {words}"), (2, f"{words} {two} {words}")], "doc_id long, text string")
        got = {r["key"]: r["n_removed"] for r in substring.digests(docs).collect()}
        assert got == {1: 24, 2: 48}
        few = spark.createDataFrame([(1, f"a b c d e f {one}"), (2, f"a b c d e f {two}")], "doc_id long, text string")
        assert {(r["class_id"], r["n_links"]) for r in jaccard.join(few).collect()} == {(1, 0), (2, 0)}
    assert substring.names_of(["x" * 100 + "  \n", "x" * 100])[0].tolist()[0] == substring.names_of(["x" * 100])[0].tolist()[0]
    assert len({*substring.names_of(["x" * 20 + " " * 40 + "y", "x" * 20])[0].tolist()}) == 2


def test_more_runs_are_asked_for_until_few_pairs_are_missed():
    """No number of runs is a limit: the deepest walk of 1e12 classes asks for far fewer than can be numbered."""
    deep = math.log(1e12) / -math.log(jaccard.CLOSE * jaccard.SPREAD)
    assert math.log(1 - jaccard.TARGET_RECALL) / math.log(jaccard.miss(int(deep))) < jaccard.RUNS / 50


# ---- 1: nothing that the writer writes is lost


def test_warc_of_long_heads_and_large_records(spark, monkeypatch):
    for name, x in (("HELD_BYTES", 1 << 12), ("PIECE_BYTES", 1 << 10)):  # a page of 3 MB stands for one of gigabytes
        monkeypatch.setattr(warc, name, x)
    r = random.Random(3)
    large = "".join(r.choices("abcdefgh<>\n", k=3_000_000))
    rows = [(1, "http://h/" + "u" * 100_000, "p" * 1200), (2, "u", large), (3, "u", large), (4, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 50), (5, None, "\0" * 500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x["key"]: x for x in warc.read(warc.archives(warc.planned(pages, "page_id", "url", "html"))).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and all(got[k]["payload_digest"] == hashlib.sha1(t.encode()).hexdigest() and got[k]["payload_bytes"] == len(t) for k, _, t in rows)
    assert got[2]["refers_to"] == 3 and len(got[1]["uri"]) == 100_009
    assert warc.read(warc.archives(warc.planned(pages.limit(0), "page_id", "url", "html"))).count() == 0


def test_warc_salvages_after_hostile_bytes_in_little_time():
    import time

    good = warc.record(7, "u", b"x" * 1500, None)
    hostile = [b"WARC/1.1\r\n" * 100_000, b"WARC/1.1\r\na: b\r\n" * 60_000, b"x:WARC/1.1\r\n" * 80_000, b"x:WARC/1.1\r\n" * 80_000 + b"\r\n", b"\x1f\x8b\x08\x00\0\0\0\0\0\0" * 50_000, b"\x1f\x8b" * 100_000, b"\x1f\x8b\x08\x1f" * 50_000]
    for bad in hostile:
        for data in (bad + good, bad + b"\r\n\r\n" + zlib.decompress(good, 31)):
            began = time.perf_counter()
            assert [warc.key_of(f.head["warc-record-id"]) for f in warc.salvage(data) if f.kind] == [7]
            assert time.perf_counter() - began < 3


def test_warc_record_behind_a_head_cut_short():
    """The head of a damaged record runs into that of a whole one, which has no digest of its own."""
    cut = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:AAAA\r\nWARC-Date: 20"
    whole = b"WARC/1.1\r\nWARC-Record-ID: %s\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" % warc.record_id(5).encode()
    plain = b"WARC/1.1\r\nWARC-Record-ID: %s\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" % warc.record_id(6).encode()
    for one, key in ((whole, 5), (plain, 6)):
        assert [warc.key_of(f.head["warc-record-id"]) for f in warc.salvage(cut + one) if f.kind is not None] == [key]
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        assert [warc.key_of(f.head["warc-record-id"]) for f in warc.salvage(pack.compress(cut + one) + pack.flush()) if f.kind is not None] == [key]


# ---- 10: linear on runs of what a match goes on with


def test_secrets_of_hostile_runs(spark):
    import time

    token = "eyJabcdefgh.eyJabcdefgh.abcdefgh"
    dashes = "-----BEGIN PRIVATE KEY-----\n" + "ab-cd--ef\n" * 20_000 + "-----END PRIVATE KEY-----"
    texts = ["eyJ" * 1_400_000, "eyJ" * 1_000_000 + ".", "eyJ-" * 300_000 + " " + token, f"({token}) x{token} {token}.{token}", dashes + " after", "-----BEGIN PRIVATE KEY-----" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    began = time.perf_counter()
    got = {r["key"]: [tuple(s) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    assert time.perf_counter() - began < 60
    kinds = {k: i for i, k in enumerate(r.kind for r in secrets.RULES)}
    assert got[0] == got[1] == [] and got[2] == [(1_200_001, kinds["jwt"], 1_200_001 + len(token))]
    assert [s for s in got[3] if s[1] == kinds["jwt"]] == [(1, kinds["jwt"], 33), (69, kinds["jwt"], 101), (102, kinds["jwt"], 134)]
    assert got[4] == [(0, kinds["pem"], len(dashes))]
    assert got[3] == brute.spans(texts[3]) and got[5] == brute.spans(texts[5])


# ---- 9: scores against a plain version of the machine


def test_factorisation_scores_are_those_of_all_pairs(spark):
    import pickle

    r = random.Random(12)
    words = [f"w{k}" for k in range(30)]
    texts = [None, "", " ".join(r.choices(words, k=3000)), *(" ".join(r.choices(words[: 15 if k % 2 else 30], k=r.randint(1, 25))) + "!" * (k % 3) for k in range(120))]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, y int").repartition(3)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, len(texts))], "doc_id long, quality int, toxic int")
    model = factorisation.fit(factorisation.training_rows(docs, labels))
    w0, w, v = pickle.loads(model)
    got = {x["key"]: x for x in factorisation.classify(docs, labels).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        x = {}
        for slot, value in zip(*(a.tolist() for a in factorisation.features(t)), strict=True):
            x[slot] = x.get(slot, 0.0) + value
        own = sorted(x)
        z = w0 + sum(w[i] * x[i] for i in own) + sum(float(v[i] @ v[j]) * x[i] * x[j] for a, i in enumerate(own) for j in own[a + 1 :])
        # a slot that two features share meets itself no more than once in the identity
        score = 1 / (1 + math.exp(-z))
        assert got[k]["score"] == pytest.approx(score, rel=1e-9, abs=1e-9) and got[k]["predicted"] == int(got[k]["score"] >= 0.3)
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
