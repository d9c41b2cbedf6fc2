"""Operators on inline rows."""

import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexforge import schema as S
from lexforge.functions import artefacts as A
from lexforge.functions import dates as D
from lexforge.functions import html as H
from lexforge.functions import text as X
from lexforge.functions import urls as U
from lexforge.operators import evidence
from lexforge.operators import metrics as M
from lexforge.operators import ml as L
from lexforge.operators import prep as P
from lexforge.operators import retrieve as R
from lexforge.operators import verify as V
from lexforge.plans import ORACLES, QUERIES
from lexforge.sources import readers, sinks
from lexforge.streaming import events as E


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


def many(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, t {kind}")
    return [r["x"] for r in rows.select("k", fn(F.col("t")).alias("x")).orderBy("k").collect()]


# ---- text


def test_normalised(spark):
    got = many(spark, ["  “Hi” \t – it’s ﬁne \n\n  x ", "", "a\r\n b"], X.normalised)
    assert got == ['"Hi" - it\'s fine\nx', "", "a\nb"]


def test_keys_and_shingles(spark):
    assert one(spark, "  Ab-cd, É 12! ", X.dedup_key) == "ab cd 12"
    assert one(spark, "a b c", lambda t: X.shingles(X.key_words(t))) == ["a b c"]
    assert one(spark, "a b c d e f", lambda t: X.shingles(X.key_words(t))) == ["a b c d e", "b c d e f"]
    assert one(spark, "", lambda t: X.shingles(X.key_words(t))) == []


def test_ratings_cues_english(spark):
    assert many(spark, ["True", "Mostly True", "Pants on Fire!", "half true", None, ""], X.rating3) == ["TRUE", "TRUE", "FALSE", "MIXED", None, None]
    assert many(spark, ["False. Really", "Unproven", "Satire", "Outdated", "correct attribution"], X.review_rating3) == ["FALSE", None, "FALSE", "MIXED", "TRUE"]
    assert many(spark, ["BREAKING: fire", "he lives here", "just in case", None], X.has_recency_cue) == [True, False, True, False]
    assert many(spark, ["Short ascii line", "Esto es una frase en español más larga que otras que se ve aquí", "This is a sentence that we would like to see in the results of it"], X.looks_english) == [True, False, True]


TEXTS = [
    "WASHINGTON (Reuters) - The house voted.", "NEW YORK/LONDON (Reuters) - Stocks fell (Reuters) today.", "Follow @someone now", "See http://t.co/abc and https:// twitter.com/x ok", "Story text. Featured image via Getty",
    "He spoke. Photo by Joe Raedle/Getty Images", "Watch it below: then more", "LISTEN HERE: audio", "Here's the video via YouTube. Next", "John Smith is a reporter for Daily News. Bye", "Mail me at a.b@c.org please", "Text [VIDEO] more (IMAGES)",
    "(@user) September 28, 2017 said", "Sen. Ted ( ) spoke", "Via: Free Beacon text", "Source: Raw Story", "We went via Rome. photos: none. See below. HTTP is a protocol", "pic.twitter.com/GMco1 and pic. twitter. com", "Follow Trent Baker on Twitter at @x or email him at y.", "Read more: here\nnext line",
    "21st Century Wire says this\nrest", "Continue this story at Washington Times now", "(Official White House Photo by Amanda Lucidon) text", "Image credit: Nashville Public Schools", "[Email him] Email tips to us now.", "", "plain  text   here",
]


def test_artefacts_equal_plain_regular_expressions(spark):
    rows = spark.createDataFrame([(k, t, None) for k, t in enumerate(TEXTS)], "k int, text string, title string")
    got = {r["k"]: r for r in A.strip_frame(rows).collect()}
    chain = many(spark, TEXTS, A.strip_text)
    for k, t in enumerate(TEXTS):
        want, hits = t, []
        for name, p in A.TEXT_PATTERNS:
            p = p.replace("(?iu)", "(?i)").replace("(?ium)", "(?im)")
            new, n = re.subn(p, " ", want)
            hits += [name] * bool(n)
            want = new
        want = re.sub(r"[ \t]{2,}", " ", want).strip()
        assert (got[k]["text"], got[k]["hits"], chain[k]) == (want, hits, want), t
    assert got[16]["text"].startswith("We went via Rome. photos: none. See below") and got[0]["title"] == ""
    assert {r["pattern"]: r["n_docs"] for r in A.hit_counts(A.strip_frame(rows)).collect()}["dateline"] == 2


def test_titles(spark):
    got = many(spark, ["[VIDEO] A story", "A story - The New York Times", "A story (Again)", "Senator (R-TX) speaks", "End -"], A.strip_title)
    assert got == ["A story", "A story", "A story (Again)", "Senator (R-TX) speaks", "End"]


def test_urls(spark):
    assert many(spark, ["https://www.A.com/x/amp/?q#f", "a.com/x/", "http://u@b.org:80", None, "//c.net/y"], U.norm_url) == ["a.com/x", "a.com/x", "u@b.org:80", "", "//c.net/y"]
    assert many(spark, ["https://www.A.com/x", "a.com/x", "http://u@b.org:80", None], U.domain_of) == ["a.com", "a.com", "b.org", ""]
    rows = spark.createDataFrame([("https://www.snopes.com/x",), ("https://sub.reuters.com/a",), ("https://reuters.com/fact-check/b",), ("https://x.gov",), ("gov",), ("theonion.com",), ("q.org",)], "url string")
    assert [(r["tier"], r["weight"]) for r in U.with_tier(rows, "url").collect()] == [(1, 1.0), (2, 0.8), (1, 1.0), (2, 0.8), (4, 0.3), (0, 0.0), (4, 0.3)]


def test_reviews(spark):
    ld = '<link href="https://a/b" rel="canonical"><script type="application/ld+json">{"@graph":[{"@type":["X","ClaimReview"],"claimReviewed":"C","datePublished":"2020-01-02T00","reviewRating":{"ratingValue":1,"bestRating":5,"worstRating":1}}]}</script>'
    block = '<div class="pf-statement-quote"><p>Some <b>claim</b></p></div><div class="pf-statement-meter"><img src="x" alt="pants-fire"></div>'
    got = many(spark, [ld, block, "<html></html>", None, '<script type="application/ld+json">{bad</script>'], H.review)
    assert tuple(got[0]) == ("https://a/b", "C", "false", "2020-01-02") and tuple(got[1]) == (None, "Some  claim", "pants fire", None) and tuple(got[2]) == tuple(got[3]) == tuple(got[4]) == (None,) * 4


def test_dates(spark):
    got = many(spark, ["2018-02-17T10", "December 31, 2017", "Feb 3, 2016", "13-Apr-15", "nonsense", None], lambda t: D.parse_date(t).cast("string"))
    assert got == ["2018-02-17", "2017-12-31", "2016-02-03", "2015-04-13", None, None]
    row = spark.sql("SELECT DATE'2018-08-17' AS a, DATE'2018-02-17' AS b").select(F.round(D.months_between(F.col("a"), F.col("b")), 1).alias("m")).first()
    assert row["m"] == 5.9
    assert spark.sql("SELECT explode(array(DATE'2020-01-01', DATE'2020-03-01', DATE'2020-02-01', DATE'2020-04-01')) AS d").agg(D.median_low(F.col("d")).cast("string").alias("m")).first()["m"] == "2020-02-01"


# ---- preparation


def test_exact_and_near_dedup(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    base = r.choices(words, k=200)
    b = base[:100] + ["zz"] + base[101:]
    c = b[:30] + ["yy"] + b[31:]
    rows = [(0, " ".join(base)), (1, " ".join(base).upper() + "!"), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(r.choices(words, k=200)))]
    df = spark.createDataFrame(rows, "pos long, text string").repartition(3)
    left = P.drop_exact(df, "pos")
    assert {x["pos"] for x in left.collect()} == {0, 2, 3, 4}
    pairs = {(x["a"], x["b"]) for x in P.near_pairs(left, "pos", threshold=0.93).collect()}
    assert pairs == {(0, 2), (2, 3)}
    assert {x["pos"] for x in P.drop_near(left, "pos", threshold=0.93).collect()} == {0, 3, 4}  # 3 is only near a dropped one
    sig = P.minhash(left, "pos", perms=32)
    assert (0, 2) in {(x["a"], x["b"]) for x in P.lsh_candidates(sig, 16, 2).collect()}
    how = {x["pos"]: x["how"] for x in P.corpus_difference(df.filter("pos > 0"), df.filter("pos = 0"), "pos").collect()}
    assert how == {1: "exact", 2: "near", 3: "near", 4: "new"}  # two words of 200 are ten shingles of 196


def test_greedy_equals_a_scan(spark):
    r = random.Random(2)
    edges = {(a, b) for a, b in itertools.combinations(range(25), 2) if r.random() < 0.12}
    gone = set()
    for b in range(25):
        if any((a, b) in edges and a not in gone for a in range(b)):
            gone.add(b)
    got = P.greedy_drops(spark.createDataFrame(sorted(edges), "a long, b long"))
    assert {x["pos"] for x in got.collect()} == gone


def test_splits(spark):
    assert P.split_quotas({"a": 60_799})["a"] == (48_639, 6_080, 6_080)
    df = spark.createDataFrame([(k, "x" if k % 4 else "y", f"text {k}") for k in range(1000)], "id long, label string, text string")
    s = P.stratified_split(df, "label", "id")
    assert {(r["split"]): r["n"] for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 800, "val": 100, "test": 100}
    assert {r["id"] for r in s.filter("split = 'test'").collect()} == {r["id"] for r in P.stratified_split(df.repartition(7), "label", "id").filter("split = 'test'").collect()}
    assert P.split_report(s, "label").agg(F.max("max_deviation")).first()[0] < 0.01
    assert {r["shared"] for r in P.cross_split_overlap(s).collect()} == {0}
    b = P.balanced_sample(df, "label", "id", 7, ["x", "y"])
    assert {r["label"]: r["n"] for r in b.groupBy("label").agg(F.count("*").alias("n")).collect()} == {"x": 4, "y": 3}


# ---- metrics


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a", 0.9, 1), ("a", "b", 0.4, 1), ("b", "b", 0.4, 0), ("b", "b", 0.1, 0)], "gold string, pred string, p double, y int")
    rep = {r["label"]: r for r in M.class_report(df, ["a", "b", "c"]).collect()}
    assert rep["a"]["precision"] == 1.0 and rep["a"]["recall"] == 0.5 and rep["c"]["f1"] == 0.0
    s = M.summary(df, ["a", "b"]).first()
    assert s["accuracy"] == 0.75 and abs(s["macro_f1"] - (2 / 3 + 0.8) / 2) < 1e-12
    assert M.roc_auc(df, "p", "y").first()["auc"] == 0.875
    assert abs(M.cohen_kappa(df, "gold", "pred").first()["kappa"] - 0.5) < 1e-12
    assert M.flag_metrics(spark.createDataFrame([(1, 0)], "g int, f int"), "g", "f").first()["precision"] is None


# ---- verification


def plain_rule(english, satire, s, e, fc, flags, others, p, tau, me):
    side = "SUPPORTS" if s >= tau else "REFUTES" if s <= -tau else "NEUTRAL"
    no, yes = any(o[0] <= -tau and o[1] >= me for o in others), any(o[0] >= tau and o[1] >= me for o in others)
    checks = [
        ("LANG", "UNVERIFIABLE", not english), ("R0", "FAKE", satire), ("R1", "UNVERIFIABLE", e == 0), ("R2", "FAKE", fc), ("R3", "FAKE", side == "REFUTES" and e >= me), ("R4", "MISLEADING", side == "SUPPORTS" and flags),
        ("R5", "PARTIALLY TRUE", side == "SUPPORTS" and no), ("R6", "PARTIALLY TRUE", side == "NEUTRAL" and yes and no), ("R7", "REAL", side == "SUPPORTS" and e >= me),
        ("R8", "FAKE" if side == "REFUTES" and p is not None and p >= 0.85 else "REAL" if side == "SUPPORTS" and p is not None and p <= 0.15 else "UNVERIFIABLE", side != "NEUTRAL" and e == 1), ("R9", "UNVERIFIABLE", True),
    ]
    return next((r, v) for r, v, ok in checks if ok)


def test_rule_table(spark):
    cases = list(itertools.product([True, False], [True, False], [-1.5, -0.8, 0.0, 0.7, 0.8], range(5), [True, False], [True, False], [[], [(-2.0, 3)], [(2.0, 3)], [(-2.0, 3), (2.0, 3)], [(-2.0, 1)]], [None, 0.1, 0.5, 0.9]))
    rows = [(k, a, b, s, e, fc, fl, [Row(s=x, e=y) for x, y in o], p) for k, (a, b, s, e, fc, fl, o, p) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, english boolean, satire boolean, s_raw double, e_1 long, fc_match boolean, old_news boolean, others array<struct<s:double,e:bigint>>, p_fake double")
    df = df.withColumns({"out_of_context": F.lit(False), "mismatch_headline": F.lit(False), "pw_1": F.lit(1.0), "quality_1": F.lit(0.5)})
    for cfg in (V.Fusion(), V.Fusion(tau=0.6, min_evidence=2)):
        out = V.fuse(df.crossJoin(V.configs(spark, [cfg]))).select("k", "rule", "verdict", "confidence").collect()
        for r in out:
            assert (r["rule"], r["verdict"]) == plain_rule(*cases[r["k"]], cfg.tau, cfg.min_evidence), cases[r["k"]]
            assert 0.05 <= r["confidence"] <= 0.98 or r["verdict"] == "UNVERIFIABLE"


def test_confidence(spark):
    ev = spark.createDataFrame([(1, 1, "SUPPORTS", 0.9, 0.8, False, 2, None, 0.5)] * 2, "i int, claim_no int, stance string, p double, w double, is_factcheck boolean, tier int, rating3 string, cosine double").withColumn("score", F.lit(1.0))
    base = V.input_signals(V.claim_signals(ev, ["i", "claim_no"]).withColumn("score", F.lit(1.0)), "i")
    got = []
    for p in (0.5, 0.1, 0.9):
        own = base.withColumns({"english": F.lit(True), "satire": F.lit(False), "old_news": F.lit(False), "out_of_context": F.lit(False), "mismatch_headline": F.lit(False), "p_fake": F.lit(p)})
        fused = V.fuse(own.crossJoin(V.configs(spark, [V.Fusion(tau=0.6, min_evidence=2)])))
        got.append(fused.first())
    agreement = 1.44 / (1.44 + 1e-6)
    want = 0.5 * agreement + 0.3 * 0.5 + 0.2 * 0.8
    assert [g["verdict"] for g in got] == ["REAL"] * 3 and [g["confidence"] for g in got] == [round(want, 4), round(want + 0.1, 4), round(want - 0.1, 4)]
    texts = V.uncertainty(V.reason(fused.withColumns({"event_date": F.lit(None).cast("date"), "gap_months": F.lit(None).cast("double")}))).first()
    assert texts["reason"] == "2 reliable sources support the main claim." and texts["uncertainty"] == V.RETRIEVED_ONLY


def test_explanations_of_every_rule(spark):
    rules = ["LANG", *(f"R{k}" for k in range(10))]
    rows = spark.createDataFrame([(r, "REAL") for r in rules], "rule string, verdict string").withColumns({
        "claim": F.lit("A claim."), "n_sup": F.lit(1), "n_ref": F.lit(2), "n_1": F.lit(1), "sup_sources": F.lit("a, b"), "ref_sources": F.lit("c"), "summary": F.lit("s"), "refuted_text": F.lit("r."), "refuted_n": F.lit(2), "supported_text": F.lit("t"),
        "event_date": F.lit("2020-01-01"), "input_date": F.lit("2021-01-01"), "gap_months": F.lit(12.0), "mismatch_p": F.lit(0.8), "domain": F.lit("d.com"), "p_fake": F.lit(0.1), "old_news": F.lit(True), "out_of_context": F.lit(False), "mismatch_headline": F.lit(False),
        "fc_source": F.lit("S"), "fc_snippet": F.lit("x."), "fc_cosine": F.lit(0.81), "fc_rating": F.lit("False"),
    })
    got = {r["rule"]: r["explanation"] for r in V.explanation(rows).collect()}
    assert all(got[r] for r in rules) and got["R7"] == 'Marked REAL because 1 reliable sources (a, b) support "A claim".' and "similarity 0.81" in got["R2"]
    assert one(spark, "x", lambda t: V.source_list(F.array(*map(F.lit, "abcad")))) == "a, b, c +1 more"


def test_stance_and_context(spark):
    ev = spark.createDataFrame([("SUPPORTS", 0.6, 0.1, True, "FALSE", 0.2), ("NEUTRAL", 0.6, 0.1, True, "TRUE", 0.8), ("REFUTES", 0.6, 0.3, True, "FALSE", 0.9), ("REFUTES", 0.6, 0.3, False, "FALSE", 0.9)], "nli_stance string, nli_p double, p_neutral double, is_factcheck boolean, rating3 string, cosine double")
    assert [(r["stance"], r["p"]) for r in V.stance_override(ev).collect()] == [("REFUTES", 0.95), ("SUPPORTS", 0.95), ("NEUTRAL", 0.3), ("REFUTES", 0.6)]
    pair = spark.sql("SELECT array('new york') AS a, array('york') AS b, array('rome') AS c, array() AS d")
    assert tuple(pair.select(V.names_conflict(F.col("a"), F.col("b")).alias("x"), V.names_conflict(F.col("a"), F.col("c")).alias("y"), V.names_conflict(F.col("a"), F.col("d").cast("array<string>")).alias("z")).first()) == (False, True, False)


def test_retrieval(spark):
    vec = spark.createDataFrame([(k, [float(k == j) + 0.1 for j in range(4)]) for k in range(4)], "record_id long, embedding array<float>")
    top = R.vector_topk(vec, vec.withColumnRenamed("record_id", "query_id"), 1).collect()
    assert {(r["query_id"], r["record_id"]) for r in top} == {(k, k) for k in range(4)}
    own = spark.createDataFrame([([(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0])],)], "x array<struct<id:int,v:array<double>>>")
    assert [x["id"] for x in own.select(R.greedy_dedupe(F.col("x"), 0.85).alias("k")).first()["k"]] == [1, 3]
    ev = spark.createDataFrame([("https://a.com/x/amp/?u#f", None), ("https://b.com", "http://www.a.com/x"), ("https://c.com", None)], "url string, canonical string")
    leaked = R.leakage_guard(ev, spark.createDataFrame([("http://a.com/x",)], "url string"))
    assert sorted((r["url"], r["leaked"]) for r in leaked.collect()) == [("https://a.com/x/amp/?u#f", True), ("https://b.com", True), ("https://c.com", False)]


# ---- sources, sinks, streams


def test_readers(spark, tmp_path):
    (tmp_path / "w.csv").write_text(',title,text,label\n3,"A ""t""","line1\nline2",0\n4,B,x,1\n')
    got = readers.numbered_news(spark, str(tmp_path / "w.csv")).collect()
    assert [(r["id"], r["label"], r["label5"], r["text"]) for r in got] == [("welfake_3", "real", "REAL", "line1\nline2"), ("welfake_4", "fake", "FAKE", "x")]
    assert readers.paired_news(spark, str(tmp_path / "no.csv"), str(tmp_path / "w.csv")) is None
    (tmp_path / "l.tsv").write_text("\t".join(["12.json", "barely-true", 'He said "x', *["s"] * 11]) + "\n")
    r = readers.six_way_statements(spark, {"train": str(tmp_path / "l.tsv")}).first()
    assert (r["id"], r["label5"], r["label3"], r["split"], r["text"]) == ("liar_12", "MISLEADING", "MIXED", "train", 'He said "x')
    (tmp_path / "f.jsonl").write_text('{"id":7,"claim":"c","label":"NOT ENOUGH INFO","evidence":[[["1","2","B","3"],["1","2","A","1"]],[["1","2",null,null]],[["1","2","B","3"]]]}\n')
    r = readers.claim_lines(spark, str(tmp_path / "f.jsonl")).first()
    assert r["label"] == "NEUTRAL" and '"pages":["A","B"]' in r["meta"]
    (tmp_path / "bad.tsv").write_text("\t".join(["1.json", "maybe", *["s"] * 12]) + "\n")
    with pytest.raises(S.InvalidRows):
        readers.six_way_statements(spark, {"train": str(tmp_path / "bad.tsv")})
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", "d", "train"), ("a", "y", "d", "test")], "id string, label string, source_dataset string, split string")
    sinks.corpus(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).filter("split = 'test'").count() == 1
    sinks.split_csv(df, str(tmp_path / "s"))
    assert [r["id"] for r in readers.splits(spark, str(tmp_path / "s")).collect()] == ["a", "b"]
    old, new = spark.createDataFrame([("k", "1", 1.0)], "key string, value string, created double"), spark.createDataFrame([("k", "2", 2.0), ("m", None, 2.0)], "key string, value string, created double")
    assert [(r["key"], r["value"]) for r in sinks.upserted(old, new).collect()] == [("k", "2")]
    assert sinks.markdown(spark.createDataFrame([(1, 0.5, None)], "a int, b double, c string")) == "| a | b | c |\n|---|---|---|\n| 1 | 0.5000 | - |"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(src))
    for _ in range(2):
        E.append_new(E.stream(spark, str(src), 1), str(tmp_path / "out"), str(tmp_path / f"cp{_}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(str(src)).count()
    q = E.tumbling(E.stream(spark, str(src), 10), "1 day").writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = E.tumbling(spark.read.parquet(str(src)), "1 day").groupBy().agg(F.sum("n")).first()[0]
    assert 0 < spark.sql("SELECT sum(n) FROM days").first()[0] <= batch


def test_every_query_has_a_name_and_most_an_oracle():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 90 and len(QUERIES) - len(ORACLES) <= 9


@pytest.mark.parametrize(("links", "size"), [(2, 40), (2_000_000, 3000)])
def test_greedy_decides_chains_of_any_length(spark, monkeypatch, links, size):
    monkeypatch.setattr(P, "LOCAL_LINKS", links)
    chain = spark.createDataFrame([(k, k + 1) for k in range(size - 1)], "a long, b long")
    assert {x["pos"] for x in P.greedy_drops(chain).collect()} == {*range(1, size, 2)}
    assert P.greedy_drops(chain.limit(0)).count() == 0


def test_near_across_splits_raises(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(1, words, "train"), (2, words.upper() + "!", "val"), (3, words + " more", "test"), (4, "quite another text of some words here", "test")]
    found = P.near_across_splits(spark.createDataFrame(rows, "pos long, text string, split string"), "pos")
    assert {(r["split"], r["rows"], r["near"]) for r in found.collect()} == {("val", 1, 1), ("test", 2, 1)}
    with pytest.raises(ValueError, match="overlap"):
        P.require_disjoint(found, "near")
    P.require_disjoint(found.filter("near = 0"), "near")
    assert P.quotas({"a": 600, "b": 400}, 100) == {"a": 60, "b": 40} and P.quotas({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0} and P.quotas({"a": 3}, 10) == {"a": 3}


def test_review_parser(spark):
    page = lambda *blobs: "".join(f'<script type="application/ld+json">{b}</script>' for b in blobs)
    review = lambda name, **rating: json.dumps({"@type": ["Thing", "ClaimReview"], "claimReviewed": [[" a claim "]], "datePublished": "2020-01-02T03:04", "reviewRating": {"alternateName": name, **rating}})
    deep = "[" * 60_000 + "]" * 60_000
    nested = '{"a":' * 400 + review("Nested") + "}" * 400
    cases = {
        1: (page(review("False")), "False"), 2: (page("{broken", deep, review("True")), "True"), 3: (page(nested), "Nested"),
        4: (page(json.dumps({"@graph": [json.loads(review("first")), {"x": json.loads(review("last"))}]})), "last"), 5: (page(review("one"), review("two")), "two"),
        6: (page(review(None, ratingValue="4", worstRating=1, bestRating=5)), "mixed"), 7: (page(review("", ratingValue=5, worstRating=1, bestRating=5)), "true"), 8: (page(review(None, ratingValue=1, worstRating=1, bestRating="5")), "false"),
        9: (page(review(None, ratingValue=1, worstRating=1, bestRating=1)), None), 10: (page(review(None, ratingValue="x", worstRating=1, bestRating=2)), None), 11: ("<p>no review</p>", None), 12: (None, None),
        13: ('<div class="pf-statement-quote"><p>A <b>quoted</b>\nclaim</p></div><div class="pf-statement-meter"><img src="m" alt="pants-fire"></div>', "pants fire"), 14: (page(json.dumps([[]]), json.dumps({"@type": "ClaimReview", "reviewRating": []})), None),
    }
    df = spark.createDataFrame([(k, html) for k, (html, _) in cases.items()], "k int, html string")
    got = {r["k"]: r["r"] for r in df.select("k", H.review(F.col("html")).alias("r")).collect()}
    assert {k: got[k]["rating"] for k in cases} == {k: rating for k, (_, rating) in cases.items()}
    assert got[1]["claim_reviewed"] == "a claim" and got[1]["date"] == "2020-01-02" and got[13]["claim_reviewed"] == "A  quoted  claim" and got[13]["date"] is None


def test_evidence_assembly(spark):
    claims = spark.createDataFrame([(1, "the moon is made of green cheese")], "query_id long, claim string")
    body = "The moon is made of rock and dust, they say. Green cheese was never found on the moon by anybody at all. Short one. The weather is fine today in all of the town here."
    hits = spark.createDataFrame([(1, 0, "https://a.example/x", "old", "s"), (1, 1, "https://www.snopes.com/y", "t", "s"), (1, 2, "https://a.example/x", "new", "z"), (1, 3, None, "t", "s"), (1, 4, "https://en.wikipedia.org/w", "w", "s")], "query_id long, pos long, url string, title string, snippet string")
    pages = spark.createDataFrame([("https://a.example/x", body, "2020-01-01"), ("https://www.snopes.com/y", body, "2020-01-02"), ("https://en.wikipedia.org/w", body, "2020-01-03")], "url string, text string, d string").selectExpr("url", "text", "to_date(d) AS date")
    reviews = spark.createDataFrame([("https://www.snopes.com/y", " Moon made of cheese ", "False", "FALSE", None, "c"), ("https://a.example/x", "no first tier", "False", "FALSE", None, "c")], "url string, claim_reviewed string, rating string, rating3 string, date date, canonical string")
    extracts = spark.createDataFrame([(1, 9, "https://en.wikipedia.org/m", "M", body)], "query_id long, pos long, url string, title string, text string")
    ratings = spark.createDataFrame([(1, 10, "", "pub", "cheese moon", "Mostly True", None), (1, 11, "u", "pub", None, "x", None)], "query_id long, pos long, url string, publisher string, claim_reviewed string, rating string, date date")
    got = {r["pos"]: r for r in evidence.assemble(claims, hits, pages, reviews, extracts, ratings).collect()}
    assert {k: r["origin"] for k, r in got.items()} == {0: "web", 1: "web", 4: "web", 9: "encyclopaedia", 10: "factcheck"}
    assert got[0]["title"] == "new" and not got[0]["is_factcheck"] and str(got[0]["date"]) == "2020-01-01" and "Short one" not in got[0]["snippet"]
    assert got[1]["snippet"] == "Moon made of cheese" and got[1]["rating3"] == "FALSE" and got[1]["canonical"] == "c" and str(got[1]["date"]) == "2020-01-02" and got[4]["date"] is None
    assert got[10]["rating3"] == "TRUE" and got[10]["url"] == "pub"
    plain = {r["pos"]: r["is_factcheck"] for r in evidence.assemble(claims, hits, pages, reviews, extracts, ratings, evidence.shared_words, use_reviews=False).collect()}
    assert plain[1] is False and plain[10] is True


def test_headline_mismatch(spark):
    rows = [(1, "t", "b", 0.1, 0.8, 0.1), (2, "t", "b", 0.1, 0.6, 0.3), (3, "t", " t ", 0.1, 0.8, 0.1), (4, None, "b", 0.1, 0.8, 0.1), (5, "t", "b", 0.9, 0.05, 0.05)]
    df = spark.createDataFrame(rows, "k int, t string, b string, s double, r double, n double")
    flag, p = V.mismatch_headline(F.col("t"), F.col("b"), F.struct(F.col("s").alias("SUPPORTS"), F.col("r").alias("REFUTES"), F.col("n").alias("NEUTRAL")))
    assert {x["k"]: (x["f"], x["p"]) for x in df.select("k", flag.alias("f"), p.alias("p")).collect()} == {1: (True, 0.8), 2: (False, 0.6), 3: (False, None), 4: (False, None), 5: (False, None)}


def test_grids_are_whole():
    assert len(L.TFIDF_GRID) == 12 and sum(len(L.TFIDF_GRID if m != "nb" else [x for x in L.TFIDF_GRID if x[2]]) * len(v) for m, v in L.CLASSIFIERS.items()) == 90


def test_vector_topk_ties_and_widths(spark):
    rows = [(k, [1.0, 0.0]) for k in range(20)] + [(20, [0.0, 1.0]), (21, None), (22, [1.0, 0.0, 0.0])]
    index = spark.createDataFrame(rows, "record_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0])], "query_id long, embedding array<double>")
    got = [(r["query_id"], r["record_id"], r["rank"]) for r in R.vector_topk(index, asked, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 22, 1)]


def test_full_tfidf_takes_two_word_terms_and_more_than_20000(spark, tmp_path):
    words = [f"w{k}" for k in range(15_000)]
    texts = [" ".join(words), " ".join(words), "Été deux deux", "ete deux", "été deux ete", "deux", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc"]: r for r in QUERIES["tfidf_weights"](spark, str(tmp_path)).collect()}
    assert got[0]["n_terms"] == got[1]["n_terms"] == 29_999 and [got[k]["n_terms"] for k in (2, 3, 4)] == [3, 3, 3]
    idf = {"ete": math.log(8 / 4) + 1, "deux": math.log(8 / 5) + 1, "ete deux": math.log(8 / 4) + 1}
    raw = {t: (1 + math.log(2 if t == "deux" else 1)) * x for t, x in idf.items()}
    assert got[2]["max_w"] == round(max(raw.values()) / math.sqrt(sum(x * x for x in raw.values())), 5)
    top = {(r["doc"], r["rank"]): r["term"] for r in QUERIES["tfidf_top_terms"](spark, str(tmp_path)).collect()}
    assert (top[2, 1], top[3, 1], top[3, 2], top[3, 3]) == ("deux", "ete", "ete deux", "deux")
    assert {r["doc"]: r["cosine"] for r in QUERIES["nearest_neighbour_tfidf"](spark, str(tmp_path)).collect()} == {0: 1.0}


# ---- engine


def test_analyze(spark):
    from lexforge.plans import engine

    claim = "The city council of Springfield approved a budget of 40 million dollars in March"
    index = spark.createDataFrame([
        (1, claim + " said officials", None, "https://reuters.com/a", "r", "2020-03-01"), (2, "Officials said " + claim, None, "https://bbc.com/b", "b", "2020-03-02"), (3, claim + " report", None, "https://apnews.com/c", "a", "2020-03-03"),
        (4, "Martians landed near the old lighthouse yesterday evening according to sailors", "Pants on Fire", "https://www.snopes.com/d", "s", "2020-01-01"), (5, "Unrelated text about gardening and flowers", None, "https://x.org", "x", None),
    ], "record_id long, text string, rating string, url string, source string, date string")
    inputs = spark.createDataFrame([
        (1, "headline", claim, None, None, "2020-03-05"), (2, "headline", "Martians landed near the old lighthouse yesterday evening according to sailors", None, None, "2020-03-05"), (3, "headline", "BREAKING " + claim, None, None, "2021-03-05"),
        (4, "article", "Nothing known", "Some words that nobody has ever written about at all today.", "http://theonion.com/x", None), (5, "article", None, "Esto es una frase en español más larga que otras que se ve aquí y allí", None, None), (6, "article", "Obscure topic", "The zebra painted quantum violins beneath seven improbable mountains.", None, None), (7, "article", None, None, None, None),
    ], "input_id long, input_type string, title string, text string, url string, published string")
    got = {r["input_id"]: r for r in engine.analyze(inputs, index).collect()}
    assert {k: (r["rule"], r["verdict"]) for k, r in got.items()} == {1: ("R7", "REAL"), 2: ("R2", "FAKE"), 3: ("R4", "MISLEADING"), 4: ("R0", "FAKE"), 5: ("LANG", "UNVERIFIABLE"), 6: ("R1", "UNVERIFIABLE"), 7: ("R1", "UNVERIFIABLE")}
    assert all(r["explanation"] and r["uncertainty"] for k, r in got.items() if k != 7) and "3 reliable sources" in got[1]["explanation"]
    none = {r["input_id"]: r["rule"] for r in engine.analyze(inputs, index, use_evidence=False).collect()}
    assert none[1] == none[2] == "R1"
    guarded = {r["input_id"]: r["rule"] for r in engine.analyze(inputs, index, excluded=spark.createDataFrame([("http://snopes.com/d/?x",)], "url string")).collect()}
    assert guarded[2] == "R1" and engine.health(spark).first()["status"] == "ok" and engine.config(spark).count() > 10
    assert engine.explain(spark.createDataFrame([(1, "WOW!!! this is PLAIN")], "id int, text string"), "id").count() == 4


def test_headline_mismatch_in_analyze(spark):
    from lexforge.plans import engine

    title = "The minister approved the new bridge over the river"
    rows = [(1, "article", title, "The minister never approved the new bridge over the river. Officials confirmed that.", None, None), (2, "article", title, "The minister approved the new bridge over the river.", None, None), (3, "article", title, None, None, None), (4, "article", title, title, None, None)]
    inputs = spark.createDataFrame(rows, "input_id long, input_type string, title string, text string, url string, published string")
    index = spark.createDataFrame([(1, "Nothing of the kind", None, "https://reuters.com/a", "r", "2020-03-01")], "record_id long, text string, rating string, url string, source string, date string")
    got = {r["input_id"]: (r["mismatch_headline"], r["mismatch_p"]) for r in engine.analyze(inputs, index).collect()}
    assert got[1] == (True, 0.9) and got[2] == got[3] == got[4] == (False, None)
    off = engine.analyze(inputs, index, use_temporal=False).filter("input_id = 1").first()
    assert (off["mismatch_headline"], off["mismatch_p"]) == (False, None)


def test_claims(spark):
    from lexforge.plans import engine

    text = "The mayor said that 300 people met Anna Smith in the hall. Is it true that anybody came? I think we should go to the park. Too short here. The mayor said that 300 people met Anna Smith in the hall!"
    rows = engine.identify_claims(spark.createDataFrame([(1, "article", "A title", text), (2, "article", None, "One sentence only")], "input_id long, input_type string, title string, text string")).orderBy("input_id", "claim_no").collect()
    assert [(r["input_id"], r["claim"][:9], r["is_title"]) for r in rows] == [(1, "A title", True), (1, "The mayor", False), (1, "I think w", False), (2, "One sente", False)] and rows[3]["score"] == 1.0
