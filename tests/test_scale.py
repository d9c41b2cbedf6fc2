"""Order statistics, row positions, the cache's buckets, sentences, the vector index and groups of near copies, against plain versions."""

import random
import statistics
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.operators import index as I
from lexforge.operators import orderstats as O
from lexforge.operators import prep as P
from lexforge.operators import sentences as N
from lexforge.sources import readers as R
from lexforge.sources import sinks as S


def test_order_statistics_of_a_hot_key(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, r.randint(0, 40), r.randint(0, 5000)])) for _ in range(4000)] + [("none", None), ("one", 7)]
    df = spark.createDataFrame(rows, "k string, v int")
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    got = {x["k"]: x for x in O.quantiles(df, ["k"], F.col("v"), [0.0, 0.05, 0.5, 0.99, 1.0], parts=16).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs) and list(got[k]["q"]) == pytest.approx(list(np.quantile(vs, [0.0, 0.05, 0.5, 0.99, 1.0])))
    assert {x["k"]: x["v"] for x in O.median_low(df, ["k"], "v", parts=16).collect()} == {k: statistics.median_low(vs) for k, vs in groups.items()}
    ranks = O.value_ranks(df, ["k"], F.col("v"), parts=16)
    assert all(x["before"] == sum(v < x["value"] for v in groups[x["k"]]) and x["total"] == len(groups[x["k"]]) for x in ranks.collect())
    plan = O.median_low(df, ["k"], "v")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "percentile" not in plan
    assert O.quantiles(df.limit(0), ["k"], F.col("v"), [0.5]).count() == 0 and O.quantiles(df, [], F.col("v"), [0.5]).first()["n"] == sum(map(len, groups.values()))


def test_positions_over_several_files_and_blocks(spark, tmp_path):
    for k, n in enumerate((5, 4000, 0, 3)):
        (tmp_path / f"part-{k}.csv").write_text("".join(f"{k}:{i}\n" for i in range(n)))
    want = [f"{k}:{i}" for k, n in enumerate((5, 4000, 0, 3)) for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many blocks of the large file
    try:
        raw = spark.read.schema("x string").csv(str(tmp_path))
        assert raw.rdd.getNumPartitions() > 3
        got = R.with_positions(raw).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((x["pos"], x["x"]) for x in got) == list(enumerate(want))


def test_an_update_of_the_cache_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = lambda ks, t, v="v": spark.createDataFrame([(f"k{k}", None if v is None else f"{v}{k}", float(t)) for k in ks], "key string, value string, created double")
    assert S.cache_read(spark, path).count() == 0
    assert S.cache_upsert(rows(range(500), 1), path, 16, 3) == []
    files = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    assert S.cache_upsert(rows([3, 4], 2, "new"), path, 16, 3) == [] and S.cache_upsert(rows([5], 2, None), path, 16, 3) == []
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in files.items())
    buckets = {x["key"]: x["bucket"] for x in S.cache_read(spark, path).collect()}
    full = S.cache_upsert(rows([3], 0, "old"), path, 16, 3)
    assert full == [buckets["k3"]]
    left = {p for p in files if p.exists()}
    assert {p for p in files if p not in left} == {p for p in files if f"bucket={buckets['k3']}" in str(p).split("/")}
    assert all(p.stat().st_mtime_ns == files[p] for p in left)
    got = {x["key"]: x["value"] for x in S.cache_read(spark, path).collect()}
    assert len(got) == 500 and got["k3"] == "new3" and got["k4"] == "new4" and got["k5"] == "v5"  # later entries win, failures aren't kept
    assert {x["bucket"] for x in S.cache_read(spark, path).filter(f"bucket = {buckets['k3']}").collect()} == {buckets["k3"]}


def test_sentences_by_the_corpus_own_abbreviations(spark):
    r = random.Random(2)
    names, verbs = ["Smith", "Jones", "Weber"], ["said so", "went home", "wrote it down"]
    texts = [f"Yesterday prof. {r.choice(names)} {r.choice(verbs)} again. The report came later. It cost 5 dollars approx. in all." for _ in range(60)]
    texts += ["Later all of it was done again by them.", "Again and later, all so home it went down the road."] * 5
    texts += ["Mr. J. Doe met prof. Smith. They ate!", "He asked why? Nobody knew... then it rained. Look at this now.", None, "", "One line\n\nAnother line", 'She said "stop." Then left.', "No. 5 is alive."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = N.abbreviations(df)
    assert "prof" in known and "approx" in known and not {"again", "later", "all"} & set(known)
    rows = {}
    for x in N.sentence_rows(df, "doc_id").orderBy("place").collect():
        rows.setdefault(x["key"], []).append((x["sentence"], x["skipped"]))
    assert [s for s, _ in rows[0]] == [texts[0].split(". The")[0] + ".", "The report came later.", "It cost 5 dollars approx. in all."]
    assert N.split_text(texts[70], frozenset(["prof", "mr"])) == ["Mr. J. Doe met prof. Smith.", "They ate!"]
    assert rows[71] == [("He asked why?", True), ("Nobody knew... then it rained.", False), ("Look at this now.", True)]
    assert 72 not in rows and 73 not in rows and [s for s, _ in rows[74]] == ["One line", "Another line"] and [s for s, _ in rows[75]] == ['She said "stop."', "Then left."]
    claims = {x["sentence"] for x in N.claims_of(N.sentence_rows(df, "doc_id")).collect()}
    assert "They ate!" not in claims and texts[0].split(". The")[0] + "." in claims
    assert N.abbreviation_scores(N.word_stops(df.limit(0))).count() == 0


def clustered(n=3000, dims=16, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, dims))
    v = centres[r.integers(0, 40, n)] + 0.35 * r.normal(size=(n, dims))
    v[: n // 3] = v[0]  # one vector is a third of all rows
    return v


def test_vector_index(spark, monkeypatch):
    monkeypatch.setattr(I, "PART", 200)
    v = clustered()
    rows = [(k, [float(x) for x in row]) for k, row in enumerate(v)] + [(9000, None), (9001, []), (9002, [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "record_id long, embedding array<double>").repartition(4)
    built = I.built(df, sample=1500)
    assert built.info.rows == 3000 and built.info.sampled == 1500 and built.info.lists == len(built.centres) and built.vectors.count() == 3000
    assert max(x["n"] for x in built.vectors.groupBy("list", "part").agg(F.count("*").alias("n")).collect()) < 400
    queries = df.filter("record_id % 50 = 0").select(F.col("record_id").alias("query_id"), "embedding")
    unit = v / np.sqrt((v * v).sum(1, keepdims=True))
    best = {}
    for q in range(0, 3000, 50):
        s = np.round(unit @ unit[q], 6)
        best[q] = sorted(range(3000), key=lambda k: (-s[k], k))[:5]
    got = {}
    for x in I.search(built, queries, 5).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = x["record_id"]
    assert {q: [x[k] for k in range(1, 6)] for q, x in got.items()} == best
    near = {}
    for x in I.search(built, queries, 5, probes=8, exact=False).collect():
        near.setdefault(x["query_id"], set()).add(x["record_id"])
    assert sum(len(near[q] & set(best[q])) for q in best) / (5 * len(best)) >= 0.9
    # lists that no query asks for are not read
    one = I.search(built, queries.filter("query_id = 2950"), 1, probes=1, exact=False)
    assert one.count() == 1
    assert I.search(built, queries.limit(0), 5).count() == 0 and I.build(df.limit(0), str(I.shared_dir(spark))).rows == 0


def test_bands_keep_the_recall():
    for t in (0.8, 0.9):
        for recall in (0.9, 0.99999):
            bands, rows = P.lsh_bands(t, recall, 256)
            assert bands * rows <= 256 and 1 - (1 - t**rows) ** bands >= recall
    with pytest.raises(ValueError):
        P.lsh_bands(0.1, 0.999999, 2)


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_recall_of_near_classes(spark, threshold):
    """Pairs just above the threshold: of 300, nine in ten are found, and nothing below it."""
    r = random.Random(6)
    words = [f"w{k}" for k in range(50_000)]
    texts = []
    for _ in range(300):
        base = r.choices(words, k=204)  # 200 shingles
        changed = list(base)
        changed[-1 - int(200 * (1 - threshold) / (1 + threshold) - 1) :] = r.choices(words, k=1 + int(200 * (1 - threshold) / (1 + threshold) - 1))
        texts += [" ".join(base), " ".join(changed[:-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)

    def jaccard(a, b):
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
        return len(x & y) / len(x | y)

    near = [k for k in range(300) if jaccard(texts[2 * k], texts[2 * k + 1]) >= threshold]
    assert len(near) == 300
    got = {x["pos"]: x["class_id"] for x in P.near_classes(df, "doc_id", "text", threshold).collect()}
    found = sum(got.get(2 * k + 1) == 2 * k for k in near)
    assert found >= 0.9 * len(near) and all(got[p] // 2 == p // 2 for p in got)


def test_near_classes_without_pairs(spark, monkeypatch):
    """A group of 3,000 near copies, none equal, is told by its members; about as many pairs are verified as there are members and bands."""
    base = [f"b{k}" for k in range(300)]
    texts = [" ".join([*base, f"own{k}"]) for k in range(3000)] + [" ".join(base[:150] + [f"x{k}" for k in range(150)]), "short text", "short text", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    verified = []
    held = P._verified
    monkeypatch.setattr(P, "_verified", lambda found, *rest: verified.append(found.count()) or held(found, *rest))
    got = {x["pos"]: x["class_id"] for x in P.near_classes(df, "doc_id").collect()}
    assert got == {**dict.fromkeys(range(3000), 0), 3001: 3001, 3002: 3001}
    assert sum(verified) < 3000 * 20
    assert P.near_classes(df.limit(0), "doc_id").count() == 0


def test_components_of_chains(spark):
    r = random.Random(9)
    order = list(range(500))
    r.shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)] + [(900, 901), (901, 900)], "a long, b long")
    got = {x["v"]: x["label"] for x in P.components(edges).collect()}
    assert got == {**dict.fromkeys(order, 0), 900: 900, 901: 900}
