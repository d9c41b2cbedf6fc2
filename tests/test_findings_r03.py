"""Faults that the third round's reviewer found, each on the smallest input that showed it."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexforge.functions import text as X
from lexforge.operators import features as T
from lexforge.operators import ml as L
from lexforge.operators import prep as P
from lexforge.operators import serving as S
from lexforge.plans import analysis as A


def sql_rows(path, name, columns, *tables):
    """What the query's SQL gives, in the order of columns."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    rows = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    con.close()
    return sorted(rows, key=repr)


def spark_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def late_events(tmp_path_factory):
    """Events of which half lie in the last half second of a span of three days, where the second's rounding decides on the span."""
    r, path, rows = random.Random(5), tmp_path_factory.mktemp("late"), []
    ends = [datetime(1970, 1, 1) + timedelta(days=3 * k) for k in (6574, 6575, 6576)]
    for k in range(2400):
        ts = r.choice(ends) + timedelta(microseconds=r.choice([-500_000, -499_999, -1, 0, 1, 499_999, 500_000, -r.randint(10**6, 10**11)]))
        rows.append((k, ts, r.randint(0, 120), r.choice(["signup", "purchase", "error", "view", "click"]), 1.0, f'{{"k": {r.randint(0, 99)}}}'))
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.timestamp("us"), pa.int64(), pa.string(), pa.float64(), pa.string()]
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names), path / "events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["claim_signals", "ablation", "context_conflict", "evidence_rank", "evidence_summary", "explanations", "fusion_verdicts", "leak_strip", "old_news", "rule_counts"])
def test_days_are_cut_from_rounded_seconds(spark, late_events, name):
    out = entry.queries()[name](spark, late_events)
    assert spark_rows(out) == sql_rows(late_events, name, out.columns, "events")


@pytest.fixture(scope="module")
def texts(tmp_path_factory):
    """Documents with copies, an empty and a null text, and labels of most of them."""
    r, path = random.Random(8), tmp_path_factory.mktemp("texts")
    words = [f"w{k}é" if k % 5 == 0 else f"W{k}" for k in range(60)]
    rows = [" ".join(r.choice(words[(k % 2) * 20 :][:40]) for _ in range(r.randint(1, 90))) for k in range(120)]
    rows[7], rows[9], rows[11] = "", None, rows[10]
    ids = list(range(1, 121))
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": rows, "source": [f"s{k % 4}" for k in ids], "lang": ["en"] * 120, "n_chars": pa.array([len(x or "") for x in rows], pa.int64())}), path / "documents.parquet")
    own = [k for k in ids if k % 6]
    pq.write_table(pa.table({"doc_id": pa.array(own, pa.int64()), "quality": pa.array([k % 2 if k % 7 else 1 - k % 2 for k in own], pa.int32()), "toxic": [False] * len(own)}), path / "labels.parquet")
    return str(path)


def test_a_model_of_any_number_of_terms_scores_all_texts(spark, texts, monkeypatch):
    names = ["doc_id", "p_fake"]
    narrow = spark_rows(entry.queries()["batch_p_fake"](spark, texts))
    monkeypatch.setattr(S, "MAX_BROADCAST", 10)
    wide = spark_rows(entry.queries()["batch_p_fake"](spark, texts))
    assert len(wide) == 120 and wide == narrow == sql_rows(texts, "batch_p_fake", names, "documents", "labels")


def test_words_of_a_model_of_any_number_of_terms(spark, texts, monkeypatch):
    narrow = spark_rows(entry.queries()["lime_words"](spark, texts))
    monkeypatch.setattr(S, "MAX_BROADCAST", 10)
    assert spark_rows(entry.queries()["lime_words"](spark, texts)) == narrow and len({x[0] for x in narrow}) == 118


def test_surest_mistakes_of_a_model_of_any_number_of_terms(spark, texts, monkeypatch):
    monkeypatch.setattr(S, "MAX_BROADCAST", 10)
    out = entry.queries()["top_errors"](spark, texts)
    assert spark_rows(out) == sql_rows(texts, "top_errors", out.columns, "documents", "labels") and out.count() > 3


def pairs_written(monkeypatch):
    """Columns of all intermediate tables from now on."""
    made, held = [], T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, **o: made.append(df.columns) or held(df, **o))
    return made


@pytest.mark.parametrize("block", [3, 4096])
def test_nearest_writes_no_pairs(spark, texts, monkeypatch, block):
    made = pairs_written(monkeypatch)
    monkeypatch.setattr(T, "BASE_BLOCK", block)
    out = entry.queries()["nearest_neighbour_tfidf"](spark, texts)
    plan = out._jdf.queryExecution().toString()
    assert spark_rows(out) == sql_rows(texts, "nearest_neighbour_tfidf", out.columns, "documents", "labels")
    assert ["base"] in made and "Join" not in plan  # weights meet in blocks


def test_mistakes_have_nearest_documents_without_pairs(spark, texts, monkeypatch):
    made = pairs_written(monkeypatch)
    monkeypatch.setattr(T, "BASE_BLOCK", 7)
    out = entry.queries()["error_analysis"](spark, texts)
    assert spark_rows(out) == sql_rows(texts, "error_analysis", out.columns, "documents", "labels") and out.count() > 3
    assert ["base"] in made


def test_minima_are_those_of_the_built_in_hash_and_no_lambda_makes_them(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(n)) for n in (1, 4, 5, 30, 900, 1800)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    s = df.select("i", X.hashed_shingles(X.key_words(F.col("text"))).alias("s")).filter(F.size("s") > 0)
    want = s.select("i", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda k: F.array_min(F.transform("s", lambda x: F.xxhash64(x, k + 100_000)))))
    got = P.minhash(df, "i")
    assert spark_rows(got) == spark_rows(want) and len(spark_rows(got)) == 6
    assert "MapInArrow" in got._jdf.queryExecution().toString() and "array_min" not in got._jdf.queryExecution().toString()


def test_near_copy_groups_hold_sets_once(spark, texts, monkeypatch):
    gone, held = [], P.discard
    monkeypatch.setattr(P, "discard", lambda *t: gone.append([x.columns for x in t]) or held(*t))
    out = entry.queries()["near_copy_groups"](spark, texts)
    assert spark_rows(out) == sql_rows(texts, "near_copy_groups", out.columns, "documents")
    assert [sorted(set(sum(x, [])) & {"shingles", "shared"}) for x in gone] == [["shingles"], ["shared"]]  # before any link is verified


@pytest.mark.parametrize("part", [7, 8192])
def test_naive_bayes_points_are_sums_and_write_no_vectors(spark, texts, monkeypatch, part):
    monkeypatch.setattr(L, "with_vectors", None)
    monkeypatch.setattr(L, "_PART_TERMS", part)
    out = entry.queries()["grid_search_nb"](spark, texts)
    assert spark_rows(out) == sql_rows(texts, "grid_search_nb", out.columns, "documents", "labels")


def test_difference_compares_each_text_once(spark, tmp_path, monkeypatch):
    r, rows = random.Random(4), []
    bases = [[r.choice("abcdefghijklmnopqrst") + str(r.randint(0, 9)) for _ in range(60)] for _ in range(12)]
    for k in range(480):
        words = list(bases[k % 12])
        if k // 12 % 3 == 0:
            words[k // 12] = f"new{k // 12}"  # near copies
        rows.append(r.choice([" ", ", "]).join(words) if k % 12 != 7 else ["", None, "...", "É x"][k // 12 % 4])
    ids = list(range(1, 481))
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": rows}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i in ids if i % 24 < 13], pa.int64())}), tmp_path / "labels.parquet")
    met, held = [], P._verified
    monkeypatch.setattr(P, "_verified", lambda found, *a: met.append(found.count()) or held(found, *a))
    out = entry.queries()["corpus_difference"](spark, str(tmp_path))
    assert spark_rows(out) == sql_rows(tmp_path, "corpus_difference", out.columns, "documents", "labels") and len(out.select("how").distinct().collect()) == 3
    assert sum(met) < 200  # copies of a text are one text


@pytest.mark.parametrize("passes", [1, 3])
def test_vocabulary_in_passes_is_the_vocabulary(spark, passes):
    r = random.Random(6)
    df = spark.createDataFrame([(k, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(30))) for k in range(60)], "doc_id long, text string")
    lists = T.term_lists(df, "doc_id")
    for most in (20, 10_000):
        assert spark_rows(T.vocabulary_in_passes(lists, 60, passes, max_features=most)) == spark_rows(T.vocabulary(lists, 60, max_features=most))


def test_error_analysis_writes_no_terms_and_weighs_only_what_it_compares(spark, texts, monkeypatch):
    made, weighed = [], []
    for module in (A, T, L):
        monkeypatch.setattr(module, "materialize", lambda df, held=module.materialize, **o: made.append(df.columns) or held(df, **o))
    monkeypatch.setattr(T, "weighted", lambda lists, *a, held=T.weighted: weighed.append(lists.count()) or held(lists, *a))
    out = entry.queries()["error_analysis"](spark, texts)
    assert spark_rows(out) == sql_rows(texts, "error_analysis", out.columns, "documents", "labels")
    labelled = spark.read.parquet(f"{texts}/labels.parquet").count()
    assert sum(weighed) <= labelled and not any("terms" in c for c in made)


def test_a_fit_takes_as_many_tasks_as_its_own_vectors_need(spark, texts, monkeypatch):
    assert [L.parts_of_fit(size << 20, 6) for size in (1, 350, 6 * 64, 6 * 320)] == [1, 1, 2, 10]
    asked, held = [], L.parts_of_fit
    monkeypatch.setattr(L, "parts_of_fit", lambda size, columns: asked.append(columns) or held(size, columns))
    df = A._xy(spark, texts)
    out = L.grid_search(df, "doc_id", {"lr": [1.0]}, [(1, 5, True), (1, 10, True), (1, 10, False)], k=2)
    assert out.count() == 3 and asked == [3, 3]


def test_rows_of_other_keys_are_dropped_in_place(spark):
    keys = [(f"é{k}",) for k in range(0, 3000, 3)] + [(None,), ("é0",)]
    df = spark.createDataFrame([(f"é{k}", k) for k in range(3000)] + [(None, -1), ("é3", 4)], "key string, n int")
    out = P.likely_in(df, spark.createDataFrame(keys, "key string"), "key")
    ids = sorted(r["n"] for r in out.collect() if r["n"] >= 0)
    assert set(range(0, 3000, 3)) | {4} <= set(ids) and 1001 <= len(ids) < 1100
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert P.likely_in(df, spark.createDataFrame([], "key string"), "key").count() == 0


def test_surest_mistakes_shuffle_labelled_texts_and_leave_only_the_model(spark, texts, monkeypatch):
    made, asked, read = [], [], T.term_lists
    monkeypatch.setattr(S, "materialize", lambda df, held=S.materialize, **o: made.append(held(df, **o)) or made[-1])
    monkeypatch.setattr(T, "term_lists", lambda df, *a, **o: asked.append(df._jdf.queryExecution().optimizedPlan().toString()) or read(df, *a, **o))
    out = entry.queries()["top_errors"](spark, texts)
    assert spark_rows(out) == sql_rows(texts, "top_errors", out.columns, "documents", "labels") and out.count() > 3
    assert len(made) == 3 and not any(Path(t._lexforge_path).exists() for t in made)
    assert asked and all("getbit" in x for x in asked)
