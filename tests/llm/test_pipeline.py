"""The pipeline against plain versions of its stages, each on its own input, over the smallest table."""

import corpus_pipeline
from lexforge.llm import packing
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r["doc_id"], r["text"], r["n_chars"]) for r in df.collect())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, rows(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        pairs = [(d, t) for d, t, _ in kept]
        if name == "quality_rules":
            kept = [r for r in kept if brute.kept(r[1])]
        elif name == "ngram_jaccard_join":
            c = brute.classes(pairs)
            kept = [r for i, r in enumerate(kept) if c[i][0] == r[0]]
        elif name == "substring_dedup":
            kept = [(d, t, len(t)) for (d, _), t in zip(pairs, (brute.cut(t, g) for (_, t), g in zip(pairs, brute.covered(pairs), strict=True)), strict=True)]
        elif name == "secret_scan":
            kept = [(d, x, len(x)) for d, x in ((d, brute.redacted(t)) for d, t in pairs)]
        else:
            want, _ = brute.packed(pairs, packing.MAX_TOKENS, packing.BUCKETS, packing.BATCH_TOKENS)
            assert sorted((*tuple(r)[:6], r["ids"]) for r in docs.collect()) == sorted(want)
            break
        assert docs.columns == columns and rows(docs) == kept, name
    assert len(kept) > 100
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_of_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, an empty table and clashing names, in each stage on its own."""
    body = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion, and nobody in the village sees any of it. " * 1
    long = " ".join(f"Word{k} of a very long text" for k in range(20_000))
    rows = [(None, body, 1), (1, body, 1), (1, body, 1), (2, None, None), (3, "", 0), (4, long, 5), (5, f"password = abcdef12 {long[:400]}", 2), (None, None, None), (6, "a b c", 1)]
    own = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    names = ["key", "may", "id", "fp", "marked", "rest", "row", "both", "body", "kept_key", "class_id", "n_words", "size", "piece"]
    docs = own.selectExpr("*", *(f"{k} AS {n}" for k, n in enumerate(names)))
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns, name
            assert all([r[n] for n in names] == list(range(len(names))) for r in out.collect()), name
        got[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()) if name != "packing" else ((r["doc_id"], r["piece"]) for r in out.collect()), key=repr)
    pairs = sorted(((d, t) for d, t, _ in rows), key=repr)
    assert got["quality_rules"] == [x for x in pairs if brute.kept(x[1])]
    assert got["ngram_jaccard_join"] == [x for x in pairs if x != (None, body)]
    assert got["secret_scan"] == sorted(((d, brute.redacted(t)) for d, t in pairs), key=repr)
    cut = dict(got["substring_dedup"])
    assert len(got["substring_dedup"]) == len(rows) and cut[4] == long and cut[2] is None and cut[3] == "" and sum(t == body for _, t in got["substring_dedup"]) == 0 + sum(d is None and t == body for d, t in pairs)
    assert {d for d, _ in got["packing"]} == {d for d, _ in pairs}
