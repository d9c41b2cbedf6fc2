"""Registered queries of profiling, features, metrics and models, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as X
from lexforge.operators import features as T
from lexforge.operators import metrics as M
from lexforge.operators import ml as L
from lexforge.operators import profile as P
from lexforge.session import table
from lexforge.storage import materialize, scratch, shared_dir

_N = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+'))"
_STOP = ", ".join(f"'{x}'" for x in X.STOPWORDS)
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("label", F.when(F.col("quality") == 1, "real").otherwise("fake"))


_L = "l AS (SELECT d.doc_id, d.text, d.lang, d.source, quality, toxic, CASE quality WHEN 1 THEN 'real' ELSE 'fake' END AS label FROM documents d JOIN labels USING (doc_id))"


def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return c.crossJoin(c.agg(F.sum("n").alias("all"))).select("label", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.describe(_docs(spark, sf_dir), X.n_tokens(F.coalesce("text", F.lit(""))), "lang")


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.histogram(_docs(spark, sf_dir), X.n_tokens(F.coalesce("text", F.lit(""))), 100, 2000, "lang")


def ecdf_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ecdf(_docs(spark, sf_dir), X.n_tokens(F.coalesce("text", F.lit(""))).cast("long"))


def fit_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fit_share(_docs(spark, sf_dir), X.n_tokens(F.coalesce("text", F.lit(""))), [128, 256, 512])


def ngrams_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_ngrams(_labelled(spark, sf_dir), "label", 2, 25)


def unigrams_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_ngrams(_labelled(spark, sf_dir), "label", 1, 25)


def leakage_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.class_ratio(P.class_doc_freq(_labelled(spark, sf_dir), "doc_id", "label", min_df=3), "fake", "real")


WATCH = ["the", "de", "und", "license", "token", "email", "click"]


def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(w,) for w in WATCH], "term string")
    found = P.term_totals(_docs(spark, sf_dir).filter(F.col("text").isNotNull()))
    return names.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def vocab_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return P.vocabulary_overlap(P.term_totals(d.filter("lang = 'fr'")), P.term_totals(d.filter("lang = 'es'")), 500)


def oov_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.oov_rate(P.term_totals(_docs(spark, sf_dir)), P.term_totals(table(spark, sf_dir, "benchmark")))


def label_crosstab_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.crosstab(_labelled(spark, sf_dir), "lang", "label")


def monthly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_format(F.trunc(F.to_date("o_orderdate"), "MM"), "yyyy-MM").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def subject_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated parts, here of part types, counted one by one."""
    p = table(spark, sf_dir, "part")
    return p.select(F.explode(F.split("p_type", " ")).alias("subject"), "p_retailprice").groupBy("subject").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))


def speaker_false_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of fakes of the ten sources with most labelled documents."""
    own = _labelled(spark, sf_dir)
    top = own.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source").limit(10)
    return own.join(F.broadcast(top), "source").groupBy("source", "n").agg(F.round(F.avg((F.col("label") == "fake").cast("double")), 6).alias("fake_share"))


def drop_reason_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.n_tokens(F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).withColumn("reason", F.when(n == 0, "empty").when(n < 20, "short").otherwise("kept")).rollup("lang", "reason").agg(F.count("*").alias("n"))


def hyperparam_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a measure for each value of each parameter: an unpivot and one aggregation."""
    li = table(spark, sf_dir, "lineitem")
    u = li.select("l_extendedprice", F.expr("stack(2, 'returnflag', l_returnflag, 'linestatus', l_linestatus) AS (param, value)"))
    return u.groupBy("param", "value").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


def mean_and_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _labelled(spark, sf_dir).select("lang", "label", X.n_tokens(F.coalesce("text", F.lit(""))).alias("v")).groupBy("lang", "label").agg(F.count("*").alias("n"), F.avg("v").alias("m"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("sem"))
    return own.select("lang", "label", "n", F.round("m", 6).alias("mean"), F.round("sem", 6).alias("sem"), F.round(1.96 * F.col("sem"), 6).alias("ci95"))


def length_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _docs(spark, sf_dir).select("lang", X.n_tokens(F.coalesce("text", F.lit(""))).cast("double").alias("a"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[.]")).cast("double").alias("b"))
    return own.groupBy("lang").agg(F.round(F.corr("a", "b"), 6).alias("r"), F.count_if(F.col("a") > 0).alias("n"))


# ---- features


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-2-grams of words without accents, counted once and written."""
    return materialize(T.term_lists(_docs(spark, sf_dir), "doc_id", accents=False), compression="zstd")


def _weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The weights of documents with a known term, and the vocabulary, by the production parameters."""
    lists = _lists(spark, sf_dir)
    vocab = materialize(T.vocabulary(lists, lists.count()))
    return T.weighted(lists, vocab).filter(F.size("w") > 0), vocab


def _written_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights as a table; the counts that they come from are gone."""
    with scratch() as keep:
        w = materialize(_weights(spark, sf_dir)[0], compression="zstd")
        keep(w)
    return w


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, _ = _weights(spark, sf_dir)
    each = F.transform("w", lambda x: x.getField("w"))
    return w.select("doc", F.size("w").cast("long").alias("n_terms"), F.round(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), 4).alias("sum_w"), F.round(F.array_max(each), 5).alias("max_w"))


def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, vocab = _weights(spark, sf_dir)
    return T.top_terms(w, 5).join(T.named(vocab), "k").select("doc", "term", F.col("rank").cast("long").alias("rank"))


def nearest_neighbour_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other document of every fiftieth one."""
    w = _written_weights(spark, sf_dir)
    found = T.nearest(w.filter("doc % 50 = 0"), w)
    return found.select("doc", F.round("cosine", 4).alias("cosine"))


#: 1-2-grams without accents, MAX_FEATURES terms.
_TFIDF = f"""
u AS (SELECT doc_id AS doc, {_TOK.replace("lower(text)", "strip_accents(lower(coalesce(text, '')))")} AS u FROM documents),
t AS (SELECT doc, unnest(u) AS term FROM u UNION ALL SELECT doc, u[i] || ' ' || u[i + 1] FROM (SELECT doc, u, unnest(range(1, len(u))) AS i FROM u)),
tf AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, df, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1), n WHERE df >= 2 AND df <= 0.95 * n ORDER BY total DESC, term LIMIT {T.MAX_FEATURES}),
r AS (SELECT doc, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN v USING (term)), w AS (SELECT doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS w FROM r)"""


# ---- metrics: quality as gold, made-up predictions


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("doc_id", "toxic", "quality", F.col("label").alias("gold"), F.when(X.n_tokens(F.coalesce("text", F.lit(""))) % 5 == 0, "fake").otherwise("real").alias("pred"), (F.length("text") % 101 / F.lit(101.0)).alias("p"))


_PRED = f"{_L}, m AS (SELECT doc_id, toxic, quality, label AS gold, CASE WHEN {_N} % 5 = 0 THEN 'fake' ELSE 'real' END AS pred, length(text) % 101 / 101.0::DOUBLE AS p FROM l)"


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(_predicted(spark, sf_dir), ["fake", "real", "other"])


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.class_report(_predicted(spark, sf_dir), ["fake", "real", "other"])
    return r.select("label", "support", "predicted", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(_predicted(spark, sf_dir), ["fake", "real"]).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.roc_auc(_predicted(spark, sf_dir), "p", "quality").select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.roc_curve(_predicted(spark, sf_dir), "p", "quality").select(F.round("threshold", 6).alias("threshold"), "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cohen_kappa(_predicted(spark, sf_dir), "gold", "pred").select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


def specific_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.specific_agreement(_predicted(spark, sf_dir), "gold", "pred").select("label", F.round("agreement", 6).alias("agreement"))


def flag_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _predicted(spark, sf_dir).select(F.col("toxic").alias("gold"), (F.col("pred") == "fake").alias("flag"))
    return M.flag_metrics(own, "gold", "flag").select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy")])


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.class_weights(_labelled(spark, sf_dir), "label")


def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.majority(_labelled(spark, sf_dir), "label").select("label", F.round("share", 6).alias("share"))


def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong predictions by the first category that fits, with the most confident ones' ids."""
    wrong = _predicted(spark, sf_dir).filter("gold <> pred").join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    n = X.n_tokens(F.coalesce("text", F.lit("")))
    person = F.regexp_count(F.lower("text"), F.lit(r"\b(i|we|my|our)\b"))
    kind = F.when(n > 512, "long").when(n < 80, "short").when(F.col("text").rlike("[!]{2}"), "shouting").when(100 * person >= 2 * n, "first person").otherwise("style")
    return wrong.select(kind.alias("category"), "doc_id").groupBy("category").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


# The cues and limits of the error categories.
FIRST_PERSON = r"\b(i|me|my|we|our|us)\b"
SATIRE = r"\b(satire|satirical|parody|the onion|humou?r)\b"
OPINION = r"\b(op-ed|opinion|commentary|editorial|column)\b"
REAL_CUES = r"\b(reuters|associated press|breitbart|said on (monday|tuesday|wednesday|thursday|friday))\b"
WIRE = r"\b(reuters|associated press)\b|\(ap\)"
FAKE_CUES = r"\b(via|watch|video|twitter|breaking|hillary)\b"
NEAR_COPY, SHORT_WORDS, PER_HUNDRED, MAX_LEN = 0.8, 80, 2, 512


def error_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes' mistakes on the held-out documents, each with its nearest training document's label and the first category that fits."""
    own = _labelled(spark, sf_dir).select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    with scratch() as keep:
        wrong = materialize(own.join(nb_train_eval(spark, sf_dir), "doc_id").filter(F.col("label") != F.col("pred")), compression="zstd")
        keep(wrong)
    train = own.filter("doc_id % 5 <> 0")
    with scratch() as keep:
        docs = _docs(spark, sf_dir)
        vocab = T.vocabulary_in_passes(T.term_lists(docs, "doc_id", accents=False), docs.count())
        weights = lambda rows: T.weighted(T.term_lists(rows, "doc_id", accents=False), vocab).filter(F.size("w") > 0)  # noqa: E731 - only of rows that are compared
        near = T.nearest(weights(wrong), weights(train))
        keep(near)
    near = near.join(train.select(F.col("doc_id").alias("neighbour"), F.col("label").alias("nn_label")), "neighbour").select(F.col("doc").alias("doc_id"), F.round("cosine", 4).alias("cosine"), "nn_label")
    low, head = F.lower("text"), F.lower(F.substring("text", 1, 300))
    n, first = X.n_tokens(F.col("text")), F.regexp_count(low, F.lit(FIRST_PERSON))
    cue = F.when(F.col("pred") == "real", low.rlike(REAL_CUES)).otherwise(low.rlike(FAKE_CUES))
    kind = (
        F.when((F.coalesce("cosine", F.lit(0.0)) >= NEAR_COPY) & (F.col("nn_label") != F.col("label")), "label noise").when(n > 2 * MAX_LEN, "truncation").when(n < SHORT_WORDS, "short")
        .when((F.col("label") == "fake") & head.rlike(WIRE), "wire copy").when(low.rlike(SATIRE), "satire").when((100 * first >= PER_HUNDRED * n) | head.rlike(OPINION), "opinion").when(cue, "wrong cue").otherwise("style")
    )
    return wrong.join(near, "doc_id", "left").select("doc_id", F.col("label").alias("gold"), "pred", F.round("cosine", 3).alias("cosine"), "nn_label", kind.alias("category"))


def nb_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _labelled(spark, sf_dir).select("doc_id", "label", "text")
    return L.naive_bayes(own.filter("doc_id % 5 <> 0"), own.filter("doc_id % 5 = 0"), "doc_id", "label").withColumnRenamed("doc", "doc_id")


NB = f"""
WITH {_L}, t AS (SELECT doc_id, label, doc_id % 5 = 0 AS test, unnest({_TOK}) AS term FROM l), tr AS (SELECT * FROM t WHERE NOT test),
c AS (SELECT label, term, count(*) AS c FROM tr GROUP BY ALL), v AS (SELECT DISTINCT term FROM tr), tot AS (SELECT label, sum(c) AS total FROM c GROUP BY 1),
pri AS (SELECT label, count(*) AS m FROM l WHERE doc_id % 5 <> 0 GROUP BY 1),
b AS (SELECT label, ln(m / (SELECT sum(m) FROM pri)::DOUBLE) AS prior, total + (SELECT count(*) FROM v) AS denom FROM pri JOIN tot USING (label)),
k AS (SELECT doc_id, term, count(*) AS tf FROM t JOIN v USING (term) WHERE test GROUP BY ALL),
s AS (SELECT d.doc_id, b.label, round(any_value(b.prior) + coalesce(sum(k.tf * ln((coalesce(c.c, 0) + 1) / b.denom::DOUBLE)), 0), 6) AS score
  FROM (SELECT doc_id FROM l WHERE doc_id % 5 = 0) d CROSS JOIN b LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN c ON c.label = b.label AND c.term = k.term GROUP BY ALL)
SELECT doc_id, label AS pred FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label DESC) = 1
"""


def _xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: title (the first line) and text in one, y 1 for fakes."""
    both = X.model_input(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), F.col("text"))
    return _labelled(spark, sf_dir).select("doc_id", both.alias("text"), "label", (F.col("label") == "fake").cast("double").alias("y"))


def _evaluated(spark: SparkSession, sf_dir: str, name: str, value: float) -> DataFrame:
    d = _xy(spark, sf_dir)
    f = L.Features.fit(d.filter("doc_id % 5 <> 0"), "doc_id")
    train, test = f.vectors(d.filter("doc_id % 5 <> 0")), f.vectors(d.filter("doc_id % 5 = 0"))
    return M.summary(L.predicted(L.classifier(name, value, train.count()).fit(train), test, "doc_id"), ["0", "1"])


def lr_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "lr", 10.0)


def svm_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, "svm", 1.0)


def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and model are written, read back, and predict alike."""
    d = _xy(spark, sf_dir)
    f = L.Features.fit(d.filter("doc_id % 5 <> 0"), "doc_id")
    model = L.classifier("lr", 10.0, d.count()).fit(f.vectors(d.filter("doc_id % 5 <> 0")))
    path = shared_dir(spark)
    L.save(f, model, path)
    again, loaded = L.load(spark, path)
    test = d.filter("doc_id % 5 = 0")
    one, two = L.predicted(model, f.vectors(test), "doc_id"), L.predicted(loaded, again.vectors(test), "doc_id").select("doc_id", F.col("pred").alias("again"))
    return one.join(two, "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("again")).alias("same"))


def top_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that speak most for fakes and for the rest, and whether they hold a leak word."""
    d = _xy(spark, sf_dir)
    f = L.Features.fit(d, "doc_id")
    found = L.top_coefficients(L.classifier("lr", 10.0, d.count()).fit(f.vectors(d)), f, 25)
    return found.select("rank", "fake_term", F.round("fake_weight", 3).alias("fake_weight"), X.leaks(F.col("fake_term")).alias("fake_leaks"), "real_term", F.round("real_weight", 3).alias("real_weight"), X.leaks(F.col("real_term")).alias("real_leaks"))


def artefact_only_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.artefact_classifier(_xy(spark, sf_dir), "doc_id")


def _grid(found: DataFrame) -> DataFrame:
    return found.select("model", "value", "ngrams", "max_features", "sublinear", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "rank", "best")


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid: 18 points of naive Bayes, 36 of each linear model, in five folds."""
    return _grid(L.grid_search(_xy(spark, sf_dir), "doc_id"))


def grid_search_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes' 18 points, which SQL can fit."""
    return _grid(L.grid_search(_xy(spark, sf_dir), "doc_id", models={"nb": L.CLASSIFIERS["nb"]}, tfidf_grid=[p for p in L.TFIDF_GRID if p[2]]))


#: Each fold's document frequencies are those of all rows minus the fold's; naive Bayes on TF-IDF sums, with smoothed priors.
GRID_NB = rf"""
WITH {_L}, r AS (SELECT doc_id AS doc, (label = 'fake')::INT AS y, (row_number() OVER (PARTITION BY label ORDER BY sha1(doc_id::VARCHAR || ':42'), doc_id) % 5)::INT AS fold,
  strip_accents(lower(trim(string_split(coalesce(text, ''), chr(10))[1] || chr(10) || coalesce(text, '')))) AS low FROM l),
w AS (SELECT doc, regexp_extract_all(low, '[\p{{L}}\p{{N}}_]{{2,}}') AS u FROM r),
tf AS (SELECT doc, term, words, count(*) AS tf FROM (SELECT doc, unnest(u) AS term, 1 AS words FROM w UNION ALL SELECT doc, u[i] || ' ' || u[i + 1], 2 FROM (SELECT doc, u, unnest(range(1, len(u))) AS i FROM w)) GROUP BY ALL),
f AS (SELECT unnest(range(5))::INT AS f), n AS (SELECT f, count(*) AS n FROM f JOIN r ON fold <> f GROUP BY f),
c AS (SELECT f, term, any_value(words) AS words, count(*) AS df, sum(tf) AS total FROM tf JOIN r USING (doc) JOIN f ON fold <> f GROUP BY f, term),
v AS (SELECT f, g.n AS ngrams, term, ln((1 + n.n) / (1 + df)::DOUBLE) + 1 AS idf, row_number() OVER (PARTITION BY f, g.n ORDER BY total DESC, term) AS place
  FROM c JOIN n USING (f) JOIN (VALUES (1), (2)) AS g(n) ON words <= g.n WHERE df >= 2 AND df <= 0.95 * n.n),
p AS (SELECT f, ngrams, most, term, idf FROM v JOIN (VALUES (50000), (100000), (200000)) AS m(most) ON place <= most), s AS (SELECT f, ngrams, most, count(*) AS size FROM p GROUP BY ALL),
raw AS (SELECT f, ngrams, most, doc, term, (1 + ln(tf)) * idf AS x FROM tf JOIN p USING (term)), x AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY f, ngrams, most, doc)) AS w FROM raw),
t AS (SELECT f, ngrams, most, y, term, sum(w) AS s FROM x JOIN r USING (doc) WHERE fold <> f GROUP BY ALL), ts AS (SELECT f, ngrams, most, y, sum(s) AS s FROM t GROUP BY ALL),
a AS (SELECT unnest([0.1, 0.5, 1.0])::DOUBLE AS a), k AS (SELECT f, y, count(*) AS m FROM r JOIN f ON fold <> f GROUP BY ALL),
b AS (SELECT f, ngrams, most, y, a, ln(m + a) - ln(n + 2 * a) AS prior, ln(ts.s + a * size) AS denom FROM ts JOIN s USING (f, ngrams, most) JOIN k USING (f, y) JOIN n USING (f), a),
g AS (SELECT b.f, b.ngrams, b.most, a, doc, b.y AS c, any_value(prior) + coalesce(sum(x.w * (ln(coalesce(t.s, 0) + a) - denom)), 0) AS score
  FROM b JOIN r ON fold = b.f LEFT JOIN x USING (f, ngrams, most, doc) LEFT JOIN t ON t.f = b.f AND t.ngrams = b.ngrams AND t.most = b.most AND t.y = b.y AND t.term = x.term GROUP BY ALL),
o AS (SELECT f, ngrams, most, a, doc, (max(score) FILTER (c = 1) > max(score) FILTER (c = 0))::INT AS pred FROM g GROUP BY ALL),
h AS (SELECT f, ngrams, most, a, (coalesce(2 * count(*) FILTER (y = 0 AND pred = 0) / nullif(count(*) FILTER (y = 0) + count(*) FILTER (pred = 0), 0)::DOUBLE, 0) + coalesce(2 * count(*) FILTER (y = 1 AND pred = 1) / nullif(count(*) FILTER (y = 1) + count(*) FILTER (pred = 1), 0)::DOUBLE, 0)) / 2 AS f1 FROM o JOIN r USING (doc) GROUP BY ALL),
e AS (SELECT a, ngrams, most, avg(f1) AS mean, stddev_pop(f1) AS std FROM h GROUP BY ALL)
SELECT 'nb' AS model, a AS value, ngrams, most AS max_features, true AS sublinear, round(mean, 6) AS mean, round(std, 6) AS std, rank() OVER (ORDER BY round(mean, 9) DESC) AS rank, rank() OVER (ORDER BY round(mean, 9) DESC) = 1 AS best FROM e
"""


_ASCII = lambda x: f"regexp_replace({x}, '[^\\x00-\\x7F]', 'x', 'g')"
ERRORS = f"""
WITH nbp AS ({NB}), {_L}, e AS (SELECT l.doc_id, label, pred, coalesce(text, '') AS text FROM l JOIN nbp USING (doc_id) WHERE label <> pred), {_TFIDF},
c AS (SELECT a.doc, b.doc AS o, round(sum(a.w * b.w), 6) AS c FROM w a JOIN w b ON a.term = b.term WHERE a.doc IN (SELECT doc_id FROM e) AND b.doc IN (SELECT doc_id FROM l WHERE doc_id % 5 <> 0) GROUP BY ALL),
b AS (SELECT doc, round(c, 4) AS cosine, label AS nn_label FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc ORDER BY c DESC, o) = 1) JOIN l ON l.doc_id = o),
x AS (SELECT e.*, b.cosine, b.nn_label, {_N} AS n, {_ASCII("lower(text)")} AS low, {_ASCII("lower(text[1:300])")} AS head FROM e LEFT JOIN b ON b.doc = e.doc_id)
SELECT doc_id, label AS gold, pred, round(cosine, 3) AS cosine, nn_label, CASE WHEN cosine >= {NEAR_COPY} AND nn_label <> label THEN 'label noise' WHEN n > {2 * MAX_LEN} THEN 'truncation' WHEN n < {SHORT_WORDS} THEN 'short'
  WHEN label = 'fake' AND regexp_matches(head, '{WIRE}') THEN 'wire copy' WHEN regexp_matches(low, '{SATIRE}') THEN 'satire' WHEN 100 * len(regexp_extract_all(low, '{FIRST_PERSON}')) >= {PER_HUNDRED} * n OR regexp_matches(head, '{OPINION}') THEN 'opinion'
  WHEN CASE pred WHEN 'real' THEN regexp_matches(low, '{REAL_CUES}') ELSE regexp_matches(low, '{FAKE_CUES}') END THEN 'wrong cue' ELSE 'style' END AS category FROM x
"""
QUERIES = {f.__name__: f for f in (class_balance, length_percentiles, length_histogram, ecdf_lengths, fit_share, ngrams_top, unigrams_top, leakage_tokens, watch_list, vocab_overlap, oov_rate, label_crosstab_margins, monthly_counts, subject_explode, speaker_false_share, drop_reason_cube, hyperparam_marginals, mean_and_error, length_correlation, tfidf_weights, tfidf_top_terms, nearest_neighbour_tfidf, confusion_matrix, classification_report, metric_summary, roc_auc, roc_curve, cohen_kappa, specific_agreement, flag_metrics, class_weights, majority_baseline, error_categories, error_analysis, nb_train_eval, lr_train_eval, svm_train_eval, saved_model, top_coefficients, artefact_only_lr, grid_search, grid_search_nb)}
_PCT = ", ".join(f"round(quantile_cont(n, {q}), 6) AS p{round(100 * q):02d}" for q in P.PERCENTILES)
_TERMS = lambda where, t="documents": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOK}) AS term FROM {t} {where}) GROUP BY 1"
_LABELS = "(VALUES ('fake'), ('real'), ('other')) AS x(label)"
_REPORT = f"SELECT x.label, count(*) FILTER (gold = x.label) AS support, count(*) FILTER (pred = x.label) AS predicted, count(*) FILTER (gold = x.label AND pred = x.label) AS h FROM m, {_LABELS} GROUP BY 1"
ORACLES = {
    "class_balance": f"WITH {_L} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM l GROUP BY 1",
    "length_percentiles": f"SELECT lang, count(*) AS n, round(avg(n), 6) AS mean, {_PCT} FROM (SELECT lang, {_N} AS n FROM documents) GROUP BY 1",
    "length_histogram": f"SELECT lang, (least(n, 2000) // 100 * 100)::BIGINT AS bin, count(*) AS n FROM (SELECT lang, {_N} AS n FROM documents) GROUP BY ALL",
    "ecdf_lengths": f"SELECT value, n, round(sum(n) OVER (ORDER BY value) / sum(n) OVER ()::DOUBLE, 6) AS share FROM (SELECT {_N}::BIGINT AS value, count(*) AS n FROM documents GROUP BY 1)",
    "fit_share": f"SELECT m::INT AS max_len, round(avg((n <= m)::INT), 6) AS fits, round(quantile_cont(least(n, m) / n::DOUBLE, 0.5), 6) AS kept FROM (SELECT {_N} AS n FROM documents), (VALUES (128), (256), (512)) AS v(m) WHERE n > 0 GROUP BY 1",
    "ngrams_top": f"WITH {_L}, w AS (SELECT label, list_filter({_TOK}, lambda x: x NOT IN ({_STOP})) AS w FROM l), g AS (SELECT label, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT label, w, unnest(range(1, len(w))) AS i FROM w)) SELECT label, gram, count(*) AS n FROM g GROUP BY label, gram QUALIFY row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, gram) <= 25",
    "unigrams_top": f"WITH {_L}, w AS (SELECT label, unnest({_TOK}) AS gram FROM l) SELECT label, gram, count(*) AS n FROM w WHERE gram NOT IN ({_STOP}) GROUP BY label, gram QUALIFY row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, gram) <= 25",
    "leakage_tokens": f"WITH {_L}, t AS (SELECT DISTINCT doc_id, label, unnest({_TOK}) AS term FROM l), f AS (SELECT term, label, count(*) AS df FROM t WHERE term NOT IN ({_STOP}) GROUP BY ALL HAVING count(*) >= 3), p AS (SELECT term, coalesce(sum(df) FILTER (label = 'fake'), 0)::BIGINT AS df_a, coalesce(sum(df) FILTER (label = 'real'), 0)::BIGINT AS df_b FROM f GROUP BY 1) SELECT *, round(log2((df_a + 0.5) / (df_b + 0.5)), 6) AS log2_ratio FROM p",
    "watch_list": f"WITH t AS ({_TERMS('')}) SELECT w.term, coalesce(n, 0) AS n FROM (VALUES {', '.join(f'({chr(39)}{w}{chr(39)})' for w in WATCH)}) AS w(term) LEFT JOIN t ON t.term = w.term",
    "vocab_overlap": f"WITH a AS (SELECT term FROM ({_TERMS(chr(87) + 'HERE lang = ' + chr(39) + 'fr' + chr(39))}) ORDER BY n DESC, term LIMIT 500), b AS (SELECT term FROM ({_TERMS('WHERE lang = ' + chr(39) + 'es' + chr(39))}) ORDER BY n DESC, term LIMIT 500) SELECT count(*) FILTER (a.term IS NOT NULL AND b.term IS NOT NULL) AS n_common, count(*) AS n_union, round(count(*) FILTER (a.term IS NOT NULL AND b.term IS NOT NULL) / count(*)::DOUBLE, 6) AS jaccard FROM a FULL JOIN b ON a.term = b.term",
    "oov_rate": f"WITH a AS ({_TERMS('')}), b AS ({_TERMS('', 'benchmark')}) SELECT sum(n)::BIGINT AS tokens, coalesce(sum(n) FILTER (term NOT IN (SELECT term FROM a)), 0)::BIGINT AS oov, round(coalesce(sum(n) FILTER (term NOT IN (SELECT term FROM a)), 0) / sum(n)::DOUBLE, 6) AS rate FROM b",
    "label_crosstab_margins": f"WITH {_L} SELECT lang, label, count(*) AS n FROM l GROUP BY CUBE (lang, label)",
    "monthly_counts": "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL",
    "subject_explode": "SELECT subject, count(*) AS n, round(avg(p), 4) AS mean_price FROM (SELECT unnest(string_split(p_type, ' ')) AS subject, p_retailprice AS p FROM part) GROUP BY 1",
    "speaker_false_share": f"WITH {_L}, t AS (SELECT source, count(*) AS n FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT source, n, round(avg((label = 'fake')::INT), 6) AS fake_share FROM l JOIN t USING (source) GROUP BY ALL",
    "drop_reason_cube": f"SELECT lang, CASE WHEN n = 0 THEN 'empty' WHEN n < 20 THEN 'short' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT lang, {_N} AS n FROM documents) GROUP BY ROLLUP (lang, reason)",
    "hyperparam_marginals": "SELECT 'returnflag' AS param, l_returnflag AS value, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 2 UNION ALL SELECT 'linestatus', l_linestatus, count(*), round(avg(l_extendedprice), 4) FROM lineitem GROUP BY 2",
    "mean_and_error": f"WITH {_L}, n AS (SELECT lang, label, {_N} AS v FROM l) SELECT lang, label, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem, round(1.96 * (stddev_samp(v) / sqrt(count(*))), 6) AS ci95 FROM n GROUP BY ALL",
    "length_correlation": f"SELECT lang, round(corr(a, b), 6) AS r, count(*) FILTER (a > 0) AS n FROM (SELECT lang, {_N}::DOUBLE AS a, len(regexp_extract_all(coalesce(text, ''), '[.]'))::DOUBLE AS b FROM documents) GROUP BY 1",
    "tfidf_weights": f"WITH {_TFIDF} SELECT doc, count(*) AS n_terms, round(sum(w), 4) AS sum_w, round(max(w), 5) AS max_w FROM w GROUP BY 1",
    "tfidf_top_terms": f"WITH {_TFIDF} SELECT doc, term, row_number() OVER (PARTITION BY doc ORDER BY round(w, 9) DESC, term) AS rank FROM w QUALIFY rank <= 5",
    "nearest_neighbour_tfidf": f"WITH {_TFIDF} SELECT doc, round(max(c), 4) AS cosine FROM (SELECT a.doc, b.doc AS o, round(sum(a.w * b.w), 6) AS c FROM w a JOIN w b ON a.term = b.term AND a.doc <> b.doc WHERE a.doc % 50 = 0 GROUP BY ALL) GROUP BY 1",
    "confusion_matrix": f"WITH {_PRED} SELECT g.label AS gold, p.label AS pred, (SELECT count(*) FROM m WHERE gold = g.label AND pred = p.label) AS n FROM {_LABELS.replace('x(', 'g(')}, {_LABELS.replace('x(', 'p(')}",
    "classification_report": f"WITH {_PRED}, r AS ({_REPORT}) SELECT label, support, predicted, CASE WHEN predicted = 0 THEN 0 ELSE round(h / predicted::DOUBLE, 6) END AS precision, CASE WHEN support = 0 THEN 0 ELSE round(h / support::DOUBLE, 6) END AS recall, CASE WHEN support + predicted = 0 THEN 0 ELSE round(2 * h / (support + predicted)::DOUBLE, 6) END AS f1 FROM r",
    "metric_summary": f"WITH {_PRED}, r AS ({_REPORT}) SELECT (SELECT count(*) FROM m) AS n, (SELECT round(avg((gold = pred)::INT), 6) FROM m) AS accuracy, round(avg(2 * h / (support + predicted)::DOUBLE), 6) AS macro_f1 FROM r WHERE label <> 'other'",
    "roc_auc": f"WITH {_PRED} SELECT (SELECT count(*) FROM m WHERE quality = 1) AS n_pos, (SELECT count(*) FROM m WHERE quality = 0) AS n_neg, round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END::DOUBLE), 6) AS auc FROM m a, m b WHERE a.quality = 1 AND b.quality = 0",
    "roc_curve": f"WITH {_PRED}, t AS (SELECT DISTINCT p FROM m) SELECT round(t.p, 6) AS threshold, count(*) FILTER (m.p >= t.p AND quality = 1) AS tp, count(*) FILTER (m.p >= t.p AND quality = 0) AS fp, round(count(*) FILTER (m.p >= t.p AND quality = 1) / count(*) FILTER (quality = 1)::DOUBLE, 6) AS tpr, round(count(*) FILTER (m.p >= t.p AND quality = 0) / count(*) FILTER (quality = 0)::DOUBLE, 6) AS fpr FROM t, m GROUP BY t.p",
    "cohen_kappa": f"WITH {_PRED}, g AS (SELECT count(*)::DOUBLE AS n, avg((gold = pred)::INT) AS po, sum((gold = 'fake')::INT) * sum((pred = 'fake')::INT) + sum((gold = 'real')::INT) * sum((pred = 'real')::INT) AS e FROM m) SELECT n::BIGINT AS n, round(po, 6) AS observed, round(e / (n * n), 6) AS expected, round((po - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM g",
    "specific_agreement": f"WITH {_PRED}, r AS ({_REPORT}) SELECT label, round(2 * h / (support + predicted)::DOUBLE, 6) AS agreement FROM r WHERE label <> 'other'",
    "flag_metrics": f"WITH {_PRED}, c AS (SELECT count(*) FILTER (toxic = 1 AND pred = 'fake') AS tp, count(*) FILTER (toxic = 0 AND pred = 'fake') AS fp, count(*) FILTER (toxic = 1 AND pred <> 'fake') AS fn, count(*) FILTER (toxic = 0 AND pred <> 'fake') AS tn FROM m) SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy FROM c",
    "class_weights": f"WITH {_L}, c AS (SELECT label, count(*) AS n FROM l GROUP BY 1) SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE, 4) AS weight FROM c",
    "majority_baseline": f"WITH {_L} SELECT label, round(count(*) / (SELECT count(*) FROM l)::DOUBLE, 6) AS share FROM l GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1",
    "error_categories": rf"WITH {_PRED}, e AS (SELECT m.doc_id, text, {_N} AS n, len(regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7F]', 'x', 'g'), '\b(i|we|my|our)\b')) AS f FROM m JOIN documents USING (doc_id) WHERE gold <> pred) SELECT CASE WHEN n > 512 THEN 'long' WHEN n < 80 THEN 'short' WHEN regexp_matches(text, '[!]{{2}}') THEN 'shouting' WHEN 100 * f >= 2 * n THEN 'first person' ELSE 'style' END AS category, count(*) AS n, min(doc_id) AS first_doc FROM e GROUP BY 1",
    "nb_train_eval": NB,
    "grid_search_nb": GRID_NB,
    "error_analysis": ERRORS,
    "saved_model": "SELECT count(*) AS n, count(*) AS same FROM labels JOIN documents USING (doc_id) WHERE doc_id % 5 = 0",
}
