"""Registered queries of saved models and of one corpus's model on another, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.functions import artefacts as A
from lexforge.operators import features as T
from lexforge.operators import index as I
from lexforge.operators import prep as P
from lexforge.operators import serving as S
from lexforge.plans.preparation import _LETTERS, STEPS_SQL
from lexforge.session import table


def _labelled(spark: SparkSession, sf_dir: str, likely: bool = False) -> DataFrame:
    """Documents that have a label. likely: most others are dropped before the join, at the cost of a bit table."""
    label = F.when(F.col("quality") == 1, "real").otherwise("fake")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return (P.likely_in(docs, labels, "doc_id") if likely else docs).join(labels, "doc_id").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), label.alias("label"))


def cross_dataset_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corpora (sources of even and of odd number), raw and stripped of artefacts: each one's model on each one's held-out fifth."""
    corpus = F.when(F.substring("source", -1, 1).cast("int") % 2 == 0, "even").otherwise("odd")
    own = _labelled(spark, sf_dir).select("doc_id", corpus.alias("corpus"), "label", (F.col("doc_id") % 5 != 0).alias("train"), F.regexp_replace("text", _LETTERS, "x").alias("text"))
    both = own.withColumn("variant", F.lit("raw")).unionByName(A.strip_frame(own, title=None).drop("hits").withColumn("variant", F.lit("stripped")))
    found = S.cross_matrix(T.term_lists(both, "doc_id", "text", 1, ("variant", "corpus", "label", "train")))
    return found.select("variant", "model", "corpus", "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


_LABELLED = "l AS (SELECT doc_id, source, CASE quality WHEN 1 THEN 'real' ELSE 'fake' END AS label FROM documents JOIN labels USING (doc_id))"
_WORDS = r"unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}_]{2,}')) AS term"
MATRIX = f"""
WITH {_LABELLED}, {STEPS_SQL}, c AS (SELECT doc_id, CASE WHEN source[-1:]::INT % 2 = 0 THEN 'even' ELSE 'odd' END AS corpus, label, doc_id % 5 <> 0 AS train FROM l),
x AS (SELECT 'raw' AS variant, doc_id, t FROM s0 UNION ALL SELECT 'stripped', doc_id, t FROM stripped), d AS (SELECT * FROM x JOIN c USING (doc_id)),
tf AS (SELECT variant, corpus, label, train, doc_id, term, count(*) AS tf FROM (SELECT variant, corpus, label, train, doc_id, {_WORDS} FROM d) GROUP BY ALL),
n AS (SELECT variant, corpus AS model, label, term, sum(tf) AS n FROM tf WHERE train GROUP BY ALL), v AS (SELECT DISTINCT variant, model, term FROM n), z AS (SELECT variant, model, count(*) AS v FROM v GROUP BY ALL),
tot AS (SELECT variant, model, label, sum(n) AS total FROM n GROUP BY ALL), m AS (SELECT variant, corpus AS model, label, count(*) AS m FROM d WHERE train GROUP BY ALL),
b AS (SELECT variant, model, label, ln(m / sum(m) OVER (PARTITION BY variant, model)::DOUBLE) AS prior, coalesce(total, 0) + v AS denom FROM m LEFT JOIN tot USING (variant, model, label) JOIN z USING (variant, model)),
w AS (SELECT v.variant, v.model, b.label, v.term, ln((coalesce(n, 0) + 1) / denom::DOUBLE) AS w FROM v JOIN b USING (variant, model) LEFT JOIN n ON n.variant = v.variant AND n.model = v.model AND n.label = b.label AND n.term = v.term),
s AS (SELECT variant, corpus, doc_id, model, w.label, sum(tf * w) AS s FROM tf JOIN w USING (variant, term) WHERE NOT train GROUP BY ALL),
g AS (SELECT d.variant, d.corpus, d.doc_id, d.label AS gold, b.model, b.label, round(prior + coalesce(s, 0), 6) AS score FROM d JOIN b USING (variant)
  LEFT JOIN s ON s.variant = d.variant AND s.corpus = d.corpus AND s.doc_id = d.doc_id AND s.model = b.model AND s.label = b.label WHERE NOT train),
p AS (SELECT variant, model, corpus, gold, label AS pred FROM g QUALIFY row_number() OVER (PARTITION BY variant, model, corpus, doc_id ORDER BY score DESC, label DESC) = 1),
f AS (SELECT variant, model, corpus, x.label, 2 * count(*) FILTER (gold = x.label AND pred = x.label) / nullif(count(*) FILTER (gold = x.label) + count(*) FILTER (pred = x.label), 0)::DOUBLE AS f1 FROM p, (VALUES ('fake'), ('real')) AS x(label) GROUP BY ALL),
a AS (SELECT variant, model, corpus, count(*) AS n, avg((gold = pred)::INT) AS accuracy FROM p GROUP BY ALL)
SELECT variant, model, corpus, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM a JOIN (SELECT variant, model, corpus, avg(f1) AS macro_f1 FROM f GROUP BY ALL) USING (variant, model, corpus)
"""


def _naive_bayes(spark: SparkSession, sf_dir: str) -> S.LinearModel | S.WideModel:
    """A model of the labelled documents, saved and read again."""
    lists = T.term_lists(_labelled(spark, sf_dir), "doc_id", "text", 1, ("label",))
    weights, intercept = S.naive_bayes_linear(lists, ["real", "fake"])
    return S.saved(spark, weights, intercept, ["real", "fake"])


def batch_p_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of a fake by a saved model, for all documents."""
    found = S.batch_scores(table(spark, sf_dir, "documents"), "doc_id", "text", _naive_bayes(spark, sf_dir), "fake")
    return found.select(F.col("key").alias("doc_id"), F.round("p", 6).alias("p_fake"))


BATCH = f"""
WITH {_LABELLED}, w AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_WORDS.replace('lower(t)', "lower(coalesce(text, ''))")} FROM documents) GROUP BY ALL),
c AS (SELECT label, term, sum(tf) AS c FROM w JOIN l USING (doc_id) GROUP BY ALL), v AS (SELECT DISTINCT term FROM c),
b AS (SELECT label, ln(m / sum(m) OVER ()::DOUBLE) AS prior, total + (SELECT count(*) FROM v) AS denom FROM (SELECT label, count(*) AS m FROM l GROUP BY 1) JOIN (SELECT label, sum(c) AS total FROM c GROUP BY 1) USING (label)),
k AS (SELECT term, sum(CASE b.label WHEN 'fake' THEN 1 ELSE -1 END * ln((coalesce(c, 0) + 1) / denom::DOUBLE)) AS weight FROM v CROSS JOIN b LEFT JOIN c USING (label, term) GROUP BY term),
z AS (SELECT doc_id, sum(tf * weight) AS z FROM w JOIN k USING (term) GROUP BY 1)
SELECT doc_id, round(1 / (1 + exp(-greatest(least((SELECT sum(CASE label WHEN 'fake' THEN prior ELSE -prior END) FROM b) + coalesce(z, 0), 700), -700))), 6) AS p_fake FROM documents LEFT JOIN z USING (doc_id)
"""


def lime_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that speak most for or against a fake in the first words of each document: a row for each."""
    docs, model = table(spark, sf_dir, "documents"), _naive_bayes(spark, sf_dir)
    found = S.lime_weights(docs, "text", model, "fake")
    return docs.select("doc_id", S.lime_key(F.col("text"), model, "fake").alias("key")).join(found, "key").select("doc_id", "rank", "word", F.round("weight", 4).alias("weight"))


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of every fiftieth vector, by an index."""
    rows = table(spark, sf_dir, "embeddings")
    index = I.built(rows, key="vec_id")
    found = I.search(index, rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 6)
    again = W.Window.partitionBy("query_id").orderBy("rank")
    return found.filter("query_id <> record_id").withColumn("place", F.row_number().over(again)).filter("place <= 5").select("query_id", "record_id", "cosine", F.col("place").cast("long").alias("rank"))


INDEX_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS record_id, round(list_inner_product(q.v, d.v) / (q.n * d.n), 6) AS cosine FROM u q JOIN u d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, record_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, record_id) AS rank FROM s QUALIFY rank <= 5
"""


QUERIES = {f.__name__: f for f in (cross_dataset_matrix, batch_p_fake, lime_words, vector_index_topk)}
ORACLES = {"cross_dataset_matrix": MATRIX, "batch_p_fake": BATCH, "vector_index_topk": INDEX_SQL}
