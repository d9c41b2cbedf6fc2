"""Saved text models at work on whole tables: batch scores, and LIME weights of words.

A linear model is a folder: terms with their weights as Parquet, settings with the order of its labels as JSON. It is read by Spark, as only
Spark may reach the folder. Up to a bound of terms it is broadcast; each Python worker makes it ready once, and all of its batches use it. A model of more
terms stays a table (WideModel), and the terms of texts meet it in a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.features import MAX_FEATURES, plain, term_lists, terms_of
from lexforge.storage import drop_shuffles, materialize, shared_dir

_SETTINGS = "n int, weighting string, accents boolean, intercept double, labels array<string>"
#: Terms of a model that is broadcast.
MAX_BROADCAST = 2 * MAX_FEATURES
#: What a worker has made ready, by the model's name.
_READY: dict[str, dict[str, tuple[float, float]]] = {}


@dataclass
class LinearModel:
    """z = intercept + the sum of a text's weights; the chance of labels[1] is 1 / (1 + exp(-z)).

    weighting: counts (how often each term occurs), or tfidf or tfidf-log (counts, or their logarithms, times idf, scaled to length one).
    """

    terms: pa.Array
    idf: np.ndarray
    weight: np.ndarray
    intercept: float
    labels: list[str]
    n: int = 1
    weighting: str = "counts"
    accents: bool = True
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def ready(self, loads=None) -> dict[str, tuple[float, float]]:
        """The terms as a table, made once in a worker. loads: an accumulator of the processes that made it."""
        if self.name not in _READY:
            if loads is not None:
                loads.add([os.getpid()])
            _READY[self.name] = dict(zip(self.terms.to_pylist(), zip(self.idf.tolist(), self.weight.tolist(), strict=True), strict=True))
        return _READY[self.name]

    def predict(self, texts: list[str | None], label: str, loads=None) -> np.ndarray:
        """The chance of a label for each text, in the order of labels that the model has."""
        return self.predict_by(self.ready(loads), texts, label)

    def predict_by(self, table: dict[str, tuple[float, float]], texts: list[str | None], label: str) -> np.ndarray:
        """predict() with a table (idf, weight) of the terms in these texts."""
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            low = (text or "").lower()
            known = [(c, *table[t]) for t, c in terms_of(low if self.accents else plain(low), self.n).items() if t in table]
            tf, idf, weight = np.array(known, np.float64).reshape(-1, 3).T
            if self.weighting != "counts":
                tf = (1 + np.log(tf) if self.weighting == "tfidf-log" else tf) * idf
                tf = tf / max(np.sqrt(tf @ tf), 1e-300)
            out[k] = self.intercept + tf @ weight
        return self.chance(out, label)

    def chance(self, z: np.ndarray, label: str) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        return p if self.labels.index(label) == 1 else 1 - p

    def masked_by(self, table: dict[str, tuple[float, float]], own: list[str], names: list[str], z: np.ndarray, label: str) -> np.ndarray:
        """The chance for each sample of a text of the words own: z says which of the distinct ones, names, it keeps."""
        if self.weighting != "counts" or self.n > 1:
            place = {w: k for k, w in enumerate(names)}
            return self.predict_by(table, [" ".join(w for w in own if row[place[w]]) for row in z], label)
        counts, low = Counter(own), str.lower if self.accents else lambda w: plain(w.lower())
        part = [counts[w] * sum(table[t][1] * c for t, c in terms_of(low(w), 1).items() if t in table) for w in names]  # a sample's z is the sum of its words' parts
        return self.chance(self.intercept + z @ np.array(part, np.float64), label)


@dataclass
class WideModel:
    """A linear model whose terms, too many to be broadcast, stay a table (term, idf, weight); settings has everything else, without terms."""

    weights: DataFrame
    settings: LinearModel

    @property
    def name(self) -> str:
        return self.settings.name


def save_linear(weights: DataFrame, path: str, intercept: float, labels: list[str], n: int = 1, weighting: str = "counts", accents: bool = True) -> None:
    """weights (term, idf, weight) and the settings to a folder."""
    spark = weights.sparkSession
    weights.select("term", "idf", "weight").write.parquet(f"{path}/weights")
    spark.createDataFrame([(n, weighting, accents, float(intercept), labels)], _SETTINGS).coalesce(1).write.json(f"{path}/settings")


def load_linear(spark: SparkSession, path: str, most: int = MAX_BROADCAST) -> LinearModel:
    """The model of a folder; more than most terms raise an error, as it is broadcast."""
    s = spark.read.schema(_SETTINGS).json(f"{path}/settings").first()
    held = spark.read.schema("term string, idf double, weight double").parquet(f"{path}/weights").limit(most + 1).toArrow()
    if held.num_rows > most:
        raise ValueError(f"a linear model of over {most} terms")
    return LinearModel(held.column("term").combine_chunks(), held.column("idf").to_numpy(), held.column("weight").to_numpy(), s["intercept"], list(s["labels"]), s["n"], s["weighting"], s["accents"], path)


def open_linear(spark: SparkSession, path: str, most: int = MAX_BROADCAST) -> LinearModel | WideModel:
    """The model of a folder: to be broadcast with most terms at most, else as a table."""
    weights = spark.read.schema("term string, idf double, weight double").parquet(f"{path}/weights")
    if weights.count() <= most:
        return load_linear(spark, path, most)
    s = spark.read.schema(_SETTINGS).json(f"{path}/settings").first()
    none = np.empty(0)
    return WideModel(weights, LinearModel(pa.array([], pa.string()), none, none, s["intercept"], list(s["labels"]), s["n"], s["weighting"], s["accents"], path))


def _wide_scores(df: DataFrame, key: str, text: str, model: WideModel, label: str) -> DataFrame:
    """batch_scores() by a join of the texts' terms with the model's, summed by key."""
    m = model.settings
    each = term_lists(df, key, text, m.n, accents=m.accents).select("doc", F.explode("terms").alias("x")).select("doc", "x.term", "x.tf")
    known = each.join(model.weights, "term")
    if m.weighting == "counts":
        sums = known.groupBy("doc").agg(F.sum(F.col("tf") * F.col("weight")).alias("s"))
    else:
        x = (1 + F.ln("tf") if m.weighting == "tfidf-log" else F.col("tf")) * F.col("idf")
        sums = known.groupBy("doc").agg((F.sum(x * F.col("weight")) / F.greatest(F.sqrt(F.sum(x * x)), F.lit(1e-300))).alias("s"))
    z = F.greatest(F.least(F.lit(m.intercept) + F.coalesce("s", F.lit(0.0)), F.lit(700.0)), F.lit(-700.0))
    p = 1 / (1 + F.exp(-z))
    return df.select(F.col(key).alias("key")).join(sums, F.col("key") == F.col("doc"), "left").select("key", (p if m.labels.index(label) == 1 else 1 - p).alias("p"))


def batch_scores(df: DataFrame, key: str, text: str, model: LinearModel | WideModel, label: str, loads=None) -> DataFrame:
    """(key, p): the chance of a label for every row. A null text counts as empty."""
    if isinstance(model, WideModel):
        return _wide_scores(df, key, text, model, label)
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(df[key].alias("key"), df[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.predict(b.column(1).to_pylist(), label, loads))], ["key", "p"])

    return rows.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, p double")


# ---- LIME

# Samples and words of a text, the kernel's width, the penalties of the two regressions, and how many words are told.
SAMPLES, WORDS, WIDTH, FIRST_PENALTY, PENALTY, TOLD, SEED = 80, 60, 25.0, 0.01, 1.0, 10, 42


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def masks(text: str, n_words: int, samples: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """(samples, words) of 0 and 1: the whole text first; each other sample loses 1 to all words, those of the least hashes."""
    start = np.frombuffer(hashlib.blake2b(f"{seed}:{text}".encode(), digest_size=8).digest(), np.uint64)
    h = _mixed(_mixed(start + np.arange(samples * (n_words + 1), dtype=np.uint64)).reshape(samples, n_words + 1))
    lost = 1 + (h[:, -1] % np.uint64(max(n_words, 1))).astype(np.int64)
    out = (h[:, :-1].argsort(1, kind="stable").argsort(1, kind="stable") >= lost[:, None]).astype(np.float64)
    out[0] = 1
    return out


def ridge(z: np.ndarray, y: np.ndarray, k: np.ndarray, penalty: float) -> np.ndarray:
    """Weights of a regression of y on z with sample weights k and an intercept, by the normal equations."""
    zc, yc = z - k @ z / k.sum(), y - k @ y / k.sum()
    return np.linalg.solve(zc.T @ (zc * k[:, None]) + penalty * np.eye(z.shape[1]), zc.T @ (k * yc))


def lime(text: str | None, predict, words: int = WORDS, samples: int = SAMPLES, told: int = TOLD, masked=None) -> list[tuple[str, float]]:
    """(word, weight) of the words of a text's first words that speak most for or against what predict gives, the largest first.

    predict: texts to chances; masked in its place: (words, distinct words, samples) to chances. Each word stands for all its occurrences. Samples count by their cosine distance from the whole text; the
    words with the largest weights in a regression on all are kept and fitted again.
    """
    own = (text or "").split()[:words]
    names = list(dict.fromkeys(own))
    if not names:
        return []
    z = masks(" ".join(own), len(names), samples)
    place = {w: k for k, w in enumerate(names)}
    y = masked(own, names, z) if masked else predict([" ".join(w for w in own if row[place[w]]) for row in z])
    k = np.sqrt(np.exp(-((100 * (1 - np.sqrt(z.mean(1)))) ** 2) / WIDTH**2))
    first = ridge(z, y, k, FIRST_PENALTY)
    kept = np.sort(np.argsort(-np.abs(first), kind="stable")[:told])
    weight = ridge(z[:, kept], y, k, PENALTY)
    order = np.argsort(-np.abs(weight), kind="stable")
    return [(names[kept[j]], float(weight[j])) for j in order]


_LIME = "key string, rank int, word string, weight double"


def lime_weights(df: DataFrame, text: str, model: LinearModel | WideModel, label: str, cache: str | None = None, words: int = WORDS, samples: int = SAMPLES, told: int = TOLD, loads=None) -> DataFrame:
    """(key, rank, word, weight): a row for each word told of each distinct text; key is a hash of the text and the settings.

    cache: a folder of such rows; only texts whose key it lacks are worked on, and they are added to it.
    """
    spark, wide = df.sparkSession, isinstance(model, WideModel)
    if wide and model.settings.n > 1:
        raise ValueError("samples of a text have runs of words that the text has not, so a model of runs must be small enough to be broadcast")
    own = _first_words(df.select(lime_key(F.col(text), model, label, words, samples, told).alias("key"), F.coalesce(text, F.lit("")).alias("text")), words)
    own = own.groupBy("key").agg(F.first("text").alias("text"))
    known = spark.read.schema(_LIME).parquet(cache) if cache and _exists(spark, cache) else None
    if known is not None:
        own = own.join(known.select("key").distinct(), "key", "left_anti")
    if wide:
        own = _with_weights(own, model)
    held = spark.sparkContext.broadcast(model.settings if wide else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ranks, names, weights = [], [], [], []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, t = row[:2]
                table = {x["term"]: (x["idf"], x["weight"]) for x in row[2] or ()} if wide else held.value.ready(loads)
                found = lime(t, None, words, samples, told, lambda *x: held.value.masked_by(table, *x, label)) or [(None, None)]  # noqa: B023 - a text without words is known as such
                keys += [key] * len(found)
                ranks += range(1, len(found) + 1)
                names += [w for w, _ in found]
                weights += [x for _, x in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ranks, pa.int32()), pa.array(names, pa.string()), pa.array(weights, pa.float64())], ["key", "rank", "word", "weight"])

    made = own.mapInArrow(run, _LIME)
    if cache:
        made.write.mode("append").parquet(cache)
        made = spark.read.schema(_LIME).parquet(cache)
    return made.filter("word IS NOT NULL")


def _first_words(rows: DataFrame, words: int) -> DataFrame:
    """(key, text) with the first words of each text, of which alone samples are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(t.split(None, words)[:words]) for t in b.column(1).to_pylist()], pa.string())], ["key", "text"])

    return rows.mapInArrow(run, "key string, text string")


def _with_weights(own: DataFrame, model: WideModel) -> DataFrame:
    """(key, text, known) of texts of a few words, with what the model knows of their terms."""
    own = materialize(own)
    m = model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lows = (t.lower() for t in b.column(1).to_pylist())
            found = [list(terms_of(t if m.accents else plain(t), m.n)) for t in lows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["key", "terms"])

    each = own.mapInArrow(run, "key string, terms array<string>").select("key", F.explode("terms").alias("term"))
    known = each.join(model.weights, "term").groupBy("key").agg(F.collect_list(F.struct("term", "idf", "weight")).alias("known"))  # as many as the words' terms
    return own.join(known, "key", "left").select("key", "text", "known")


def lime_key(text, model: LinearModel | WideModel, label: str, words: int = WORDS, samples: int = SAMPLES, told: int = TOLD):
    return F.sha1(F.concat(F.lit(json.dumps([model.name, label, words, samples, told]) + "|"), F.coalesce(text, F.lit(""))))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


# ---- models as tables


def naive_bayes_weights(lists: DataFrame, by: tuple[str, ...] = (), alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(by..., term, label, weight) and (by..., label, prior) of multinomial naive Bayes on lists (by..., label, terms), of one model for each value of by.

    weight is the logarithm of a term's share in a class, for every term of the model and every class, prior that of the class's share of rows.
    """
    lists = materialize(lists.select(*by, "label", "terms"))
    drop_shuffles(lists.sparkSession)  # those of the texts
    counts = materialize(lists.select(*by, "label", F.explode("terms").alias("x")).groupBy(*by, "label", "x.term").agg(F.sum("x.tf").alias("c")))
    vocab = counts.select(*by, "term").distinct()
    sizes = vocab.groupBy(*by).agg(F.count("*").alias("v"))
    classes = lists.groupBy(*by, "label").agg(F.count("*").alias("m")).join(counts.groupBy(*by, "label").agg(F.sum("c").alias("total")), [*by, "label"], "left")
    all_ = classes.groupBy(*by).agg(F.sum("m").alias("rows"))
    joined = lambda a, b: a.join(F.broadcast(b), list(by)) if by else a.crossJoin(F.broadcast(b))  # noqa: E731 - b has a row for each model
    base = joined(joined(classes, all_), sizes).select(*by, "label", F.ln(F.col("m") / F.col("rows")).alias("prior"), (F.coalesce("total", F.lit(0)) + alpha * F.col("v")).alias("denom"))
    base = materialize(base)
    full = joined(vocab, base.groupBy(*by).agg(F.collect_list(F.struct("label", "denom")).alias("classes"))).select(*by, "term", F.explode("classes").alias("x")).select(*by, "term", "x.label", "x.denom")
    weights = full.join(counts, [*by, "term", "label"], "left").select(*by, "term", "label", F.ln((F.coalesce("c", F.lit(0)) + alpha) / F.col("denom")).alias("weight"))
    return weights, base.select(*by, "label", "prior")


def naive_bayes_linear(lists: DataFrame, labels: list[str], alpha: float = 1.0) -> tuple[DataFrame, float]:
    """(term, idf, weight) and the intercept of the linear model that naive Bayes is for two labels: log odds of the second."""
    weights, priors = naive_bayes_weights(lists, (), alpha)
    prior = {r["label"]: r["prior"] for r in priors.collect()}  # two rows
    side = lambda x: F.max(F.when(F.col("label") == x, F.col("weight")))
    return weights.groupBy("term").agg((side(labels[1]) - side(labels[0])).alias("weight")).withColumn("idf", F.lit(1.0)), prior[labels[1]] - prior[labels[0]]


def cross_matrix(lists: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(variant, model, corpus, n, accuracy, macro_f1) of every pair of corpora, from lists (doc, variant, corpus, label, train, terms).

    One naive Bayes model for each variant and corpus, of its training rows, with a vocabulary that is frozen there; every model scores the other
    rows of every corpus, in their own variant, in one join of terms. Rows of several variants of one document stand side by side.
    """
    lists = materialize(lists)
    weights, priors = naive_bayes_weights(lists.filter("train").select("variant", F.col("corpus").alias("model"), "label", "terms"), ("variant", "model"), alpha)
    tests = lists.filter("NOT train")
    each = tests.select("variant", "corpus", "doc", F.explode("terms").alias("x")).select("variant", "corpus", "doc", "x.term", "x.tf")
    sums = each.join(weights, ["variant", "term"]).groupBy("variant", "corpus", "doc", "model", "label").agg(F.sum(F.col("tf") * F.col("weight")).alias("s"))
    asked = tests.select("variant", "corpus", "doc", F.col("label").alias("gold")).join(F.broadcast(priors), "variant")  # a row for each model and class
    scored = asked.join(sums, ["variant", "corpus", "doc", "model", "label"], "left").select("variant", "corpus", "doc", "model", "gold", F.struct(F.round(F.col("prior") + F.coalesce("s", F.lit(0.0)), 6), "label").alias("x"))
    pred = scored.groupBy("variant", "model", "corpus", "doc").agg(F.first("gold").alias("gold"), F.max("x").alias("x")).select("variant", "model", "corpus", "gold", F.col("x.label").alias("pred"))
    sides = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("side")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("side"))))
    f1 = pred.select("variant", "model", "corpus", (F.col("gold") == F.col("pred")).cast("int").alias("hit"), sides.alias("y")).groupBy("variant", "model", "corpus", "y.label").agg(F.sum("hit").alias("h"), F.count("*").alias("both"))
    macro = f1.groupBy("variant", "model", "corpus").agg(F.avg(F.col("h") / F.col("both")).alias("macro_f1"))
    total = pred.groupBy("variant", "model", "corpus").agg(F.count("*").alias("n"), F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"))
    return total.join(macro, ["variant", "model", "corpus"])


def saved(spark: SparkSession, weights: DataFrame, intercept: float, labels: list[str], most: int | None = None, **settings) -> LinearModel | WideModel:
    """A model written to the shared folder and opened again. most: the terms that may be broadcast."""
    path = shared_dir(spark)
    save_linear(weights, path, intercept, labels, **settings)
    return open_linear(spark, path, MAX_BROADCAST if most is None else most)
