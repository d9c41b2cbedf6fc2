"""Sentences, with abbreviations learnt from the corpus itself.

Whether a full stop ends a sentence is decided by how often the word before it is followed by one in the whole corpus: a likelihood ratio
(Dunning) between "nearly always" and "as often as any word", scaled by the word's length and its occurrences without a stop, as Kiss and Strunk
describe (Computational Linguistics 32, 2006). Spark counts the words; the ratio is an expression; the splitter gets the abbreviations, of
which there are ABBREVIATIONS_MOST at most, the surest first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The share of stops after an abbreviation, the least score of one, and words that commonly open an order.
ALWAYS, LEAST = 0.99, 0.3
ABBREVIATIONS_MOST = 20_000
ORDERS = frozenset("add ask avoid be bring buy call check click come consider contact do don't donate download find follow get give go help imagine join keep learn leave let like listen look make move note open please post read remember report see send share sign start stop subscribe take tell think try turn use visit vote wait watch write".split())
_TOKEN = r"[^ \t\n\r\f\x0B]+"


def word_stops(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, stops, plain): how often each lower-case word stands before a full stop that ends its token, and how often not; quotes and brackets around tokens don't count."""
    token = F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))).alias("t")
    bare = F.regexp_replace(F.regexp_replace("t", r"""^[("'\[]+""", ""), r"""[)"'\],;:!?]+$""", "")
    own = df.select(token).select(bare.alias("t")).filter("t <> '' AND t <> '.'")
    stop = F.col("t").endswith(".")
    word = F.when(stop, F.expr("substring(t, 1, length(t) - 1)")).otherwise(F.col("t"))
    return own.select(word.alias("word"), stop.cast("int").alias("s")).filter(F.col("word").rlike(r"^[a-z]")).groupBy("word").agg(F.sum("s").cast("long").alias("stops"), F.sum(1 - F.col("s")).cast("long").alias("plain"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """counts with score: LEAST or more for an abbreviation."""
    total = counts.agg(F.sum("stops").alias("all_stops"), F.sum(F.col("stops") + F.col("plain")).alias("all_words"))
    n, k = (F.col("stops") + F.col("plain")).cast("double"), F.col("stops").cast("double")
    p = F.col("all_stops") / F.col("all_words")
    # of k stops in n words: by chance p, against nearly always
    ratio = 2 * (k * (F.ln(F.lit(ALWAYS)) - F.ln(p)) + (n - k) * (F.ln(F.lit(1 - ALWAYS)) - F.ln(1 - p)))
    letters = F.length(F.regexp_replace("word", "[.]", ""))
    inner = F.length("word") - letters + 1
    score = ratio * F.exp(-letters.cast("double")) * inner * F.pow(letters.cast("double"), -F.col("plain"))
    rows = counts.filter("stops > 0").crossJoin(F.broadcast(total))  # one row
    return rows.select("word", "stops", "plain", F.when((letters > 0) & (F.col("all_words") > F.col("all_stops")), score).otherwise(0.0).alias("score"))


def abbreviations(df: DataFrame, text: str = "text") -> list[str]:
    """The surest abbreviations of the corpus, ABBREVIATIONS_MOST at most."""
    found = abbreviation_scores(word_stops(df, text)).filter(F.col("score") >= LEAST)
    return [r["word"] for r in found.orderBy(F.col("score").desc(), "word").limit(ABBREVIATIONS_MOST).collect()]


_END = regex.compile(r"""[.!?…]+[)"'\]”’]*(?=\s+\S)|\n\s*\n""")
_LAST = regex.compile(r"""[("'\[]*(\S+?)\.+[)"'\]”’]*$""")


def split_text(text: str, known: frozenset[str]) -> list[str]:
    """The sentences of a text. A full stop after an abbreviation, an initial or a number before a small letter doesn't end one; an empty line does."""
    out, begin = [], 0
    for m in _END.finditer(text):
        follows = text[m.end() :].lstrip()[:1] if m.group()[0] != "\n" else "\n"
        if m.group().startswith(".") and follows != "\n":
            last = _LAST.search(text[max(begin, m.end() - 64) : m.end()])
            word = last.group(1).rstrip(".") if last else ""
            small = follows.islower()
            if word.lower() in known or (len(word) == 1 and word.isalpha() and word.isupper()) or (small and (word.isdigit() or m.group().startswith(".."))):
                continue
        out.append(text[begin : m.end()].strip())
        begin = m.end()
    out.append(text[begin:].strip())
    return [s for s in out if s]


def is_order_or_question(sentence: str) -> bool:
    """A question, or a sentence that opens with the bare form of a common verb of orders."""
    words = regex.findall(r"[\p{L}']+", sentence.lower())
    return sentence.rstrip().endswith("?") or bool(words) and words[0] in ORDERS


def is_order(sentence: Column) -> Column:
    """Whether a sentence opens with the bare form of a common verb of orders."""
    return F.lower(F.regexp_extract(sentence, r"[\p{L}']+", 0)).isin(sorted(ORDERS))


def splitter(known: list[str]) -> Callable[[Column], Column]:
    """A function of columns that splits texts into arrays of sentences by given abbreviations."""
    held = frozenset(known)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", held))

    return split


def sentence_rows(df: DataFrame, key: str, text: str = "text", known: list[str] | None = None) -> DataFrame:
    """(key, place, sentence, skipped) of every sentence; skipped: a question or an order, which is no claim. known: abbreviations, else those of df itself."""
    held = df.sparkSession.sparkContext.broadcast(frozenset(abbreviations(df, text) if known is None else known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, places, found = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                own = split_text(t or "", held.value)
                keys += [k] * len(own)
                places += range(1, len(own) + 1)
                found += own
            skipped = [is_order_or_question(s) for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(places, pa.int32()), pa.array(found, pa.string()), pa.array(skipped, pa.bool_())], ["key", "place", "sentence", "skipped"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, place int, sentence string, skipped boolean")


def claims_of(sentences: DataFrame, least_words: int = 6) -> DataFrame:
    """Sentences that may be claims: of least_words words or more, neither questions nor orders; a text of one sentence keeps it."""
    alone: Column = F.col("n") == 1
    sizes = sentences.groupBy("key").agg(F.count("*").alias("n")).withColumnRenamed("key", "k")
    words = F.size(F.regexp_extract_all("sentence", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    joined = sentences.join(sizes, F.col("key").eqNullSafe(F.col("k")))
    return joined.filter(alone | (~F.col("skipped") & (words >= least_words))).drop("k", "n")
