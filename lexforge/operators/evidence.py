"""Assembling evidence for claims from web hits, pages, structured reviews, encyclopaedia extracts and fact-check searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.functions import text as X
from lexforge.functions import vectors as V
from lexforge.functions.urls import with_tier
from lexforge.operators.retrieve import best_sentences

Similarity = Callable[[Column, Column], Column]
PAGES, SENTENCES = 5, 3
ITEM = ("query_id", "pos", "origin", "source", "url", "title", "snippet", "date", "tier", "w_source", "cosine", "rating", "rating3", "is_factcheck", "canonical")


def embedded(sentence: Column, claim: Column) -> Column:
    """The cosine of the registered embedding."""
    from lexforge.functions.scorers import scorer

    embed = scorer("embed")
    return V.dot(V.normalised(embed(sentence)), V.normalised(embed(claim)))


def shared_words(sentence: Column, claim: Column) -> Column:
    """The share of words in common, for plans without a model."""
    a, b = F.array_distinct(X.word_tokens(sentence)), F.array_distinct(X.word_tokens(claim))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def merged_hits(hits: DataFrame) -> DataFrame:
    """(query_id, pos, url, title, snippet): of hits with one URL the last one's words at the first one's place; none without a URL."""
    own = hits.filter(F.coalesce("url", F.lit("")) != "")
    return own.groupBy("query_id", "url").agg(F.min("pos").alias("pos"), F.max_by(F.struct("title", "snippet"), "pos").alias("x")).select("query_id", "pos", "url", "x.title", "x.snippet")


def passages(texts: DataFrame, claims: DataFrame, similarity: Similarity) -> DataFrame:
    """(query_id, pos, passage, top): of each text (query_id, pos, text) the SENTENCES sentences most like the claim, in their order."""
    rows = texts.select("query_id", "pos", F.posexplode(X.quotable_sentences(F.coalesce("text", F.lit("")))).alias("i", "sentence")).join(claims.select("query_id", "claim"), "query_id")
    scored = rows.select(F.struct("query_id", "pos").alias("key"), F.col("i").alias("pos"), "sentence", similarity(F.col("sentence"), F.col("claim")).alias("sim"))
    return best_sentences(scored, "key", SENTENCES).select("key.query_id", "key.pos", "passage", "top")


def _item(df: DataFrame, origin: str, **columns: Column) -> DataFrame:
    """df's rows as ITEM rows; columns give those that differ from the defaults."""
    none = {"rating": "string", "rating3": "string", "canonical": "string", "date": "date"}
    own = with_tier(df.withColumn("origin", F.lit(origin)), "url").withColumnsRenamed({"domain": "source", "weight": "w_source"})
    defaults = {k: F.lit(None).cast(t) for k, t in none.items() if k not in columns} | {"is_factcheck": columns.pop("is_factcheck", F.lit(False))}
    return own.withColumns(columns | defaults).withColumn("cosine", F.round("cosine", 4)).select(*ITEM)


def assemble(claims: DataFrame, hits: DataFrame, pages: DataFrame, reviews: DataFrame, extracts: DataFrame, ratings: DataFrame, similarity: Similarity = embedded, use_reviews: bool = True) -> DataFrame:
    """ITEM rows of each claim (query_id, claim).

    hits (query_id, pos, url, title, snippet), pages (url, text, date) of which the first PAGES of a claim are read, reviews
    (url, claim_reviewed, rating, rating3, date, canonical) that only first-tier sources count for, extracts (query_id, pos, url,
    title, text), ratings (query_id, pos, url, publisher, claim_reviewed, rating, date). A rated review stands for its page.
    """
    web = with_tier(merged_hits(hits), "url")
    web = web.withColumn("place", F.row_number().over(W.Window.partitionBy("query_id").orderBy("pos")))  # a claim's hits: some dozen
    page = pages.select(F.col("url").alias("p_url"), F.col("text").alias("p_text"), F.col("date").alias("p_date"))
    review = reviews.select(F.col("url").alias("r_url"), X.stripped(F.col("claim_reviewed")).alias("claim_reviewed"), "rating", "rating3", F.col("date").alias("r_date"), "canonical")
    found = web.join(page, (F.col("url") == F.col("p_url")) & (F.col("place") <= PAGES), "left")
    first_tier = (F.col("tier") == 1) & F.lit(use_reviews)
    found = found.join(review, (F.col("url") == F.col("r_url")) & first_tier, "left").drop("tier", "domain", "weight").join(claims.select("query_id", "claim"), "query_id")
    rated = (F.coalesce("claim_reviewed", F.lit("")) != "") & F.col("rating3").isNotNull()
    one = _item(
        found.filter(rated).withColumns({"snippet": F.col("claim_reviewed"), "cosine": similarity(F.col("claim_reviewed"), F.col("claim"))}), "web",
        date=F.coalesce("r_date", "p_date"), rating=F.col("rating"), rating3=F.col("rating3"), is_factcheck=F.lit(True), canonical=F.col("canonical"),
    )
    plain = found.filter(~rated).withColumn("text", F.coalesce(F.nullif("p_text", F.lit("")), "snippet"))
    quoted = plain.drop("snippet", "rating", "rating3").join(passages(plain, claims, similarity), ["query_id", "pos"]).withColumnsRenamed({"passage": "snippet", "top": "cosine"})
    own_date = F.when(~F.contains(F.col("url"), F.lit("wikipedia.org")), F.col("p_date"))  # there it is the page's, not the event's
    two = _item(quoted, "web", date=own_date, canonical=F.col("canonical"))
    wiki = extracts.join(passages(extracts, claims, similarity), ["query_id", "pos"]).withColumnsRenamed({"passage": "snippet", "top": "cosine"})
    checks = ratings.filter(F.coalesce("claim_reviewed", F.lit("")) != "").join(claims.select("query_id", "claim"), "query_id")
    checks = checks.withColumns({"url": F.coalesce(F.nullif("url", F.lit("")), "publisher", F.lit("")), "title": F.col("publisher"), "snippet": F.col("claim_reviewed"), "cosine": similarity(F.col("claim_reviewed"), F.col("claim"))})
    four = _item(checks, "factcheck", date=F.col("date"), rating=F.col("rating"), rating3=X.rating3(F.col("rating")), is_factcheck=F.lit(True))
    return one.unionByName(two).unionByName(_item(wiki, "encyclopaedia")).unionByName(four)
