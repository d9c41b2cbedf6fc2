"""Readers of raw corpora and of run artefacts into the unified schema or typed frames. Schemas are declared; nothing is inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.functions.dates import parse_date
from lexforge.schema import BINARY_TO_FIVE, BINARY_TO_THREE, SIX_TO_FIVE, SIX_TO_THREE, STANCES, align, duplicates, mapped, require, violations
from lexforge.storage import materialize

# Column names of the raw files.
SIX_WAY = ["id", "label", "statement", "subject", "speaker", "speaker_job", "state", "party", "barely_true_counts", "false_counts", "half_true_counts", "mostly_true_counts", "pants_on_fire_counts", "context"]
CLAIMS = "id string, claim string, original_rating string, label string, publisher string, factcheck_url string, factcheck_date string, claim_date string, claimant string, context string, input_type string, modality string, split string, notes string"
EVIDENCE = "array<array<array<string>>>"


def _csv(spark: SparkSession, path: str, schema: str, **options: object) -> DataFrame:
    return spark.read.options(header=True, multiLine=True, escape='"', **options).schema(schema).csv(path)


def _binary(df: DataFrame, label: Column) -> DataFrame:
    return df.withColumn("label", label).withColumn("label5", mapped(F.col("label"), BINARY_TO_FIVE)).withColumn("label3", mapped(F.col("label"), BINARY_TO_THREE))


def numbered_news(spark: SparkSession, path: str, name: str = "welfake") -> DataFrame:
    """CSV with a serial first column; label 0 is real, 1 fake."""
    raw = _csv(spark, path, "serial long, title string, text string, label_no int")
    out = _binary(raw, F.when(F.col("label_no") == 0, "real").when(F.col("label_no") == 1, "fake"))
    return align(out.withColumn("id", F.concat(F.lit(f"{name}_"), F.col("serial"))).withColumn("source_dataset", F.lit(name)))


def with_positions(raw: DataFrame, name: str = "pos") -> DataFrame:
    """raw, just read from files, with each row's place in the whole input, from 0: files in order of their names, blocks and rows in order inside.

    Two passes: rows are written with the file and block they are from, then rows are counted by block, and a row's place is that in its block and the sizes
    of the blocks before.
    """
    own = materialize(raw.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m")))
    blocks = own.groupBy("__f", "__b").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))  # a row for each block of a file
    before = W.Window.orderBy("__f", "__b").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = blocks.select("__f", "__b", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return own.join(offsets, ["__f", "__b"]).withColumn(name, F.col("__before") + F.col("__m") - F.col("__first")).drop("__f", "__b", "__m", "__first", "__before")


def paired_news(spark: SparkSession, real: str, fake: str, name: str = "isot") -> DataFrame | None:
    """Two CSV files whose name is the label; ids are row positions. None if a file is missing."""
    parts = []
    for label, path in (("real", real), ("fake", fake)):
        try:
            raw = _csv(spark, path, "title string, text string, subject string, date string")
        except AnalysisException:
            return None
        rows = with_positions(raw, "__p")
        parts.append(rows.withColumn("label", F.lit(label)).withColumn("id", F.concat(F.lit(f"{name}_{label}_"), F.col("__p"))))
    both = _binary(parts[0].unionByName(parts[1]), F.col("label"))
    return align(both.withColumns({"date": parse_date(F.col("date")).cast("string"), "source_dataset": F.lit(name), "meta": F.to_json(F.struct("subject"))}))


def six_way_statements(spark: SparkSession, paths: dict[str, str], name: str = "liar") -> DataFrame:
    """TSV without header or quotes, a file for each split; unknown labels raise."""
    schema = ", ".join(f"{c} string" for c in SIX_WAY)
    parts = [spark.read.options(sep="\t", quote="", nullValue="\u0000").schema(schema).csv(p).withColumn("split", F.lit(s)) for s, p in paths.items()]
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p)
    require(violations(raw, {"known_label": F.col("label").isin(list(SIX_TO_FIVE))}))
    own = raw.withColumns({"meta": F.to_json(F.struct(*SIX_WAY[3:])), "text": F.col("statement"), "label5": mapped(F.col("label"), SIX_TO_FIVE), "label3": mapped(F.col("label"), SIX_TO_THREE), "source_dataset": F.lit(name)})
    return align(own.withColumn("id", F.concat(F.lit(f"{name}_"), F.regexp_replace("id", r"\.json$", ""))))


def flat_evidence(evidence: Column) -> Column:
    """Distinct (page, sentence) of nested annotations that have both, sorted."""
    flat = F.filter(F.flatten(evidence), lambda x: (F.size(x) >= 4) & F.get(x, F.lit(2)).isNotNull())
    return F.array_sort(F.array_distinct(F.transform(flat, lambda x: F.struct(F.get(x, F.lit(2)).alias("page"), F.get(x, F.lit(3)).cast("int").alias("sentence")))))


def claim_lines(spark: SparkSession, path: str, name: str = "fever") -> DataFrame:
    """JSON lines of claims with nested evidence; pages in meta, sorted and distinct."""
    raw = spark.read.schema(f"id long, claim string, label string, verifiable string, evidence {EVIDENCE}").json(path)
    require(violations(raw, {"known_label": F.col("label").isin(list(STANCES))}))
    pairs = flat_evidence(F.col("evidence"))
    pages = F.array_sort(F.array_distinct(F.transform(pairs, lambda x: x.getField("page"))))
    return align(raw.withColumns({"text": F.col("claim"), "meta": F.to_json(F.struct(pages.alias("pages"), pairs.alias("evidence"))), "label": mapped(F.col("label"), STANCES), "source_dataset": F.lit(name), "id": F.concat(F.lit(f"{name}_"), F.col("id"))}))


def gold_evidence(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, label, pages, text): the first occurrence of each claim; distinct pages joined by a bar."""
    raw = spark.read.schema("original_id long, label string, evidence array<array<string>>").json(paths)
    raw = with_positions(raw)
    first = raw.groupBy("original_id").agg(F.min_by(F.struct("label", "evidence"), "pos").alias("x"))
    pages = F.array_join(F.array_distinct(F.transform("x.evidence", lambda e: F.get(e, F.lit(0)))), "|")
    return first.select(F.col("original_id").alias("id"), F.col("x.label").alias("label"), pages.alias("pages"), F.array_join(F.transform("x.evidence", lambda e: F.get(e, F.lit(2))), " ").alias("text"))


def tweeted_news(spark: SparkSession, real: str, fake: str, name: str = "fnn") -> DataFrame:
    """Two all-text CSV files; the label is part of the id, as ids recur; tweets are counted by tabs."""
    parts = [_csv(spark, p, "id string, news_url string, title string, tweet_ids string").withColumn("label", F.lit(label)) for label, p in (("real", real), ("fake", fake))]
    own = _binary(parts[0].unionByName(parts[1]), F.col("label"))
    tweets = F.when(F.coalesce("tweet_ids", F.lit("")) == "", 0).otherwise(F.size(F.split("tweet_ids", "\t")))
    return align(own.withColumns({"meta": F.to_json(F.struct("news_url", tweets.alias("n_tweets"))), "id": F.concat_ws("_", F.lit(name), "label", "id"), "text": F.col("title"), "source_dataset": F.lit(name)}))


def live_claims(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All-text CSV; empty fields are null."""
    out = _csv(spark, path, CLAIMS, nullValue="", emptyValue="")
    return out if split is None else out.filter(F.col("split") == split)


def live_claim_violations(df: DataFrame) -> DataFrame:
    """All broken rules at once: domains, required fields, URL form, ISO dates, unique ids and URLs."""
    filled = lambda c: F.coalesce(F.length(F.col(c)) > 0, F.lit(False))
    iso = lambda c: F.col(c).isNull() | (F.col(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")).isNotNull())
    rules = {f"{c}_filled": filled(c) for c in ("id", "claim", "label", "original_rating", "publisher", "factcheck_url", "factcheck_date", "input_type", "modality", "split")}
    rules |= {"label_known": F.col("label").isin("REAL", "FAKE", "MISLEADING", "PARTIALLY TRUE", "UNVERIFIABLE"), "split_known": F.col("split").isin("dev", "eval"), "input_type_known": F.col("input_type").isin("headline", "article", "url"), "modality_known": F.col("modality").isin("text", "media")}
    rules |= {"https": F.col("factcheck_url").startswith("https://"), "factcheck_date_iso": iso("factcheck_date"), "claim_date_iso": iso("claim_date")}
    return violations(df, rules).unionByName(duplicates(df, "id")).unionByName(duplicates(df, "factcheck_url"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, blank ones skipped; an empty frame if there is no such file."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def logs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON files of a folder with their name."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("file", F.col("_metadata.file_path"))


def splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("id string, label string").csv(path)


def load_split(corpus: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """Rows of a split joined one to one; missing rows and labels or splits that disagree raise."""
    both = split.select("id", F.col("label").alias("split_label")).join(corpus, "id", "left")
    found = violations(both, {"row_exists": F.col("source_dataset").isNotNull(), "same_label": F.col("label") == F.col("split_label"), "same_split": F.coalesce(F.col("split") == name, F.lit(True))})
    require(found.unionByName(duplicates(split, "id")))
    return both.drop("split_label")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files: the manifest of a download."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def cache_lookup(keys: DataFrame, cache: DataFrame, source: str) -> DataFrame:
    """keys (query) with value of the cache, whose key is a hash of source and query; null is a miss."""
    own = keys.withColumn("key", F.sha1(F.concat(F.lit(f"{source}|"), F.col("query"))))
    return own.join(cache.select("key", "value"), "key", "left")


REVIEW = "struct<publisher: struct<name: string>, url: string, reviewDate: string, textualRating: string>"


def factcheck_answers(spark: SparkSession, path: str) -> DataFrame:
    """(query, claim_no, claim, publisher, url, date, rating) of a fact-check service's answers as JSON lines: of each claim the first review, if it has one."""
    raw = spark.read.schema(f"query string, claims array<struct<text: string, claimReview: array<{REVIEW}>>>").json(path)
    each = raw.select("query", F.posexplode("claims").alias("p", "c")).select("query", (F.col("p") + 1).alias("claim_no"), F.col("c.text").alias("claim"), F.explode(F.slice("c.claimReview", 1, 1)).alias("r"))
    return each.select("query", "claim_no", "claim", F.col("r.publisher.name").alias("publisher"), "r.url", F.substring("r.reviewDate", 1, 10).alias("date"), F.col("r.textualRating").alias("rating"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a configuration file of "name: value" lines: sections are joined to their names by a dot, comments and empty lines go.

    Such files are written by people and small; their lines are kept in order by the reader's one task.
    """
    lines = [r[0] for r in spark.read.text(path).coalesce(1).collect()]
    rows, section = [], ""
    for line in lines:
        bare = line.split("#")[0].rstrip()
        name, colon, value = bare.strip().partition(":")
        if not colon:
            continue
        if not value.strip():
            section = name.strip()
        else:
            rows.append((f"{section}.{name.strip()}" if section and line[:1] in " \t" else name.strip(), value.strip().strip("\"'")))
    return spark.createDataFrame(rows, "name string, value string")
