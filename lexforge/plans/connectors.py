"""Registered queries of sources and sinks: fixtures are written to the shared folder from the tables, and read back by the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.schema import SIX_TO_FIVE, SIX_TO_THREE, align
from lexforge.session import table
from lexforge.sources import readers as R
from lexforge.sources import sinks as S
from lexforge.storage import shared_dir


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a title; without carriage returns, which CSV readers take for line ends."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    text = F.translate(F.coalesce("text", F.lit("")), "\r\\", "")
    return d.select("doc_id", "quality", "toxic", "lang", F.concat(F.lit("Title "), F.col("doc_id").cast("string"), F.lit(', "quoted"')).alias("title"), F.concat(F.lit("x"), F.trim(text), F.lit("x")).alias("text"))


_OWN = "o AS (SELECT doc_id, quality, toxic, lang, 'Title ' || doc_id || ', \"quoted\"' AS title, 'x' || trim(replace(replace(coalesce(text, ''), chr(13), ''), chr(92), '')) || 'x' AS text FROM documents JOIN labels USING (doc_id))"


def _csv(df: DataFrame, path: str) -> str:
    df.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def _short(df: DataFrame, *names: str | Column) -> DataFrame:
    return df.select(*names, F.sha1("text").alias("text_sha1"))


def source_numbered_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _csv(_own(spark, sf_dir).select("doc_id", "title", "text", F.lit(1) - F.col("quality")), shared_dir(spark))
    return _short(R.numbered_news(spark, path), "id", "title", "label", "label5", "label3", "source_dataset")


NUMBERED = f"WITH {_OWN} SELECT 'welfake_' || doc_id AS id, title, CASE quality WHEN 1 THEN 'real' ELSE 'fake' END AS label, CASE quality WHEN 1 THEN 'REAL' ELSE 'FAKE' END AS label5, CASE quality WHEN 1 THEN 'TRUE' ELSE 'FALSE' END AS label3, 'welfake' AS source_dataset, sha1(text) AS text_sha1 FROM o"


def source_paired_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _own(spark, sf_dir).select("doc_id", "quality", "title", "text", F.col("lang").alias("subject"), F.lit("Dec 31, 2017").alias("date"))
    in_order = lambda q: own.filter(F.col("quality") == q).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").drop("quality", "doc_id")  # noqa: E731 - three files
    paths = [_csv(in_order(q), shared_dir(spark)) for q in (1, 0)]
    return _short(R.paired_news(spark, *paths), "id", "title", "label", "date", F.get_json_object("meta", "$.subject").alias("subject"))


PAIRED = f"WITH {_OWN} SELECT 'isot_' || CASE quality WHEN 1 THEN 'real_' ELSE 'fake_' END || (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) AS id, title, CASE quality WHEN 1 THEN 'real' ELSE 'fake' END AS label, '2017-12-31' AS date, lang AS subject, sha1(text) AS text_sha1 FROM o"
_SIX = list(SIX_TO_FIVE)


def source_six_way_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    label = F.element_at(F.array(*map(F.lit, _SIX)), (F.col("item_id") % len(_SIX) + 1).cast("int"))
    own = b.select(F.concat("item_id", F.lit(".json")).alias("id"), label.alias("label"), F.translate("text", "\t\n\r", "   ").alias("statement"), *[(F.col("item_id") + k).cast("string").alias(c) for k, c in enumerate(R.SIX_WAY[3:])])
    paths = {}
    for k, s in enumerate(("train", "val", "test")):
        paths[s] = shared_dir(spark)
        own.filter(F.split_part("id", F.lit("."), F.lit(1)).cast("long") % 3 == k).write.options(sep="\t", quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(paths[s])
    return _short(R.six_way_statements(spark, paths), "id", "label", "label5", "label3", "split", F.get_json_object("meta", "$.speaker").alias("speaker"))


_CASE = lambda m: " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items())
SIX_WAY = f"""
WITH b AS (SELECT item_id, translate(text, chr(9) || chr(10) || chr(13), '   ') AS text, [{', '.join(f"'{x}'" for x in _SIX)}][item_id % {len(_SIX)} + 1] AS label FROM benchmark)
SELECT 'liar_' || item_id AS id, label, CASE label {_CASE(SIX_TO_FIVE)} END AS label5, CASE label {_CASE(SIX_TO_THREE)} END AS label3, ['train', 'val', 'test'][item_id % 3 + 1] AS split, (item_id + 1)::VARCHAR AS speaker, sha1(text) AS text_sha1 FROM b
"""


def source_claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    one = lambda k: F.array((i * 10 + k).cast("string"), i.cast("string"), F.when((i + k) % 3 != 0, F.concat(F.lit("Page_"), (i + k) % 4)), F.lit(k).cast("string"))
    label = F.element_at(F.array(F.lit("SUPPORTS"), F.lit("REFUTES"), F.lit("NOT ENOUGH INFO")), (i % 3 + 1).cast("int"))
    path = shared_dir(spark)
    table(spark, sf_dir, "benchmark").select(i.alias("id"), F.col("text").alias("claim"), label.alias("label"), F.lit("VERIFIABLE").alias("verifiable"), F.array(F.array(one(0), one(1)), F.array(one(1), one(4))).alias("evidence")).write.json(path)
    return _short(R.claim_lines(spark, path), "id", F.array_join(F.from_json(F.get_json_object("meta", "$.pages"), "array<string>"), "|").alias("pages"))


LINES = """
WITH p AS (SELECT item_id, text, list_sort(list_distinct(list_filter(list_transform([0, 1, 4], lambda k: CASE WHEN (item_id + k) % 3 <> 0 THEN 'Page_' || (item_id + k) % 4 END), lambda x: x IS NOT NULL))) AS p FROM benchmark)
SELECT 'fever_' || item_id AS id, array_to_string(p, '|') AS pages, sha1(text) AS text_sha1 FROM p
"""


def source_gold_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    path = shared_dir(spark)
    line = lambda k: F.array(F.concat(F.lit("P"), (i + k) % 3), F.lit(str(k)), F.concat(F.lit(f"s{k} "), F.substring("text", 1, 20)))
    table(spark, sf_dir, "benchmark").select(i.alias("original_id"), F.lit("SUPPORTS").alias("label"), F.array(line(0), line(1), line(3)).alias("evidence")).write.json(path)
    return R.gold_evidence(spark, [path]).select("id", "label", "pages", F.sha1("text").alias("text_sha1"))


GOLD = "SELECT item_id AS id, 'SUPPORTS' AS label, 'P' || item_id % 3 || '|P' || (item_id + 1) % 3 AS pages, sha1('s0 ' || text[1:20] || ' s1 ' || text[1:20] || ' s3 ' || text[1:20]) AS text_sha1 FROM benchmark"


def source_tweeted_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _own(spark, sf_dir).select("quality", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("http://x/"), "doc_id").alias("news_url"), "title", F.when(F.col("doc_id") % 4 > 0, F.repeat(F.lit("7\t"), (F.col("doc_id") % 4 - 1).cast("int"))).alias("t"))
    own = own.withColumn("tweet_ids", F.when(F.col("t").isNotNull(), F.concat("t", F.lit("9"))).otherwise("")).drop("t")
    paths = [_csv(own.filter(F.col("quality") == q).drop("quality"), shared_dir(spark)) for q in (1, 0)]
    return R.tweeted_news(spark, *paths).select("id", "text", "label", F.get_json_object("meta", "$.n_tweets").cast("int").alias("n_tweets"))


TWEETED = f"WITH {_OWN} SELECT 'fnn_' || CASE quality WHEN 1 THEN 'real_' ELSE 'fake_' END || doc_id AS id, title AS text, CASE quality WHEN 1 THEN 'real' ELSE 'fake' END AS label, (doc_id % 4)::INT AS n_tweets FROM o"


def sink_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by data set and split, read back with what the folders' names tell."""
    path = shared_dir(spark)
    own = _own(spark, sf_dir)
    S.corpus(align(own.select(F.concat(F.lit("d_"), "doc_id").alias("id"), "title", "text", F.col("lang").alias("source_dataset"), F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"))), path)
    return _short(spark.read.parquet(path), "id", "source_dataset", "split")


CORPUS = f"WITH {_OWN} SELECT 'd_' || doc_id AS id, lang AS source_dataset, CASE quality WHEN 1 THEN 'train' ELSE 'test' END AS split, sha1(text) AS text_sha1 FROM o"


def sink_split_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split lists as CSV, joined back to their corpus row by row."""
    path = shared_dir(spark)
    own = _own(spark, sf_dir).select(F.concat(F.lit("d_"), "doc_id").alias("id"), F.when(F.col("quality") == 1, "real").otherwise("fake").alias("label"), "text")
    S.split_csv(own, path)
    corpus = align(own.withColumn("source_dataset", F.lit("d")))
    return _short(R.load_split(corpus, R.splits(spark, path), "train"), "id", "label")


SPLITS = f"WITH {_OWN} SELECT 'd_' || doc_id AS id, CASE quality WHEN 1 THEN 'real' ELSE 'fake' END AS label, sha1(text) AS text_sha1 FROM o"


def sink_json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log appended twice, and the inputs that it lacks."""
    path = shared_dir(spark)
    own = _own(spark, sf_dir).select("doc_id", "quality")
    for k in (0, 1):
        S.append_json(own.filter(F.col("doc_id") % 3 == k), path)
    done = R.json_lines(spark, path, "doc_id long, quality int")
    left = S.unfinished(own, done, "doc_id").withColumn("state", F.lit("open"))
    return done.withColumn("state", F.lit("done")).unionByName(left.select("doc_id", "quality", "state"))


LOG = f"WITH {_OWN} SELECT doc_id, quality, CASE WHEN doc_id % 3 < 2 THEN 'done' ELSE 'open' END AS state FROM o"


def sink_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of answers, updated, and looked up by the hash of source and question."""
    e = table(spark, sf_dir, "events").select(F.sha1(F.concat(F.lit("web|"), F.col("user_id").cast("string"))).alias("key"), F.when(F.col("event_type") != "error", F.col("event_id").cast("string")).alias("value"), F.col("event_id").cast("double").alias("created"))
    path = shared_dir(spark)
    for third in range(3):
        S.cache_upsert(e.filter(F.col("created").cast("long") % 3 == third), path, 16, 2)
    cache = S.cache_read(spark, path)
    users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("query")).distinct().unionByName(spark.createDataFrame([("nobody",)], "query string"))
    return R.cache_lookup(users, cache, "web").select("query", "value")


CACHE = """
WITH e AS (SELECT user_id::VARCHAR AS query, max_by(event_id::VARCHAR, event_id) FILTER (event_type <> 'error') AS value FROM events GROUP BY 1)
SELECT query, value FROM e UNION ALL SELECT 'nobody', NULL
"""


def source_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums of files: all items as text in five files."""
    path = shared_dir(spark)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("value"), F.pmod("item_id", F.lit(5)).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "item_id").drop("item_id").write.partitionBy("part").text(path)
    found = R.checksums(spark, f"{path}/part=*/*.txt")
    return found.select(F.regexp_extract("path", r"part=([0-9])/", 1).cast("int").alias("part"), "length", "sha256")


CHECKSUMS = """
WITH f AS (SELECT (item_id % 5)::INT AS part, encode(string_agg(coalesce(text, ''), chr(10) ORDER BY item_id) || chr(10)) AS t FROM benchmark GROUP BY 1) SELECT part, octet_length(t)::BIGINT AS length, sha256(t) AS sha256 FROM f
"""


def sink_error_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    S.table_csv(_own(spark, sf_dir).select("doc_id", "title", F.length("text").alias("n")), path, "doc_id")
    return spark.read.options(header=True, escape='"').schema("doc_id long, title string, n int").csv(path)


ERRORS_CSV = f"WITH {_OWN} SELECT doc_id, title, length(text)::INT AS n FROM o"


def sink_config_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of some thresholds, of which the last one counts."""
    path = shared_dir(spark)
    nations = table(spark, sf_dir, "nation")
    for v in range(3):
        S.config_version(nations.filter(F.col("n_nationkey") % 3 >= v).select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 100.0 * v).alias("value")), path, v)
    return S.latest_config(spark, path)


CONFIGS = "SELECT n_name AS name, n_nationkey + 100.0::DOUBLE * (n_nationkey % 3) AS value FROM nation"


QUERIES = {f.__name__: f for f in (source_numbered_news, source_paired_news, source_six_way_statements, source_claim_lines, source_gold_evidence, source_tweeted_news, sink_corpus, sink_split_csv, sink_json_log, sink_cache, sink_error_csv, sink_config_versions, source_checksums)}
ORACLES = {
    "source_numbered_news": NUMBERED, "source_paired_news": PAIRED, "source_six_way_statements": SIX_WAY, "source_claim_lines": LINES, "source_gold_evidence": GOLD, "source_tweeted_news": TWEETED,
    "sink_corpus": CORPUS, "sink_split_csv": SPLITS, "sink_json_log": LOG, "sink_cache": CACHE, "sink_error_csv": ERRORS_CSV, "sink_config_versions": CONFIGS, "source_checksums": CHECKSUMS,
}
