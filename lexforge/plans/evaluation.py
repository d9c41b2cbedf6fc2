"""Registered queries of evaluation sets, runs and reports, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.functions import html as H
from lexforge.functions import scorers as C
from lexforge.functions import text as X
from lexforge.functions.dates import FORMATS, parse_date, years_named
from lexforge.operators import features as T
from lexforge.operators import orderstats as O
from lexforge.operators import reports as P
from lexforge.operators import serving as S
from lexforge.operators import verify as V
from lexforge.plans import engine
from lexforge.plans.preparation import _LETTERS
from lexforge.plans.serving import _LABELLED, _WORDS, _labelled
from lexforge.session import table
from lexforge.sources import readers as R
from lexforge.sources import sinks
from lexforge.storage import scratch, shared_dir

VERDICTS = ["REAL", "FAKE", "MISLEADING", "PARTIALLY TRUE", "UNVERIFIABLE"]
_VERDICTS = ", ".join(f"'{x}'" for x in VERDICTS)


def _verdict(c):
    return F.element_at(F.array(*map(F.lit, VERDICTS)), (c % 5 + 1).cast("int"))


def live_claim_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of claims as a CSV file with faults in it, read and checked: how many rows break each rule."""
    i, path = F.col("doc_id"), shared_dir(spark)
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    broken = lambda n, good, bad: F.when(i % n == 0, bad).otherwise(good)
    rows = table(spark, sf_dir, "documents").select(
        text("LC", F.when(i % 97 == 0, 0).otherwise(i)).alias("id"), text("Claim ", i).alias("claim"), F.lit("False").alias("original_rating"), broken(11, _verdict(i), F.lit("MAYBE")).alias("label"), broken(13, F.lit("p"), F.lit("")).alias("publisher"),
        text(broken(17, F.lit("https://f/"), F.lit("http://f/")), i).alias("factcheck_url"), broken(19, F.lit("2024-02-29"), F.lit("2023-02-29")).alias("factcheck_date"), broken(23, F.lit(""), F.lit("1 May 2024")).alias("claim_date"), F.lit("").alias("claimant"),
        F.lit("").alias("context"), broken(29, F.lit("headline"), F.lit("tweet")).alias("input_type"), F.lit("text").alias("modality"), broken(3, F.lit("eval"), F.lit("dev")).alias("split"), F.lit("").alias("notes"),
    )
    rows.write.options(header=True).csv(path)
    found = R.live_claim_violations(R.live_claims(spark, path))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


LIVE = """
WITH r AS (SELECT count(*) FILTER (doc_id % 11 = 0) AS label_known, count(*) FILTER (doc_id % 13 = 0) AS publisher_filled, count(*) FILTER (doc_id % 17 = 0) AS https, count(*) FILTER (doc_id % 19 = 0) AS factcheck_date_iso,
  count(*) FILTER (doc_id % 23 = 0) AS claim_date_iso, count(*) FILTER (doc_id % 29 = 0) AS input_type_known, (count(*) FILTER (doc_id % 97 = 0) > 1)::BIGINT AS unique_id FROM documents)
SELECT rule, n FROM (UNPIVOT r ON COLUMNS(*) INTO NAME rule VALUE n) WHERE n > 0
"""


def dates_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in each of the formats, and as nonsense, and read again; years that a text names; cues of recency."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("d"))
    k = F.pmod("o_orderkey", F.lit(len(FORMATS) + 2))
    written = F.when(k == len(FORMATS), F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss")).when(k == len(FORMATS) + 1, F.concat(F.lit("about "), F.date_format("d", "yyyy")))
    for j, f in enumerate(FORMATS):
        written = written.when(k == j, F.date_format("d", f))
    named = F.concat(F.lit("In "), F.date_format("d", "yyyy"), F.lit(" and 3000, not "), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, ", Breaking: today").otherwise(", yesterdays"))
    own = o.select("o_orderkey", written.alias("w"), named.alias("t"))
    return own.select("o_orderkey", parse_date(F.col("w")).cast("string").alias("parsed"), F.array_join(F.transform(years_named(F.col("t")), lambda d: d.cast("string")), ",").alias("years"), X.has_recency_cue(F.col("t")).alias("recent"))


_CUES = "|".join(X.RECENCY_CUES).replace("'", "''")
DATES = rf"""
WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % {len(FORMATS) + 2} AS k, 'In ' || year(o_orderdate) || ' and 3000, not ' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ', Breaking: today' ELSE ', yesterdays' END AS t FROM orders),
y AS (SELECT o_orderkey, string_agg(y || '-07-01', ',' ORDER BY y) AS years FROM (SELECT DISTINCT o_orderkey, unnest(regexp_extract_all(t, '\b((?:19|20)[0-9][0-9])\b', 1)) AS y FROM o) GROUP BY 1)
SELECT o_orderkey, CASE WHEN k < {len(FORMATS) + 1} THEN d::VARCHAR END AS parsed, coalesce(years, '') AS years, regexp_matches(t, '(?i)\b({_CUES})\b') AS recent FROM o LEFT JOIN y USING (o_orderkey)
"""


def scale_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers on scales as true, false or mixed; scales without a range and values that are no number are passed over."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    value, low, high = F.when(k % 9 == 0, "n/a").otherwise((k % 11).cast("string")), F.lit("0"), F.when(k % 7 == 0, "0").otherwise("10")
    return e.select("event_id", H.rating_on_scale(value, low, high).alias("rating"))


SCALES = """
SELECT event_id, CASE WHEN k % 9 = 0 OR k % 7 = 0 THEN NULL WHEN k % 11 >= 8 THEN 'true' WHEN k % 11 <= 2 THEN 'false' ELSE 'mixed' END AS rating FROM (SELECT event_id, (props->>'$.k')::INT AS k FROM events)
"""


def stance_of_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of three logits, the most probable stance, of equals the first, and its probability."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    z = [(k % m).cast("double") / 4 for m in (5, 7, 9)]
    p = V.softmax(F.array(*z))
    own = e.select("event_id", p.alias("p"))
    parts = [F.get("p", F.lit(j)) for j in range(3)]
    return own.select("event_id", V.argmax_stance(*parts).alias("stance"), F.round(F.greatest(*parts), 6).alias("p"))


LOGITS = """
WITH z AS (SELECT event_id, (k % 5) / 4.0::DOUBLE AS a, (k % 7) / 4.0::DOUBLE AS b, (k % 9) / 4.0::DOUBLE AS c FROM (SELECT event_id, (props->>'$.k')::INT AS k FROM events))
SELECT event_id, CASE WHEN a >= b AND a >= c THEN 'SUPPORTS' WHEN b >= c THEN 'REFUTES' ELSE 'NEUTRAL' END AS stance, round(exp(greatest(a, b, c)) / (exp(a) + exp(b) + exp(c)), 6) AS p FROM z
"""


def agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two labellers' lists hold: how many labels count, who is left out, who disagrees, and the agreement beyond chance."""
    d = table(spark, sf_dir, "documents")
    gold = d.select(F.col("doc_id").cast("string").alias("id"), _verdict(F.col("doc_id")).alias("label"))
    i = F.col("doc_id")
    second = d.filter("doc_id % 4 <> 3").select(i.cast("string").alias("id"), F.when(i % 10 == 0, "  ").when(i % 10 == 1, "unreadable").when(i % 10 == 2, F.lower(_verdict(i + 1))).otherwise(F.concat(F.lit(" "), _verdict(i))).alias("label2"))
    found = P.agreement(gold, second, VERDICTS)
    return found.select("kind", "name", F.round("value", 6).alias("value"), "ids")


AGREEMENT = f"""
WITH b AS (SELECT doc_id::VARCHAR AS id, [{_VERDICTS}][doc_id % 5 + 1] AS a, CASE WHEN doc_id % 10 IN (0, 1) THEN NULL WHEN doc_id % 10 = 2 THEN [{_VERDICTS}][(doc_id + 1) % 5 + 1] ELSE [{_VERDICTS}][doc_id % 5 + 1] END AS b FROM documents WHERE doc_id % 4 <> 3),
u AS (SELECT * FROM b WHERE b IS NOT NULL), c AS (SELECT unnest([{_VERDICTS}]) AS c), t AS (SELECT c, (SELECT count(*) FROM u WHERE a = c) AS x, (SELECT count(*) FROM u WHERE b = c) AS y, (SELECT count(*) FROM u WHERE a = c AND b = c) AS h FROM c),
n AS (SELECT count(*)::DOUBLE AS n, avg((a = b)::INT) AS raw FROM u), e AS (SELECT sum(x * y) / (SELECT n * n FROM n) AS e FROM t)
SELECT 'summary' AS kind, 'used' AS name, n AS value, NULL::VARCHAR AS ids FROM n UNION ALL SELECT 'summary', 'raw', round(raw, 6), NULL FROM n UNION ALL SELECT 'summary', 'kappa', round((raw - e) / (1 - e), 6), NULL FROM n, e
UNION ALL SELECT 'class', c, round(2 * h / nullif(x + y, 0)::DOUBLE, 6), NULL FROM t
UNION ALL SELECT 'excluded', NULL, count(*)::DOUBLE, string_agg(id, ',' ORDER BY id) FROM b WHERE b IS NULL UNION ALL SELECT 'disagreement', a || ' / ' || b, count(*)::DOUBLE, string_agg(id, ',' ORDER BY id) FROM u WHERE a <> b GROUP BY a, b
"""


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency of runs by mode (median, 90th percentile, share of runs without a miss), and a first version of each beside a second."""
    e = table(spark, sf_dir, "events")
    ms = (F.col("value") * 1000).cast("long")
    first = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("mode"), ms.alias("wall_ms"), (F.col("event_id") % 3).alias("misses"))
    second = e.filter("event_id % 10 <> 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("mode"), (ms / 2 + F.col("event_id") % 100).cast("long").alias("wall_ms"), F.lit(0).cast("long").alias("misses"))
    return P.run_report(first, second)


RUNS = """
WITH a AS (SELECT event_id AS id, event_type AS mode, trunc(value * 1000)::BIGINT AS ms, event_id % 3 AS misses FROM events), b AS (SELECT id, mode, trunc(ms / 2.0::DOUBLE + id % 100)::BIGINT AS ms, 0 AS misses FROM a WHERE id % 10 <> 0),
s AS (SELECT 'v1' AS version, * FROM a UNION ALL SELECT 'v2', * FROM b),
l AS (SELECT version, mode, count(*) AS n, round(quantile_cont(ms, 0.5), 4) AS median_ms, round(quantile_cont(ms, 0.9), 4) AS p90_ms, round(avg((misses = 0)::INT), 6) AS warm FROM s GROUP BY ALL),
d AS (SELECT a.mode, count(*) FILTER (b.ms < a.ms) AS faster, count(*) FILTER (b.id IS NULL) AS missing FROM a LEFT JOIN b ON a.id = b.id AND a.mode = b.mode GROUP BY 1)
SELECT version, mode, n, median_ms, p90_ms, warm, faster, missing FROM l JOIN d USING (mode)
"""


def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten surest mistakes of a model in either direction on the held-out fifth."""
    own = _labelled(spark, sf_dir, likely=True)
    with scratch():  # what the model is made of goes once the model is saved
        weights, intercept = S.naive_bayes_linear(T.term_lists(own.filter("doc_id % 5 <> 0"), "doc_id", "text", 1, ("label",)), ["real", "fake"])
        model = S.saved(spark, weights, intercept, ["real", "fake"])
    test = own.filter("doc_id % 5 = 0").select("doc_id", "label", "text")
    p = S.batch_scores(test, "doc_id", "text", model, "fake").withColumnRenamed("key", "doc_id")
    return P.top_errors(test.join(p, "doc_id").withColumn("p", F.round("p", 6)), "doc_id", "label", "p", 10)


_WORDS_OF = _WORDS.replace("lower(t)", "lower(coalesce(text, ''))")
TOP_ERRORS = f"""
WITH {_LABELLED}, w AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_WORDS_OF} FROM documents) GROUP BY ALL), t AS (SELECT * FROM l WHERE doc_id % 5 <> 0),
c AS (SELECT label, term, sum(tf) AS c FROM w JOIN t USING (doc_id) GROUP BY ALL), v AS (SELECT DISTINCT term FROM c),
b AS (SELECT label, ln(m / sum(m) OVER ()::DOUBLE) AS prior, total + (SELECT count(*) FROM v) AS denom FROM (SELECT label, count(*) AS m FROM t GROUP BY 1) JOIN (SELECT label, sum(c) AS total FROM c GROUP BY 1) USING (label)),
k AS (SELECT term, sum(CASE b.label WHEN 'fake' THEN 1 ELSE -1 END * ln((coalesce(c, 0) + 1) / denom::DOUBLE)) AS weight FROM v CROSS JOIN b LEFT JOIN c USING (label, term) GROUP BY term),
z AS (SELECT doc_id, sum(tf * weight) AS z FROM w JOIN k USING (term) GROUP BY 1),
p AS (SELECT doc_id, label, round(1 / (1 + exp(-greatest(least((SELECT sum(CASE label WHEN 'fake' THEN prior ELSE -prior END) FROM b) + coalesce(z, 0), 700), -700))), 6) AS p FROM l LEFT JOIN z USING (doc_id) WHERE doc_id % 5 = 0),
e AS (SELECT doc_id, label AS gold, CASE WHEN p >= 0.5 THEN 'fake' ELSE 'real' END AS pred, p FROM p)
SELECT gold, pred, row_number() OVER (PARTITION BY gold ORDER BY round(abs(p - 0.5), 6) DESC, doc_id) AS rank, doc_id, p FROM e WHERE gold <> pred QUALIFY rank <= 10
"""


def title_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of titles (first lines) by class of which half the letters or more are capitals."""
    own = _labelled(spark, sf_dir).select("label", F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), _LETTERS, "x").alias("title"))
    caps = X.mostly_capitals(F.col("title"))
    return own.groupBy("label").agg(F.count("*").alias("n"), F.count_if(caps).alias("shouted"), F.round(F.avg(X.capital_share(F.col("title"))), 6).alias("mean_share"))


CAPITALS = f"""
WITH {_LABELLED}, t AS (SELECT label, regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '{_LETTERS}', 'x', 'g') AS t FROM l JOIN documents USING (doc_id)),
c AS (SELECT label, len(regexp_extract_all(t, '[A-Z]')) AS u, len(regexp_extract_all(t, '[A-Za-z]')) AS a FROM t)
SELECT label, count(*) AS n, count(*) FILTER (a > 0 AND 2 * u >= a) AS shouted, round(avg(u / greatest(a, 1)::DOUBLE), 6) AS mean_share FROM c GROUP BY 1
"""


def telling_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms by class without function words, numbers and words of two letters or fewer."""
    words = X.telling(X.word_tokens(F.col("text")))
    rows = _labelled(spark, sf_dir).select("label", F.explode(words).alias("term")).groupBy("label", "term").agg(F.count("*").alias("n"))
    order = W.Window.partitionBy("label").orderBy(F.col("n").desc(), "term")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 20")


_STOPS = ", ".join(f"'{x}'" for x in X.STOPWORDS)
TELLING = rf"""
WITH {_LABELLED}, t AS (SELECT label, {_WORDS_OF} FROM l JOIN documents USING (doc_id)), c AS (SELECT label, term, count(*) AS n FROM t WHERE term NOT IN ({_STOPS}) AND length(term) > 2 AND NOT regexp_matches(term, '^[0-9_]+$') GROUP BY ALL)
SELECT label, term, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS rank FROM c QUALIFY rank <= 20
"""


def factcheck_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a fact-check service as nested JSON lines: the first review of each claim, its date cut to the day."""
    path, i = shared_dir(spark), F.col("item_id")
    review = lambda k: F.struct(F.struct(F.concat(F.lit("p"), ((i + k) % 3).cast("string")).alias("name")).alias("publisher"), F.concat(F.lit("https://x/"), (i * 10 + k).cast("string")).alias("url"), F.lit("2024-03-05T10:00:00Z").alias("reviewDate"), F.when((i + k) % 2 == 0, "False").otherwise("True").alias("textualRating"))
    claim = lambda k: F.struct(F.concat(F.lit(f"{k} "), F.substring("text", 1, 20)).alias("text"), F.when((i + k) % 4 == 0, F.array(review(k)).cast(f"array<{R.REVIEW}>")).when((i + k) % 4 == 1, F.slice(F.array(review(k)), 1, 0)).otherwise(F.array(review(k), review(k + 1))).alias("claimReview"))
    table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), i.cast("string")).alias("query"), F.array(claim(0), claim(1)).alias("claims")).write.json(path)
    return R.factcheck_answers(spark, path)


ANSWERS = """
WITH c AS (SELECT 'q' || item_id AS query, item_id AS i, k, k || ' ' || text[1:20] AS claim FROM benchmark, (VALUES (0), (1)) AS v(k))
SELECT query, k + 1 AS claim_no, claim, 'p' || (i + k) % 3 AS publisher, 'https://x/' || (i * 10 + k) AS url, '2024-03-05' AS date, CASE WHEN (i + k) % 2 = 0 THEN 'False' ELSE 'True' END AS rating FROM c WHERE (i + k) % 4 <> 1
"""


def published_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a page says that it was published, in one of four places, of which the first in this order counts."""
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    i = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (i % 1000).cast("int")), "yyyy-MM-dd")
    put = F.when(i % 5 == 0, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T08:00:00Z"/>'))).when(i % 5 == 1, F.concat(F.lit("<meta content='"), day, F.lit("' name='date'>")))
    put = put.when(i % 5 == 2, F.concat(F.lit('<script type="application/ld+json">{"datePublished": "'), day, F.lit('T01:00"}</script><time datetime="2001-01-01">'))).when(i % 5 == 3, F.concat(F.lit('<time class="x" datetime="'), day, F.lit('">then</time>'))).otherwise("")
    return p.select("page_id", H.published(F.concat(put, "html")).cast("string").alias("published"))


PUBLISHED = "SELECT page_id, CASE WHEN page_id % 5 < 4 THEN (DATE '2020-01-01' + (page_id % 1000)::INT)::VARCHAR END AS published FROM pages"


def claim_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews in pages' structured data: plain, in a graph with a scale, nested, broken, of two blobs, and none."""
    i = F.col("page_id")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    blob = lambda *x: text('<script type="application/ld+json">', *x, "</script>")
    plain = blob('{"@type": "ClaimReview", "claimReviewed": " Claim ', i, ' ", "datePublished": "2024-03-05T10:00", "reviewRating": {"alternateName": "Mostly false", "ratingValue": 2}}')
    graph = blob('{"@graph": [{"@type": "WebPage"}, {"@type": ["Thing", "ClaimReview"], "claimReviewed": ["Graph ', i, '"], "reviewRating": {"ratingValue": ', i % 11, ', "worstRating": "0", "bestRating": 10}}]}')
    nested = blob('{"@type": "NewsArticle", "mainEntity": {"parts": [{"@type": "ClaimReview", "claimReviewed": "Deep ', i, '", "datePublished": "2023-01-02", "reviewRating": [{"name": "True"}]}]}}')
    put = F.when(i % 6 == 0, plain).when(i % 6 == 1, graph).when(i % 6 == 2, nested).when(i % 6 == 3, blob('{"@type": "ClaimReview", ')).when(i % 6 == 4, F.concat(plain, nested)).otherwise("")
    r = H.review(F.concat(F.coalesce("html", F.lit("")), put))
    return table(spark, sf_dir, "pages").select("page_id", r.alias("r")).select("page_id", "r.claim_reviewed", "r.rating", "r.date")


REVIEWS = """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Claim ' || page_id WHEN 1 THEN 'Graph ' || page_id WHEN 2 THEN 'Deep ' || page_id WHEN 4 THEN 'Deep ' || page_id END AS claim_reviewed,
  CASE page_id % 6 WHEN 0 THEN 'Mostly false' WHEN 1 THEN CASE WHEN page_id % 11 >= 8 THEN 'true' WHEN page_id % 11 <= 2 THEN 'false' ELSE 'mixed' END WHEN 2 THEN 'True' WHEN 4 THEN 'True' END AS rating,
  CASE page_id % 6 WHEN 0 THEN '2024-03-05' WHEN 2 THEN '2023-01-02' WHEN 4 THEN '2023-01-02' END AS date FROM pages
"""


def settings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from a file of "name: value" lines with comments and a section, over the built-in ones."""
    path = shared_dir(spark)
    own = table(spark, sf_dir, "region").select(F.concat(F.lit("  r_"), F.lower(F.translate("r_name", " ", "_")), F.lit(": "), (F.col("r_regionkey") / 4).cast("string"), F.lit("   # a comment")).alias("value"))
    lines = spark.createDataFrame([("# settings",), ("fusion:",), ("  tau: 0.7",), ("  min_evidence: 2",), ("",)], "value string").unionByName(own)
    lines.coalesce(1).write.text(path)
    return R.settings(spark, path).withColumn("value", F.col("value").try_cast("double"))


SETTINGS = """
SELECT 'fusion.tau' AS name, 0.7::DOUBLE AS value UNION ALL SELECT 'fusion.min_evidence', 2 UNION ALL SELECT 'fusion.r_' || lower(replace(r_name, ' ', '_')), r_regionkey / 4.0::DOUBLE FROM region
"""


def json_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON logs, one a language, read with the names of their files."""
    path = shared_dir(spark)
    table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("model", F.col("lang")).write.partitionBy("model").json(path)
    found = R.logs(spark, f"{path}/model=*", "lang string, n long")
    return found.select("lang", "n", F.regexp_extract("file", "model=([a-z]+)/", 1).alias("folder"))


LOGS = "SELECT lang, count(*) AS n, lang AS folder FROM documents GROUP BY lang"


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of figures about a corpus: sizes, classes, lengths, calendar of what is there, each with its name and what it says."""
    own = _labelled(spark, sf_dir)
    return P.summary(own.withColumn("n", X.n_tokens(F.col("text"))), "label", "source", "n")


SUMMARY = rf"""
WITH {_LABELLED}, d AS (SELECT label, l.source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+')) AS n FROM l JOIN documents USING (doc_id))
SELECT 'rows' AS figure, 'all' AS name, count(*)::DOUBLE AS value FROM d UNION ALL SELECT 'share', label, round(count(*) / (SELECT count(*) FROM d)::DOUBLE, 6) FROM d GROUP BY label
UNION ALL SELECT 'mean length', label, round(avg(n), 6) FROM d GROUP BY label UNION ALL SELECT 'median length', label, round(quantile_cont(n, 0.5), 6) FROM d GROUP BY label
UNION ALL SELECT 'sources', label, count(DISTINCT source) FROM d GROUP BY label UNION ALL SELECT 'single-class sources', 'all', count(*) FROM (SELECT source FROM d GROUP BY source HAVING count(DISTINCT label) = 1)
"""

def headline_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the text below a document's first line refutes that line."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), _LETTERS, "x")
    title = F.split_part(text, F.lit("\n"), F.lit(1))
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("input_id"), F.concat(title, F.when(F.col("doc_id") % 3 == 0, " never").otherwise("")).alias("title"), text.alias("text"))
    found = engine.headline_mismatch(own)
    return found.select(F.col("input_id").alias("doc_id"), "mismatch_headline", "mismatch_p")


_NEGATIONS = ", ".join(f"'{x}'" for x in C.NEGATIONS)
_DISTINCT = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}'))"
_CONTENT = f"list_filter({{}}, lambda x: x NOT IN ({_STOPS}, {_NEGATIONS}))"
MISMATCH = f"""
WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_LETTERS}', 'x', 'g') AS t FROM documents), y AS (SELECT doc_id, trim(string_split(t, chr(10))[1] || CASE WHEN doc_id % 3 = 0 THEN ' never' ELSE '' END, ' ') AS title, trim(t, ' ') AS body FROM x),
w AS (SELECT doc_id, title, body, {_DISTINCT.format('body[1:2000]')} AS p, {_DISTINCT.format('title')} AS c FROM y WHERE title <> '' AND body <> ''),
s AS (SELECT *, CASE WHEN len({_CONTENT.format('c')}) = 0 THEN 0 ELSE len(list_intersect({_CONTENT.format('p')}, {_CONTENT.format('c')})) / len({_CONTENT.format('c')})::DOUBLE END AS share,
  (len(list_filter(p, lambda x: x IN ({_NEGATIONS}))) > 0) <> (len(list_filter(c, lambda x: x IN ({_NEGATIONS}))) > 0) AS turned FROM w),
z AS (SELECT *, CASE WHEN share >= 0.5 THEN share * 0.9::DOUBLE ELSE share * 0.4::DOUBLE END AS sides FROM s), r AS (SELECT *, turned AND sides > 0.05 AND sides >= greatest(0.95::DOUBLE - sides, 0) AND title <> body AS refuted FROM z)
SELECT doc_id, refuted AND sides >= {V.Fusion().mismatch_p} AS mismatch_headline, CASE WHEN refuted THEN round(sides, 4) END AS mismatch_p FROM r
"""

QUERIES = {f.__name__: f for f in (live_claim_faults, dates_read, scale_ratings, stance_of_logits, agreement_report, run_report, top_errors, title_capitals, telling_terms, factcheck_answers, published_dates, settings_file, json_logs, corpus_summary, headline_mismatches, claim_reviews)}
ORACLES = {
    "live_claim_faults": LIVE, "dates_read": DATES, "scale_ratings": SCALES, "stance_of_logits": LOGITS, "agreement_report": AGREEMENT, "run_report": RUNS, "top_errors": TOP_ERRORS, "title_capitals": CAPITALS, "telling_terms": TELLING,
    "factcheck_answers": ANSWERS, "published_dates": PUBLISHED, "settings_file": SETTINGS, "json_logs": LOGS, "corpus_summary": SUMMARY, "headline_mismatches": MISMATCH, "claim_reviews": REVIEWS,
}
