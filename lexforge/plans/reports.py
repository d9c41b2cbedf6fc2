"""Registered queries of smaller reports and inputs: model and search inputs, group filters, shares, dates, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as X
from lexforge.operators import prep as P
from lexforge.operators import sentences as N
from lexforge.plans.analysis import _L, _N, _PRED, _TOK, _docs, _labelled, _predicted
from lexforge.plans.preparation import _KEY, _SPLIT, stratified_split
from lexforge.session import table

_TRIM = r"regexp_replace({0}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"
_STOP = ", ".join(f"'{x}'" for x in X.STOPWORDS)


def _body() -> Column:
    return F.coalesce("text", F.lit(""))


def classifier_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title (the first line) and text in one."""
    both = X.model_input(F.split_part(_body(), F.lit("\n"), F.lit(1)), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha1(both).alias("sha1"), F.length(both).cast("long").alias("n_chars"))


_INPUT = _TRIM.format(_TRIM.format("split_part(coalesce(text, ''), chr(10), 1)") + " || chr(10) || coalesce(text, '')")
INPUT = f"SELECT doc_id, sha1({_INPUT}) AS sha1, length({_INPUT})::BIGINT AS n_chars FROM documents"


def id_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with a prefix back to numbers; what is no number is null."""
    ids = _docs(spark, sf_dir).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"))
    return ids.unionByName(table(spark, sf_dir, "labels").select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("id"))).select("id", F.regexp_replace("id", "^doc_", "").try_cast("int").alias("number"))


NUMBERS = "SELECT id, try_cast(regexp_replace(id, '^doc_', '') AS INT) AS number FROM (SELECT 'doc_' || doc_id AS id FROM documents UNION ALL SELECT 'x' || doc_id FROM labels)"


def quotable_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.quotable_sentences(_body())
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), F.sha1(F.array_join(s, "|")).alias("digest"))


SENTENCES = rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''),
  lambda x: {_TRIM.format("x")}), lambda x: length(x) BETWEEN {X.SENTENCE_LEAST} AND {X.SENTENCE_MOST})[1:{X.SENTENCES}] AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n, sha1(array_to_string(s, '|')) AS digest FROM s
"""


def date_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last and median date and the number of dated rows of each class; rows without a date go."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("d")).dropna(subset=["d"])
    day = F.unix_date("d")
    middle = F.date_from_unix_date(F.percentile(day, F.lit(0.5)).cast("int"))
    return o.groupBy("o_orderstatus").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("n"), middle.alias("median"))


DATES = "SELECT o_orderstatus, min(d) AS first, max(d) AS last, count(*) AS n, DATE '1970-01-01' + floor(quantile_cont(d - DATE '1970-01-01', 0.5))::INT AS median FROM (SELECT o_orderstatus, o_orderdate::DATE AS d FROM orders) WHERE d IS NOT NULL GROUP BY 1"


def yearly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by year, a column for each class."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus")
    return o.groupBy("year").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0).select("year", *[F.col(c).alias(f"n_{c.lower()}") for c in "FOP"])


YEARLY = "SELECT year(o_orderdate)::INT AS year, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1"


def large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of languages with at least 150 of them, by source."""
    d = _docs(spark, sf_dir)
    kept = d.groupBy("lang").agg(F.count("*").alias("n")).filter("n >= 150").select("lang")
    return d.join(kept, "lang", "left_semi").groupBy("source", "lang").agg(F.count("*").alias("n"))


LARGE = "SELECT source, lang, count(*) AS n FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) >= 150) GROUP BY ALL"


def numbers_per_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers a thousand tokens of each language: a ratio of sums, not a mean of ratios."""
    own = _docs(spark, sf_dir).select("lang", F.regexp_count(_body(), F.lit("[0-9]+")).alias("x"), X.n_tokens(_body()).alias("n"))
    return own.groupBy("lang").agg(F.round(F.try_divide(F.sum("x") * 1000, F.sum("n")), 6).alias("rate"))


RATE = f"SELECT lang, round(sum(x) * 1000 / nullif(sum(n), 0)::DOUBLE, 6) AS rate FROM (SELECT lang, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS x, {_N} AS n FROM documents) GROUP BY 1"


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count_distinct("text").alias("texts"), F.count("*").alias("n"))


DISTINCT = "SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts, count(*) AS n FROM documents GROUP BY 1"


def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of customers with an order at all, and with one that is done, by segment: whether a run found evidence."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("done"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.groupBy("c_mktsegment").agg(F.round(F.avg(F.col("done").isNotNull().cast("int")), 6).alias("any_order"), F.round(F.avg((F.coalesce("done", F.lit(0)) == 1).cast("int")), 6).alias("done_order"))


COVERAGE = "SELECT c_mktsegment, round(avg((done IS NOT NULL)::INT), 6) AS any_order, round(avg(coalesce(done, 0)), 6) AS done_order FROM customer LEFT JOIN (SELECT o_custkey, max((o_orderstatus = 'F')::INT) AS done FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1"


def why_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents that the flag missed, by the first reason that holds."""
    own = _predicted(spark, sf_dir).filter("toxic = 1 AND pred <> 'fake'").join(_docs(spark, sf_dir).select("doc_id", "text", "lang"), "doc_id")
    n = X.n_tokens(_body())
    reason = F.when(n == 0, "no text").when(F.col("lang") != "en", "other language").when(n < 20, "short").when(F.col("p") < 0.5, "low score").otherwise("rule")
    return own.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


MISSED = f"WITH {_PRED}, d AS (SELECT p, lang, {_N} AS n FROM m JOIN documents USING (doc_id) WHERE toxic = 1 AND pred <> 'fake') SELECT CASE WHEN n = 0 THEN 'no text' WHEN lang <> 'en' THEN 'other language' WHEN n < 20 THEN 'short' WHEN p < 0.5 THEN 'low score' ELSE 'rule' END AS reason, count(*) AS n FROM d GROUP BY 1"


def single_class_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources have labelled documents, and the share of those with one class only."""
    own = _labelled(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("label") == "fake").alias("f"), F.count_if(F.col("label") == "real").alias("r"))
    return own.agg(F.count("*").alias("sources"), F.round(F.avg((F.least("f", "r") == 0).cast("int")), 6).alias("one_class"))


ONE_CLASS = f"WITH {_L}, c AS (SELECT source, count(*) FILTER (label = 'fake') AS f, count(*) FILTER (label = 'real') AS r FROM l GROUP BY 1) SELECT count(*) AS sources, round(avg((least(f, r) = 0)::INT), 6) AS one_class FROM c"


def raw_texts_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed rows with the raw title and text in place of their own, by id; ids without raw rows keep null."""
    done = table(spark, sf_dir, "labels").select("doc_id", "quality")
    raw = _docs(spark, sf_dir).filter("lang <> 'de'").select("doc_id", F.split_part(_body(), F.lit("\n"), F.lit(1)).alias("title"), "text")
    return done.join(raw, "doc_id", "left").select("doc_id", "quality", F.sha1("title").alias("title_sha1"), F.sha1("text").alias("text_sha1"))


RAW = "SELECT doc_id, quality, sha1(split_part(coalesce(text, ''), chr(10), 1)) AS title_sha1, sha1(text) AS text_sha1 FROM labels LEFT JOIN (SELECT * FROM documents WHERE lang <> 'de') USING (doc_id)"
RAW = RAW.replace("sha1(split_part(coalesce(text, ''), chr(10), 1))", "CASE WHEN lang IS NULL THEN NULL ELSE sha1(split_part(coalesce(text, ''), chr(10), 1)) END")


def leak_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bigrams of the corpus that hold a leak word, with their counts."""
    grams = X.let(X.word_tokens(_body()), lambda w: X.ngrams(w, 2))
    return _docs(spark, sf_dir).select(F.explode(grams).alias("term")).groupBy("term").agg(F.count("*").alias("n")).filter(X.leaks(F.col("term")))


LEAKS = f"WITH w AS (SELECT {_TOK.replace('text', 'coalesce(text, ' + chr(39) * 2 + ')')} AS w FROM documents), g AS (SELECT w[i] || ' ' || w[i + 1] AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)) SELECT term, count(*) AS n FROM g WHERE list_has_any(string_split(term, ' '), [{', '.join(f'{chr(39)}{x}{chr(39)}' for x in X.LEAK_WORDS)}]) GROUP BY 1"


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What search engines would be asked about a document: its first fifteen words, and its content words."""
    return _docs(spark, sf_dir).select("doc_id", X.first_words(_body()).alias("first_words"), F.sha1(X.keyword_query(_body())).alias("keywords_sha1"))


_WORDS = f"list_filter({_TOK.replace('text', 'coalesce(text, ' + chr(39) * 2 + ')')}, lambda x: x NOT IN ({_STOP}))"
QUERIES_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
d AS (SELECT doc_id, text, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM w)
SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')[1:15], ' ') AS first_words, sha1(CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE text END) AS keywords_sha1 FROM d
"""


def string_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitals, contains, prefix and slices of the texts, by language."""
    b = _body()
    flags = {"shouts": b.rlike(r"[A-Z]{5}"), "has_token": F.contains(b, F.lit("token")), "the_first": b.startswith("The "), "long": F.length(b) > 2000, "lower_head": F.substring(b, 1, 10) == F.lower(F.substring(b, 1, 10))}
    return _docs(spark, sf_dir).groupBy("lang").agg(*[F.count_if(c).alias(k) for k, c in flags.items()])


PREDICATES = "SELECT lang, count(*) FILTER (regexp_matches(b, '[A-Z]{5}')) AS shouts, count(*) FILTER (contains(b, 'token')) AS has_token, count(*) FILTER (starts_with(b, 'The ')) AS the_first, count(*) FILTER (length(b) > 2000) AS long, count(*) FILTER (b[1:10] = lower(b[1:10])) AS lower_head FROM (SELECT lang, coalesce(text, '') AS b FROM documents) GROUP BY 1"


def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many word pairs a text has, and how many distinct ones."""
    pairs = X.ngrams(X.word_tokens(_body()), 2)
    return _docs(spark, sf_dir).select("doc_id", F.size(pairs).cast("long").alias("n"), F.size(F.array_distinct(pairs)).cast("long").alias("n_distinct"))


PAIRS = f"WITH w AS (SELECT doc_id, {_TOK.replace('text', 'coalesce(text, ' + chr(39) * 2 + ')')} AS w FROM documents), p AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM w) SELECT doc_id, len(p)::BIGINT AS n, len(list_distinct(p))::BIGINT AS n_distinct FROM p"


def stratified_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred labelled documents that keep the classes' shares."""
    return P.stratified_subset(_labelled(spark, sf_dir).select("doc_id", "label"), "label", "doc_id", 100)


SUBSET = """
WITH l AS (SELECT doc_id, CASE quality WHEN 1 THEN 'real' ELSE 'fake' END AS label FROM labels JOIN documents USING (doc_id)), c AS (SELECT label, count(*) AS m, sum(count(*)) OVER () AS t FROM l GROUP BY 1),
q AS (SELECT label, least(100, t) * m // t + CASE WHEN row_number() OVER (ORDER BY least(100, t) * m % t DESC, label) <= least(100, t) - sum(least(100, t) * m // t) OVER () THEN 1 ELSE 0 END AS k FROM c)
SELECT doc_id, l.label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1(doc_id || ':42'), doc_id) AS r FROM l) l JOIN q ON q.label = l.label WHERE r <= k
"""


def sign_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two measures lie on the same side of their fixed middles, by language."""
    own = _docs(spark, sf_dir).select("lang", F.signum(X.n_tokens(_body()) - 300.0).alias("a"), F.signum(F.regexp_count(_body(), F.lit("[.]")) - 20.0).alias("b"))
    return own.groupBy("lang").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("agreement"))


SIGNS = f"SELECT lang, round(avg((sign(a) = sign(b))::INT), 6) AS agreement FROM (SELECT lang, {_N} - 300.0 AS a, len(regexp_extract_all(coalesce(text, ''), '[.]')) - 20.0 AS b FROM documents) GROUP BY 1"


def near_across_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and test rows that are exact or near copies of a training row."""
    own = stratified_split(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return P.near_across_splits(own, "doc_id", threshold=0.8)


ACROSS = rf"""
WITH {_SPLIT}, txt AS (SELECT doc_id, split, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS u, {_KEY.format('text')} AS k FROM s JOIN documents USING (doc_id)),
g AS (SELECT DISTINCT doc_id, split, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, split, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM (SELECT doc_id, split, string_split(k, ' ') AS w FROM txt WHERE k <> ''))),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
near AS (SELECT DISTINCT a FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.split <> 'train' AND y.split = 'train' GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c / (p.n + q.n - c)::DOUBLE >= 0.8)
SELECT split, count(*) AS rows, count(*) FILTER (u IN (SELECT u FROM txt WHERE split = 'train') OR doc_id IN (SELECT a FROM near)) AS near FROM txt WHERE split <> 'train' GROUP BY 1
"""


def abbreviation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word stands before a full stop, and how sure an abbreviation it is."""
    found = N.abbreviation_scores(N.word_stops(table(spark, sf_dir, "documents")))
    return found.select("word", "stops", "plain", (F.round("score", 4) + F.lit(0.0)).alias("score"))


ABBREVIATIONS = rf"""
WITH t AS (SELECT regexp_replace(regexp_replace(unnest(regexp_extract_all(lower(coalesce(text, '')), '[^ 	

]+')), '^[("''\[]+', ''), '[)"''\],;:!?]+$', '') AS t FROM documents),
w AS (SELECT CASE WHEN t LIKE '%.' THEN t[:-2] ELSE t END AS word, (t LIKE '%.')::INT AS s FROM t WHERE t NOT IN ('', '.')), c AS (SELECT word, sum(s)::BIGINT AS stops, sum(1 - s)::BIGINT AS plain FROM w WHERE regexp_matches(word, '^[a-z]') GROUP BY word),
a AS (SELECT sum(stops)::DOUBLE / sum(stops + plain) AS p FROM c), l AS (SELECT *, length(replace(word, '.', ''))::DOUBLE AS letters FROM c WHERE stops > 0)
SELECT word, stops, plain, round(CASE WHEN letters > 0 THEN 2 * (stops * (ln({N.ALWAYS}::DOUBLE) - ln(p)) + plain * (ln(1 - {N.ALWAYS}::DOUBLE) - ln(1 - p))) * exp(-letters) * (length(word) - letters + 1) * pow(letters, -plain) ELSE 0 END, 4) + 0.0::DOUBLE AS score FROM l, a
"""


def claim_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents by the corpus's own abbreviations, and how many of them may be claims."""
    rows = N.sentence_rows(table(spark, sf_dir, "documents"), "doc_id")
    claims = N.claims_of(rows).groupBy("key").agg(F.count("*").alias("n_claims")).withColumnRenamed("key", "k")
    own = rows.groupBy("key").agg(F.count("*").alias("n_sentences"), F.count_if("skipped").alias("n_skipped"), F.max(F.length("sentence")).cast("long").alias("longest"))
    return own.join(claims, F.col("key") == F.col("k"), "left").select(F.col("key").alias("doc_id"), "n_sentences", "n_skipped", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), "longest")


QUERIES = {f.__name__: f for f in (classifier_input, id_numbers, quotable_sentences, date_statistics, yearly_wide, large_groups, numbers_per_thousand, distinct_counts, evidence_coverage, why_missed, single_class_sources, raw_texts_by_id, leak_terms, search_queries, string_predicates, distinct_pairs, stratified_subset, sign_agreement, near_across_splits, abbreviation_counts, claim_sentences)}
ORACLES = {
    "abbreviation_counts": ABBREVIATIONS,
    "classifier_input": INPUT, "id_numbers": NUMBERS, "quotable_sentences": SENTENCES, "date_statistics": DATES, "yearly_wide": YEARLY, "large_groups": LARGE, "numbers_per_thousand": RATE, "distinct_counts": DISTINCT,
    "evidence_coverage": COVERAGE, "why_missed": MISSED, "single_class_sources": ONE_CLASS, "raw_texts_by_id": RAW, "leak_terms": LEAKS, "search_queries": QUERIES_SQL, "string_predicates": PREDICATES,
    "distinct_pairs": PAIRS, "stratified_subset": SUBSET, "sign_agreement": SIGNS, "near_across_splits": ACROSS,
}  # fmt: skip
