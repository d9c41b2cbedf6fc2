"""Registered queries of corpus preparation and text functions, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import artefacts as A
from lexforge.functions import html as H
from lexforge.functions import text as X
from lexforge.operators import prep as P
from lexforge.schema import BINARY_TO_FIVE, BINARY_TO_THREE, align, mapped
from lexforge.session import table

_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_NORM = r"regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), '‘’‚“”„–—−' || chr(160), '''''''" + '"""' + r"--- '), '[ \t\r\f\x0B]+', ' ', 'g'), '[ \t\n\r\f\x0B]*\n[ \t\n\r\f\x0B]*', chr(10), 'g'), '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"
_NORM = _NORM.replace("coalesce(text, '')", "replace(coalesce(text, ''), '…', '...')")
_N = r"len(regexp_extract_all({0}, '[^ \t\n\r\f\x0B]+'))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").withColumn("label", F.when(F.col("quality") == 1, "real").otherwise("fake"))


def unify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels in the unified schema."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    label = F.when(F.col("quality") == 1, "real").when(F.col("quality") == 0, "fake")
    return align(d.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("title"), "text", label.alias("label"),
        mapped(label, BINARY_TO_FIVE).alias("label5"), mapped(label, BINARY_TO_THREE).alias("label3"), F.lit("documents").alias("source_dataset"), F.to_json(F.struct("lang", "source")).alias("meta"),
    ))


UNIFY = """
SELECT 'doc_' || d.doc_id AS id, split_part(coalesce(text, ''), chr(10), 1) AS title, text, CASE quality WHEN 1 THEN 'real' WHEN 0 THEN 'fake' END AS label, CASE quality WHEN 1 THEN 'REAL' WHEN 0 THEN 'FAKE' END AS label5,
  CASE quality WHEN 1 THEN 'TRUE' WHEN 0 THEN 'FALSE' END AS label3, 'documents' AS source_dataset, NULL::VARCHAR AS date, NULL::VARCHAR AS split, '{"lang":"' || lang || '","source":"' || source || '"}' AS meta
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""


def clean_drop_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in, empty, short, exact copies and out: texts are read once, and only counts by key and reason are shuffled."""
    flags = P.clean_flags(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cells = flags.select("drop_reason", F.when(F.col("drop_reason").isNull(), X.key_hash(F.col("text"))).alias("h")).groupBy("drop_reason", "h").agg(F.count("*").alias("n"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    kept = F.count_if(F.col("drop_reason").isNull())
    return cells.agg(of(F.lit(True)).alias("rows_in"), of(F.col("drop_reason") == "empty").alias("empty"), of(F.col("drop_reason") == "short").alias("short"), (of(F.col("drop_reason").isNull()) - kept).alias("exact_copies"), kept.alias("rows_out"))


ACCOUNT = f"""
WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents), f AS (SELECT doc_id, t, CASE WHEN t = '' THEN 'empty' WHEN {_N.format('t')} < 20 THEN 'short' END AS r FROM n),
h AS (SELECT row_number() OVER (PARTITION BY {_KEY.format('t')} ORDER BY doc_id) AS k FROM f WHERE r IS NULL)
SELECT (SELECT count(*) FROM f) AS rows_in, (SELECT count(*) FROM f WHERE r = 'empty') AS empty, (SELECT count(*) FROM f WHERE r = 'short') AS short, count(*) FILTER (k > 1) AS exact_copies, count(*) FILTER (k = 1) AS rows_out FROM h
"""


def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(X.normalised(F.coalesce("text", F.lit("")))).alias("sha1"), X.n_tokens(X.normalised(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"))


NORMALISED = f"SELECT doc_id, sha1(t) AS sha1, {_N.format('t')}::BIGINT AS n_tokens FROM (SELECT doc_id, {_NORM} AS t FROM documents)"


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.drop_exact(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", X.key_hash(F.col("text")).alias("key"))


EXACT = f"SELECT doc_id, sha1(k) AS key FROM (SELECT doc_id, {_KEY.format('text')} AS k FROM documents) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1"


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = P.drop_exact(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return P.near_pairs(own, "doc_id", "text", 0.8).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_PAIRS = f"""
d AS (SELECT doc_id, string_split(k, ' ') AS w FROM (SELECT doc_id, {_KEY.format('text')} AS k FROM documents QUALIFY row_number() OVER (PARTITION BY {_KEY.format('text')} ORDER BY doc_id) = 1) WHERE k <> ''),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
p AS (SELECT a, b, c / (x.n + y.n - c)::DOUBLE AS jaccard FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b)"""
PAIRS = f"WITH {_PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM p WHERE jaccard >= 0.8"


def near_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = P.drop_exact(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return P.greedy_drops(P.near_pairs(own, "doc_id", "text", 0.8)).withColumnRenamed("pos", "doc_id")


GREEDY = f"""
WITH RECURSIVE {_PAIRS},
e AS MATERIALIZED (SELECT a, b FROM p WHERE jaccard >= 0.8), nb AS (SELECT b, list(a) AS js, row_number() OVER (ORDER BY b) AS i FROM e GROUP BY b),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT nb.i, CASE WHEN len(list_filter(nb.js, lambda x: NOT list_contains(r.gone, x))) > 0 THEN list_append(r.gone, nb.b) ELSE r.gone END FROM r JOIN nb ON nb.i = r.i + 1)
SELECT unnest(max_by(gone, i)) AS doc_id FROM r
"""


def minhash_lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = P.drop_exact(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return P.lsh_candidates(P.minhash(own, "doc_id"))


def preparation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole preparation, step by step: rows in, empty, short, exact copies, near copies (0.8), rows out."""
    return P.prepared(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", threshold=0.8)[1]


_KEPT = f"""
t AS (SELECT doc_id, {_NORM} AS t FROM documents), f AS (SELECT doc_id, t, CASE WHEN t = '' THEN 'empty' WHEN {_N.format('t')} < 20 THEN 'short' END AS r FROM t),
d AS (SELECT doc_id, string_split(k, ' ') AS w FROM (SELECT doc_id, {_KEY.format('t')} AS k FROM f WHERE r IS NULL QUALIFY row_number() OVER (PARTITION BY {_KEY.format('t')} ORDER BY doc_id) = 1)),
s AS ("""
STEPS = f"""
WITH RECURSIVE {_KEPT}{_PAIRS.split('s AS (', 1)[1]},
e AS MATERIALIZED (SELECT a, b FROM p WHERE jaccard >= 0.8), nb AS (SELECT b, list(a) AS js, row_number() OVER (ORDER BY b) AS i FROM e GROUP BY b),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT nb.i, CASE WHEN len(list_filter(nb.js, lambda x: NOT list_contains(r.gone, x))) > 0 THEN list_append(r.gone, nb.b) ELSE r.gone END FROM r JOIN nb ON nb.i = r.i + 1),
k AS (SELECT (SELECT count(*) FROM f) AS i, (SELECT count(*) FROM f WHERE r = 'empty') AS e, (SELECT count(*) FROM f WHERE r = 'short') AS s, (SELECT count(*) FROM d) AS x, (SELECT max(len(gone)) FROM r) AS n)
SELECT 'in' AS step, 0::BIGINT AS dropped, i AS rows FROM k UNION ALL SELECT 'empty', e, i - e FROM k UNION ALL SELECT 'short', s, i - e - s FROM k UNION ALL SELECT 'exact', i - e - s - x, x FROM k UNION ALL SELECT 'near', n, x - n FROM k UNION ALL SELECT 'out', 0, x - n FROM k
"""


def near_copy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of near copies (0.8) by MinHash bands that miss a pair with a chance under one in a hundred thousand."""
    found = P.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 0.8, 0.99999, 256)
    return found.select(F.col("pos").alias("doc_id"), "class_id")


GROUPS = f"""
WITH RECURSIVE {_PAIRS}, e AS MATERIALIZED (SELECT a, b FROM p WHERE jaccard >= 0.8 UNION SELECT b, a FROM p WHERE jaccard >= 0.8), r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_KEY.format('text')}) AS first FROM documents WHERE {_KEY.format('text')} <> ''),
x AS (SELECT k.doc_id, g.label AS class_id FROM k JOIN (SELECT a, min(b) AS label FROM r GROUP BY a) g ON g.a = k.first)
SELECT doc_id, class_id FROM x QUALIFY count(*) OVER (PARTITION BY class_id) > 1
"""


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stratified_split(_labelled(spark, sf_dir).select("doc_id", "label"), "label", "doc_id").select("doc_id", "label", "split")


_SPLIT = """
l AS (SELECT doc_id, CASE quality WHEN 1 THEN 'real' ELSE 'fake' END AS label FROM labels JOIN documents USING (doc_id)),
t AS (SELECT count(*) AS n, ceil(count(*) / 10.0)::BIGINT AS test FROM l), q AS (SELECT *, ceil((n - test) / 9.0)::BIGINT AS val FROM t),
c AS (SELECT label, count(*) AS m FROM l GROUP BY 1),
x AS (SELECT label, m, test * m / n::DOUBLE AS e, test, val, n FROM c, q),
y AS (SELECT *, floor(e)::BIGINT + CASE WHEN row_number() OVER (ORDER BY floor(e) - e, label) <= test - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS qt FROM x),
z AS (SELECT *, val * (m - qt) / (n - test)::DOUBLE AS f FROM y),
k AS (SELECT label, qt, floor(f)::BIGINT + CASE WHEN row_number() OVER (ORDER BY floor(f) - f, label) <= val - sum(floor(f)) OVER () THEN 1 ELSE 0 END AS qv FROM z),
s AS (SELECT doc_id, l.label, CASE WHEN r <= qt THEN 'test' WHEN r <= qt + qv THEN 'val' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1(doc_id || ':42'), doc_id) AS r FROM l) l JOIN k ON k.label = l.label)"""
SPLIT = f"WITH {_SPLIT} SELECT * FROM s"


def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.split_report(stratified_split(spark, sf_dir), "label")
    return r.select("split", "rows", F.round("fraction", 6).alias("fraction"), F.round("max_deviation", 6).alias("max_deviation"))


REPORT = f"""
WITH {_SPLIT}, g AS (SELECT split, label, count(*) AS n FROM s GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY split) AS ns, sum(n) OVER (PARTITION BY label) AS nl, sum(n) OVER () AS na FROM g)
SELECT split, max(ns)::BIGINT AS rows, round(max(ns) / max(na)::DOUBLE, 6) AS fraction, round(max(abs(n / ns::DOUBLE - nl / na::DOUBLE)), 6) AS max_deviation FROM w GROUP BY 1
"""


def cross_split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stratified_split(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return P.cross_split_overlap(own)


OVERLAP = f"""
WITH {_SPLIT}, h AS (SELECT DISTINCT split, {_KEY.format('text')} AS k FROM s JOIN documents USING (doc_id))
SELECT split, count(*) FILTER (k IN (SELECT k FROM h WHERE split = 'train')) AS shared FROM h WHERE split <> 'train' GROUP BY 1
"""


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.balanced_sample(_labelled(spark, sf_dir).select("doc_id", "label"), "label", "doc_id", 51, ["fake", "real"])


BALANCED = "SELECT doc_id, label FROM (SELECT doc_id, CASE quality WHEN 1 THEN 'real' ELSE 'fake' END AS label FROM labels JOIN documents USING (doc_id)) QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha1(doc_id || ':42'), doc_id) <= CASE label WHEN 'fake' THEN 26 ELSE 25 END"


def class_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic labelled documents, filled up from all labelled ones."""
    own = _labelled(spark, sf_dir).select("doc_id", "label", "toxic")
    return P.class_topup(own.filter("toxic = 1").drop("toxic"), own.drop("toxic"), "label", "doc_id", 140)


TOPUP = """
WITH l AS (SELECT doc_id, CASE quality WHEN 1 THEN 'real' ELSE 'fake' END AS label, toxic FROM labels JOIN documents USING (doc_id)), have AS (SELECT doc_id, label FROM l WHERE toxic = 1),
need AS (SELECT label, 140 - count(*) AS k FROM have GROUP BY 1), extra AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY sha1(doc_id || ':42'), doc_id) AS r FROM l WHERE toxic = 0)
SELECT * FROM have UNION ALL SELECT extra.doc_id, extra.label FROM extra LEFT JOIN need USING (label) WHERE r <= coalesce(k, 140)
"""


def corpus_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents against the others, as another corpus: exact, near or new."""
    d, known = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id")
    return P.corpus_difference(d.join(known, "doc_id", "left_semi"), d.join(known, "doc_id", "left_anti"), "doc_id", "text", 0.8).withColumnRenamed("pos", "doc_id")


DIFFERENCE = rf"""
WITH k AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS mine, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS u, {_KEY.format('text')} AS k FROM documents),
s AS (SELECT DISTINCT doc_id, mine, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, mine, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM (SELECT doc_id, mine, string_split(k, ' ') AS w FROM k WHERE k <> ''))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
near AS (SELECT DISTINCT a FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.mine AND NOT y.mine GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE c / (p.n + q.n - c)::DOUBLE >= 0.8)
SELECT doc_id, CASE WHEN u IN (SELECT u FROM k WHERE NOT mine) THEN 'exact' WHEN doc_id IN (SELECT a FROM near) THEN 'near' ELSE 'new' END AS how FROM k WHERE mine
"""


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.n_tokens(F.coalesce("text", F.lit(""))).cast("long").alias("n_tokens"), F.length("text").cast("long").alias("n_chars"))


TOKENS = f"SELECT doc_id, {_N.format('coalesce(text, chr(32))')}::BIGINT AS n_tokens, length(text)::BIGINT AS n_chars FROM documents"


def style_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.style(F.coalesce("text", F.lit("")))
    own = table(spark, sf_dir, "documents").select("doc_id", *[c.cast("long").alias(k) for k, c in s.items()])
    return own.withColumn("flesch", F.round(X.flesch(F.col("n_tokens"), F.col("n_sentences"), F.col("n_syllables")), 6))


_COUNT = "len(regexp_extract_all({0}, '{1}'))::BIGINT"
STYLE = rf"""
WITH s AS (SELECT doc_id, {_N.format('text')}::BIGINT AS n_tokens, {_COUNT.format('text', '!')} AS n_exclaim, {_COUNT.format('text', '[?]')} AS n_question, {_COUNT.format('text', chr(92) + 'b[A-Z]{3,}' + chr(92) + 'b')} AS n_caps0,
  {_COUNT.format('text', '[.!?]+(?:[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'f' + chr(92) + 'x0B]|$)')} AS n_sentences, {_COUNT.format('lower(text)', '[aeiouy]+')} AS n_syllables, text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, n_tokens, n_exclaim, n_question, {_COUNT.format("regexp_replace(text, '[^" + chr(92) + "x00-" + chr(92) + "x7F]', 'x', 'g')", chr(92) + 'b[A-Z]{3,}' + chr(92) + 'b')} AS n_caps, n_sentences, n_syllables,
  round(206.835::DOUBLE - 1.015::DOUBLE * (n_tokens / greatest(n_sentences, 1)::DOUBLE) - 84.6::DOUBLE * (n_syllables / greatest(n_tokens, 1)::DOUBLE), 6) AS flesch FROM s
"""


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.shingles(X.key_words(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.sha1(F.array_join(F.array_sort(s), "|")).alias("digest"))


SHINGLES = f"""
WITH d AS (SELECT doc_id, list_filter(string_split({_KEY.format("coalesce(text, '')")}, ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) END AS s FROM d)
SELECT doc_id, len(s)::BIGINT AS n, sha1(array_to_string(s, '|')) AS digest FROM g
"""


def html_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.page_title(F.col("html")).alias("title"), F.sha1(H.page_text(F.col("html"))).alias("text_sha1"))


def _unescape(x: str) -> str:
    for k, v in H.ENTITIES.items():
        x = f"replace({x}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return x


_STRIP = "regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>|<!--.*?-->', ' ', 'g')"
_TAGLESS = f"regexp_replace({_STRIP}, '<[^>]*>', ' ', 'g')"
HTML = rf"""
SELECT page_id, trim(regexp_replace({_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '[ \t\r\n]+', ' ', 'g')) AS title,
  sha1(trim(regexp_replace({_unescape(_TAGLESS)}, '[ \t\r\n]+', ' ', 'g'))) AS text_sha1 FROM pages
"""


def english_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", X.looks_english(F.coalesce("text", F.lit(""))).alias("english"))


ENGLISH = rf"""
WITH h AS (SELECT doc_id, lang, substring(coalesce(text, ''), 1, 500) AS h FROM documents), w AS (SELECT *, list_filter(string_split_regex(lower(h), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM h),
s AS (SELECT *, len(list_filter(w, lambda x: regexp_replace(x, '^[.,!?;:"'']+|[.,!?;:"'']+$', '', 'g') IN ({', '.join(f"'{x}'" for x in X.STOPWORDS)}))) AS n FROM w)
SELECT doc_id, lang, len(w) = 0 OR n >= 0.2 * len(w) OR (len(w) < 10 AND regexp_full_match(h, '[\x00-\x7F]*')) AS english FROM s
"""

_PTB = ["A man -LRB- born 1950 -RRB- said , `` no '' .", "It 's the firm 's plan , is n't it ?", "[ see -LSB- 1 -RSB- ] : 5 % of it ; done !", "plain text"]


def ptb_detok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with every escape, and the texts of all turns and benchmark items with brackets escaped."""
    rows = spark.createDataFrame([(f"s{k}", x) for k, x in enumerate(_PTB)], "id string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("_", F.lit("c"), "conv_id", "turn").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    escaped = turns.unionByName(items).withColumn("text", F.replace(F.replace("text", F.lit(","), F.lit(" , -LRB- ")), F.lit("."), F.lit(" -RRB- . ``")))
    return rows.unionByName(escaped).select("id", F.sha1(X.detokenised(F.col("text"))).alias("sha1"))


_P = "text"
for _t, _v in (("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "["), ("-RSB-", "]"), ("-COLON-", ":"), ("``", '"'), ("''''", '"')):
    _P = f"replace({_P}, '{_t}', '{_v}')"
_VALUES = ", ".join(f"('s{k}', '{x.replace(chr(39), chr(39) * 2)}')" for k, x in enumerate(_PTB))
PTB = rf"""
WITH v AS (SELECT * FROM (VALUES {_VALUES}) AS v(id, text) UNION ALL SELECT id, replace(replace(text, ',', ' , -LRB- '), '.', ' -RRB- . ``') FROM (SELECT 'c_' || conv_id || '_' || turn AS id, text FROM conversations UNION ALL SELECT 'b' || item_id, text FROM benchmark))
SELECT id, sha1(regexp_replace(regexp_replace(regexp_replace({_P}, ' ([.,;:!?%)\]])', '\1', 'g'), '([(\[]) ', '\1', 'g'), ' (''(?:s|re|ve|ll|d|m)|n''t)\b', '\1', 'g')) AS sha1 FROM v
"""

_RATINGS = ["True", "Mostly True", "Pants on Fire!", "half true", "False. A hoax", "No evidence for it", "Unproven", "correct attribution", "Fake", "", "Misleading", "accurate!"]


def rating_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal ratings, and the first words of all turns, of which any may come."""
    rows = spark.createDataFrame([(x,) for x in _RATINGS], "name string")
    rows = rows.unionByName(table(spark, sf_dir, "conversations").select(F.concat(F.element_at(F.array(*map(F.lit, ("", "False: ", "true ", "no evidence "))), (F.col("turn") % 4 + 1).cast("int")), F.substring("text", 1, 24)).alias("name")))
    return rows.select("name", X.rating3(F.col("name")).alias("by_words"), X.review_rating3(F.col("name")).alias("by_review"))


RATINGS = rf"""
WITH r AS (SELECT name, lower(regexp_replace(trim(name), '[.!]+$', '')) AS n FROM (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in _RATINGS)}) AS v(name) UNION ALL SELECT ['', 'False: ', 'true ', 'no evidence '][turn % 4 + 1] || text[1:24] FROM conversations)),
f AS (SELECT *, regexp_replace(string_split_regex(n, '[ \t\n]+')[1], '^[.,:;!]+|[.,:;!]+$', '', 'g') AS w FROM r)
SELECT name, CASE WHEN trim(name) = '' THEN NULL WHEN regexp_matches(trim(name), '(?i){X.RATING_TRUE}') THEN 'TRUE' WHEN regexp_matches(trim(name), '(?i){X.RATING_FALSE}') THEN 'FALSE' ELSE 'MIXED' END AS by_words,
  CASE WHEN n = '' OR regexp_matches(n, '{X.REVIEW_NONE}') THEN NULL WHEN n IN ({", ".join(f"'{x}'" for x in X.REVIEW_TRUE)}) THEN 'TRUE' WHEN n IN ({", ".join(f"'{x}'" for x in X.REVIEW_FALSE)}) OR w IN ('false', 'fake') THEN 'FALSE' ELSE 'MIXED' END AS by_review FROM f
"""


#: Letters beyond ASCII, which the oracle's patterns would not take for letters; both sides compare with x in their place.
_LETTERS = "[À-ÖØ-öø-ɏͰ-ϿЀ-ӿ]"


def artefact_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.strip_frame(table(spark, sf_dir, "documents").select("doc_id", "text"), title=None)
    return s.select("doc_id", F.sha1(F.regexp_replace("text", _LETTERS, "x")).alias("sha1"), F.array_join("hits", ",").alias("hits"))


def artefact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[c.cast("long").alias(n) for c, (n, _) in zip(A.counts(F.coalesce("text", F.lit(""))), A.TEXT_PATTERNS, strict=True)])


def artefact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each class's documents that a pattern matches."""
    own = _labelled(spark, sf_dir).select("label", *A.counts(F.coalesce("text", F.lit(""))))
    names = [n for n, _ in A.TEXT_PATTERNS]
    shares = own.groupBy("label").agg(*[F.round(F.avg((F.col(n) > 0).cast("int")), 6).alias(n) for n in names])
    return shares.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(n).alias("share")) for n in names])).alias("x")).select("label", "x.pattern", "x.share")


def _plain_pattern(pattern: str) -> tuple[str, str]:
    """A pattern without lookaround, and what it leaves in its place: the neighbour that it takes along, and a blank."""
    p, left = pattern.replace("(?iu)", "(?i)").replace("(?ium)", "(?im)").replace("'", "''"), " "
    flags = p[: p.index(")") + 1] if p.startswith("(?i") or p.startswith("(?m") else ""
    body = p[len(flags):] if flags and not flags.endswith(":)") else p
    if "(?<![" in body:
        seen = "\\w" if "(?<![\\w])" in body else "A-Za-z"
        body, left = f"(^|[^{seen}])(?:" + body.replace(f"(?<![{seen}])", "") + ")", "\\1 "
    body = body.replace("(?!\\w)", "\\B")  # after a full stop these are one
    body = body.replace("(?![a-z])", "\\b")  # and so are these after a letter, but where digits or capitals follow
    if body.endswith("(?![\\w/])"):
        body, left = body.removesuffix("(?![\\w/])") + "([^\\w/]|$)", " \\1"
    return flags + body, left


_PLAIN = [(n, *_plain_pattern(p)) for n, p in A.TEXT_PATTERNS]
_XTEXT = f"regexp_replace(coalesce(text, ''), '{_LETTERS}', 'x', 'g')"
_HITS = ", ".join(f"len(regexp_extract_all(t, '{p}'))::BIGINT AS {n}" for n, p, _ in _PLAIN)
COUNTS = f"SELECT doc_id, {_HITS} FROM (SELECT doc_id, {_XTEXT} AS t FROM documents)"
SHARES = f"WITH l AS (SELECT CASE quality WHEN 1 THEN 'real' ELSE 'fake' END AS label, {_XTEXT} AS t FROM documents JOIN labels USING (doc_id)) " + " UNION ALL ".join(f"SELECT label, '{n}' AS pattern, round(avg(regexp_matches(t, '{p}')::INT), 6) AS share FROM l GROUP BY 1" for n, p, _ in _PLAIN)
_STEPS = [f"s0 AS (SELECT doc_id, {_XTEXT} AS t, []::VARCHAR[] AS hits FROM documents)"]
for _k, (_n, _p, _l) in enumerate(_PLAIN):
    _STEPS.append(f"s{_k + 1} AS (SELECT doc_id, regexp_replace(t, '{_p}', '{_l}', 'g') AS t, CASE WHEN regexp_matches(t, '{_p}') THEN list_append(hits, '{_n}') ELSE hits END AS hits FROM s{_k})")
_STEPS.append(f"stripped AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \\t]{{2,}}', ' ', 'g'), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS t, hits FROM s{len(_PLAIN)})")
#: s0 (the texts) to stripped, for other queries as well.
STEPS_SQL = ", ".join(_STEPS)
STRIPPED = f"WITH {STEPS_SQL} SELECT doc_id, sha1(t) AS sha1, array_to_string(hits, ',') AS hits FROM stripped"


_TITLES = ["[VIDEO] A story", "A story (IMAGES)", "A story - The New York Times", "A story | CNN", "A story (Again)", "Senator (R-TX) speaks", "Plain title -", "A – Breitbart News", "[WATCH/TWEETS] Go  on"]


def title_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal titles, and the first lines of all documents with a suffix that depends on the id."""
    rows = spark.createDataFrame([(x,) for x in _TITLES], "title string")
    first = F.substring(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), 1, 80)
    suffix = F.element_at(F.array(*map(F.lit, ("", " - CNN", " [VIDEO]", " | Fox News", " (Again)"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = rows.unionByName(table(spark, sf_dir, "documents").select(F.concat(first, suffix).alias("title")))
    return rows.select("title", A.strip_title(F.col("title")).alias("stripped"))


_U = r"[\s]"
TITLES = rf"""
WITH t AS (SELECT title, regexp_replace(regexp_replace(title, '{A.FORMAT_TAG.replace("(?iu)", "(?i)").replace("'", "''")}', ' ', 'g'), '{A.TITLE_PATTERNS[1][1].replace("(?iu)", "(?i)").replace("'", "''")}', ' ', 'g') AS s FROM (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in _TITLES)}) AS v(title) UNION ALL SELECT split_part(coalesce(text, ''), chr(10), 1)[1:80] || ['', ' - CNN', ' [VIDEO]', ' | Fox News', ' (Again)'][doc_id % 5 + 1] FROM documents)),
u AS (SELECT title, regexp_replace(trim(regexp_replace(s, '[ \t]{{2,}}', ' ', 'g')), '{A.DANGLING}', '') AS s FROM t)
SELECT title, trim(regexp_replace(s, '[ \t]{{2,}}', ' ', 'g')) AS stripped FROM u
"""


def claimreview_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", H.review(F.col("html")).alias("r")).select("page_id", "r.*")


QUERIES = {f.__name__: f for f in (unify_documents, clean_drop_accounting, normalised_text, exact_dedup, near_dup_pairs, near_dedup_greedy, minhash_lsh_candidates, near_copy_groups, preparation_steps, stratified_split, split_report, cross_split_overlap, balanced_sample, class_topup, corpus_difference, token_counts, style_features, shingle_counts, html_title_text, english_filter, ptb_detok, rating_labels, artefact_strip, artefact_counts, artefact_shares, title_strip, claimreview_parse)}
ORACLES = {
    "unify_documents": UNIFY, "clean_drop_accounting": ACCOUNT, "normalised_text": NORMALISED, "exact_dedup": EXACT, "near_dup_pairs": PAIRS, "near_dedup_greedy": GREEDY, "near_copy_groups": GROUPS, "preparation_steps": STEPS, "stratified_split": SPLIT, "split_report": REPORT,
    "cross_split_overlap": OVERLAP, "balanced_sample": BALANCED, "class_topup": TOPUP, "corpus_difference": DIFFERENCE, "token_counts": TOKENS, "style_features": STYLE, "shingle_counts": SHINGLES, "html_title_text": HTML,
    "english_filter": ENGLISH, "ptb_detok": PTB, "rating_labels": RATINGS, "title_strip": TITLES,
    "artefact_strip": STRIPPED, "artefact_counts": COUNTS, "artefact_shares": SHARES,
}
