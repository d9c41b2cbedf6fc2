"""DuckDB SQL for the operators that SQL can express."""

from lexforge.llm import quality, secrets

_BODY = "SELECT doc_id, coalesce(text, '') AS body FROM documents"


def _quality() -> str:
    rules = " OR ".join(f"({r.sql})" for r in quality.RULES).replace("regexp_count(body, ", "regexp_hits(body, ")
    for chars in ("[A-Z]", "!", "[0-9]"):
        rules = rules.replace(f"regexp_hits(body, '{chars}')", f"len(regexp_extract_all(body, '{chars}'))")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM ({_BODY})),
w AS (SELECT k, unnest(range(len(words) - 4)) AS i, words FROM d WHERE len(words) >= 5),
grams AS (SELECT k, i, array_to_string(words[i + 1 : i + 5], ' ') AS gram FROM w),
twins AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM grams) WHERE n > 1),
repeated AS (SELECT k, count(DISTINCT i + j)::BIGINT AS n FROM twins, range(5) AS t(j) GROUP BY k),
lines AS (SELECT k, (count(*) - count(DISTINCT line))::BIGINT AS n FROM (SELECT k, unnest(string_split(body, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (SELECT d.doc_id, d.body, len(words)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeated USING (k) LEFT JOIN lines USING (k)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {rules.replace(chr(10), "' || chr(10) || '")}) AS kept FROM b
"""


#: The base as the contract has it: kind, pattern, the group whose length counts (0: all), at least so many characters.
_BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)


def _secrets() -> str:
    parts = []
    more = [(r.kind, r.body.replace("*+", "*").replace("++", "+").replace("}+", "}"), r.value, r.at_least, r.not_after) for r in secrets.MORE]  # RE2 needs no possessive repetitions
    for k, (kind, body, value, least, not_after) in enumerate([*((*b, "") for b in _BASE), *more]):
        p = body.replace("'", "''")
        gap = f"(.*?(?:^|[^{not_after[1:-1]}]))" if not_after else "(.*?)"  # RE2 has no lookbehind: the character before a match is in the gap
        all_of = lambda g: f"regexp_extract_all(body, '(?s){gap}({p})', {g})"  # noqa: B023, E731
        parts.append(f"SELECT k, {k} AS r, '{kind}' AS kind, {least} AS least, {all_of(1)} AS gaps, {all_of(2)} AS hits, {all_of(value + 2 if value else 2)} AS vals FROM d WHERE regexp_matches(body, '{p}')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, body FROM ({_BODY})),
m AS ({" UNION ALL ".join(parts)}),
u AS (SELECT k, r, kind, least, unnest(range(len(hits))) AS i, unnest(gaps) AS gap, unnest(hits) AS hit, unnest(vals) AS val FROM m),
s AS (SELECT k, r, kind, least, length(val) AS n, sum(length(gap) + length(hit)) OVER (PARTITION BY k, r ORDER BY i) AS stop, length(hit) AS size FROM u),
f AS (SELECT k, r, kind, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM s WHERE n >= least),
g AS (SELECT k, count(*) FILTER (r = 0) AS n0, count(*) FILTER (r = 1) AS n1, count(*) FILTER (r = 2) AS n2,
  string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, r) FILTER (r < 3) AS base, string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, r) AS spans FROM f GROUP BY k)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (k)
"""


#: DuckDB's length of a blob is octet_length.
_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS response FROM q)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> response THEN response END AS refers_to
FROM r
"""

_SUBSTRING = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM ({_BODY})),
w AS (SELECT k, doc_id, unnest(range(len(words) - 19)) AS i, words FROM d WHERE len(words) >= 20),
g AS (SELECT k, doc_id, i, array_to_string(words[i + 1 : i + 20], ' ') AS gram FROM w),
f AS (SELECT k, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS nth FROM g),
gone AS (SELECT DISTINCT k, i + j AS i FROM f, range(20) AS t(j) WHERE nth > 1),
x AS (SELECT k, words[i + 1] AS word, i FROM d, LATERAL (SELECT unnest(range(len(words))) AS i)),
kept AS (SELECT x.k, string_agg(word, ' ' ORDER BY x.i) AS text, count(*) AS n FROM x ANTI JOIN gone ON x.k = gone.k AND x.i = gone.i GROUP BY x.k)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""

_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM ({_BODY})),
g AS (SELECT DISTINCT k, array_to_string(words[i + 1 : i + 5], ' ') AS gram FROM (SELECT k, words, unnest(range(greatest(len(words) - 4, 1))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT k, count(*) AS size FROM g GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.k <> b.k GROUP BY a.k, b.k),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 5 * common >= 4 * (x.size + y.size - common)),
r AS (SELECT k AS a, k AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, m.class_id, (SELECT count(*) FROM e WHERE e.a = d.k)::BIGINT AS n_links
FROM d JOIN (SELECT r.a, min(x.doc_id) AS class_id FROM r JOIN d x ON x.k = r.b GROUP BY r.a) m ON m.a = d.k
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC-32 over half bytes, the low one first: a table of 16 entries, each four steps of the polynomial.
_RESAMPLING = f"""
WITH RECURSIVE steps AS (SELECT n, n AS c, 0 AS i FROM range(16) AS t(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 4),
half AS (SELECT list(c ORDER BY n) AS h FROM steps WHERE i = 4),
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT {_WORDS} AS words FROM benchmark),
lengths AS (SELECT unnest([1, 2, 3]) AS n),
df AS (SELECT k, array_to_string(words[i + 1 : i + n], ' ') AS f FROM (SELECT k, words, n, unnest(range(len(words) - n + 1)) AS i FROM d, lengths WHERE len(words) >= n)),
bf AS (SELECT array_to_string(words[i + 1 : i + n], ' ') AS f FROM (SELECT words, n, unnest(range(len(words) - n + 1)) AS i FROM b, lengths WHERE len(words) >= n)),
names AS (SELECT f, hex(f) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
halves AS (SELECT f, flatten(list_transform(range(1, length(x), 2), lambda i: [instr('123456789ABCDEF', x[i + 1]), instr('123456789ABCDEF', x[i])])) AS v FROM names),
crc AS (SELECT f, xor(list_reduce(list_prepend(4294967295, v), lambda c, y: xor(c >> 4, h[(xor(c, y) & 15) + 1])), 4294967295) % 10000 AS bucket FROM halves, half),
s AS (SELECT bucket, count(*) AS n FROM df JOIN crc USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN crc USING (f) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS own, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS target),
g AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (own + 10000)) / ((s.n + 1)::DOUBLE * (target + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sums),
w AS (SELECT k, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight FROM df JOIN crc USING (f) JOIN g USING (bucket) GROUP BY k),
z AS (SELECT k, doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256(concat('42:', doc_id))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (k)),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM z WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END::BIGINT AS rank FROM z LEFT JOIN r USING (k)
"""

_BENCHMARK = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
w AS (SELECT DISTINCT item_id, array_to_string(words[i + 1 : i + 10], ' ') AS gram, least(len(words), 10) AS n FROM (SELECT item_id, words, unnest(range(greatest(len(words) - 9, 1))) AS i FROM b WHERE len(words) > 0)),
u AS (SELECT DISTINCT gram, n FROM w),
g AS (SELECT k, n, i, array_to_string(words[i + 1 : i + n], ' ') AS gram FROM (SELECT k, words, n, unnest(range(len(words) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM u) WHERE len(words) >= n)),
m AS (SELECT k, i, g.n, gram FROM g JOIN u USING (gram)),
h AS (SELECT k, count(DISTINCT i + j)::BIGINT AS n_hit FROM (SELECT k, i, unnest(range(n)) AS j FROM m) GROUP BY k),
t AS (SELECT k, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM m JOIN w USING (gram) WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)
"""

_NEGATIVES = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""

ORACLES = {"op11_hard_negatives": _NEGATIVES, "op12_benchmark_decontamination": _BENCHMARK, "op13_importance_resampling": _RESAMPLING, "op7_chosen_path_join": _JACCARD, "op5_recompression_dedup": _SUBSTRING, "op1_warc_salvage": _WARC, "op4_quality_cascade": _quality(), "op10_secret_spans": _secrets()}
