"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Every rule is a Boolean expression that rejects a text. On a bounded sample each rule is timed, text by text inside one job,
and the share of texts that it rejects is counted; rules then run by falling rejection per cost inside one CASE, so that
later rules are evaluated only for texts that all earlier ones let pass. The verdict (any rule rejects) does not depend
on the order; only the time does.

judge() returns the base measures, which it needs of every text, and runs the rules over them. apply_quality() only
filters: there the two base limits are rules of the cascade too, and each measure is computed where its rule is reached.

Defined cases: a null text counts as empty; a text under ten words fails the base; repeated rows are judged one by
one; an empty table gives an empty table; columns of docs beyond those named are ignored by measure() and kept by
apply_quality(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import WORD, let

#: Base limits; the sample's bounds: so many texts of so many bytes at most, from so many files, each timed so many times.
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_FILES, TIMES = 512, 16_384, 16, 8
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """rejects: of the measures and the body of a text; sql: the same for other engines."""

    name: str
    sql: str
    rejects: Callable[[SimpleNamespace], Column]


def _count(m: SimpleNamespace, pattern: str) -> Column:
    return F.regexp_count(m.body, F.lit(pattern))


def _lines(m: SimpleNamespace) -> Column:
    return F.length(m.body) - F.length(F.replace(m.body, F.lit("\n"), F.lit(""))) + 1


RULES = (
    Rule("symbols", "4 * n_symbols > n_words", lambda m: 4 * m.n_symbols > m.n_words),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * (length(body) - length(replace(body, '\n', '')) + 1)", lambda m: let(m.n_dup_lines, lambda n: (n >= 3) & (10 * n > 3 * _lines(m)))),
    Rule("short_words", "word_chars < 2 * n_words", lambda m: m.word_chars < 2 * m.n_words),
    Rule("long_words", "word_chars > 25 * n_words", lambda m: m.word_chars > 25 * m.n_words),
    Rule("capitals", "2 * regexp_count(body, '[A-Z]') > word_chars", lambda m: 2 * _count(m, "[A-Z]") > m.word_chars),
    Rule("exclamations", "2 * regexp_count(body, '!') > n_words", lambda m: 2 * _count(m, "!") > m.n_words),
    Rule("few_letters", "2 * regexp_count(body, '[0-9]') > word_chars", lambda m: 2 * _count(m, "[0-9]") > m.word_chars),
)
BASE = (
    Rule("few_words", f"n_words < {MIN_WORDS}", lambda m: m.n_words < MIN_WORDS),
    Rule("repeated_words", f"100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words", lambda m: 100 * m.n_repeat_words > MAX_REPEATED_PERCENT * m.n_words),
)


def _repeated_words(words: Column) -> Column:
    """Words inside windows of five that the text holds twice or more. O(n log n), and O(n) where nothing repeats."""

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            def twin(x: Column, k: Column) -> Column:
                h = x.getField("h")
                return F.when((F.get(s, k - 1).getField("h") == h) | (F.get(s, k + 1).getField("h") == h), x.getField("i"))

            places = F.array_sort(F.filter(F.transform(s, twin), lambda x: x.isNotNull()))
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            step = lambda a, i: F.struct(i.alias("last"), (a.getField("n") + F.least(F.lit(WINDOW), i - a.getField("last"))).alias("n"))
            return F.aggregate(places, start, step, lambda a: a.getField("n"))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, of_sorted))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows, covered))


def _word_chars(body: Column) -> Column:
    return F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long")


def _n_symbols(body: Column) -> Column:
    return F.regexp_count(body, F.lit(SYMBOLS)).cast("long")


def _n_dup_lines(body: Column) -> Column:
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _words(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(WORD), F.lit(0))


def measures(text: Column) -> Column:
    """A struct of the base measures of one text."""
    body = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), _word_chars(body).alias("word_chars"), _n_symbols(body).alias("n_symbols"),
            _n_dup_lines(body).alias("n_dup_lines"), _repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    return let(_words(body), of)


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, body, the base measures and base_failed of every text."""
    out = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"), measures(F.col(text)).alias("m"))
    out = out.select("key", "body", "m.*")
    m = _measured()
    return out.withColumn("base_failed", BASE[0].rejects(m) | BASE[1].rejects(m))


def _measured() -> SimpleNamespace:
    """The columns of measure()."""
    return SimpleNamespace(**{c: F.col(c) for c in ("body", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")})


def _on_demand(body: Column, both: Column) -> SimpleNamespace:
    """Measures that are computed where they are used, but for the two cheap ones that most rules need."""
    return SimpleNamespace(body=body, n_words=both.getField("n_words"), word_chars=both.getField("word_chars"), n_symbols=_n_symbols(body), n_dup_lines=_n_dup_lines(body), n_repeat_words=let(_words(body), _repeated_words))


def _both(body: Column) -> Column:
    return F.struct(F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_words"), _word_chars(body).alias("word_chars"))


# ---- the order


def sample(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, text): at most SAMPLE_ROWS texts of at most SAMPLE_BYTES, from files spread over the whole table.

    It only orders the rules and decides about no text, so a table that isn't read from files that hold its texts
    gives some of its first rows.
    """
    files = sorted(docs.inputFiles())
    files = files[:: max(1, -(-len(files) // SAMPLE_FILES))]
    sources = [docs]
    if files:
        raw = [docs.sparkSession.read.parquet(f) for f in files] if files[0].endswith(".parquet") else []
        if raw and all(text in r.columns and r.schema[text].dataType == docs.schema[text].dataType for r in raw):
            sources = raw
    parts = [x.select(F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES).limit(SAMPLE_ROWS // len(sources)) for x in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select(F.monotonically_increasing_id().alias("id"), "text")


def order_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, on_demand: bool = False) -> list[tuple[Rule, float, float]]:
    """(rule, nanoseconds a text, share rejected), best rejection per cost first.

    One job reads the clock before and after each rule of each text, TIMES times over, and takes the least of the times,
    so that neither scheduling nor compilation counts. on_demand: the measures that a rule needs are part of its cost.
    """
    texts = sample(docs, text)
    if on_demand:
        body = F.col("text")
        rows = texts.select("id", "text", _both(body).alias("both"))
        m = _on_demand(body, F.col("both"))
    else:
        rows, m = measure(texts, "id").filter(~F.col("base_failed")).withColumnRenamed("key", "id"), _measured()
    clock = F.java_method(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    steps = [clock.alias("t0")]
    for k, r in enumerate(rules):
        steps += [F.coalesce(r.rejects(m), F.lit(False)).alias(f"r{k}"), clock.alias(f"t{k + 1}")]
    timed = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(TIMES))).alias("time")).select("id", F.struct(*steps).alias("s"))
    each = timed.groupBy("id").agg(*[F.min(F.col(f"s.t{k + 1}") - F.col(f"s.t{k}")).alias(f"t{k}") for k in range(len(rules))], *[F.max(f"s.r{k}").alias(f"r{k}") for k in range(len(rules))])
    found = each.agg(F.count("*").alias("n"), *[F.avg(f"t{k}").alias(f"t{k}") for k in range(len(rules))], *[F.count_if(f"r{k}").alias(f"r{k}") for k in range(len(rules))]).first()
    n = max(found["n"], 1)
    costs = [(r, float(found[f"t{k}"] or 0), found[f"r{k}"] / n) for k, r in enumerate(rules)]
    return sorted(costs, key=lambda x: (-x[2] / max(x[1], 1.0), x[1]))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, the measures, base_failed and kept of every row of docs."""
    case = F.when(F.col("base_failed"), False)
    for rule, _, _ in order_rules(docs, text, rules):
        case = case.when(rule.rejects(_measured()), False)
    return measure(docs, key, text).withColumn("kept", case.otherwise(True)).drop("body")


def passes(text: Column, order: list[Rule]) -> Column:
    """Whether no rule rejects: a CASE stops at the first one that does."""
    body = F.coalesce(text, F.lit(""))

    def of(both: Column) -> Column:
        case, m = F.when(F.lit(False), False), _on_demand(body, both)
        for rule in order:
            case = case.when(rule.rejects(m), False)
        return case.otherwise(True)

    return let(_both(body), of)


def apply_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with their columns."""
    order = [r for r, _, _ in order_rules(docs, text, BASE + rules, on_demand=True)]
    return docs.filter(passes(F.col(f"`{text}`"), order))
