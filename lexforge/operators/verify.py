"""Claim verification over batches: stance overrides, temporal checks, signals, fusion, confidence, explanations, tuning.

The rule table is one ordered CASE over per-input aggregates. Evidence is reduced to a row for each claim, then for each
input; thresholds are columns, so that a grid of them is a small join after the reduction.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import dates as D
from lexforge.operators import orderstats as O


# Thresholds of fusion and temporal checks.
@dataclass(frozen=True)
class Fusion:
    tau: float = 0.8
    min_evidence: int = 3
    reliable_weight: float = 0.5
    important_claim: float = 0.6
    factcheck_match_cosine: float = 0.75
    factcheck_p: float = 0.95
    tiebreak_fake: float = 0.85
    tiebreak_real: float = 0.15
    clf_agree_fake: float = 0.7
    clf_agree_real: float = 0.3
    clf_adj: float = 0.10
    conf_min: float = 0.05
    conf_max: float = 0.98
    satire_confidence: float = 0.9
    months: float = 6.0
    mismatch_p: float = 0.7
    max_evidence: int = 10

    def columns(self) -> dict[str, Column]:
        return {f"cfg_{f.name}": F.lit(getattr(self, f.name)) for f in fields(self)}


def configs(spark: SparkSession, many: list[Fusion]) -> DataFrame:
    """(cfg, cfg_*): a row for each configuration."""
    names = [f.name for f in fields(Fusion)]
    rows = [(k, *(float(getattr(c, n)) for n in names)) for k, c in enumerate(many)]
    return spark.createDataFrame(rows, "cfg int, " + ", ".join(f"cfg_{n} double" for n in names))


def grid(taus: list[float], least: list[int], months: list[float]) -> list[Fusion]:
    return [Fusion(tau=t, min_evidence=m, months=n) for t in taus for m in least for n in months]


# ---- stance


def stance_override(evidence: DataFrame, cfg: Fusion | None = None) -> DataFrame:
    """stance and p of evidence items (nli_stance, nli_p, p_neutral, is_factcheck, rating3, cosine) after ratings are heeded."""
    cfg = cfg or Fusion()
    rated = F.coalesce(F.col("is_factcheck"), F.lit(False)) & F.col("rating3").isNotNull()
    restates = (F.col("nli_stance") == "SUPPORTS") | ((F.col("nli_stance") != "REFUTES") & (F.col("cosine") >= cfg.factcheck_match_cosine))
    negates = (F.col("nli_stance") == "REFUTES") & (F.col("rating3") != "TRUE")
    by_rating = F.when(F.col("rating3") == "TRUE", "SUPPORTS").when(F.col("rating3") == "FALSE", "REFUTES").otherwise("NEUTRAL")
    stance = F.when(rated & restates, by_rating).when(rated & negates, "NEUTRAL").otherwise(F.col("nli_stance"))
    p = F.when(rated & restates, cfg.factcheck_p).when(rated & negates, F.col("p_neutral")).otherwise(F.col("nli_p"))
    return evidence.withColumn("stance", stance).withColumn("p", F.round(p, 4))


def argmax_stance(supports: Column, refutes: Column, neutral: Column) -> Column:
    """The most probable stance; of equals the first in this order."""
    top = F.greatest(supports, refutes, neutral)
    return F.when(supports == top, "SUPPORTS").when(refutes == top, "REFUTES").otherwise("NEUTRAL")


def softmax(logits: Column) -> Column:
    """Probabilities of logits, as an array."""
    shifted = lambda x: F.transform(x, lambda z: F.exp(z - F.array_max(x)))
    return F.transform(shifted(logits), lambda e: e / F.aggregate(shifted(logits), F.lit(0.0), lambda a, y: a + y))


# ---- temporal


def temporal(claims: DataFrame, evidence: DataFrame, keys: list[str], cfg: Fusion | None = None) -> DataFrame:
    """keys, gap_months, event_date, old_news, date_conflict of claims (keys, input_date, claim_date, recency_cue) by their supporting evidence's dates.

    The gap is compared rounded, the claim's own date unrounded.
    """
    cfg = cfg or Fusion()
    dated = O.median_low(evidence.filter(F.col("stance") == "SUPPORTS").select(*keys, F.col("date").alias("event_date")), keys, "event_date")
    out = claims.join(dated, keys, "left")
    gap = F.round(D.months_between(F.col("input_date"), F.col("event_date")), 1)
    conflict = F.coalesce(D.months_between(F.col("claim_date"), F.col("event_date")) >= cfg.months, F.lit(False))
    out = out.withColumn("gap_months", gap).withColumn("date_conflict", conflict)
    old = F.coalesce(F.col("recency_cue") & (F.col("gap_months") >= cfg.months), F.lit(False)) | F.col("date_conflict")
    return out.withColumn("old_news", old)


def names_conflict(claim: Column, passage: Column) -> Column:
    """Both name something and nothing of the one is part of anything of the other."""
    overlap = F.exists(claim, lambda a: F.exists(passage, lambda b: F.contains(b, a) | F.contains(a, b)))
    return (F.size(claim) > 0) & (F.size(passage) > 0) & ~overlap


def mismatch_headline(title: Column, body: Column, stance: Column, cfg: Fusion | None = None) -> tuple[Column, Column]:
    """(flag, p): whether the body refutes its own headline with enough probability, and that probability where it refutes at all.

    stance: struct of probabilities of the body's first 2,000 characters towards the title. Inputs without both, or with
    the same text in both, never mismatch.
    """
    cfg = cfg or Fusion()
    none = F.lit("")
    t, b = (F.trim(F.coalesce(x, none)) for x in (title, body))
    supports, refutes, neutral = (stance.getField(x) for x in ("SUPPORTS", "REFUTES", "NEUTRAL"))
    refuted = (t != "") & (b != "") & (t != b) & (argmax_stance(supports, refutes, neutral) == "REFUTES")
    p = F.when(refuted, F.round(refutes, 4))
    return F.coalesce(refuted & (refutes >= cfg.mismatch_p), F.lit(False)), p


def out_of_context(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """keys, out_of_context: two or more supporting passages conflict with the claim in places or years."""
    conflict = names_conflict(F.col("claim_places"), F.col("places")) | names_conflict(F.col("claim_years"), F.col("years"))
    return evidence.filter(F.col("stance") == "SUPPORTS").groupBy(*keys).agg((F.count_if(conflict) >= 2).alias("out_of_context"))


# ---- fusion


def signed(stance: Column, p: Column, w: Column) -> Column:
    return F.when(stance == "SUPPORTS", p * w).when(stance == "REFUTES", -p * w).otherwise(F.lit(0.0))


def claim_signals(evidence: DataFrame, keys: list[str], cfg: Fusion | None = None) -> DataFrame:
    """keys, s (unrounded), e, n_evidence, pw, quality, fc_match of each claim: one shuffle by keys."""
    cfg = cfg or Fusion()
    takes_side = F.col("stance") != "NEUTRAL"
    match = F.coalesce(F.col("is_factcheck") & (F.col("tier") == 1) & (F.col("rating3") == "FALSE") & (F.col("stance") == "REFUTES") & (F.col("cosine") >= cfg.factcheck_match_cosine), F.lit(False))
    return evidence.groupBy(*keys).agg(
        F.sum(signed(F.col("stance"), F.col("p"), F.col("w"))).alias("s"),
        F.count_if(takes_side & (F.col("w") >= cfg.reliable_weight)).alias("e"),
        F.count("*").alias("n_evidence"),
        F.sum(F.col("p") * F.col("w")).alias("pw"),
        F.coalesce(F.avg(F.when(takes_side, F.col("w"))), F.lit(0.0)).alias("quality"),
        F.max(match).alias("fc_match"),
    )


def input_signals(claims: DataFrame, key: str, important: float = 0.6) -> DataFrame:
    """One row an input: the main claim's signals and the others as an array of (s, e), rounded, of the important ones."""
    main = lambda c: F.max(F.when(F.col("claim_no") == 1, F.col(c)))
    other = (F.col("claim_no") > 1) & (F.col("score") >= important)
    return claims.groupBy(key).agg(
        main("s").alias("s_raw"), main("e").alias("e_1"), main("n_evidence").alias("n_1"), main("pw").alias("pw_1"), main("quality").alias("quality_1"), main("fc_match").alias("fc_match"),
        F.collect_list(F.when(other, F.struct(F.round("s", 4).alias("s"), F.col("e").alias("e")))).alias("others"),
    )


def fuse(inputs: DataFrame) -> DataFrame:
    """inputs with main_stance, rule, verdict, confidence.

    inputs: one row for each input and configuration with input_signals' columns, english, satire, old_news, out_of_context,
    mismatch_headline, p_fake (nullable) and the cfg_* columns. The first rule that holds decides.
    """
    c = F.col
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    out = inputs.withColumn("s_1", F.round(F.coalesce(c("s_raw"), F.lit(0.0)), 4)).withColumn("e_1", zero("e_1"))
    raw = F.coalesce(c("s_raw"), F.lit(0.0))
    out = out.withColumn("main_stance", F.when(raw >= c("cfg_tau"), "SUPPORTS").when(raw <= -c("cfg_tau"), "REFUTES").otherwise("NEUTRAL"))
    enough = c("e_1") >= c("cfg_min_evidence")
    others = F.coalesce(c("others"), F.array().cast("array<struct<s:double,e:bigint>>"))
    against = F.exists(others, lambda x: (x.getField("s") <= -c("cfg_tau")) & (x.getField("e") >= c("cfg_min_evidence")))
    for_ = F.exists(others, lambda x: (x.getField("s") >= c("cfg_tau")) & (x.getField("e") >= c("cfg_min_evidence")))
    flagged = F.coalesce(c("old_news") | c("out_of_context") | c("mismatch_headline"), F.lit(False))
    side = c("main_stance")
    rule = (
        F.when(~c("english"), "LANG").when(c("satire"), "R0").when(c("e_1") == 0, "R1").when(F.coalesce(c("fc_match"), F.lit(False)), "R2")
        .when((side == "REFUTES") & enough, "R3").when((side == "SUPPORTS") & flagged, "R4").when((side == "SUPPORTS") & against, "R5")
        .when((side == "NEUTRAL") & for_ & against, "R6").when((side == "SUPPORTS") & enough, "R7").when((side != "NEUTRAL") & (c("e_1") == 1), "R8").otherwise("R9")
    )
    out = out.withColumn("rule", rule)
    broken_tie = F.when((side == "REFUTES") & (c("p_fake") >= c("cfg_tiebreak_fake")), "FAKE").when((side == "SUPPORTS") & (c("p_fake") <= c("cfg_tiebreak_real")), "REAL").otherwise("UNVERIFIABLE")
    verdict = F.when(c("rule").isin("R0", "R2", "R3"), "FAKE").when(c("rule") == "R4", "MISLEADING").when(c("rule").isin("R5", "R6"), "PARTIALLY TRUE").when(c("rule") == "R7", "REAL").when(c("rule") == "R8", broken_tie).otherwise("UNVERIFIABLE")
    out = out.withColumn("verdict", verdict)
    agreement = F.abs(c("s_1")) / (F.coalesce(c("pw_1"), F.lit(0.0)) + F.lit(1e-6))
    base = 0.5 * agreement + 0.3 * (F.least(c("e_1"), F.lit(4)) / F.lit(4.0)) + 0.2 * F.coalesce(c("quality_1"), F.lit(0.0))
    fake, real = c("p_fake") >= c("cfg_clf_agree_fake"), c("p_fake") <= c("cfg_clf_agree_real")
    adjust = F.when(((c("verdict") == "FAKE") & fake) | ((c("verdict") == "REAL") & real), c("cfg_clf_adj")).when(((c("verdict") == "FAKE") & real) | ((c("verdict") == "REAL") & fake), -c("cfg_clf_adj")).otherwise(F.lit(0.0))
    confidence = F.when(c("rule") == "LANG", F.lit(0.8)).when(c("rule") == "R0", c("cfg_satire_confidence")).when(c("verdict") == "UNVERIFIABLE", 1 - F.greatest(agreement, F.lit(0.2))).otherwise(F.least(F.greatest(base + adjust, c("cfg_conf_min")), c("cfg_conf_max")))
    return out.withColumn("confidence", F.round(confidence, 4))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence < 0.5, "Low").when(confidence <= 0.75, "Medium").otherwise("High")


# ---- explanations

# The sentences of explanations and uncertainty notes.
REASONS = {
    "LANG": "English-only in this version.",
    "R0": "The input originates from a satire / known-hoax site.",
    "R1": "No reliable evidence for or against the main claim was found. This does not mean the claim is false.",
    "R5": "The main claim is supported, but another important claim is refuted.",
    "R6": "The important claims are split: some supported, some refuted.",
    "R9": "The evidence is inconclusive.",
}
NO_EVIDENCE = "We could not find reliable evidence either way. This does not mean the claim is false."
ONE_SOURCE = "Only one reliable source was found; this result could change as more coverage appears."
RETRIEVED_ONLY = "Based on the retrieved evidence only; evidence dates are shown where known."


def reason(fused: DataFrame) -> DataFrame:
    """fused with reason. fc_source names the fact-checker of R2, where it is known."""
    c = F.col
    checker = F.coalesce("fc_source", F.lit("Tier-1")) if "fc_source" in fused.columns else F.lit("Tier-1")
    n = c("e_1").cast("string")
    flags = F.concat_ws(", ", F.when(c("old_news"), "old news"), F.when(c("out_of_context"), "out of context"), F.when(c("mismatch_headline"), "mismatch headline"))
    tie = F.when(c("verdict") == "FAKE", "One reliable source refutes the main claim; the style classifier breaks the tie.").when(c("verdict") == "REAL", "One reliable source supports the main claim; the style classifier breaks the tie.").otherwise("Only one source was found; this result could change as more coverage appears.")
    case = F.when(c("rule") == "R3", F.concat(n, F.lit(" reliable sources contradict the main claim."))).when(c("rule") == "R4", F.concat(F.lit("The main claim is supported, but "), flags, F.lit(" was detected.")))
    case = case.when(c("rule") == "R2", F.concat(F.lit("A fact-checker ("), checker, F.lit(") rates a matching claim as false.")))
    case = case.when(c("rule") == "R7", F.concat(n, F.lit(" reliable sources support the main claim."))).when(c("rule") == "R8", tie)
    for rule, words in REASONS.items():
        case = case.when(c("rule") == rule, words)
    return fused.withColumn("reason", case)


def quoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[.]+$", "")


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def source_list(names: Column) -> Column:
    """The first three distinct names, and how many more."""
    d = F.array_distinct(names)
    return F.concat(F.array_join(F.slice(d, 1, 3), ", "), F.when(F.size(d) > 3, F.concat(F.lit(" +"), (F.size(d) - 3).cast("string"), F.lit(" more"))).otherwise(""))


def explanation(fused: DataFrame) -> DataFrame:
    """fused with explanation. Needs claim, n_sup, n_ref, sup_sources, ref_sources, summary, refuted_text, refuted_n, supported_text, event_date, input_date, gap_months, mismatch_p, domain."""
    c, cat = F.col, lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else F.coalesce(y.cast("string"), F.lit("")) for y in x])
    claim = cat('"', quoted(c("claim")), '"')
    shown = c("p_fake").cast("string")
    temporal_ = F.concat(
        F.when(c("old_news"), cat(" the supporting reports are dated ", c("event_date"), " while the input is dated ", c("input_date"), " (", c("gap_months"), " months apart)")).otherwise(""),
        F.when(c("out_of_context"), " the places or years in the claim do not match those in the supporting reports").otherwise(""),
        F.when(c("mismatch_headline"), cat(" the article body contradicts its own headline (NLI p = ", c("mismatch_p"), ")")).otherwise(""),
    )
    sources = F.when(c("sup_sources") != "", c("sup_sources")).otherwise(c("ref_sources"))
    tie = F.when(c("verdict") == "UNVERIFIABLE", cat("; the writing-style classifier", F.when(c("p_fake").isNotNull(), cat(" (p_fake = ", shown, ")")).otherwise(""), " is not decisive, so the result stays UNVERIFIABLE")).otherwise(cat("; the writing-style classifier (p_fake = ", shown, ") breaks the tie, giving ", c("verdict")))
    texts = {
        "LANG": F.lit("Marked UNVERIFIABLE: this version only analyses English text."),
        "R0": cat("Marked FAKE because the input comes from a satire / known-hoax site", F.when(c("domain") != "", cat(" (", c("domain"), ")")).otherwise(""), "."),
        "R1": cat("Marked UNVERIFIABLE because no reliable evidence for or against ", claim, " was found", F.when(c("n_1") > 0, cat(" (", plural(c("n_1"), "retrieved item"), ", none taking a side)")).otherwise(""), "."),
        "R2": cat("Marked FAKE because ", c("fc_source"), ' rated a matching statement ("', quoted(c("fc_snippet")), '", similarity ', F.format_string("%.2f", c("fc_cosine")), ') as "', c("fc_rating"), '".'),
        "R3": cat("Marked FAKE because ", c("n_ref"), " reliable sources (", c("ref_sources"), ") contradict ", claim, "."),
        "R4": cat("Marked MISLEADING: ", claim, " is supported by ", plural(c("n_sup"), "source"), ", but", temporal_, "."),
        "R5": cat("Marked PARTIALLY TRUE: the main claim ", claim, " is supported by ", plural(c("n_sup"), "source"), ', but "', quoted(c("refuted_text")), '" is contradicted by ', plural(c("refuted_n"), "source"), "."),
        "R6": cat('Marked PARTIALLY TRUE: the important claims are split - "', quoted(c("supported_text")), '" is supported, while "', quoted(c("refuted_text")), '" is contradicted.'),
        "R7": cat("Marked REAL because ", c("n_sup"), " reliable sources (", c("sup_sources"), ") support ", claim, "."),
        "R8": cat("Only one reliable source (", sources, ") ", F.when(c("n_sup") > 0, "supports").otherwise("contradicts"), " ", claim, tie, "."),
        "R9": cat("Marked UNVERIFIABLE: the evidence about ", claim, " is inconclusive (", c("summary"), ")."),
    }
    case = F.lit(None).cast("string")
    for rule, text in texts.items():
        case = F.when(c("rule") == rule, text).otherwise(case)
    return fused.withColumn("explanation", case)


def uncertainty(fused: DataFrame) -> DataFrame:
    """fused with uncertainty: never empty."""
    c = F.col
    old = F.concat(F.lit("The underlying event is verified, but the supporting reports date from "), c("event_date").cast("string"), F.lit(", "), c("gap_months").cast("string"), F.lit(" months before this input."))
    text = F.when(c("verdict") == "UNVERIFIABLE", NO_EVIDENCE).when(c("e_1") == 1, ONE_SOURCE).when(c("old_news"), F.coalesce(old, F.lit(RETRIEVED_ONLY))).otherwise(RETRIEVED_ONLY)
    return fused.withColumn("uncertainty", text)


def stance_summary(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_sup, n_ref, n_neu, summary."""
    count = lambda s: F.count_if(F.col("stance") == s)
    own = evidence.groupBy(*keys).agg(count("SUPPORTS").alias("n_sup"), count("REFUTES").alias("n_ref"), count("NEUTRAL").alias("n_neu"))
    return own.withColumn("summary", F.format_string("%d supporting, %d refuting, %d neutral", "n_sup", "n_ref", "n_neu"))
