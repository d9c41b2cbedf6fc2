"""The engine's API over batches: health, config, classify, analyze, explain.

analyze() answers all inputs at once: claims, evidence from an index, stances, temporal checks, fusion and explanations,
each a join or aggregation by input. Ablations leave parts of the plan out.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.functions import scorers as C
from lexforge.functions import text as X
from lexforge.functions.dates import parse_date, years_named
from lexforge.functions.urls import domain_of, with_tier
from lexforge.operators import retrieve as R
from lexforge.operators import sentences as N
from lexforge.operators import serving as S
from lexforge.operators import verify as V
from lexforge.storage import materialize

TOP_CLAIMS, TEXT_CHARS, TITLE_CHARS, SAME_CLAIM, MIN_COSINE, INDEX_HITS, BODY_CHARS = 5, 20_000, 1000, 0.85, 0.55, 5, 2000


def health(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ok", spark.version, ",".join(sorted(C.SCORERS)))], "status string, spark string, scorers string")


def config(spark: SparkSession, cfg: V.Fusion | None = None) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in asdict(cfg or V.Fusion()).items()], "name string, value double")


def classify(inputs: DataFrame, model: S.LinearModel | S.WideModel | None = None, key: str = "input_id") -> DataFrame:
    """inputs with p_fake by a saved model, or by the registered classifier; one that is given stays."""
    if model is not None:
        whole = inputs.select(key, X.model_input(F.col("title"), F.col("text")).alias("text"))
        found = S.batch_scores(whole, key, "text", model, "fake").withColumnsRenamed({"key": "__key", "p": "__p"})
        joined = inputs.join(found, F.col(key) == F.col("__key"), "left")
        given = F.coalesce("p_fake", "__p") if "p_fake" in inputs.columns else F.col("__p")
        return joined.withColumn("p_fake", F.round(given, 4)).drop("__key", "__p")
    p = C.scorer("p_fake")(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    return inputs.withColumn("p_fake", F.coalesce("p_fake", p) if "p_fake" in inputs.columns else p)


def identify_claims(inputs: DataFrame, k: int = TOP_CLAIMS, known: list[str] | None = None) -> DataFrame:
    """(input_id, claim_no, claim, score, v, is_title): the title first, then the sentences most worth a check, near repeats left out.

    known: abbreviations of the corpus (sentences.abbreviations), by which texts are split; else a full stop and a blank always end a sentence.
    Headlines are one claim. Sentences under six words, questions and orders go, but a text of one sentence is kept with score 1.
    At most 4k candidates of an input are compared, in an array; no pairs leave their row.
    """
    body = F.substring(F.coalesce("text", F.lit("")), 1, TEXT_CHARS)
    title = X.stripped(F.coalesce("title", F.lit("")))
    headline = F.col("input_type") == "headline"
    sents = F.when(headline, F.array().cast("array<string>")).otherwise(X.sentences(body) if known is None else N.splitter(known)(body))
    own = inputs.select("input_id", F.when(headline, F.substring(F.when(title != "", title).otherwise(body), 1, TITLE_CHARS)).otherwise(title).alias("t"), sents.alias("s"))
    rows = own.select("input_id", F.size("s").alias("n"), F.posexplode(F.concat(F.array("t"), "s")).alias("i", "claim")).filter("claim <> ''")
    names, numbers = F.size(C.scorer("names")(F.col("claim"))) > 0, F.col("claim").rlike("[0-9]")
    score = F.when((F.col("i") == 0) | (F.col("n") == 1), F.lit(1.0)).otherwise(X.check_worthiness(F.col("claim"), F.col("i") - 1, names, numbers))
    good = (F.col("i") == 0) | (F.col("n") == 1) | ((X.n_tokens(F.col("claim")) >= 6) & ~F.trim("claim").endswith("?") & ~N.is_order(F.col("claim")))
    order = W.Window.partitionBy("input_id").orderBy((F.col("i") == 0).desc(), F.col("score").desc(), "i")
    ranked = rows.filter(good).withColumn("score", score).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 4 * k)
    item = F.struct("r", "claim", "score", (F.col("i") == 0).alias("is_title"), C.scorer("embed")(F.col("claim")).alias("v"))
    kept = ranked.groupBy("input_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    return kept.select("input_id", F.posexplode(R.greedy_dedupe(F.col("c"), SAME_CLAIM, k)).alias("p", "x")).select("input_id", (F.col("p") + 1).alias("claim_no"), "x.claim", "x.score", "x.is_title", "x.v")


def gather_evidence(claims: DataFrame, index: DataFrame, excluded: DataFrame | None = None, hits: int = INDEX_HITS, least: float = MIN_COSINE, limit: int = 10) -> DataFrame:
    """Evidence of each claim from an index (record_id, text, rating, url, source, date): nearest records, satire and leaked pages left out, best first."""
    own = claims.withColumn("query_id", F.xxhash64("input_id", "claim_no"))
    vectors = index.select("record_id", C.scorer("embed")(F.col("text")).alias("embedding"))
    top = R.vector_topk(vectors, own.select("query_id", F.col("v").alias("embedding")), hits, least)
    ev = own.select("input_id", "claim_no", "claim", "query_id").join(top, "query_id").join(index, "record_id")
    ev = with_tier(ev, "url").withColumnRenamed("weight", "w").withColumn("rating3", X.rating3(F.col("rating"))).withColumn("is_factcheck", F.col("rating").isNotNull())
    if excluded is not None:
        ev = R.leakage_guard(ev.withColumn("canonical", F.lit(None).cast("string")), excluded).filter("NOT leaked")
    return R.rank_evidence(ev.drop("rank"), ["input_id", "claim_no"], "record_id", limit)


def assign_stance(evidence: DataFrame, cfg: V.Fusion) -> DataFrame:
    s = C.scorer("stance")(F.col("text"), F.col("claim"))
    own = evidence.withColumn("s", s)
    best = V.argmax_stance(F.col("s.SUPPORTS"), F.col("s.REFUTES"), F.col("s.NEUTRAL"))
    own = own.withColumns({"nli_stance": best, "nli_p": F.greatest("s.SUPPORTS", "s.REFUTES", "s.NEUTRAL"), "p_neutral": F.col("s.NEUTRAL")})
    return V.stance_override(own, cfg).drop("s")


def headline_mismatch(inputs: DataFrame, cfg: V.Fusion | None = None, key: str = "input_id") -> DataFrame:
    """(key, mismatch_headline, mismatch_p) of the inputs that have both a title and a text: whether the text's beginning refutes its own title.

    Stance is scored once a row, and written: later expressions read its probabilities instead of scoring again.
    """
    title, body = (F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "text"))
    both = inputs.select(key, title.alias("title"), body.alias("text")).filter("title <> '' AND text <> ''")
    scored = materialize(both.select(key, "title", "text", C.scorer("stance")(F.substring("text", 1, BODY_CHARS), F.col("title")).alias("s")))
    flag, p = V.mismatch_headline(F.col("title"), F.col("text"), F.col("s"), cfg)
    return scored.select(key, flag.alias("mismatch_headline"), p.alias("mismatch_p"))


def analyze(inputs: DataFrame, index: DataFrame, cfg: V.Fusion | None = None, excluded: DataFrame | None = None, use_evidence: bool = True, use_temporal: bool = True, use_classifier: bool = True, least: float = MIN_COSINE, model: S.LinearModel | S.WideModel | None = None, known: list[str] | None = None) -> DataFrame:
    """A verdict for each input (input_id, input_type, title, text, url, published): rule, verdict, confidence, explanation, uncertainty, signals.

    model: a saved classifier in place of the registered one; known: abbreviations of the corpus.
    """
    cfg = cfg or V.Fusion()
    own = classify(inputs, model) if use_classifier else inputs.withColumn("p_fake", F.lit(None).cast("double"))
    own = with_tier(own, "url").withColumnRenamed("tier", "input_tier").drop("weight")
    whole = F.concat_ws(" ", "title", "text")
    own = own.withColumns({"english": C.scorer("english")(whole), "satire": F.col("url").isNotNull() & (F.col("input_tier") == 0), "recency_cue": X.has_recency_cue(whole), "input_date": parse_date(F.col("published")), "domain": domain_of(F.col("url"))})
    claims = identify_claims(own.filter("english AND NOT satire"), known=known)
    claims = materialize(claims)
    ev = materialize(assign_stance(gather_evidence(claims, index, excluded, least=least), cfg))  # both are read many times below
    if not use_evidence:
        ev = ev.limit(0)
    ev = ev.withColumn("date", parse_date(F.col("date")))
    signals = claims.select("input_id", "claim_no", "score").join(V.claim_signals(ev, ["input_id", "claim_no"], cfg), ["input_id", "claim_no"], "left").na.fill({"s": 0.0, "e": 0, "n_evidence": 0, "pw": 0.0, "quality": 0.0, "fc_match": False})
    per_input = V.input_signals(signals, "input_id", cfg.important_claim)
    main = claims.filter("claim_no = 1").select("input_id", "claim", F.array_max(years_named(F.col("claim"))).alias("claim_date"))
    main_ev = ev.filter("claim_no = 1")
    sources = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("stance") == side, F.struct("rank", "domain")))), lambda x: x.getField("domain"))
    summary = V.stance_summary(main_ev, ["input_id"]).join(main_ev.groupBy("input_id").agg(V.source_list(sources("SUPPORTS")).alias("sup_sources"), V.source_list(sources("REFUTES")).alias("ref_sources")), "input_id")
    check = main_ev.filter("is_factcheck AND rating3 = 'FALSE' AND stance = 'REFUTES'").groupBy("input_id").agg(F.min_by(F.struct(F.col("domain").alias("fc_source"), F.col("text").alias("fc_snippet"), F.col("cosine").alias("fc_cosine"), F.col("rating").alias("fc_rating")), "rank").alias("fc")).select("input_id", "fc.*")
    others = claims.filter("claim_no > 1").select("input_id", "claim_no", "claim").join(signals.select("input_id", "claim_no", "s", "e"), ["input_id", "claim_no"]).groupBy("input_id").agg(F.min_by(F.struct("claim", "e"), "s").alias("lo"), F.max_by("claim", "s").alias("supported_text")).select("input_id", F.col("lo.claim").alias("refuted_text"), F.col("lo.e").alias("refuted_n"), "supported_text")
    names = C.scorer("names")
    places = main_ev.withColumns({"claim_places": F.transform(names(F.col("claim")), F.lower), "places": F.transform(names(F.col("text")), F.lower), "claim_years": F.transform(years_named(F.col("claim")), lambda d: d.cast("string")), "years": F.transform(years_named(F.col("text")), lambda d: d.cast("string"))})
    out = own.join(main, "input_id", "left").join(per_input, "input_id", "left")
    for part in (summary, check, others, V.out_of_context(places, ["input_id"])):
        out = out.join(part, "input_id", "left")
    out = V.temporal(out, main_ev, ["input_id"], cfg).join(headline_mismatch(own, cfg), "input_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if use_temporal else F.lit(False)
    out = out.withColumns({"old_news": flag("old_news"), "out_of_context": flag("out_of_context"), "mismatch_headline": flag("mismatch_headline"), "mismatch_p": F.when(F.lit(use_temporal), F.col("mismatch_p"))}).na.fill(0, ["n_sup", "n_ref", "n_neu", "n_1"]).na.fill("", ["sup_sources", "ref_sources"])
    fused = V.fuse(out.withColumns(cfg.columns()))
    return V.uncertainty(V.explanation(V.reason(fused))).select("input_id", "rule", "verdict", "confidence", V.confidence_band(F.col("confidence")).alias("band"), "main_stance", "s_1", "e_1", "n_sup", "n_ref", "p_fake", "old_news", "gap_months", "mismatch_headline", "mismatch_p", "reason", "explanation", "uncertainty")


def explain(text: DataFrame, key: str, p_fake=None, words: int = 60) -> DataFrame:
    """(key, word, weight): how much the classifier's score falls when a word is left out, for the first words of each text."""
    score = p_fake or (lambda t: C.scorer("p_fake")(F.lit(""), t))
    own = text.select(F.col(key).alias("key"), "text", F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n]+"), lambda w: w != ""), 1, words).alias("ws"))
    rows = own.select("key", "ws", F.posexplode("ws").alias("i", "word"))
    without = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("i")), F.slice("ws", F.col("i") + 2, F.lit(words))), " ")
    return rows.select("key", "word", F.round(score(F.array_join("ws", " ")) - score(without), 4).alias("weight"))
