"""Text functions as column expressions. Patterns are given so that Java, RE2 and Python agree unless a note says otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Cue patterns, word lists and thresholds of the claim and stance heuristics.
REPORTING = r"\b(said|says|announced|confirmed|claimed|claims|reported|according to|stated)\b"
OPINION = r"\b(i think|i believe|we believe|in my opinion|should|must|ought to)\b"
HEDGE = r"\b(may|might|could|perhaps|possibly)\b"
NUMBERS = r"[0-9]|\b(more|less|fewer|higher|lower|most|least|biggest|largest|smallest)\b|[A-Za-z0-9_]+er than\b"
RECENCY_CUES = ["breaking", "just in", "just now", "moments ago", "today", "this morning", "tonight", "right now", "happening now", "live"]
RATING_FALSE = r"false|pants on fire|fake|fabricated|incorrect|hoax|scam|no evidence"
RATING_TRUE = r"^(true|correct|accurate|mostly true)\b"
REVIEW_TRUE = ["true", "mostly true", "correct", "accurate", "correct attribution"]
REVIEW_FALSE = ["false", "pants on fire", "pants on fire!", "fake", "fabricated", "scam", "hoax", "satire", "labeled satire"]
REVIEW_NONE = r"unproven|unverified|unfounded|no proof|no evidence|no reports|not official|what we know|research in progress|legend|explainer"
QUOTES = {"‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "−": "-", "…": "...", " ": " "}

#: Function words of English, for the stop-word ratio and for n-grams.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should "
    "so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: what a lambda refers to outside would be computed again for every element."""
    return F.transform(F.array(value), body).getItem(0)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation, for which Spark has no function."""
    return texts.str.normalize("NFKC")


@F.pandas_udf(StringType())
def unaccented(texts: pd.Series) -> pd.Series:
    """Without combining marks, in the compatibility form, for which Spark has no function."""
    return texts.str.normalize("NFKD").map(lambda t: t if t is None or t.isascii() else "".join(c for c in t if not unicodedata.combining(c)))


def unquoted(text: Column) -> Column:
    """Typographic quotes, dashes and the hard space in their plain forms."""
    one = {k: v for k, v in QUOTES.items() if len(v) == 1}
    out = F.translate(text, "".join(one), "".join(one.values()))
    for k, v in QUOTES.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def normalised(text: Column, compatibility: bool = True) -> Column:
    """Compatibility form, plain quotes, single blanks, no blanks around line ends, trimmed."""
    out = unquoted(nfkc(text) if compatibility else text)
    out = F.regexp_replace(out, r"[ \t\r\f\x0B]+", " ")
    out = F.regexp_replace(out, r"[ \t\n\r\f\x0B]*\n[ \t\n\r\f\x0B]*", "\n")
    return stripped(out)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+"))


def dedup_key(text: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def key_hash(text: Column) -> Column:
    return F.sha1(dedup_key(text))


def word_key(text: Column) -> Column:
    """The key of corpus comparison: all but letters, digits and underscores of any script as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def key_words(text: Column) -> Column:
    return F.filter(F.split(dedup_key(text), " "), lambda w: w != "")


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct runs of k words; fewer words make one shingle of all of them."""
    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        return F.when(F.size(w) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return let(words, of)


def hashed_shingles(words: Column, k: int = 5) -> Column:
    """The shingles as distinct 64-bit hashes of their words, without strings of their own."""
    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))
        return F.when(F.size(w) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def sentences(text: Column) -> Column:
    """Split after a full stop, exclamation or question mark and white space; empty parts go."""
    return F.filter(F.split(text, r"(?<=[.!?])[ \t\n\r\f\x0B]+"), lambda s: s != "")


def word_tokens(text: Column) -> Column:
    """Lower-case words of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def without_stopwords(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def telling(words: Column) -> Column:
    """Words without function words, numbers and words of two letters or fewer."""
    return F.filter(words, lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 2) & ~w.rlike("^[0-9_]+$"))


def ngrams(words: Column, n: int) -> Column:
    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<string>"))

    return let(words, of)


def style(text: Column) -> dict[str, Column]:
    """Counts that style measures divide."""
    return {
        "n_tokens": n_tokens(text),
        "n_exclaim": F.regexp_count(text, F.lit("!")),
        "n_question": F.regexp_count(text, F.lit(r"[?]")),
        "n_caps": F.regexp_count(text, F.lit(r"\b[A-Z]{3,}\b")),
        "n_sentences": F.regexp_count(text, F.lit(r"[.!?]+(?:[ \t\n\r\f\x0B]|$)")),
        "n_syllables": F.regexp_count(F.lower(text), F.lit("[aeiouy]+")),
    }


def capital_share(title: Column) -> Column:
    """The share of capitals among the letters of A to Z."""
    return F.regexp_count(title, F.lit("[A-Z]")) / F.greatest(F.regexp_count(title, F.lit("[A-Za-z]")), F.lit(1))


def mostly_capitals(title: Column) -> Column:
    """Whether half the letters or more are capitals; no letters, no capitals."""
    letters = F.regexp_count(title, F.lit("[A-Za-z]"))
    return (letters > 0) & (2 * F.regexp_count(title, F.lit("[A-Z]")) >= letters)


def flesch(tokens: Column, sents: Column, syllables: Column) -> Column:
    one = F.lit(1)
    return F.lit(206.835) - F.lit(1.015) * (tokens / F.greatest(sents, one)) - F.lit(84.6) * (syllables / F.greatest(tokens, one))


def has_recency_cue(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\b(" + "|".join(RECENCY_CUES) + r")\b"), F.lit(False))


def rating3(text: Column) -> Column:
    """A rating in words as TRUE, FALSE or MIXED; null if there is none."""
    t = F.trim(text)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(None)).when(t.rlike("(?i)" + RATING_TRUE), "TRUE").when(t.rlike("(?i)" + RATING_FALSE), "FALSE").otherwise("MIXED")


def review_rating3(text: Column) -> Column:
    """The rating of a structured review; ratings that only note missing evidence are null."""
    name = F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[.!]+$", ""))
    first = F.regexp_replace(F.split(name, r"[ \t\n]+").getItem(0), r"^[.,:;!]+|[.,:;!]+$", "")
    return F.when((name == "") | name.rlike(REVIEW_NONE), F.lit(None)).when(name.isin(REVIEW_TRUE), "TRUE").when(name.isin(REVIEW_FALSE) | first.isin("false", "fake"), "FALSE").otherwise("MIXED")


def looks_english(text: Column) -> Column:
    """At least a fifth of the words of the first 500 characters are English function words, or the text is short and ASCII."""
    head = F.substring(text, 1, 500)
    words = F.filter(F.split(F.lower(head), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.regexp_replace(w, r"^[.,!?;:\"']+|[.,!?;:\"']+$", "").isin(STOPWORDS)))
    return (F.size(words) == 0) | (hits >= 0.2 * F.size(words)) | ((F.size(words) < 10) & head.rlike(r"^[\x00-\x7F]*$"))


def check_worthiness(text: Column, position: Column, strong: Column, numeric: Column) -> Column:
    """A sentence's score between 0 and 1; strong and numeric tell whether it names entities of those kinds."""
    low = F.lower(text)
    flag = lambda c, weight: F.when(c, F.lit(weight)).otherwise(F.lit(0.0))
    h = flag(strong, 1.0) + flag(numeric, 0.8) + flag(low.rlike(REPORTING), 0.6) + flag(position < 3, 0.5) + flag(low.rlike(NUMBERS), 0.4) - flag(low.rlike(OPINION), 0.8) - flag(low.rlike(HEDGE), 0.5)
    return F.round(F.least(F.greatest(h / F.lit(3.3), F.lit(0.0)), F.lit(1.0)), 4)


def detokenised(text: Column) -> Column:
    """Bracket and quote tokens of treebank text in plain form, without blanks before punctuation."""
    # The treebank's escapes.
    for token, plain in (("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "["), ("-RSB-", "]"), ("-COLON-", ":"), ("``", '"'), ("''", '"')):
        text = F.replace(text, F.lit(token), F.lit(plain))
    text = F.regexp_replace(text, r" ([.,;:!?%)\]])", "$1")
    text = F.regexp_replace(text, r"([(\[]) ", "$1")
    return F.regexp_replace(text, r" ('(?:s|re|ve|ll|d|m)|n't)\b", "$1")


def model_input(title: Column, text: Column) -> Column:
    """What classifiers read: the title, a line end and the text, without white space around."""
    none = F.lit("")
    return stripped(F.concat(stripped(F.coalesce(title, none)), F.lit("\n"), F.coalesce(text, none)))


def first_words(text: Column, n: int = 15) -> Column:
    """The first n words: what a search engine is asked."""
    return F.array_join(F.slice(F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != ""), 1, n), " ")


def keyword_query(text: Column) -> Column:
    """The distinct words that are no function words, in their order; the text itself if there are none."""
    found = F.array_join(F.array_distinct(without_stopwords(word_tokens(text))), " ")
    return F.when(found != "", found).otherwise(text)


#: Bounds of the sentences that may be quoted as evidence, and how many of a page are looked at.
SENTENCE_LEAST, SENTENCE_MOST, SENTENCES = 25, 600, 200


def quotable_sentences(text: Column) -> Column:
    """The first SENTENCES sentences of SENTENCE_LEAST to SENTENCE_MOST characters, trimmed."""
    trimmed = F.transform(sentences(text), stripped)
    return F.slice(F.filter(trimmed, lambda s: F.length(s).between(SENTENCE_LEAST, SENTENCE_MOST)), 1, SENTENCES)


# Words that would show that a source's marks survived the preparation.
LEAK_WORDS = (
    "reuters", "featured", "image", "getty", "pic", "twitter", "com", "http", "https", "www",
    "video", "via", "wire", "21st", "century", "21wire", "read", "images", "ap", "afp", "bbc", "cnn",
    "breitbart", "follow", "photo", "screenshot", "screengrab", "york times", "nytimes", "politico",
)


def leaks(term: Column) -> Column:
    """Whether a word of a term is a leak word. Terms are split at blanks, so an entry of two words never holds."""
    return F.arrays_overlap(F.split(F.lower(term), r"[ \t\n]+"), F.array(*map(F.lit, LEAK_WORDS)))
