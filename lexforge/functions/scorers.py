"""Pluggable scorers with deterministic defaults in column expressions.

A scorer is registered by name as a function of columns; a model is plugged in as a pandas UDF of the same signature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions import text as X
from lexforge.functions.vectors import normalised

DIM = 64
# Words that turn a statement round.
NEGATIONS = ["not", "no", "never", "none", "false", "fake", "hoax", "denied", "denies", "wrong", "incorrect", "untrue", "debunked"]


def hashed_embedding(text: Column) -> Column:
    """Unit vectors of DIM numbers: words are hashed to a place and a sign."""
    hashes = F.transform(X.without_stopwords(X.word_tokens(text)), lambda w: F.xxhash64(w))
    place = lambda h: F.pmod(h, F.lit(DIM))
    sign = lambda h: F.when(F.pmod(F.shiftright(h, 8), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    dense = X.let(hashes, lambda hs: F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.aggregate(F.filter(hs, lambda h: place(h) == i), F.lit(0.0), lambda a, h: a + sign(h))))
    return X.let(dense, normalised)


def lexical_stance(premise: Column, claim: Column) -> Column:
    """struct<SUPPORTS, REFUTES, NEUTRAL> of probabilities: the claim's words that the premise has, and whether just one of them negates."""
    words = lambda t: F.array_distinct(X.word_tokens(F.coalesce(t, F.lit(""))))
    content = lambda w: F.filter(X.without_stopwords(w), lambda x: ~x.isin(NEGATIONS))

    def of(both: Column) -> Column:
        p, c = both.getItem(0), both.getItem(1)
        share = F.coalesce(F.try_divide(F.size(F.array_intersect(content(p), content(c))), F.size(content(c))), F.lit(0.0))
        negated = lambda w: F.exists(w, lambda x: x.isin(NEGATIONS))
        turned = negated(p) != negated(c)
        sides = F.when(share >= 0.5, share * 0.9).otherwise(share * 0.4)
        return F.struct(F.when(turned, F.lit(0.05)).otherwise(sides).alias("SUPPORTS"), F.when(turned, sides).otherwise(F.lit(0.05)).alias("REFUTES"), F.greatest(0.95 - sides, F.lit(0.0)).alias("NEUTRAL"))

    return X.let(F.array(words(premise), words(claim)), of)


def style_p_fake(title: Column, text: Column) -> Column:
    """A probability from capitals, exclamation marks and the length of sentences."""
    whole = F.concat_ws(" ", title, text)
    s = X.style(whole)
    n = F.greatest(s["n_tokens"], F.lit(1))
    z = F.lit(-1.0) + 30 * (s["n_exclaim"] / n) + 20 * (s["n_caps"] / n)
    return F.round(1 / (1 + F.exp(-z)), 4)


def strong_names(text: Column) -> Column:
    """Capitalised words inside a sentence, standing for named entities."""
    return F.regexp_extract_all(text, F.lit(r"(?<=[a-z,;] )([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), F.lit(1))


#: Function words of the other languages that a fallback tells from English.
FOREIGN = "de la el los las que y en un una le les des du et est dans pour der die das und ist nicht mit von zu ein eine il che per non sono con o os uma para".split()


def english(text: Column) -> Column:
    """looks_english, or plain ASCII with fewer foreign function words than one in ten."""
    head = F.substring(text, 1, 500)
    foreign = F.size(F.filter(X.word_tokens(head), lambda w: w.isin(FOREIGN)))
    return X.looks_english(text) | (head.rlike(r"^[\x00-\x7F]*$") & (10 * foreign < X.n_tokens(head)))


SCORERS: dict[str, Callable[..., Column]] = {"embed": hashed_embedding, "stance": lexical_stance, "p_fake": style_p_fake, "names": strong_names, "english": english}


def scorer(name: str) -> Callable[..., Column]:
    return SCORERS[name]


def register(name: str, fn: Callable[..., Column]) -> None:
    SCORERS[name] = fn
