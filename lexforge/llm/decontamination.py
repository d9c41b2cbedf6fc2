"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

An item's windows are its runs of WINDOW consecutive words, or all its words where it has fewer. A window is a set of shingles
(SHINGLE consecutive words, or all of a shorter window) with their places, and a document holds it exactly if some stretch of
the window's size contains them all. So one shingle of each window, its prefix, is necessary for a match, and the rarest one
joins least: a first pass counts how often each shingle of the items occurs in all documents, and each window's prefix is the shingle
with the least count, of equals the first. A second pass joins the documents' shingles with the prefixes. Where a document's
shingle meets a prefix, the window can only begin so many words before it (positional bound), and must end by
the document's last word (length bound); then its words and those of the stretch there are compared one by one. So each occurrence is
found once and nothing else is.

Both passes read the texts once and keep them in place: words are exploded, hashed, joined and verified inside one stage.
Only what was found is shuffled, with one row for each document that has its number of words. Windows of several items
count once; the items are joined to what was found at the end.

Prefixes are broadcast if there are at most BROADCAST_WINDOWS windows of BROADCAST_BYTES in all. Beyond that, a bit table of bounded size
(BITS_MOST) sorts out nearly all shingles in place, and those left are shuffled to the prefixes with the words around them.

Defined cases: a null text has no words; an item without words has no window; an item without a key marks words but isn't counted
or listed; items that share a key count as one. Rows of one key and text share their matches (they are named by the key and a
hash of the text, so that no key is hot) and each row has its own result; null keys are kept. An empty table of documents gives an
empty table, one of items nothing found. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import materialize

WINDOW, SHINGLE = 10, 3
BROADCAST_WINDOWS, BROADCAST_BYTES, BITS_LEAST, BITS_MOST = 200_000, 32 << 20, 1 << 16, 1 << 26
#: A word, once A to Z are lower-cased: digits, a to z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))


def _shingle(own: Column, at: Column, k: int) -> Column:
    """The name of k words from a place on; its number of words is part of it."""
    return F.xxhash64(F.lit(k), *[F.get(own, at + j) for j in range(k)])


# ---- the items' side


def windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(win, words, size) of the distinct windows, and (win, item) of the items that have them; both written."""
    rows = items.select(items[key].cast("string").alias("item"), words(items[text]).alias("all")).filter(F.size("all") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0))))
    each = rows.select("item", "all", at.alias("at")).select("item", F.slice("all", F.col("at") + 1, F.lit(window)).alias("words")).distinct()
    each = materialize(each)
    distinct = materialize(each.select("words").distinct().select(F.monotonically_increasing_id().alias("win"), "words", F.size("words").alias("size")))
    return distinct, materialize(each.filter("item IS NOT NULL").join(distinct, "words").select("win", "item"))


def shingles(wins: DataFrame) -> DataFrame:
    """(win, at, token) of all shingles of windows."""
    parts = []
    for k in range(1, SHINGLE + 1):
        own = wins.filter(F.col("size") == k) if k < SHINGLE else wins.filter(F.col("size") >= k)
        places = own.select("win", "words", F.explode(F.sequence(F.lit(0), F.col("size") - k)).alias("at"))
        parts.append(places.select("win", "at", _shingle(F.col("words"), F.col("at"), k).alias("token")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _bits(tokens: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A bit table of tokens as one row with an array of 64-bit words, and its number of bits: at least eight for each token, if that is within the bounds."""
    width = min(max(BITS_LEAST, 1 << (8 * max(n, 1) - 1).bit_length()), BITS_MOST)
    place = F.pmod("token", F.lit(width))
    some = tokens.groupBy(F.shiftright(place, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(token, {width}) % 64 AS int))")).alias("b"))
    all_ = tokens.sparkSession.range(width // 64).select(F.col("id").alias("i")).join(some, "i", "left")
    row = all_.agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("b", F.lit(0)).alias("b")))).alias("x"))  # a bounded group
    return materialize(row.select(F.col("x.b").alias("bits"))), width


def _held(token: Column, table: DataFrame, width: int) -> Column:
    place = F.pmod(token, F.lit(width))
    return F.getbit(F.get(table.scalar(), F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1


# ---- the documents' side


def _exploded(docs: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """(key, th, words, n, p, token): a row for each shingle, and one with p = n for each document, whose token names the document."""
    rows = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("th"), words(docs[text]).alias("words"))
    each = rows.select("key", "th", "words", F.size("words").alias("n"), F.explode(F.sequence(F.lit(0), F.size("words"))).alias("p"))
    own = lambda k: F.when(F.col("p") + k <= F.col("n"), _shingle(F.col("words"), F.col("p"), k)).when(F.col("p") == F.col("n"), F.xxhash64("key", "th", F.lit(k)))
    if len(sizes) == 1:
        return each.withColumn("token", own(sizes[0])).filter("token IS NOT NULL")
    named = F.array(own(sizes[0]), *[F.when(F.col("p") < F.col("n"), own(k)) for k in sizes[1:]])
    return each.withColumn("token", F.explode(named)).filter("token IS NOT NULL")


def _few(wins: DataFrame) -> tuple[int, bool]:
    """The number of windows, and whether they may be broadcast."""
    n, size = wins.agg(F.count("*"), F.sum(F.length(F.array_join("words", " ")))).first()
    return n, n <= BROADCAST_WINDOWS and (size or 0) <= BROADCAST_BYTES


def prefixes(exploded: DataFrame, wins: DataFrame, n: int, few: bool) -> DataFrame:
    """(win, words, size, at, token): each window's necessary shingle, the rarest in the documents."""
    own = materialize(shingles(wins))
    tokens = own.select("token").distinct()
    asked = exploded.filter("p < n")
    if few:
        asked = asked.join(F.broadcast(tokens), "token", "left_semi")
    else:
        asked = asked.filter(_held(F.col("token"), *_bits(tokens, n * WINDOW)))
    counts = asked.groupBy("token").agg(F.count("*").alias("c"))
    ranked = own.join(materialize(counts), "token", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "at", "token")).alias("x"))  # of one window's shingles
    # where even the rarest one occurs nowhere, neither does the window
    return materialize(ranked.filter("x.c > 0").select("win", "x.at", "x.token").join(wins, "win"))


def matches(docs: DataFrame, wins: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, th, n, start, size, win) of every occurrence of a window, and a row without a window for each document."""
    sizes = [r[0] for r in wins.select(F.least("size", F.lit(SHINGLE))).distinct().collect()] or [SHINGLE]  # three at most
    exploded = _exploded(docs, key, text, sorted(sizes, reverse=True))
    n, few = _few(wins)
    found = prefixes(exploded, wins, n, few)
    prefix = found.select("win", "size", "at", F.col("token").alias("asked"), F.col("words").alias("window"))
    if few:
        met, base = exploded.join(F.broadcast(prefix), F.col("token") == F.col("asked"), "left"), F.lit(0)
    else:
        passed = exploded.filter((F.col("p") == F.col("n")) | _held(F.col("token"), *_bits(found.select("token"), n)))
        base = F.greatest(F.col("p") - window, F.lit(0))
        around = F.when(F.col("p") < F.col("n"), F.slice("words", base + 1, F.lit(2 * window)))
        met = passed.select("key", "th", around.alias("words"), "n", "p", "token").join(prefix, F.col("token") == F.col("asked"), "left")
    start = F.col("p") - F.col("at")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n"))
    same = F.when(fits, F.slice("words", start - base + 1, F.col("size")) == F.col("window")).otherwise(False)
    real = met.filter((F.col("p") == F.col("n")) | same)
    inner = F.col("p") < F.col("n")
    return real.select("key", "th", "n", *[F.when(inner, c).alias(a) for c, a in ((start, "start"), (F.col("size"), "size"), (F.col("win"), "win"))])


def _covered(spans: Column) -> Column:
    """How many words are in some span (start, size)."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        end = x.getField("start") + x.getField("size")
        fresh = F.greatest(end - F.greatest(x.getField("start"), a.getField("at")), F.lit(0))
        return F.struct(F.greatest(a.getField("at"), end).alias("at"), (a.getField("n") + fresh).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step, lambda a: a.getField("n"))


def _found(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, window: int) -> DataFrame:
    """(key, th, n_words, copies, spans, items) of every distinct row of docs."""
    wins, owners = windows(items, item_key, item_text, window)
    found = matches(docs, wins, key, text, window).groupBy("key", "th").agg(
        F.max("n").alias("n_words"), F.count_if(F.col("win").isNull()).alias("copies"), F.collect_set(F.when(F.col("win").isNotNull(), F.struct("start", "size"))).alias("spans"), F.collect_set("win").alias("wins")
    )  # of one document's words
    found = materialize(found)
    listed = found.select("key", "th", F.explode("wins").alias("win")).join(owners, "win").groupBy("key", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select(F.col("key").alias("k"), F.col("th").alias("t"), "items")
    joined = found.join(listed, F.col("key").eqNullSafe(F.col("k")) & F.col("th").eqNullSafe(F.col("t")), "left")
    return joined.select("key", "th", "n_words", "copies", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, spans array<struct<start, size>>, items array<string>) of every row of docs: the words that some
    occurrence of a window covers, the occurrences in words, and the items they are from."""
    found = _found(docs, items, key, text, item_key, item_text, window)
    own = found.select("key", F.col("n_words").cast("long"), _covered(F.col("spans")).cast("long").alias("n_hit"), F.array_sort("spans").alias("spans"), "items", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return own.drop("col")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window occurs, with all their columns."""
    hit = _found(docs, items, key, text, item_key, item_text, window).filter(F.size("spans") > 0).select(F.col("key").alias("hit_key"), F.col("th").alias("hit_th"))
    return docs.join(hit, docs[key].eqNullSafe(F.col("hit_key")) & F.xxhash64(docs[text]).eqNullSafe(F.col("hit_th")), "left_anti")
