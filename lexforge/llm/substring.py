"""Substring dedup by recompression.

Words are level-0 symbols. A first round names runs of equal symbols; further rounds name pairs: each round deals all
symbols to a left and a right class by a hash of their name, and a left symbol followed by a right one becomes one
symbol. Names are hashes of what they stand for (64 bits, and 64 others for what verifies), so every Spark task gives equal things equal names
without an exchange, and equal substrings get the same symbols inside, away from their ends. With each symbol goes its
context: the stretch of words that its being there depends on. Rounds go on until all contexts are longer.

A window of WINDOW words is known by an anchor: of the symbols inside it whose context is half a window or less, on the highest level that
has one, that of the least name. Equal windows have equal anchors. The work goes in four steps:

1. Every run of windows with the same anchor gives one row (anchor, stretch, document, windows); the stretch is a
   fingerprint of all words that the run's windows cover.
2. Anchors that occur once are dropped: their windows occur once.
3. Of equal stretches (of one anchor and one fingerprint, two hashes of different bases) all but the first are marked as
   a whole. Windows of the first ones can only recur where an anchor has two or more different stretches; those are
   verified window by window with 128-bit fingerprints, both halves of names of their own, and all but the first occurrence of each are marked.
4. Words covered by marked windows are removed.

All steps deal by anchor, fingerprint or document, with counts combined before the exchange and joins whose
skewed side can be split; nothing is capped, and copies are never paired with each other.

A document is named by its key and a hash of its text, so that no key, null or other, is hot.

Defined cases: null and empty texts, and those shorter than a window, lose nothing. Order is by key, nulls first. Rows
that share a key are in order of their texts' hashes; equal rows count as one document and fare alike. An
empty table gives an empty table; in apply_dedup() all columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import discard, materialize, slices

WINDOW, SLICE_CHARS = 20, 2 << 20
#: Beyond any round: each one lengthens a context by a word at least.
LEVELS = 64
#: A symbol is an anchor if its context is a REACH-th of a window or less, so that many neighbouring windows share it.
REACH = 2
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_U = np.uint64
BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
#: Each round deals the classes anew.
CLASSES = tuple(_U((k + 1) * int(BASES[0]) % (1 << 64)) for k in range(LEVELS))
INVERSES = tuple(_U(pow(int(b), -1, 1 << 64)) for b in BASES)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _byte_values(base: np.uint64) -> np.ndarray:
    """What a byte counts for in a word's name; the white space between words counts for nothing."""
    out = mix(np.arange(1, 257, dtype=np.uint64) * base)
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


CHUNK_BYTES = 1 << 15  # so that a chunk's arrays stay in a core's cache
#: Longer words are named by BLAKE2b. A polynomial modulo 2^64 gives certain words of 1,024 bytes and more one value, whatever its base.
SHORT_WORD = 32
_VALUES = tuple(_byte_values(b) for b in reversed(BASES))
_SPACE = _VALUES[0] == 0


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASES[base]), np.full(n, INVERSES[base])
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


_POWERS = tuple(_powers(CHUNK_BYTES, k) for k in range(len(BASES)))


def _named(texts: pa.Array | list[str | None], which: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    if isinstance(texts, list):
        texts = pa.array(texts, pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return [np.empty(0, np.uint64) for _ in which], np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    names, counts = [[np.empty(0, np.uint64)] for _ in which], np.zeros(len(texts) + 1, np.int64)
    for first, end in slices(np.diff(at).tolist(), CHUNK_BYTES):
        own = data[at[first] : at[end]]
        if not len(own):
            continue
        space, rows = _SPACE[own], at[first:end] - at[first]
        begins = ~space
        begins[1:] &= space[:-1]
        heads = rows[rows < len(own)]
        begins[heads] = ~space[heads]
        begin = np.flatnonzero(begins)
        if len(begin):
            stop = np.append(begin[1:], len(own))  # and white space after the word, which only makes a word look longer
            long = np.flatnonzero(stop - begin > SHORT_WORD)
            digests = [hashlib.blake2b(own[begin[k] : stop[k]].tobytes().rstrip(b" \t\n\v\f\r"), digest_size=16).digest() for k in long.tolist()]
            longer = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
            for out, k in zip(names, which, strict=True):
                up, down = _POWERS[k] if len(own) <= CHUNK_BYTES else _powers(len(own), k)
                name = mix(np.add.reduceat(_VALUES[k][own] * up[: len(own)], begin) * down[begin])
                if len(long):
                    size = np.add.reduceat(~space, begin)
                    word = size[long] > SHORT_WORD
                    name[long[word]] = longer[word, k]
                out.append(name)
        counts[first + 1 : end + 1] = np.diff(np.searchsorted(begin, np.append(rows, len(own))))
    return [np.concatenate(x) for x in names], np.cumsum(counts)


def names_of(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The names of all words of all texts end to end, and where each text begins (one more at the end).

    A word's name is a polynomial fingerprint of its bytes, found for all words of a chunk at once, without a string of their own; that of a
    word of over SHORT_WORD bytes is half of its BLAKE2b digest.
    """
    (names,), starts = _named(texts, (0,))
    return names, starts


def names_twice(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As names_of, with second names between that are independent of the first: 128 bits a word."""
    (names, checks), starts = _named(texts, (0, 1))
    return names, checks, starts


class Prefix:
    """Polynomial fingerprints of any stretch of words."""

    def __init__(self, names: np.ndarray, which: int):
        n = len(names)
        powers, self.back = np.full(n + 1, BASES[which]), np.full(n + 1, INVERSES[which])
        powers[:1] = self.back[:1] = 1
        powers, self.back = np.cumprod(powers), np.cumprod(self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(names + _U(which + 1)) * powers[:-1], out=self.sums[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.back[first] + (end - first).astype(np.uint64))


def levels(names: np.ndarray, starts: np.ndarray, rounds: int = LEVELS - 2) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, lo, hi) of the symbols after each round; [lo, hi) is a symbol's context, beyond all windows if a text's end is in it."""
    n, far = len(names), len(names) + 4 * WINDOW
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    # runs of equal words: each needs its two neighbours to be known as complete
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], n)
    size = (end - first).astype(np.uint64)
    s, text = np.where(size > 1, mix(names[first] + size * BASES[1]), names[first]), text[first]
    inner_left, inner_right = np.append(False, text[1:] == text[:-1]), np.append(text[1:] == text[:-1], False)
    lo, hi = np.where(inner_left, first - 1, -far), np.where(inner_right, end + 1, far)
    yield s, lo, hi
    for k in range(rounds):
        n = len(s)
        right = (mix(s + CLASSES[k]) & _U(1)).astype(bool)
        near = np.append(text[1:] == text[:-1], False)  # to the next one
        joined = ~right & near
        joined[:-1] &= right[1:]
        taken = np.append(False, joined[:-1])
        # what a symbol's fate depends on: a left one on the next, a right one on the one before
        reach_hi, reach_lo = np.append(hi[1:], far), np.append(-far, lo[:-1])
        after = np.where(near, reach_hi, far)
        before = np.where(np.append(False, near[:-1]), reach_lo, -far)
        lo2, hi2 = np.where(right, before, lo), np.where(right, hi, after)
        follows = np.append(s[1:], _U(0))
        s2 = np.where(joined, mix(s * BASES[0] + (follows ^ BASES[1])), s)
        keep = ~taken
        s, lo, hi, text = s2[keep], lo2[keep], hi2[keep], text[keep]
        yield s, lo, hi


def anchors(names: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, first, n): runs of n windows of a text, from the word first, that share an anchor."""
    count = np.maximum(np.diff(starts) - window + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    if not len(text):
        return np.empty(0, np.uint64), text, text, text
    offset = np.concatenate([[0], np.cumsum(count)[:-1]])
    begin = np.arange(len(text)) - offset[text] + starts[:-1][text]
    prefix = Prefix(names, 0)
    key = np.zeros(len(begin), np.uint64)
    mark = np.full(len(begin), -1, np.int64)
    fitting = []
    for s, lo, hi in levels(names, starts):
        fit = np.flatnonzero((hi - lo <= max(window // REACH, 3)) & (lo >= 0) & (hi <= len(names)))
        if not len(fit):
            break  # contexts only grow
        fitting.append((s[fit], lo[fit], hi[fit]))
    for level, (s, lo, hi) in reversed(list(enumerate(fitting))):
        open_ = np.flatnonzero(mark < 0)
        if not len(open_):
            break
        at = begin[open_]
        a, b = np.searchsorted(lo, at), np.searchsorted(hi, at + window, side="right")
        some = b > a
        open_, a, b = open_[some], a[some], b[some]
        order = mix(s + BASES[0])
        best, least = a.copy(), order[a]
        for d in range(1, int((b - a).max(initial=0))):
            more = np.flatnonzero(a + d < b)
            value = order[a[more] + d]
            less = value < least[more]
            best[more[less]], least[more[less]] = a[more[less]] + d, value[less]
        key[open_] = prefix.of(lo[best], hi[best]) + _U(level)
        mark[open_] = lo[best] * LEVELS + level
    alone = np.flatnonzero(mark < 0)
    key[alone] = prefix.of(begin[alone], begin[alone] + window) + _U(LEVELS - 1)
    mark[alone] = begin[alone] * LEVELS + LEVELS - 1
    new = np.ones(len(mark), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return key[first], text[first], begin[first] - starts[:-1][text[first]], np.diff(np.append(first, len(mark)))


# ---- the four steps


def _sliced(b: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, int, pa.Array]]:
    texts = b.column(column)
    for first, end in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_CHARS):
        yield first, end, texts[first:end]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _identity(docs: DataFrame, key: str, text: str) -> Column:
    """What names a document: its key, for the order, and a hash of its text."""
    return F.struct(docs[key].alias("key"), F.xxhash64(docs[text]).alias("th"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(_identity(docs, key, text).alias("key"), docs[text].alias("text"))


def anchor_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(anchor, stretch, key, first, n) of every run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, _, texts in _sliced(b):
                names, checks, starts = names_twice(texts)
                k, owner, first, n = anchors(names, starts, window)
                at = first + starts[owner]
                stretch = Prefix(checks, 1).of(at, at + n + window - 1)
                yield pa.RecordBatch.from_arrays([_signed(k), _signed(stretch), b.column(0).take(pa.array(owner + low)), pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["anchor", "stretch", "key", "first", "n"])

    rows = _rows(docs, key, text)
    return rows.mapInArrow(run, f"anchor long, stretch long, key {rows.schema['key'].dataType.simpleString()}, first int, n int")


def window_rows(docs: DataFrame, runs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(h1, h2, key, pos) of the windows in runs (key, runs array<struct<first, n>>)."""
    rows = _rows(docs, key, text)
    joined = rows.join(runs.withColumnRenamed("key", "run_key"), _same("key", "run_key")).select("key", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, _, texts in _sliced(b):
                names, checks, starts = names_twice(texts)
                one, two = Prefix(names, 0), Prefix(checks, 1)
                owners, begins = [], []
                for k in range(len(texts)):
                    own = b.column(2)[low + k].values
                    first, n = (own.field(c).to_numpy().astype(np.int64) for c in (0, 1))
                    pos = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    pos = pos[pos <= starts[k + 1] - starts[k] - window]
                    owners.append(np.full(len(pos), k))
                    begins.append(pos)
                owner, pos = np.concatenate(owners), np.concatenate(begins)
                at = pos + starts[owner]
                for c in range(0, max(len(at), 1), 1 << 17):
                    part = slice(c, c + (1 << 17))
                    yield pa.RecordBatch.from_arrays([_signed(one.of(at[part], at[part] + window)), _signed(two.of(at[part], at[part] + window)), b.column(0).take(pa.array(owner[part] + low)), pa.array(pos[part], pa.int32())], ["h1", "h2", "key", "pos"])

    return joined.mapInArrow(run, f"h1 long, h2 long, key {rows.schema['key'].dataType.simpleString()}, pos int")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, marked array<struct<first, n, h>>): the windows of each document that occur earlier, as runs with the fingerprint
    of the words they cover. One row a document that has some."""
    named = materialize(anchor_rows(docs, key, text, window))
    again = materialize(named.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"))
    runs = materialize(named.join(again, "anchor", "left_semi"))
    discard(named, again)
    earliest = F.min(F.struct("key", "first")).alias("earliest")
    stretches = materialize(runs.groupBy("anchor", "stretch").agg(earliest, F.count("*").alias("c"), F.first("n").alias("n")))
    # runs that copy an earlier one
    copied = stretches.filter("c > 1").select("anchor", "stretch", "earliest")
    later = runs.join(copied, ["anchor", "stretch"]).filter(~(F.col("key").eqNullSafe(F.col("earliest.key")) & (F.col("first") == F.col("earliest.first"))))
    later = materialize(later.select("key", "first", "n", F.col("stretch").alias("h")))
    # first runs whose windows may recur in another stretch
    varied = materialize(stretches.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"))
    open_ = stretches.join(varied, "anchor", "left_semi").select("earliest.key", "earliest.first", "n")
    open_ = materialize(open_.groupBy("key").agg(F.collect_list(F.struct("first", "n")).alias("runs")))
    discard(runs, stretches, varied)
    windows = materialize(window_rows(docs, open_, key, text, window))
    earliest = F.min(F.struct("key", "pos")).alias("earliest")
    firsts = materialize(windows.groupBy("h1", "h2").agg(earliest, F.count("*").alias("c")).filter("c > 1").select("h1", "h2", "earliest"))
    single = windows.join(firsts, ["h1", "h2"]).filter(~(F.col("key").eqNullSafe(F.col("earliest.key")) & (F.col("pos") == F.col("earliest.pos"))))
    marked = later.unionByName(single.select("key", F.col("pos").alias("first"), F.lit(1).alias("n"), F.col("h2").alias("h")))
    marked = materialize(marked.groupBy("key").agg(F.collect_list(F.struct("first", "n", "h")).alias("marked")))
    discard(later, open_, windows, firsts)
    return marked


def removed(checks: np.ndarray, first: np.ndarray, n: np.ndarray, h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words of a text are covered by its marked runs. Runs whose fingerprint isn't that of the words there are left out."""
    delta = np.zeros(len(checks) + 1, np.int64)
    first, end = first.astype(np.int64), first.astype(np.int64) + n + window - 1
    own = (first >= 0) & (end <= len(checks))
    first, end, h = first[own], end[own], h[own]
    fits = Prefix(checks, 1).of(first, end).view(np.int64) == h
    np.add.at(delta, first[fits], 1)
    np.add.at(delta, end[fits], -1)
    return np.cumsum(delta[:-1]) > 0


def _cut(b: pa.RecordBatch, texts: pa.Array, low: int) -> Iterator[np.ndarray | None]:
    """Which words of each text go (None: none)."""
    (checks,), starts = _named(texts, (1,))
    for k in range(len(texts)):
        marks = b.column(2)[low + k]
        none = not marks.is_valid or not len(marks.values)
        yield None if none else removed(checks[starts[k] : starts[k + 1]], *(marks.values.field(c).to_numpy() for c in range(3)))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row; kept words are joined by one space."""
    marks = repeats(docs, key, text, window).withColumnRenamed("key", "mark_key")
    joined = _rows(docs, key, text).join(marks, _same("key", "mark_key"), "left").select(F.col("key.key").alias("key"), F.col("text").alias("row"), "marked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, end, texts in _sliced(b):
                rows = []
                for t, gone in zip(texts.to_pylist(), _cut(b, texts, low), strict=True):
                    words = _WORD.findall(t or "")
                    kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
                out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[low:end], *out], ["key", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"key {kind}, n_words long, n_removed long, kept_sha256 string")


def shortened(text: str, gone: np.ndarray) -> str:
    """The text without some of its words; white space stays before what is kept."""
    places, out, at = [m.start() for m in _WORD.finditer(text)], [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(text[at : places[first]])
        at = places[end] if end < len(places) else len(text)
    return "".join([*out, text[at:]])


def apply_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with repeated words taken out of text. Texts without any stay as they are, and so do other columns."""
    rest = F.struct(F.lit(0).alias("none"), *[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text])
    marks = repeats(docs, key, text, window).withColumnRenamed("key", "mark_key")
    own = docs.select(_identity(docs, key, text).alias("key"), docs[text].alias("row"), rest.alias("rest"))
    joined = own.join(marks, _same("key", "mark_key"), "left").select("key", "row", "marked", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, end, texts in _sliced(b):
                new = [t if gone is None else shortened(t, gone) for t, gone in zip(texts.to_pylist(), _cut(b, texts, low), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), b.column(3)[low:end]], ["text", "rest"])

    out = joined.mapInArrow(run, f"text string, rest {joined.schema['rest'].dataType.simpleString()}")
    return out.select(*[(F.col("text") if c == text else F.col(f"rest.c{k}")).alias(c) for k, c in enumerate(docs.columns)])
