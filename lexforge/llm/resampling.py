"""Importance resampling towards a target distribution, in two Arrow passes over the documents.

The features of a text are its runs of one to three words. A feature's bucket is the CRC-32 of its bytes modulo BUCKETS. The
first pass counts buckets: each partition sums np.bincount of its texts to one vector of BUCKETS numbers, and treeReduce
merges the vectors, so that the driver receives about a hundred of them, whatever the input. The target's buckets are counted
likewise. A bucket's gain is 1000 times the logarithm of how much commoner it is in the target, rounded down. The second pass takes the gains as
a broadcast of BUCKETS numbers, gathers them by bucket and sums them by document, with np.bincount once more; a document's
score is that weight plus Gumbel noise from a hash of its key, so that the highest scores are a draw without replacement.

No feature becomes a string: a CRC is linear, so that of a run is put together from those of its words, with tables that
move a CRC past so many bytes.

Ranks are global. Rows are dealt by range of (eligible, score, key, place), sorted inside the parts and written; a row's rank is
its place in its part and the sizes of the parts before it. Neither a class nor a score is hot, as the place is another for each row.

Defined cases: a null or empty text, or one without words, has no features, weight 0 and the score of its noise; only texts of
min_words words or more are drawn. A null key counts as an empty one in the noise and comes first among equal scores. Rows that
are equal are ranked in any order, but each has a rank of its own. An empty target or an empty table has counts of 0. Other
columns don't matter. A word of any length counts whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.llm.common import materialize, parts_for
from lexforge.llm.substring import _sliced

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
_POLYNOMIAL, _SHORT = 0xEDB88320, 64


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 by bytes; what a CRC becomes after 0 to 63 zero bytes, from each of its four bytes; and after 64 times powers of two."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, byte >> 1 ^ np.uint32(_POLYNOMIAL), byte >> 1).astype(np.uint32)
    near = [np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(_SHORT):
        near.append(byte[near[-1] & 255] ^ near[-1] >> 8)
    far = [near.pop()]
    for _ in range(31):
        far.append(_moved(far[-1], 0, far[-1]))
    return byte, np.concatenate(near), np.array(far)


def _moved(crc: np.ndarray, row: np.ndarray | int, table: np.ndarray) -> np.ndarray:
    base = row * 1024
    return table[base + (crc & 255)] ^ table[base + 256 + (crc >> 8 & 255)] ^ table[base + 512 + (crc >> 16 & 255)] ^ table[base + 768 + (crc >> 24)]


_BYTE, _NEAR, _FAR = _tables()
_SPACE = np.uint32(zlib.crc32(b" "))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[:48] = _IN_WORD[58:97] = _IN_WORD[123:128] = False  # after lower-casing: digits, a to z and all beyond ASCII


def past(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs moved past n bytes each."""
    out = _moved(crc, n % _SHORT, _NEAR)
    for k in range(int(n.max(initial=0) // _SHORT).bit_length()):
        far = np.flatnonzero(n // _SHORT >> k & 1)
        out[far] = _moved(out[far], 0, _FAR[k])
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts end to end, and of each word its first byte, its bytes and its text."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    at -= at[0]
    inside = _IN_WORD[data]
    head = np.zeros(len(data) + 1, bool)
    head[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | head[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | head[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return data, begin, end - begin, np.searchsorted(at, begin, side="right") - 1


def word_crcs(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: byte by byte for all short words at once, the longest first, so that those still going on are in front."""
    order = np.argsort(-size, kind="stable")
    long = int((size > _SHORT).sum())
    out = np.empty(len(size), np.uint32)
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[begin[k] : begin[k] + size[k]])
    order = order[long:]
    at, left, crc = begin[order], size[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -j))  # words of more than j bytes
        crc[:n] = _BYTE[crc[:n] & 255 ^ data[at[:n] + j]] ^ crc[:n] >> 8
    out[order] = ~crc
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature)."""
    data, begin, size, owner = words_of(texts)
    word = word_crcs(data, begin, size)
    owners, buckets, run = [owner], [word % BUCKETS], word
    for n in range(1, LONGEST):
        run, last = run[: max(len(word) - n, 0)], word[n:]
        # a run of one word more: the run before, a space, and the next word
        run = past(_BYTE[run & 255] ^ run >> 8 ^ _SPACE, size[n:]) ^ last
        whole = owner[n:] == owner[: len(run)]
        owners.append(owner[n:][whole])
        buckets.append(run[whole] % BUCKETS)
    return np.bincount(owner, minlength=len(texts)), np.concatenate(owners), np.concatenate(buckets)


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, texts in _sliced(b, 0):
                total += np.bincount(features(texts)[2], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    vectors = df.select(df[text].alias("text")).mapInArrow(run, "v binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    none = df.sparkSession.sparkContext.parallelize([np.zeros(BUCKETS, np.int64)], 1)  # of a table without partitions
    depth = max(2, ceil(log(max(vectors.getNumPartitions(), 2)) / log(100)))
    return vectors.union(none).treeReduce(np.add, depth)


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, from the features in each bucket of the documents and of the target."""
    all_own, all_target = float(own.sum()), float(target.sum())
    ratios = ((target + 1.0) * (all_own + BUCKETS)) / ((own + 1.0) * (all_target + BUCKETS))
    return np.array([floor(1000 * log(x)) for x in ratios.tolist()], np.float64)


def noise(name: str, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, by a hash of a key's text."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[key].cast("string"), F.lit("")).alias("name"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(1)
            for low, end, texts in _sliced(b, 2):
                n_words, owner, bucket = features(texts)
                n = np.bincount(owner, minlength=len(texts))
                weight = np.bincount(owner, weights=held.value[bucket], minlength=len(texts)).astype(np.int64)
                own = np.array([noise(x, seed) for x in names[low:end].to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0)[low:end], *map(pa.array, (n_words, n, weight, weight + own))], ["key", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, n_words long, n_features long, weight long, score long")


def drawn(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored with rank: 1, 2, ... of the rows drawn, by score; null for the others."""
    rows = materialize(scored.withColumn("fit", F.col("n_words") >= min_words).withColumn("place", F.monotonically_increasing_id()))
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("key"), F.col("place")]
    parts = parts_for(rows)
    # the number of a sorted row: its part, and its place there below
    sorted_ = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()))
    sizes = sorted_.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("n"), F.count_if("fit").alias("fits"))  # a row for each part
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.floor(F.lit(percent) * F.sum("fits").over(W.Window.partitionBy()) / 100).alias("most"))
    numbered = sorted_.join(F.broadcast(offsets), F.shiftright("row", 33) == F.col("part"))
    rank = F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before") + 1
    return numbered.select("key", "n_words", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= F.col("most")), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of docs: percent of those of min_words words or more are drawn."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    return drawn(scores(docs, gain, key, text, seed), min_words, percent)
