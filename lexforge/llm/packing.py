"""Packing with optimal length buckets.

Texts are encoded, and their token ids cut into pieces of at most MAX_TOKENS. One aggregation gives the histogram of piece
lengths, at most MAX_TOKENS cells whatever the corpus holds. Dynamic programming over the cells chooses BUCKETS upper
bounds so that the padding of all pieces to their bucket's bound is the least possible. Inside each bucket, pieces form
batches of as many as the token budget holds when each is padded to the bound; batches() lays each out as a padded matrix.

A piece's place in its bucket needs a running number over all pieces. Pieces are in order of length there, then of the task that cut them, then as
they were cut: each task counts its pieces of each length as it goes, so that a number is put together from the histogram, the counts of earlier tasks
by length, and that count. The ids stay where they were written; no bucket and no key meets in one task. Which of the pieces of one length are
neighbours follows the input's partitions, all else does not.

Defined cases: a null or empty text has one piece of no tokens in bucket 0 with no batch; null and shared keys are keys like
others; equal rows are placed one by one; an empty table gives an empty table. Columns of docs beyond key
and text aren't kept, so their names can't clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.llm.common import materialize, slices

MAX_TOKENS, BUCKETS, BATCH_TOKENS, SLICE_BYTES = 2048, 16, 32_768, 1 << 20
#: Offsets by length and task are broadcast up to so many rows; more are joined by an exchange.
OFFSET_ROWS = 200_000


def optimal_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The upper bounds, ascending, of at most so many buckets with the least total padding.

    cost(i, j): padding of the lengths i+1..j to length j. best[j] after k rounds: the least for the first j lengths
    in k buckets. The best split moves right with j (the cost is Monge), so each round is solved by halving: O(n log n).
    """
    sizes = sorted(x for x, n in histogram.items() if x > 0 and n > 0)
    if not sizes:
        return []
    n = len(sizes)
    count = [0, *accumulate(histogram[x] for x in sizes)]
    total = [0, *accumulate(histogram[x] * x for x in sizes)]
    cost = lambda i, j: sizes[j - 1] * (count[j] - count[i]) - (total[j] - total[i])
    best, splits = [0] + [cost(0, j) for j in range(1, n + 1)], []
    for _ in range(1, min(buckets, n)):
        now, split = [0] * (n + 1), [0] * (n + 1)
        work = [(1, n, 0, n - 1)]
        while work:
            low, high, first, last = work.pop()
            if low > high:
                continue
            j = (low + high) // 2
            now[j], split[j] = min((best[i] + cost(i, j), i) for i in range(first, min(last, j - 1) + 1))
            work += [(low, j - 1, first, split[j]), (j + 1, high, split[j], last)]
        splits.append(split)
        best = now
    bounds, j = [], n
    for split in reversed(splits):
        if not j:
            break
        bounds.append(sizes[j - 1])
        j = split[j]
    if j:
        bounds.append(sizes[j - 1])
    return bounds[::-1]


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 of a token's bytes, and its id)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(k) for token, k in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(key, piece, start, n_tokens, ids, part, nth): consecutive pieces of each whole text; nth counts, from 0, those of as many tokens in its task, part."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seen = encoding(path, pattern).encode_ordinary, TaskContext.get().partitionId(), np.zeros(max_tokens + 1, np.int64)
        for b in batches:
            texts = b.column(1)
            for low, end in slices([len(t.as_buffer()) if t.is_valid else 0 for t in texts], SLICE_BYTES):
                ids = [np.array(encode(t.as_py() or ""), np.int32) for t in texts[low:end]]
                size = np.array([len(x) for x in ids], np.int64)
                times = np.maximum(-(-size // max_tokens), 1)
                owner = np.repeat(np.arange(len(ids)), times)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
                n = np.minimum(size[owner] - piece * max_tokens, max_tokens)
                flat = np.concatenate(ids)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                order = np.argsort(n, kind="stable")
                nth = np.empty(len(n), np.int64)
                nth[order] = np.arange(len(n)) - np.searchsorted(n[order], n[order])
                nth += seen[n]
                seen += np.bincount(n, minlength=max_tokens + 1)
                columns = [b.column(0).take(pa.array(owner + low)), pa.array(piece.astype(np.int32)), pa.array(piece * max_tokens), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.full(len(n), part, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "n_tokens", "ids", "part", "nth"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, piece int, start long, n_tokens long, ids array<int>, part int, nth long")


def pack(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, offset_rows: int = OFFSET_ROWS) -> DataFrame:
    """(key, piece, start, n_tokens, bucket, padded_to, batch, place, ids): bucket from 1, batch from 0 inside the bucket."""
    cut = materialize(pieces(docs, path, pattern, key, text, max_tokens), compression="zstd")  # counted, then numbered: texts are read once
    cells = materialize(cut.groupBy("n_tokens", "part").agg(F.count("*").alias("n")))
    histogram = {r["n_tokens"]: r["n"] for r in cells.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # max_tokens + 1 rows at most
    bounds = optimal_bounds(histogram, buckets)
    case = F.when(F.col("n_tokens") == 0, F.lit(0))
    limit = F.when(F.col("n_tokens") == 0, F.lit(0))
    for k, b in enumerate(bounds, 1):
        case, limit = case.when(F.col("n_tokens") <= b, F.lit(k)), limit.when(F.col("n_tokens") <= b, F.lit(b))
    # a row's number in its bucket: the rows of fewer tokens there, those of as many in earlier tasks, and those before it in its own
    first, shorter, ends = {}, 0, {0, *bounds}
    for n in sorted(histogram):
        first[n], shorter = shorter, shorter + histogram[n]
        shorter = 0 if n in ends else shorter  # the next bucket
    base = F.get(F.array(*[F.lit(first.get(n, 0)).cast("long") for n in range(max(histogram, default=0) + 1)]), F.col("n_tokens").cast("int"))
    before = W.Window.partitionBy("n_tokens").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = cells.select("n_tokens", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row for each task of one length
    offsets = F.broadcast(offsets) if cells.count() <= offset_rows else offsets
    placed = cut.join(offsets, ["n_tokens", "part"]).withColumns({"bucket": case.cast("int"), "padded_to": limit.cast("long"), "row": base + F.col("offset") + F.col("nth")})
    room = F.greatest(F.floor(F.lit(batch_tokens) / F.greatest(F.col("padded_to"), F.lit(1))), F.lit(1))
    at = F.when(F.col("bucket") > 0, F.col("row"))
    return placed.select("key", "piece", "start", "n_tokens", "bucket", "padded_to", F.floor(at / room).cast("long").alias("batch"), F.pmod(at, room).cast("long").alias("place"), "ids")


def batches(packed: DataFrame, pad: int = -1) -> DataFrame:
    """(bucket, batch, padded_to, keys, lengths, ids): the rows of each batch in place order, padded. batch_tokens ids at most."""
    row = F.struct("place", "key", "n_tokens", F.concat("ids", F.array_repeat(F.lit(pad), (F.col("padded_to") - F.col("n_tokens")).cast("int"))).alias("ids"))
    rows = packed.filter("bucket > 0").groupBy("bucket", "batch", "padded_to").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("bucket", "batch", "padded_to", F.col("rows.key").alias("keys"), F.col("rows.n_tokens").alias("lengths"), F.col("rows.ids").alias("ids"))
