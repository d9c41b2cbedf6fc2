"""Hard-negative mining by ball trees with branch and bound.

Vectors are dealt by label, and inside a label by a hash of their key, to blocks of about BLOCK rows. Each block becomes a ball tree, written
as one row: halves by the component of widest spread down to leaves of at most LEAF rows, and of each node the centre and the radius.
With a query q, all inner products with a node's rows lie within |q| * radius of that with its centre.

Anchors are packed into chunks of their label, CHUNK at a time, and each chunk meets each tree that may hold its results: those of its own
label for the positives, all others for the negatives. In a tree, windows of scores are searched, for all anchors of a chunk
at once: nodes whose bounds lie outside all windows of an anchor are cut. Each anchor first looks into its most promising leaf, and
then nodes that lie strictly below the least of the k results so far are cut too (not equal ones, as a tie may have a
lower key). What is left of the leaves is scored by products of matrices, the most promising leaves first.
Each cell of a tree and a chunk gives at most k results for an anchor's window, of which the first k are taken. Results are exact.

Only rows of packed blocks are replicated: a chunk goes to every tree, a tree to one task. Neither a label nor a key is hot.

Scores are exact integers: in doubles where lengths allow it, else in 64-bit integers.

Defined cases: rows with a null key, label or vector, or with a null or non-finite component take no part, and neither do those whose
scores might not fit a long (squared length in units of 1 / scale of LENGTH_MOST or more). Shorter vectors count as if filled up with zeros. A key
names one row: equal rows count once, and of different rows of one key that of the least label and vector counts. Ties go to
the smaller key. Fewer positives or negatives than asked give as many as there are, an empty table none. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexforge.llm.common import materialize

BLOCK, CHUNK, LEAF = 16_384, 1024, 64
POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
LENGTH_MOST = 2.0**54
_LEAST, _MOST = -(1 << 62), 1 << 62


# ---- one tree


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """An integer array in the smallest type that holds it."""
    most = int(np.abs(x).max(initial=0))
    kind = "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "int64"
    return kind, x.astype(kind).tobytes()


class BallTree:
    """A complete binary tree over rows of integers: node j of level l has rows edges[l][j] to edges[l][j + 1]."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, centres: list[np.ndarray], radii: list[np.ndarray]):
        self.keys, self.vectors, self.centres, self.radii = keys, vectors, centres, radii
        self.edges = [np.arange((1 << k) + 1) * len(keys) >> k for k in range(len(centres))]
        self.longest = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(1)).max(initial=0))
        self.floats = vectors.astype(np.float64)

    @classmethod
    def build(cls, keys: np.ndarray, vectors: np.ndarray) -> BallTree:
        order = np.argsort(keys, kind="stable")
        keys, vectors, n = keys[order], vectors[order], len(keys)
        depth = max(ceil(n / LEAF) - 1, 0).bit_length()
        for level in range(depth):
            edges = np.arange((1 << level) + 1) * n >> level
            spread = np.maximum.reduceat(vectors, edges[:-1]) - np.minimum.reduceat(vectors, edges[:-1])
            node = np.repeat(np.arange(1 << level), np.diff(edges))
            order = np.lexsort((vectors[np.arange(n), spread.argmax(1)[node]], node))
            keys, vectors = keys[order], vectors[order]
        centres, radii, floats = [], [], vectors.astype(np.float64)
        for level in range(depth + 1):
            edges = np.arange((1 << level) + 1) * n >> level
            size = np.diff(edges)
            centre = (np.add.reduceat(floats, edges[:-1]) / size[:, None]).astype(np.float32)
            apart = np.sqrt(((floats - np.repeat(centre.astype(np.float64), size, axis=0)) ** 2).sum(1))  # from the centre as it is stored
            centres.append(centre)
            radii.append(np.maximum.reduceat(apart, edges[:-1]))
        return cls(keys, vectors, centres, radii)

    def row(self) -> dict[str, object]:
        kind, vectors = packed(self.vectors)
        return {"keys": self.keys.tobytes(), "kind": kind, "vectors": vectors, "centres": np.concatenate(self.centres).tobytes(), "radii": np.concatenate(self.radii).tobytes()}

    @classmethod
    def of_row(cls, keys: bytes, kind: str, vectors: bytes, centres: bytes, radii: bytes) -> BallTree:
        own, r = np.frombuffer(keys, np.int64), np.frombuffer(radii, np.float64)
        c = np.frombuffer(centres, np.float32).reshape(len(r), -1)
        cuts = [(1 << k) - 1 for k in range(1, len(r).bit_length())]
        return cls(own, np.frombuffer(vectors, kind).reshape(len(own), -1), np.split(c, cuts), np.split(r, cuts))

    def search(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Best:
        """The k best rows in each window [low, high] of each anchor; low and high are (anchors, windows)."""
        best, n = Best(*low.shape, k, low), len(anchors)
        width = self.vectors.shape[1]
        anchors = np.pad(anchors, ((0, 0), (0, max(width - anchors.shape[1], 0))))[:, :width]  # missing components are zeros
        q = anchors.astype(np.float64)
        length = np.sqrt((q**2).sum(1))
        exact = float(length.max(initial=0)) * self.longest < 2.0**52
        q_rows, rows = (q, self.floats) if exact else (anchors.astype(np.int64), self.vectors.astype(np.int64))
        bounds = []
        for centre, radius in zip(self.centres, self.radii, strict=True):
            middle, reach = q @ centre.T.astype(np.float64), length[:, None] * radius
            slack = 1e-9 * (np.abs(middle) + reach) + 1e-6  # of rounding
            bounds.append((middle - reach - slack, middle + reach + slack))
        lower, upper = bounds[-1]

        def open_nodes(lower: np.ndarray, upper: np.ndarray, who: np.ndarray | slice) -> np.ndarray:
            """Nodes whose bounds meet a window and aren't strictly below its least result."""
            out = np.zeros(lower.shape, bool)
            for w in range(low.shape[1]):
                out |= (upper >= best.floor[who, w][:, None]) & (lower <= high[who, w][:, None])
            return out

        def walk() -> np.ndarray:
            alive = np.ones((n, 1), bool)
            for level, (lo, up) in enumerate(bounds):
                alive = (np.repeat(alive, 2, axis=1) if level else alive) & open_nodes(lo, up, slice(None))
            return alive

        def score(leaf: int, who: np.ndarray) -> None:
            a, b = self.edges[-1][leaf], self.edges[-1][leaf + 1]
            s = q_rows[who] @ rows[a:b].T
            x, y = np.nonzero((s >= best.floor[who].min(1)[:, None]) & (s <= high[who].max(1)[:, None]))
            if len(x):
                best.add(who[x], s[x, y].astype(np.int64), self.keys[a:b][y], high)

        alive = walk()
        promise = np.where(alive, np.minimum(upper, high.max(1)[:, None]), -np.inf)
        first = promise.argmax(1)
        some = alive.any(1)
        for leaf in np.unique(first[some]).tolist():
            score(leaf, np.flatnonzero(some & (first == leaf)))
        alive = walk()
        alive[np.arange(n), first] = False
        for leaf in np.argsort(-np.where(alive, promise, 0).sum(0), kind="stable").tolist():
            who = np.flatnonzero(alive[:, leaf])
            who = who[open_nodes(lower[who, leaf][:, None], upper[who, leaf][:, None], who)[:, 0]]
            if len(who):
                score(leaf, who)
        return best


class Best:
    """The k best (score, key) of each anchor's windows, higher scores first, then smaller keys."""

    def __init__(self, n: int, windows: int, k: int, low: np.ndarray):
        self.windows, self.k, self.floor = windows, k, low.astype(np.int64).copy()
        self.score, self.key = np.full((n * windows, k), _LEAST, np.int64), np.zeros((n * windows, k), np.int64)

    def add(self, anchor: np.ndarray, score: np.ndarray, key: np.ndarray, high: np.ndarray) -> None:
        """Scores of rows with anchors, each for all windows of the anchor that it lies in."""
        places = []
        for w in range(self.windows):
            own = np.flatnonzero((score >= self.floor[anchor, w]) & (score <= high[anchor, w]))
            places.append((anchor[own] * self.windows + w, score[own], key[own]))
        at, score, key = (np.concatenate(c) for c in zip(*places, strict=True))
        touched = np.unique(at)
        held = self.score[touched] > _LEAST
        at, score, key = np.concatenate([np.repeat(touched, held.sum(1)), at]), np.concatenate([self.score[touched][held], score]), np.concatenate([self.key[touched][held], key])
        order = np.lexsort((key, -score, at))
        at, score, key = at[order], score[order], key[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        own = rank < self.k
        self.score[at[own], rank[own]], self.key[at[own], rank[own]] = score[own], key[own]
        full = touched[self.score[touched, -1] > _LEAST]
        self.floor[full // self.windows, full % self.windows] = self.score[full, -1]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, window, key, score)."""
        at, rank = np.nonzero(self.score > _LEAST)
        return at // self.windows, at % self.windows, self.key[at, rank], self.score[at, rank]


# ---- blocks and chunks


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as rows, shorter ones filled up with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(lists), max(int(sizes.max(initial=0)), 1)), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def vectors(df: DataFrame, key: str, label: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(key, label, v) of the rows that take part; v has whole numbers in units of 1 / scale."""
    rows = df.select(df[key].alias("key"), df[label].alias("label"), df[vector].alias("v")).filter("key IS NOT NULL AND label IS NOT NULL")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x.cast("double") * scale) * (x.cast("double") * scale))
    rows = rows.filter(F.forall("v", finite)).filter(length < LENGTH_MOST)
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select("key", F.struct("label", whole.alias("v")).alias("x")).groupBy("key").agg(F.min("x").alias("x")).select("key", "x.label", "x.v")


def _trees(rows: DataFrame) -> DataFrame:
    """(block, keys, kind, vectors, centres, radii): a row for each tree."""

    def build(t: pa.Table) -> pa.Table:
        tree = BallTree.build(t.column("key").to_numpy(), _vectors(t.column("v")))
        return pa.Table.from_pylist([{"block": t.column("block")[0].as_py(), **tree.row()}])

    return rows.select("block", "key", "v").groupBy("block").applyInArrow(build, "block long, keys binary, kind string, vectors binary, centres binary, radii binary")


def _chunks(anchors: DataFrame) -> DataFrame:
    """(chunk, first, end, a_keys, a_kind, a_vectors, low, high) of anchors (chunk, first, end, key, v, low array, high array): a row for each chunk."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        kind, v = packed(_vectors(t.column("v")))
        low, high = (_filled(t.column(c), x) for c, x in (("low", _MOST), ("high", _LEAST)))
        own = {c: t.column(c)[0].as_py() for c in ("chunk", "first", "end")}
        return pa.Table.from_pylist([own | {"a_keys": t.column("key").to_numpy().tobytes(), "a_kind": kind, "a_vectors": v, "low": low.tobytes(), "high": high.tobytes()}])

    return anchors.groupBy("chunk").applyInArrow(pack, "chunk long, first long, end long, a_keys binary, a_kind string, a_vectors binary, low binary, high binary")


def _filled(column: pa.ChunkedArray, missing: int) -> np.ndarray:
    """Lists of the windows' bounds as rows; a window that an anchor lacks is empty."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    out = np.full((len(lists), int(sizes.max(initial=1))), missing, np.int64)
    for k, n in enumerate(sizes.tolist()):
        out[k, :n] = lists[k].values.to_numpy()
    return out


def _searched(cells: DataFrame, trees: DataFrame, parts: int, k: int) -> DataFrame:
    """(anchor, place, key, score): the k best rows of each cell for each window of an anchor, place being the window's."""
    met = cells.repartition(parts, "block").join(trees.repartition(parts, "block"), "block")
    names = ["block", "keys", "kind", "vectors", "centres", "radii", "a_keys", "a_kind", "a_vectors", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for b in batches:
            for x in range(b.num_rows):
                own = {c: b.column(c)[x] for c in names}
                if own["block"].as_py() != last:
                    last = own["block"].as_py()
                    tree = BallTree.of_row(own["keys"].as_buffer(), own["kind"].as_py(), *(own[c].as_buffer() for c in ("vectors", "centres", "radii")))
                keys = np.frombuffer(own["a_keys"].as_buffer(), np.int64)
                chunk, low, high = (np.frombuffer(own[c].as_buffer(), kind).reshape(len(keys), -1) for c, kind in (("a_vectors", own["a_kind"].as_py()), ("low", np.int64), ("high", np.int64)))
                anchor, place, key, score = tree.search(chunk, low, high, k).results()
                yield pa.RecordBatch.from_arrays([pa.array(keys[anchor]), pa.array(place, pa.int32()), pa.array(key), pa.array(score)], ["anchor", "place", "key", "score"])

    return met.select(*names).mapInArrow(run, "anchor long, place int, key long, score long")


def _first(found: DataFrame, group: list[str], k: int) -> DataFrame:
    order = W.Window.partitionBy(*group).orderBy(F.col("score").desc(), "key")  # at most k of each cell
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(df: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: which keys are anchors, as a condition on the column "key". Positives are the best of the anchor's label, negatives the best of other labels with
    a score of low to high percent of the positive's.
    """
    rows = materialize(vectors(df, key, label, vector, scale))
    size = rows.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.count_if(anchor) / CHUNK).alias("chunks"))
    before = W.Window.orderBy("label").rowsBetween(W.Window.unboundedPreceding, -1)  # a row for each label
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    labels = materialize(size.select(F.col("label").alias("own"), "blocks", "chunks", offset("blocks").alias("first"), offset("chunks").alias("chunk0")))
    dealt = rows.join(labels, F.col("label") == F.col("own")).withColumn("block", F.col("first") + F.pmod(F.xxhash64("key"), F.col("blocks")))
    chunk = F.when(anchor, F.col("chunk0") + F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks")))
    dealt = materialize(dealt.select("key", "v", "block", "first", (F.col("first") + F.col("blocks")).alias("end"), chunk.alias("chunk")))
    trees = materialize(_trees(dealt))
    total = labels.agg(F.sum("blocks")).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * total)
    anchors = dealt.filter("chunk IS NOT NULL").select("chunk", "first", "end", "key", "v")

    one = lambda x: F.array(F.lit(x).cast("long"))
    asked = _chunks(anchors.select("*", one(_LEAST + 1).alias("low"), one(_MOST).alias("high")))
    cells = asked.withColumn("block", F.explode(F.sequence("first", F.col("end") - 1)))
    found = _searched(cells, trees, parts, positives + 1).filter("anchor <> key")
    best = materialize(_first(found, ["anchor"], positives))

    bound = {c: F.expr(f"(({n}) - pmod(({n}), 100L)) div 100") for c, n in (("low", f"{low}L * score + 99L"), ("high", f"{high}L * score"))}  # rounded up and down, in whole numbers
    held = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", bound["low"].alias("low"), bound["high"].alias("high")))).alias("w"))  # of one anchor
    wanted = anchors.join(held, F.col("key") == F.col("anchor")).select("chunk", "first", "end", "key", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    cells = _chunks(wanted).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(total - 1, 0)).cast("long")))).filter("block < first OR block >= end")
    found = _first(_searched(cells, trees, parts, negatives), ["anchor", "place"], negatives)
    pairs = best.select(F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("nth"))
    joined = found.join(pairs, (F.col("anchor") == F.col("anchor_id")) & (F.col("place") == F.col("nth")))
    return joined.select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
