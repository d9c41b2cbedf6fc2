"""N-gram Jaccard join by chosen paths.

A text's set is its distinct five-word shingles. Texts with equal sets form one class, and only classes are joined; sets
of fewer than four shingles have no partner but their equals.

In each run the classes walk down a tree of buckets. At the root a class samples its two least shingles by a hash of the
run; below, each shingle with a chance of SPREAD / size by a hash of the bucket it is in. It goes on in the bucket of every
shingle it sampled, so that two classes stay together wherever they sampled a shared one. A bucket of at most SPLIT_ABOVE
classes ends there and is compared by brute force. In a larger one, each class whose mean similarity to a sample of the
bucket is CLOSE or more, so that no shingle would part it from the others, is compared with all of them and leaves; the
others walk on, however deep, from buckets over FAR_ABOVE two levels at a time. That ends: their mean overlap times SPREAD is
under one, and buckets shrink.

miss() bounds the chance that a pair at the threshold is in no common bucket of a run, by the depth reached. FIRST_RUNS
suffice where no class walked on; those that did get runs up to WALK_RUNS at once, and then as many more as it takes until the
chance is at most 1 - TARGET_RECALL.

Brute force has two parts. Sketches (16 bits of each of SKETCH minima) reject pairs far below the threshold; then
the sets of the classes that have a pair left are fetched, and they are intersected exactly. A pair counts only in the
first bucket that compares it, which the lists of both sides' buckets tell, so that no pair has to be written down.
A bucket over BLOCK classes or BLOCK_SHINGLES shingles is dealt in blocks by a hash, and each pair of blocks is a group of
its own. Tasks return a row for each class: its links, and the least class of its connected part of the group; never pairs.
A group of m near copies that nothing parts is compared in m * m / 2 pairs, and its sets are read m / BLOCK times.

Classes linked by a chain form a group; labels spread along links with pointer jumping until none changes.

Defined cases: texts of one to four words have one shingle of all words; null and wordless texts have no set and are
groups of their own without links; rows with equal texts are copies of each other, also if they share a key; null keys
are kept and never name a group unless all its keys are null; an empty table gives an empty table; further columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import materialize, scratch, slices
from lexforge.llm.substring import Prefix, _sliced, mix, names_of

SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5  # at least 4/5
FIRST_RUNS, WALK_RUNS, SPREAD, CLOSE, TARGET_RECALL = 4, 13, 1.25, 0.55, 0.99999
SPLIT_ABOVE, FAR_ABOVE, BLOCK, BLOCK_SHINGLES, SAMPLE = 1024, 4096, 1024, 1 << 20, 32
#: Sketches agree in 0.8 of their places on average at the threshold; in fewer than 30 of 64 with a chance below 1e-7.
SKETCH, SKETCH_LEAST = 64, 30
LAZY_PAIRS = 4096
LEAST_SIZE = NUMERATOR  # a smaller set reaches 4/5 with its equal only
_U = np.uint64
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) | 1) % (1 << 64) for k in range(SKETCH)], np.uint64)
_ADD = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
_NODE_BITS = 47  # the run above them
RUNS = 1 << 62 - _NODE_BITS  # as many as have a number; far more than any depth asks for


def miss(depth: int) -> float:
    """A bound of the chance that a run parts a pair at the threshold, whose classes walked down to this depth.

    At the root both take two of their shingles; they share none, one or two of them with chances of at most 0.04, and 0.32
    and 0.64 (a set inside the other; sets of one size are better off). Below, the shared ones sampled number at least
    SPREAD * 4/5 on average, and no more than with Poisson's chance none.
    """
    alive = 1.0
    for _ in range(depth - 1):
        alive = 1 - exp(-SPREAD * NUMERATOR / DENOMINATOR * alive)
    return 0.04 + 0.32 * (1 - alive) + 0.64 * (1 - alive) ** 2


def shingle_sets(texts: pa.Array | list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes."""
    names, starts = names_of(texts)
    out, sizes = [], np.diff(starts)
    for low, high in slices(sizes.tolist(), 1 << 14):  # as many as stay in a core's cache
        prefix = Prefix(names[starts[low] : starts[high]], 0)
        first = starts[low:high] - starts[low]
        begin = np.arange(len(prefix.sums) - 1)
        whole = prefix.of(begin, np.minimum(begin + SHINGLE, len(begin)))
        for at, n in zip(first.tolist(), sizes[low:high].tolist(), strict=True):
            if n >= SHINGLE:
                out.append(np.unique(whole[at : at + n - SHINGLE + 1]))
            elif n:
                out.append(prefix.of(np.array([at]), np.array([at + n])))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a set, by sums that don't depend on its order."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s + _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + _U(len(s))], np.uint64).tobytes()


def node_id(run: int, name: np.ndarray) -> np.ndarray:
    """A bucket's number: its run, then a hash. Buckets are in order of their runs."""
    return (_U(run << _NODE_BITS) | (name & _U((1 << _NODE_BITS) - 1))).view(np.int64)


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sketches (sets, SKETCH), and the root buckets of the first runs (sets, FIRST_RUNS, 2); none of the sets is empty.

    A set of one shingle has its bucket twice.
    """
    out, root = np.empty((len(sets), SKETCH), np.uint16), np.empty((len(sets), FIRST_RUNS, 2), np.int64)
    for first, end in slices([len(s) for s in sets], 1 << 14):  # as many as stay in a core's cache
        size = np.array([len(s) for s in sets[first:end]])
        flat, starts = np.concatenate(sets[first:end]), np.cumsum(size) - size
        x, high = np.empty_like(flat), np.empty_like(flat)
        for k in range(SKETCH):
            np.bitwise_xor(flat, _ADD[k], out=x)
            np.multiply(x, _ODD[k], out=x)
            np.right_shift(x, _U(32), out=high)
            np.bitwise_xor(x, high, out=x)
            least = np.minimum.reduceat(x, starts)
            out[first:end, k] = least >> _U(16)
            if k < FIRST_RUNS:
                x[x == np.repeat(least, size)] = ~_U(0)
                root[first:end, k, 0] = node_id(k, mix(least))
                root[first:end, k, 1] = np.where(size > 1, node_id(k, mix(np.minimum.reduceat(x, starts))), root[first:end, k, 0])
    return out, root


def roots_of(s: np.ndarray, run: int) -> np.ndarray:
    """The root buckets of one set in a later run."""
    return node_id(run, mix(np.sort(mix(s ^ mix(np.array([run], np.uint64))))[:2]))


def children(s: np.ndarray, node: int) -> np.ndarray:
    """The buckets below a bucket that a set goes on in: those of the shingles it samples there."""
    h = mix(s ^ mix(np.array([node], np.int64).view(np.uint64)))
    return node_id(node >> _NODE_BITS, mix(h[h <= _U(min(int(SPREAD / len(s) * 2.0**64), 2**64 - 1))] + _U(1)))


def below(s: np.ndarray, node: int, stride: int) -> list[int]:
    """The buckets of a set so many levels below a bucket."""
    nodes = [node]
    for _ in range(stride):
        nodes = [c for x in nodes for c in children(s, x).tolist()]
    return sorted(set(nodes))


def _set_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, fp, size, root, sketch) of every row; th is a hash of the text, fp null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, end, texts in _sliced(b):
                sets = shingle_sets(texts)
                own = [k for k, s in enumerate(sets) if len(s)]
                fps, ways, short = ([None] * len(sets) for _ in range(3))
                if own:
                    sketch, root = sketches([sets[k] for k in own])
                    for i, k in enumerate(own):
                        fps[k], ways[k], short[k] = fingerprint(sets[k]), root[i].ravel(), sketch[i].tobytes()
                out = [pa.array(fps, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(ways, pa.list_(pa.int64())), pa.array(short, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0)[low:end], b.column(2)[low:end], *out], ["key", "th", "fp", "size", "root", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    return _texts(docs, key, text).mapInArrow(run, f"key {kind}, th long, fp binary, size long, root array<long>, sketch binary")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("th"))


def _sets_of(docs: DataFrame, key: str, text: str, classes: DataFrame) -> DataFrame:
    """(fp, shingles) of classes (fp, rep, th): the text is found by the key and the hash of one document of the class."""
    texts, asked = _texts(docs, key, text), classes.select("fp", "rep", F.col("th").alias("asked"))
    held = texts.join(asked, texts["key"].eqNullSafe(F.col("rep")) & (F.col("th") == F.col("asked"))).select("fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, end, texts in _sliced(b):
                sets = shingle_sets(texts)
                fps = b.column(0)[low:end].to_pylist()
                own = [k for k, s in enumerate(sets) if len(s) and fingerprint(s) == fps[k]]
                yield pa.RecordBatch.from_arrays([pa.array([fps[k] for k in own], pa.binary()), pa.array([sets[k].tobytes() for k in own], pa.binary())], ["fp", "shingles"])

    return held.mapInArrow(run, "fp binary, shingles binary").groupBy("fp").agg(F.first("shingles").alias("shingles"))


# ---- paths


def _judged(large: DataFrame, known: DataFrame) -> DataFrame:
    """large with full, whether a class is close to a sample of its bucket of about SAMPLE classes by a hash, and else its buckets below and how deep they are."""
    stride = F.when(F.col("n") > FAR_ABOVE, 2).otherwise(1)
    places = F.collect_list(F.struct("node", "n", "total", "depth", stride.alias("stride"))).alias("places")  # as many as a class's paths
    walkers = materialize(large.groupBy("fp").agg(places).join(known, "fp").select("fp", "size", "sketch", "shingles", "places"))
    each = walkers.select("*", F.explode("places").alias("p")).select("p.*", "fp", "size", "sketch", "shingles")
    drawn = each.filter(F.pmod(F.xxhash64("fp", "node"), F.col("n")) < SAMPLE)
    drawn = materialize(drawn.groupBy("node").agg(F.array_join(F.collect_list(F.hex("sketch")), "").alias("drawn")))
    names = ["node", "n", "total", "depth", "stride", "fp", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sample = None, None
        for b in batches:
            full, ways = [], []
            for node, far, own, s, x in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), *b.columns[7:], strict=True):
                if node != last:
                    last, sample = node, np.frombuffer(bytes.fromhex(x.as_py() or ""), np.uint16).reshape(-1, SKETCH)
                close = bool(len(sample)) and float((sample == np.frombuffer(own.as_buffer(), np.uint16)).mean()) >= CLOSE
                full.append(close)
                ways.append([] if close else below(np.frombuffer(s.as_buffer(), np.uint64), node, far))
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(full, pa.bool_()), pa.array(ways, pa.list_(pa.int64()))], [*names, "full", "below"])

    joined = each.join(drawn, "node", "left").select(*names, "sketch", "shingles", "drawn")
    return joined.mapInArrow(run, "node long, n long, total long, depth int, stride int, fp binary, size long, full boolean, below array<long>")


def _later_roots(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(node, fp, size, depth): the root buckets of classes (fp, low, high) in the runs from low to before high."""
    rows = asked.join(known.select("fp", "size", "shingles"), "fp").select("fp", "size", "low", "high", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ways = []
            for low, high, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                ways.append(np.unique(np.concatenate([roots_of(s, r) for r in range(low, high)])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ways, pa.list_(pa.int64()))], ["fp", "size", "below"])

    return rows.mapInArrow(run, "fp binary, size long, below array<long>").select(F.explode("below").alias("node"), "fp", "size", F.lit(1).alias("depth"))


def buckets(classes: DataFrame, sets) -> DataFrame:
    """(node, fp, size, n, total, full): the members of all buckets to compare, of as many runs as are needed.

    sets: gives (fp, shingles) of classes (fp).
    """
    rows = classes.select(F.explode(F.array_distinct("root")).alias("node"), "fp", "size", F.lit(1).alias("depth"))
    small, large_ones, known, at, enough = [], [], None, WALK_RUNS, log(1 - TARGET_RECALL)
    while True:
        counts = materialize(rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("total")).filter("n > 1"))
        here = materialize(rows.join(counts, "node").select("node", "fp", "size", "depth", "n", "total"))
        small.append(here.filter(F.col("n") <= SPLIT_ABOVE))
        large = here.filter(F.col("n") > SPLIT_ABOVE)
        if not large.isEmpty():
            first = known is None
            if first:
                some = materialize(large.select("fp").distinct())
                known = materialize(sets(some).join(classes.select("fp", "size", "sketch"), "fp"))
            judged = materialize(_judged(large, known))
            large_ones.append(judged)
            rest = judged.filter(~F.col("full"))
            rows = rest.select(F.explode("below").alias("node"), "fp", "size", (F.col("depth") + F.col("stride")).alias("depth"))
            if first:
                walking = rest.select("fp").distinct().select("fp", F.lit(FIRST_RUNS).alias("low"), F.lit(WALK_RUNS).alias("high"))
                rows = rows.unionByName(materialize(_later_roots(walking, known)))
            continue
        if known is None:
            break
        # all paths end: which classes lack runs, at the rate so far?
        deep = large_ones[0]
        for x in large_ones[1:]:
            deep = deep.unionByName(x)
        deep = deep.filter(~F.col("full")).groupBy("fp", F.shiftright("node", _NODE_BITS).alias("run")).agg(F.max(F.col("depth") + F.col("stride")).alias("depth"))
        depths = F.create_map(*[x for d in range(1, 200) for x in (F.lit(d), F.lit(log(miss(d))))])
        worse = F.coalesce(F.try_element_at(depths, F.col("depth")), F.lit(log(miss(200)))) - log(miss(1))
        lacks = deep.groupBy("fp").agg((at * F.lit(log(miss(1))) + F.sum(worse)).alias("miss")).filter(F.col("miss") > enough)
        need = F.ceil((F.lit(enough) - F.col("miss")) * at / F.col("miss")).cast("int")
        asked = materialize(lacks.select("fp", F.lit(at).alias("low"), (at + need).alias("high")))
        most = asked.agg(F.max("high")).first()[0]
        if most is None:
            break
        if most > RUNS:
            raise RuntimeError(f"{most} runs are needed, {RUNS} can be numbered")
        rows, at = materialize(_later_roots(asked, known)), most
    out = small[0]
    for x in small[1:]:
        out = out.unionByName(x)
    out = out.drop("depth").withColumn("full", F.lit(True))
    for x in large_ones:  # of those where some class is compared with all
        mixed = materialize(x.filter("full").select("node").distinct())
        out = out.unionByName(x.join(mixed, "node", "left_semi").select(out.columns))
    return out


# ---- brute force


def _by_group(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of batches that are sorted by their first n columns. A group is held whole; blocks bound its size."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in range(n)]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for first, end in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
            own = tuple(int(k[first]) for k in keys)
            if own != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                held, now = [], own
            held.append(b.slice(first, end - first))
    if held:
        yield now, pa.Table.from_batches(held)


class Group:
    """The members of one pair of blocks of a bucket, and its pairs to compare."""

    def __init__(self, node: int, low: int, high: int, t: pa.Table):
        self.node, self.t, side = node, t, t.column("side").to_numpy()
        self.across = low != high
        self.left, self.right = (np.flatnonzero(side == low), np.flatnonzero(side == high)) if self.across else (np.arange(len(side)),) * 2
        self.size = t.column("size").to_numpy()
        self.sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(t.num_rows, -1)
        self._compared: np.ndarray | None = None

    def compared(self) -> np.ndarray:
        """Which pairs of left and right this bucket is the first to compare."""
        if self._compared is not None:
            return self._compared
        n = self.t.num_rows
        lists = self.t.column("held").combine_chunks()
        place, owner = lists.flatten().to_numpy(), np.repeat(np.arange(n), lists.value_lengths().to_numpy())
        # an entry is twice a bucket's number, and one more where its member is compared with all of it
        number, full = place >> 1, (place & 1).astype(bool)
        whole_here = np.zeros(n, bool)
        whole_here[owner[full & (number == self.node)]] = True
        self._compared = whole_here[self.left][:, None] | whole_here[self.right]
        earlier = number < self.node
        if earlier.any():
            _, column, times = np.unique(number[earlier], return_inverse=True, return_counts=True)
            shared = times[column] > 1
            self._compared &= ~self._before(owner[earlier][shared], (np.cumsum(times > 1) - 1)[column[shared]], full[earlier][shared])
        return self._compared

    def _before(self, owner: np.ndarray, column: np.ndarray, full: np.ndarray, width: int = 2048) -> np.ndarray:
        """The pairs of left and right that an earlier bucket compares; so many buckets at a time."""
        out = np.zeros((len(self.left), len(self.right)), bool)
        order = np.argsort(column, kind="stable")
        owner, column, full = owner[order], column[order], full[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            low, high = np.searchsorted(column, [first, first + width])
            there, whole = (np.zeros((self.t.num_rows, min(width, int(column[-1]) + 1 - first)), np.float32) for _ in range(2))
            there[owner[low:high], column[low:high] - first] = 1
            whole[owner[low:high][full[low:high]], column[low:high][full[low:high]] - first] = 1
            out |= whole[self.left] @ there[self.right].T + there[self.left] @ whole[self.right].T > 0
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(a, b), some at a time: pairs that no earlier bucket compares and that sizes and sketches let pass.

        In a small group, most often none passes, and only then the lists of buckets are looked at.
        """
        step, small = max(1, (1 << 18) // max(len(self.right), 1)), len(self.left) * len(self.right) <= LAZY_PAIRS
        right, size = self.right, self.size * DENOMINATOR
        for at in range(0, len(self.left), step):
            left = self.left[at : at + step]
            fit = (size[left][:, None] >= self.size[right] * NUMERATOR) & (size[right] >= self.size[left][:, None] * NUMERATOR)
            if not self.across:
                fit &= left[:, None] < right
            if not small:
                fit &= self.compared()[at : at + step]
            a, b = np.nonzero(fit)
            like = [np.empty(0, bool)]
            for c in range(0, len(a), 1 << 14):
                like.append((self.sketch[left[a[c : c + (1 << 14)]]] == self.sketch[right[b[c : c + (1 << 14)]]]).sum(1) >= SKETCH_LEAST)
            like = np.concatenate(like)
            a, b = a[like], b[like]
            if small and len(a):
                first = self.compared()[at : at + step][a, b]
                a, b = a[first], b[first]
            if len(a):
                yield left[a], right[b]


class Common:
    """How many shingles the members of a group share, pair by pair: products of 0/1 matrices, some shingles at a time."""

    def __init__(self, group: Group, sets: list[np.ndarray], width: int = 2048):
        self.row, self.column = np.empty(len(sets), np.int64), np.empty(len(sets), np.int64)
        self.row[group.left], self.column[group.right] = np.arange(len(group.left)), np.arange(len(group.right))
        size = np.array([len(s) for s in sets])
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[place] > 1  # the shingles of one member add nothing
        owner, place = np.repeat(np.arange(len(sets)), size)[shared], (np.cumsum(times > 1) - 1)[place[shared]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        self.both = np.zeros((len(group.left), len(group.right)), np.float32)
        for first in range(0, int(place[-1]) + 1 if len(place) else 0, width):
            low, high = np.searchsorted(place, [first, first + width])
            m = np.zeros((len(sets), width), np.float32)
            m[owner[low:high], place[low:high] - first] = 1
            self.both += m[group.left] @ m[group.right].T

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.both[self.row[a], self.column[b]].astype(np.int64)


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's connected part, if root is that of the links so far."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _grouped(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, low, high, side, fp, size, n_docs, sketch, held): the members of every group to compare.

    held lists twice the number of each bucket of a class, and one more where the class is compared with all of it.
    """
    entry = F.shiftleft("node", 1) + F.col("full").cast("long")
    own = members.groupBy("fp").agg(F.collect_list(F.struct(entry.alias("entry"), "n", "total")).alias("own"))  # as many as a class's paths
    rows = classes.select("fp", "size", "n_docs", "sketch").join(own, "fp")
    rows = rows.select("*", F.transform("own", lambda x: x.getField("entry")).alias("held"), F.explode("own").alias("o"))
    blocks = F.greatest(F.ceil(F.col("o.n") / BLOCK), F.ceil(F.col("o.total") / BLOCK_SHINGLES)).cast("int")
    rows = rows.select("*", F.shiftright("o.entry", 1).alias("node"), blocks.alias("blocks"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("fp", "node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("node", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "fp", "size", "n_docs", "sketch", "held")


_GROUP = "node long, low int, high int, side int, fp binary, size long, n_docs long, sketch binary, held array<long>"


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("node", "low", "high").sortWithinPartitions("node", "low", "high", "fp")


def _with_candidates(groups: DataFrame) -> DataFrame:
    """The members of groups that have a candidate there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for where, t in _by_group(batches, 3):
            if t.num_rows > 1:
                some = np.zeros(t.num_rows, bool)
                for a, b in Group(*where, t).pairs():
                    some[a] = some[b] = True
                if some.any():
                    yield from t.filter(pa.array(some)).combine_chunks().to_batches()

    return _dealt(groups).mapInArrow(run, _GROUP)


def _verified(members: DataFrame) -> DataFrame:
    """(fp, links, root): of each member with its set, the documents it is linked with in its group, and the least member it hangs together with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for where, t in _by_group(batches, 3):
            group, links, root, common = Group(*where, t), np.zeros(t.num_rows, np.int64), np.arange(t.num_rows), None
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in t.column("shingles").chunks for x in c]
            n, size = t.column("n_docs").to_numpy(), group.size
            for a, b in group.pairs():
                if common is None and len(a) * 40 > sum(map(len, sets)):
                    common = Common(group, sets)
                both = common(a, b) if common else np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
                good = both * DENOMINATOR >= (size[a] + size[b] - both) * NUMERATOR
                a, b = a[good], b[good]
                links += np.bincount(a, n[b], len(links)).astype(np.int64) + np.bincount(b, n[a], len(links)).astype(np.int64)
                root = _roots(root, a, b)
            some = np.flatnonzero(links)
            if len(some):
                fp = t.column("fp").combine_chunks()
                yield pa.RecordBatch.from_arrays([fp.take(pa.array(some)), pa.array(links[some]), fp.take(pa.array(root[some]))], ["fp", "links", "root"])

    return _dealt(members).mapInArrow(run, "fp binary, links long, root binary")


# ---- groups


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label): the least vertex of each vertex's connected component. Edges may repeat; each round is written out."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        heard = both.join(state, both["a"] == state["v"]).groupBy("b").agg(F.min("label").alias("heard"))
        up = state.select(F.col("v").alias("up_v"), F.col("label").alias("up"))
        new = state.join(up, F.col("label") == F.col("up_v")).join(heard, F.col("v") == F.col("b"), "left")
        new = materialize(new.select("v", F.least("label", "up", "heard").alias("label"), (F.least("label", "up", "heard") < F.col("label")).alias("moved")))
        if new.filter("moved").isEmpty():
            return new.select("v", "label")
        state = new.select("v", "label")


def _joined(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, class_id, n_links) of every row."""
    with scratch() as keep:
        rows, known = _classes(docs, key, text)
        keep(rows)
        keep(known)
    out = rows.select("key", "th", "fp").join(known, F.col("fp") == F.col("class_fp"), "left")
    return out.select("key", "th", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links) of every row: the least key of its group, and how many other rows are as similar as the threshold."""
    return _joined(docs, key, text).drop("th")


def _classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints, and (class_fp, class_id, n_links)."""
    rows = materialize(_set_rows(docs, key, text))
    least = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "th")))
    own = [F.coalesce(least, F.min(F.struct("key", "th"))).alias("rep"), F.count("*").alias("n_docs"), F.first("size").alias("size"), F.first("root").alias("root"), F.first("sketch").alias("sketch")]
    classes = materialize(rows.filter("fp is not null").groupBy("fp").agg(*own).select("fp", "rep.key", "rep.th", "n_docs", "size", "root", "sketch").withColumnRenamed("key", "rep"))
    joined = classes.filter(F.col("size") >= LEAST_SIZE)
    sets = lambda some: materialize(_sets_of(docs, key, text, classes.join(some, "fp", "left_semi")))
    members = materialize(_with_candidates(_grouped(materialize(buckets(joined, sets)), joined)))
    found = materialize(_verified(members.join(sets(members.select("fp").distinct()), "fp").select(*members.columns, "shingles")))
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    labels = components(found, "fp", "root").withColumnRenamed("v", "fp")
    linked = materialize(classes.select("fp", "rep").join(labels, "fp"))
    named = linked.join(materialize(linked.groupBy("label").agg(F.min("rep").alias("least"))), "label").select("fp", "least")
    known = classes.select("fp", "rep", "n_docs").join(named, "fp", "left").join(links, "fp", "left")
    known = known.select(F.col("fp").alias("class_fp"), F.coalesce("least", "rep").alias("class_id"), (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows, materialize(known)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose key is the least of their group, with all their columns. Rows of the group that share that key stay."""
    found = _joined(docs, key, text).filter(F.col("class_id").eqNullSafe(F.col("key"))).select(F.col("key").alias("kept_key"), F.col("th").alias("kept_th")).distinct()
    return docs.join(found, docs[key].eqNullSafe(found["kept_key"]) & (F.xxhash64(docs[text]) == found["kept_th"]), "left_semi")
