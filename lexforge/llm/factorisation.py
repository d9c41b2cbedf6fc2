"""Quality classifier: a factorisation machine.

A text's features are hashed words, shares and counts of its structure, and its length as metadata. The score is
w0 + sum w_i x_i + sum over i<j of <v_i, v_j> x_i x_j, the pairs in linear time as half of |sum v_i x_i|^2 minus the
sum of |v_i x_i|^2. Texts are featurised on the executors; the machine is fitted by AdaGrad in one executor task on
a bounded sample of labelled rows (SAMPLE_ROWS, a documented parameter); every row is scored.

Defined cases: null and empty texts have the features of an empty text and are scored like others; repeated rows get
equal scores; repeated labels of a key count once, the larger one if they differ; an empty table gives an empty table; without any labelled row all scores are 0.5; rows without a label
only get scores. Labels, language, source and ids are never features.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash slots, rank, the most words of a text's bag that count as distinct slots, and the sample's bound.
SLOTS, RANK, EPOCHS, BATCH, SAMPLE_ROWS = 4096, 8, 12, 128, 12_000
DENSE = 21
FOLDS, HELD_OUT_FOLD, THRESHOLD = 5, 0, 0.3

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_COUNTS = [re.compile(p) for p in (r"[A-Z]", r"[0-9]", r"[#*$%&|<>]", r"!", r"[.]", r",", r"[^\x00-\x7F]", r"\?", r"[\"'()\[\]{}]", r"[/\\_=@~^+-]")]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): DENSE structure features first, then hashed words scaled to unit length."""
    text = text or ""
    words = _WORD.findall(text)
    n, m, lines = len(words), max(len(text), 1), text.split("\n")
    bag = Counter(words)
    counts = [len(p.findall(text)) for p in _COUNTS]
    full = [x for x in lines if x.strip()]
    grams = [" ".join(words[k : k + 3]) for k in range(n - 2)]
    sizes = sum(map(len, words))
    dense = [
        1.0, np.log1p(n) / 8, np.log1p(m) / 10, sizes / max(n, 1) / 10, len(bag) / max(n, 1), max(bag.values(), default=0) / max(n, 1),
        1 - len(set(full)) / max(len(full), 1), 1 - len(set(grams)) / max(len(grams), 1), min(len(full) / max(n, 1), 1.0), float(n < 20),
        sum(map(str.__eq__, words, words[1:])) / max(n, 1),
        *(min(c / max(n, 1), 3.0) if k != 6 else c / m for k, c in enumerate(counts)),
    ]
    slots: dict[int, float] = {}
    for w, c in bag.items():
        slot = DENSE + zlib.crc32(w.lower().strip(".,;:!?").encode()) % (SLOTS - DENSE)
        slots[slot] = slots.get(slot, 0.0) + c
        marks = re.sub(r"[^\W\d_]+", "a", w)[:6]
        slot = DENSE + zlib.crc32(b"\0" + marks.encode()) % (SLOTS - DENSE)
        slots[slot] = slots.get(slot, 0.0) + c
    values = np.log1p(np.fromiter(slots.values(), float, len(slots)))
    norm = np.sqrt(np.dot(values, values)) or 1.0
    return np.concatenate([np.arange(DENSE), np.fromiter(slots, np.int64, len(slots))]), np.concatenate([dense, values / norm]).astype(np.float64)


class Machine:
    """w0, w (SLOTS) and v (SLOTS x RANK)."""

    def __init__(self, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(SLOTS)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (SLOTS, RANK))

    def raw(self, slots: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of n texts whose features are laid end to end, and each text's sum of v_i x_i."""
        vx = self.v[slots] * values[:, None]
        sums = np.stack([np.bincount(owner, vx[:, k], n) for k in range(RANK)], 1)
        squares = np.bincount(owner, (vx * vx).sum(1), n)
        return self.w0 + np.bincount(owner, self.w[slots] * values, n) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
        """AdaGrad on the logistic loss, both classes weighted alike up to a factor that keeps probabilities near the truth."""
        rng, g0, gw, gv = np.random.default_rng(seed), 1e-8, np.full(SLOTS, 1e-8), np.full((SLOTS, RANK), 1e-8)
        self.w0 = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                slots, values, owner = laid([rows[k] for k in own])
                z, sums = self.raw(slots, values, owner, len(own))
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]
                e = error[owner] * values
                dw, dv = np.zeros(SLOTS), np.zeros((SLOTS, RANK))
                np.add.at(dw, slots, e)
                inner = e[:, None] * (sums[owner] - self.v[slots] * values[:, None])
                for k in range(RANK):
                    dv[:, k] = np.bincount(slots, inner[:, k], SLOTS)
                dw, dv, d0 = dw / len(own) + decay * self.w, dv / len(own) + decay * self.v, error.mean()
                g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
                self.w0, self.w, self.v = self.w0 - rate * d0 / np.sqrt(g0), self.w - rate * dw / np.sqrt(gw), self.v - rate * dv / np.sqrt(gv)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        z, _ = self.raw(*laid(list(map(features, texts))), len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def laid(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y) of sample_rows labelled rows at most, none of the held-out fold, picked by a hash of the key."""
    fold = F.crc32(F.col(key).cast("string")) % FOLDS
    own = labels.filter(F.col(label).isNotNull() & (fold != HELD_OUT_FOLD)).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    own = own.orderBy(F.xxhash64("key"), "y").limit(sample_rows)  # a top-k: each task keeps so many thin rows
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.join(F.broadcast(own), "key").select("text", "y")  # sample_rows thin rows at most


def _training_features(rows: DataFrame) -> DataFrame:
    """(order, name, y, slots, data) of rows (text, y): the features of a text, SLOTS at most, in place of the text itself; order and name put rows in an order of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                raw = [(t or "").encode() for t in part.column(0).to_pylist()]
                own = [features(t) for t in part.column(0).to_pylist()]
                columns = [pa.array([zlib.crc32(t) for t in raw], pa.int64()), pa.array([hashlib.sha1(t).hexdigest() for t in raw]), part.column(1)]
                columns += [pa.array([s.astype(np.int32).tobytes() for s, _ in own], pa.binary()), pa.array([x.tobytes() for _, x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["order", "name", "y", "slots", "data"])

    return rows.select("text", "y").mapInArrow(run, "order long, name string, y int, slots binary, data binary")


def fit(rows: DataFrame, epochs: int = EPOCHS) -> bytes | None:
    """A pickled Machine fitted in one executor task on rows (text, y), which are bounded, as are their features, whatever the texts; None without rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "name", "y"])  # whatever way the rows came
        own = [(np.frombuffer(s, np.int32).astype(np.int64), np.frombuffer(x)) for s, x in zip(pdf["slots"], pdf["data"], strict=True)]
        machine = Machine().fit(own, pdf["y"].to_numpy(float), epochs)
        return pd.DataFrame({"model": [pickle.dumps((machine.w0, machine.w, machine.v))]})

    found = _training_features(rows).groupBy(F.lit(0).alias("one")).applyInPandas(run, "model binary").collect()
    return bytes(found[0]["model"]) if found else None


def scores(docs: DataFrame, model: bytes | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine()
        if shared.value:
            machine.w0, machine.w, machine.v = pickle.loads(shared.value)
        else:
            machine.v[:] = 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(machine.score(part.column(1).to_pylist()), pa.float64())], ["key", "score"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) of every row of docs."""
    model = fit(training_rows(docs, labels, key=key, text=text))
    held = F.coalesce(F.crc32(F.col("key").cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))
    return scores(docs, model, key, text).select("key", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
