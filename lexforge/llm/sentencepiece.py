"""SentencePiece BPE by a prefix table.

For every prefix of a unit the table stores the last token of that prefix's encoding; it is unique. An automaton
gives all pieces that end at a place; of those the one is right whose predecessor, the last token of the prefix
before it, stays apart from it when the two are encoded together. Ids are then recovered from the end backwards.
This takes time linear in the unit, however long it is.

Texts are cut into units where no piece can cross: before a space mark that follows another character, and around
characters that no piece has (they fall back to their bytes). Both are checked against the model on loading. Units
recur, so their ids are kept in a table of bounded size.

Defined cases: null and empty texts have the end id alone; repeated rows give equal rows; an empty table gives an
empty table; only key and text columns are read, whatever else docs has.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MARK = "▁"
#: Units and pairs that a worker keeps: some hundred bytes each.
MOST_UNITS, MOST_PAIRS = 700_000, 500_000

codecs.register_error("lexforge_byte", lambda e: ("�", e.start + 1))


class _Stays(dict):
    """Pieces.stays, remembered."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, piece: int) -> bool:
        found = self[piece] = self.pieces.stays(piece)
        return found


class Pieces(dict):
    """A BPE model; as a dict, the ids of units seen."""

    def __init__(self, path: str):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)  # read for its table of pieces only
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.rank = {names[i]: (-model.get_score(i), i) for i in range(n) if not special[i] and not model.is_byte(i) and not model.is_unused(i)}
        self.names, self.end = names, model.eos_id()
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.raw = [b"" if model.is_control(i) else " ⁇ ".encode() if special[i] else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.control = frozenset(i for i in range(n) if model.is_control(i))
        self.marked = frozenset(i for i in range(n) if names[i].startswith(MARK))
        self.text = [str(i) for i in range(n)]
        if len(self.byte) != 256 or any(MARK in p.lstrip(MARK) or (p[:2] == MARK * 2 and p.strip(MARK)) for p in self.rank):
            raise ValueError("this model has no byte fallback, or pieces that cross the border between two words")
        known = "".join(sorted({c for p in self.rank for c in p} - {MARK}))
        self.units = re.compile(f"{MARK}+[{re.escape(known)}]*|[{re.escape(known)}]+|[^{MARK}{re.escape(known)}]")
        self.automaton = ahocorasick.Automaton()
        for p, (_, i) in self.rank.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.traces: dict[int, list[tuple]] = {}
        self.apart: dict[int, bool] = {}
        self.whole = _Stays(self)

    def trace(self, piece: int) -> list[tuple]:
        """How the piece's own string merges: the rank of each merge in turn, then the symbols at its ends after it."""
        found = self.traces.get(piece)
        if found is None:
            parts, rank = list(self.names[piece]), self.rank
            found = [(None, parts[0], parts[-1])]
            while len(parts) > 1:
                best, at = None, 0
                for k in range(len(parts) - 1):
                    r = rank.get(parts[k] + parts[k + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, k
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                found.append((best, parts[0], parts[-1]))
            self.traces[piece] = found
        return found

    def stays(self, piece: int) -> bool:
        """Does the piece's own string encode as the piece? Others never occur in an encoding."""
        return self.trace(piece)[-1][1] == self.names[piece]

    def compatible(self, a: int, b: int) -> bool:
        """Do two pieces side by side encode as these two?

        The merges inside each go on as they would alone, the better of the two next ones first, unless the pair
        across the border ranks before both; of equals the leftmost merges, which is the left piece's, then that pair.
        """
        key = a << 32 | b
        found = self.apart.get(key)
        if found is None:
            left, right, rank = self.trace(a), self.trace(b), self.rank
            i, j, m, n = 0, 0, len(left) - 1, len(right) - 1
            while True:
                across = rank.get(left[i][2] + right[j][1])
                x, y = (left[i + 1][0] if i < m else None), (right[j + 1][0] if j < n else None)
                if across is not None and (x is None or across < x) and (y is None or across <= y):
                    found = False
                    break
                if x is None and y is None:
                    found = True
                    break
                if y is None or (x is not None and x <= y):
                    i += 1
                else:
                    j += 1
            if len(self.apart) >= MOST_PAIRS:
                self.apart.clear()
            self.apart[key] = found
        return found

    def by_prefixes(self, unit: str) -> list[int]:
        last, size = [-1] * (len(unit) + 1), [0] * (len(unit) + 1)
        apart, stays = self.apart, self.whole
        for end, (piece, n) in self.automaton.iter(unit):
            if last[end + 1] < 0:
                before = last[end + 1 - n]
                if end + 1 == n:
                    if not stays[piece]:
                        continue
                elif before < 0 or not stays[piece]:
                    continue
                elif (right := apart.get(before << 32 | piece)) is None:
                    right = self.compatible(before, piece)
                    if not right:
                        continue
                elif not right:
                    continue
                last[end + 1], size[end + 1] = piece, n
        ids, at = [], len(unit)
        while at:
            if last[at] < 0:
                raise ValueError(f"no encoding of {unit[:40]!r}")
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def __missing__(self, unit: str) -> tuple[int, ...]:
        whole = self.rank.get(unit)
        if whole and self.whole[whole[1]]:
            ids = (whole[1],)
        elif len(unit) == 1 and not whole:
            ids = tuple(self.byte[x] for x in unit.encode("utf-8", "surrogatepass"))
        else:
            ids = tuple(self.by_prefixes(unit))
        if len(self) < MOST_UNITS and len(unit) <= 32:
            self[unit] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids without begin or end."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.__getitem__, self.units.findall(MARK + text.replace(" ", MARK)))))

    def decode(self, ids: Iterable[int]) -> str:
        ids = [i for i in ids if i not in self.control]
        data = b"".join(map(self.raw.__getitem__, ids))
        if ids and ids[0] in self.marked:
            data = data[1:]
        return data.decode("utf-8", "lexforge_byte")


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """Once for each Python worker."""
    return Pieces(path)


def encoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row: the end id last."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for b in batches:
            ids = [[*pieces.encode(t.as_py()), pieces.end] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")


def decoded(encodings: DataFrame, model: str) -> DataFrame:
    """(key, text) of rows (key, ids)."""
    kind = encodings.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["key", "text"])

    return encodings.select("key", "ids").mapInArrow(run, f"key {kind}, text string")


def digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each row is encoded, and its ids decoded, without leaving the task."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for b in batches:
            rows = []
            for t in b.column(1):
                ids = [*pieces.encode(t.as_py()), pieces.end]
                line = " ".join(map(pieces.text.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(pieces.decode(ids).encode()).hexdigest()))
            n, a, z = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
