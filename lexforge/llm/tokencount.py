"""Token counts with a whole-token shortcut.

Offline, once on the driver, every vocabulary string with an end-of-word mark is merged by the rules; those that end
as one token are proved whole. On the executors a pre-token that is such a string counts one directly; only the rest
is merged. Counts equal the library's: special strings count one each, texts between them are normalised (NFC, white
space, lower case by character) and cut by the file's pattern.

The library's Unicode tables may be older or newer than Python's. So the driver also tries every assigned code point up to
LAST in many contexts (alone, doubled, between letters, symbols and digits, at apostrophes, among accents, decomposed) and
keeps those that this module and the library cut alike. A text that holds any other character is normalised and cut by the
library itself, and its pre-tokens are counted here like all others.

Defined cases: null and empty texts have no tokens; repeated rows give equal rows; an empty table gives an empty
table; only key and text are read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pre-tokens that a worker keeps beside the whole ones.
MOST_WORDS = 400_000
LAST = 0x1FFFF


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Counter(dict):
    """Tokens of pre-tokens, by the text of the pre-token."""

    def __init__(self, path: str, whole: frozenset[str] | None = None, known: str = ""):
        """whole: the proved strings; known: a character class of what both sides cut alike, '' for ASCII only."""
        super().__init__()
        self.path, self.other, self._library = path, re.compile(f"[^\\x00-\\x7f{known}]"), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if spec["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not steps[0]["invert"] or not steps[1]["type"] == "ByteLevel":
            raise ValueError("this counter reads BPE files with NFC, lower case, a split pattern and byte-level words")
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        pairs = ((m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.cut = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        marks = [x["content"] for x in spec["added_tokens"] if x["special"]]
        self.special = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True)))) if marks else None
        self.names = _byte_names()
        if whole is None:
            byte = {c: b for b, c in enumerate(self.names)}
            whole = set()
            for v in spec["model"]["vocab"]:
                if v.endswith(self.suffix) and len(v) > len(self.suffix):
                    data = bytes(byte[c] for c in v.removesuffix(self.suffix))
                    try:
                        word = data.decode()
                    except UnicodeDecodeError:
                        continue  # part of a character: no pre-token
                    if self.merge(word) == 1:
                        whole.add(word)
        self.whole = frozenset(whole)
        self.update(dict.fromkeys(self.whole, 1))
        self.most = len(self) + MOST_WORDS

    def merge(self, word: str) -> int:
        """Tokens of a pre-token by its merges: lowest rank first, then leftmost; linked symbols and a heap."""
        s = [self.names[b] for b in word.encode("utf-8", "surrogatepass")]
        s[-1] += self.suffix
        n, rank = len(s), self.rank
        if n <= 24:
            while n > 1:
                best, at = None, 0
                for k in range(n - 1):
                    r = rank.get((s[k], s[k + 1]))
                    if r is not None and (best is None or r < best):
                        best, at = r, k
                if best is None:
                    break
                s[at : at + 2] = [s[at] + s[at + 1]]
                n -= 1
            return n
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        heap = [(r, k, s[k], s[k + 1]) for k in range(n - 1) if (r := rank.get((s[k], s[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if s[k] != a or j >= n or s[j] != b:
                continue
            s[k], s[j], after[k], left = a + b, "", after[j], left - 1
            if after[k] < n:
                before[after[k]] = k
                if (r := rank.get((s[k], s[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, s[k], s[after[k]]))
            if before[k] >= 0 and (r := rank.get((s[before[k]], s[k]))) is not None:
                heapq.heappush(heap, (r, before[k], s[before[k]], s[k]))
        return left

    def __missing__(self, word: str) -> int:
        n = self.merge(word)
        if len(self) < self.most and len(word) <= 32:
            self[word] = n
        return n

    def cuts(self, text: str) -> list[str]:
        """The pre-tokens of a text of known characters."""
        text = unicodedata.normalize("NFC", text)
        low = text.lower()
        if "Σ" in text:  # its lower case must not depend on its place
            low = "".join(c.lower() for c in text)
        return self.cut.findall(low)

    def library_cuts(self, text: str) -> list[str]:
        """The pre-tokens of any text, by the library."""
        if self._library is None:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(self.path)
            self._library = model.normalizer.normalize_str, model.pre_tokenizer.pre_tokenize_str, {c: b for b, c in enumerate(self.names)}
        normal, cut, byte = self._library
        return [bytes(map(byte.__getitem__, x)).decode() for x, _ in cut(normal(text))]

    def _plain(self, text: str) -> int:
        known = text.isascii() or not self.other.search(text)
        return sum(map(self.__getitem__, (self.cuts if known else self.library_cuts)(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def contexts(c: str) -> str:
    """A character in the company that its class, case, marks and composition show in."""
    apart = unicodedata.normalize("NFD", c)
    if apart == c and unicodedata.category(c) == "Lo":  # no case, no mark, no parts: a letter or not
        return f" {c} a{c}a 1{c}#{c}1 '{c}'ll{c}'s a\u0301{c}\u0323 "
    return f" {c} {c}{c} a{c}a #{c}# 1{c}1 '{c} {c}'ll A{c}'s ×{c}× é{c}º a\u0301{c}\u0323 a{c}\u0301 a\u0323{c}\u0301 {apart} {apart}\u0301 a{apart}b "


def known_characters(counter: Counter) -> str:
    """A character class, without brackets, of the code points that cuts() and library_cuts() treat alike."""
    good, bad = [], set()

    def tried(points: list[int]) -> None:
        text = "".join(contexts(chr(p)) for p in points)
        if counter.cuts(text) == counter.library_cuts(text):
            good.extend(points)
        elif len(points) > 1:
            tried(points[: len(points) // 2])
            tried(points[len(points) // 2 :])
        else:  # nor may its parts come together in a text
            bad.update(map(ord, unicodedata.normalize("NFD", chr(points[0]))))

    points = [p for p in range(128, LAST + 1) if unicodedata.category(chr(p)) not in ("Cn", "Cs", "Co")]
    for at in range(0, len(points), 64):
        tried(points[at : at + 64])
    good = [p for p in good if p not in bad]
    out, at = [], 0
    while at < len(good):
        end = at
        while end + 1 < len(good) and good[end + 1] == good[end] + 1:
            end += 1
        out.append(f"\\U{good[at]:08x}-\\U{good[end]:08x}")
        at = end + 1
    return "".join(out)


@lru_cache(maxsize=4)
def prove(path: str) -> tuple[frozenset[str], str]:
    """The vocabulary strings that encode alone as one token, and the known characters. Bounded by the vocabulary and Unicode; once on the driver."""
    counter = Counter(path)
    return counter.whole, known_characters(counter)


@lru_cache(maxsize=4)
def _load(path: str, whole: frozenset[str], known: str) -> Counter:
    return Counter(path, whole, known)


def counts(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    proved = docs.sparkSession.sparkContext.broadcast(prove(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _load(path, *proved.value)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            n = [counter.count(t) for t in texts]
            columns = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
