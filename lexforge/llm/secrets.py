"""Secret scans by a trigram inverted index, in DataFrame functions alone.

From each rule's pattern a Boolean query over lower-case trigrams is derived on the driver: a text that matches must
satisfy it. The index holds postings (trigram, row id) for the trigrams that some query names. Postings are
intersected by OR-ing each row's trigrams to a bit mask, with map-side combination, and testing every query on it.
Candidates are then verified with the pattern itself. A rule without a mandatory trigram (a bare run of hex digits)
scans every text.

Defined cases: a null text has no spans; rows of one key and text share their candidates, which are verified one by
one; an empty table gives an empty table; other columns don't matter. Equal rows give equal results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import let, parts_for

_parser = re._parser  # the standard library's own parser: one tree for every rule


@dataclass(frozen=True)
class Secret:
    """body: Java's and Python's alike. value: the group whose length counts, at_least so many characters.

    not_after: a class of characters that must not stand before a match. Where these are also what a match goes on with, a run of
    them is tried once, at its begin.
    """

    kind: str
    body: str
    at_least: int = 0
    value: int = 0
    not_after: str = ""

    @property
    def pattern(self) -> str:
        return f"(?<!{self.not_after})(?:{self.body})" if self.not_after else self.body


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + f"|{_either('api')}_?{_either('key')}"
#: The first three are the base; a hex run of 24 is what remains of all runs once the short ones are dropped, and so for the access keys.
BASE = (
    Secret("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Secret("access", "AKIA[A-Z0-9]{16,}"),
    Secret("hex", "[0-9a-f]{24,}"),
)
#: A key block up to its END line; repetitions are possessive, as what they take can't be anything else. Where that is missing: headers, all up to the last long base64 word, and one more line of base64.
_B64 = r"A-Za-z0-9+/=\\"
_PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+[^-]++)*+-{5,}END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:[\r\n]+(?:Proc-Type|DEK-Info): [^\r\n]*){{0,2}}(?:[{_B64} \t\r\n]*[{_B64}]{{20}})?(?:[ \t]*[\r\n]+[ \t]*[{_B64}]+(?:[\r\n]|$))?)"
)
MORE = (
    Secret("pem", _PEM),
    Secret("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", not_after="[A-Za-z0-9_-]"),
    Secret("forge", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Secret("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Secret("cloud", "AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE
#: Matches that are folded at once.
CHUNK = 64

# ---- Boolean queries: True (anything), ("and", parts), ("or", parts) or a trigram


def _all(parts) -> object:
    flat = {p for p in parts if p is not True}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _any(parts) -> object:
    parts = set(parts)
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _of_strings(strings) -> object:
    return _any(_all(s[k : k + 3] for k in range(len(s) - 2)) for s in strings)


def _item(op: str, arg, most: int) -> tuple[frozenset | None, object]:
    """(the strings one item can be, if few; else None, and what holds for any match)."""
    if op == "LITERAL":
        return frozenset([chr(arg).lower()]), True
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        return frozenset(chr(a).lower() for _, a in arg), True
    if op == "SUBPATTERN":
        return _walk(arg[-1], most)
    if op == "BRANCH":
        ways = [_walk(way, most) for way in arg[1]]
        if all(strings is not None for strings, _ in ways):
            return frozenset().union(*(strings for strings, _ in ways)), True
        return None, _any(need if strings is None else _of_strings(strings) for strings, need in ways)
    if op == "MAX_REPEAT" and tuple(arg[:2]) == (0, 1):
        strings, _ = _walk(arg[2], most)
        return (None if strings is None else strings | {""}), True
    if op == "MAX_REPEAT" and arg[0] >= 1:
        strings, need = _walk(arg[2], most)
        return None, need if strings is None else _of_strings(strings)
    return None, True


def _walk(items, most: int = 64) -> tuple[frozenset | None, object]:
    """As _item, of a sequence: neighbouring known strings are multiplied out, so trigrams cross their borders."""
    run, needs, whole = frozenset([""]), [], True
    for op, arg in items:
        strings, need = _item(str(op), arg, most)
        needs.append(need)
        if strings is not None and len(run) * len(strings) <= most:
            run = frozenset(a + b for a in run for b in strings)
        else:
            needs.append(_of_strings(run))
            run, whole = strings or frozenset([""]), False
    return (run, True) if whole else (None, _all([*needs, _of_strings(run)]))


def query(pattern: str) -> object:
    """The Boolean trigram query of a pattern; True if nothing is mandatory."""
    strings, need = _walk(_parser.parse(pattern))
    return need if strings is None else _of_strings(strings)


def trigrams(q: object) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(trigrams, q[1]))


def _holds(q: object, bit: dict[str, tuple[str, int]]) -> Column:
    if isinstance(q, str):
        name, k = bit[q]
        return F.col(name).bitwiseAND(F.lit(1 << k)) != 0
    parts = [_holds(x, bit) for x in sorted(q[1], key=str)]
    out = parts[0]
    for x in parts[1:]:
        out = out & x if q[0] == "and" else out | x
    return out


# ---- the index


def vocabulary(rules: tuple[Secret, ...] = RULES) -> list[str]:
    return sorted(set().union(*(trigrams(query(r.pattern)) for r in rules)))


def row_id(key: Column, text: Column) -> Column:
    """What postings name a row by: rows that share a key are told apart by their texts, so that no key is hot.

    Rows of one id share their candidates, which only widens these.
    """
    return F.xxhash64(key, text)


def postings(docs: DataFrame, grams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(gram, id): the inverted index over the trigrams named. A posting for each gram and text, whatever its count there."""
    low = docs.select(row_id(F.col(key), F.col(text)).alias("id"), F.lower(F.col(text)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(k)) for k, g in enumerate(grams)]))
    return low.select("id", F.explode(held).alias("gram"))


def candidates(index: DataFrame, grams: list[str], rules: tuple[Secret, ...] = RULES) -> DataFrame:
    """(id, may): of each row id that meets some rule's query, a mask of those rules. Only masks of grams are shuffled."""
    width = 60
    bit = {g: (f"held{k // width}", k % width) for k, g in enumerate(grams)}
    one = lambda at: F.expr(f"if(gram div {width} = {at}, shiftleft(1L, gram % {width}), 0L)")
    masks = index.groupBy("id").agg(*[F.bit_or(one(at)).alias(f"held{at}") for at in range(-(-len(grams) // width))])
    asked = [(k, query(r.pattern)) for k, r in enumerate(rules)]
    may = sum((F.when(_holds(q, bit), F.lit(1 << k)).otherwise(F.lit(0)) for k, q in asked if q is not True), F.lit(0))
    return masks.select("id", may.cast("long").alias("may")).filter("may > 0")


# ---- verification


def _none(k: int) -> Column:
    """No spans, as an array of their type."""
    return F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(k).alias("k"), F.lit(0).alias("end"))), 1, 0)


def _spans(text: Column, rule: Secret, k: int) -> Column:
    """All matches of a rule as structs (start, k, end) in code points, leftmost first.

    The pattern goes on where the last match ended (\\G) and takes the gap before the next match along, so that lengths
    add up to places. A fold copies what it has gathered at each step; so matches are folded CHUNK by CHUNK, each chunk from
    the sum of those before, and many matches cost little more than few.
    """
    whole = F.lit(rf"\G([\s\S]*?)({rule.pattern})")
    length = lambda group: F.transform(F.regexp_extract_all(text, whole, F.lit(group)), F.length)
    sizes = [length(1).alias("gap"), length(2).alias("hit")]
    if rule.value:
        sizes.append(length(rule.value + 2).alias("value"))
    long_enough = lambda x: (x.getField("value") >= rule.at_least) if rule.value else F.lit(True)

    def step(a: Column, x: Column) -> Column:
        begin = a.getField("at") + x.getField("gap")
        end = begin + x.getField("hit")
        hit = F.array(F.struct(begin.alias("start"), F.lit(k).alias("k"), end.alias("end")))
        found = F.when(long_enough(x), F.concat(a.getField("found"), hit)).otherwise(a.getField("found"))
        return F.struct(end.alias("at"), found.alias("found"))

    def placed(all_: Column) -> Column:
        cut = lambda c: F.slice(all_, c * CHUNK + 1, F.lit(CHUNK))
        chunks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int"))
        width = lambda c: F.aggregate(cut(c), F.lit(0), lambda a, x: a + x.getField("gap") + x.getField("hit"))
        # the sums before each chunk, the last one first
        before = lambda: F.aggregate(chunks, F.array(F.lit(0)), lambda a, c: F.concat(F.array(F.get(a, F.lit(0)) + width(c)), a))
        own = lambda sums: F.transform(chunks, lambda c: F.aggregate(cut(c), F.struct(F.get(sums, F.size(sums) - 1 - c).alias("at"), _none(k).alias("found")), step, lambda a: a.getField("found")))
        few = F.aggregate(all_, F.struct(F.lit(0).alias("at"), _none(k).alias("found")), step, lambda a: a.getField("found"))
        return F.when(F.size(all_) <= CHUNK, few).otherwise(F.flatten(let(before(), own)))

    return F.when(text.rlike(rule.pattern), let(F.arrays_zip(*sizes), placed)).otherwise(_none(k))


def verify(text: Column, may: Column, rules: tuple[Secret, ...] = RULES) -> Column:
    """The spans of a text in order of start, then of the rules. A rule with a query runs only if may has its bit."""
    body, found = F.coalesce(text, F.lit("")), []
    for k, rule in enumerate(rules):
        spans = _spans(body, rule, k)
        if query(rule.pattern) is not True:
            spans = F.when(may.bitwiseAND(F.lit(1 << k)) != 0, spans).otherwise(_none(k))
        found.append(spans)
    return F.array_sort(F.concat(*found))


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _with(docs: DataFrame, key: str, text: str, rules: tuple[Secret, ...], mask: str, own: str) -> DataFrame:
    """docs with their ids as own and their rules' mask, null where a row is no candidate. Partitions grow with the input."""
    grams, parts = vocabulary(rules), parts_for(docs)
    may = candidates(postings(docs, grams, key, text), grams, rules).withColumnsRenamed({"id": own, "may": mask})
    return docs.withColumn(own, row_id(F.col(key), F.col(text))).repartition(parts, own).join(may.repartition(parts, own), own, "left")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Secret, ...] = RULES) -> DataFrame:
    """(key, body, spans): spans as array<struct<start, k, end>>, k the rule's number. One row for each row of docs."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    joined = _with(rows, "key", "body", rules, "may", "id")
    return joined.select("key", "body", verify(F.col("body"), F.coalesce(F.col("may"), F.lit(0)), rules).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Secret, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark; texts without one stay as they are, null ones too.

    Overlapping spans are replaced as one. Other columns and the order of columns stay.
    """
    names = docs.columns
    mask, own = _unused("may", names), _unused("id", names)
    joined = _with(docs, key, text, rules, mask, own)
    spans = verify(F.col(text), F.coalesce(F.col(mask), F.lit(0)), rules)

    def cut(s: Column) -> Column:
        body = F.col(text)
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(a: Column, x: Column) -> Column:
            gap = F.greatest(x.getField("start") - a.getField("at"), F.lit(0))
            fresh = x.getField("start") >= a.getField("at")
            piece = F.when(fresh, F.concat(F.substring(body, a.getField("at") + 1, gap), F.lit(mark))).otherwise(F.lit(""))
            return F.struct(F.greatest(a.getField("at"), x.getField("end")).alias("at"), F.concat(a.getField("out"), piece).alias("out"))

        tail = lambda a: F.concat(a.getField("out"), F.substring(body, a.getField("at") + 1, F.length(body)))
        return F.when(F.size(s) == 0, body).otherwise(F.aggregate(s, start, step, tail))

    out = F.when(F.col(text).isNull(), F.col(text)).otherwise(let(spans, cut))
    return joined.select(*[(out.alias(c) if c == text else F.col(f"`{c}`")) for c in names])
