"""Plain versions of the operators, for small fixtures."""

import hashlib
import re
from itertools import combinations

import public_tokenizers

from lexforge.llm import packing, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else None
    if twice is None:
        from collections import Counter

        c = Counter(grams)
        twice = {g for g in c if c[g] > 1}
    covered = {k + j for k, g in enumerate(grams) if g in twice for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": n < 10 or 100 * len(covered) > 20 * n}


def kept(text):
    text = text or ""
    m = measures(text)
    n, c = m["n_words"], m["word_chars"]
    return not (
        m["base_failed"] or 4 * m["n_symbols"] > n or (m["n_dup_lines"] >= 3 and 10 * m["n_dup_lines"] > 3 * (text.count("\n") + 1)) or c < 2 * n or c > 25 * n
        or 2 * len(re.findall("[A-Z]", text)) > c or 2 * text.count("!") > n or 2 * len(re.findall("[0-9]", text)) > c
    )


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def classes(docs):
    """{position: (class id, links)} of [(key, text)]."""
    sets = [shingles(t) for _, t in docs]
    parent, links = list(range(len(docs))), [0] * len(docs)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        if sets[a] and sets[b]:
            c = len(sets[a] & sets[b])
            if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, (key, _) in enumerate(docs):
        r = root(k)
        least[r] = key if r not in least else min(least[r], key)
    return {k: (least[root(k)], links[k]) for k in range(len(docs))}


def covered(docs, window=20):
    """For [(key, text)] in order: the words that go, as Booleans."""
    seen, out = set(), {}
    for k in sorted(range(len(docs)), key=lambda k: docs[k][0]):
        w = WORD.findall(docs[k][1] or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone[i : i + window] = [True] * window
            seen.add(g)
        out[k] = gone
    return [out[k] for k in range(len(docs))]


def cut(text, gone):
    if not any(gone):
        return text
    places = [m.start() for m in WORD.finditer(text)]
    out, k = [text[: places[0]]], 0
    for k, p in enumerate(places):
        end = places[k + 1] if k + 1 < len(places) else len(text)
        if not gone[k]:
            out.append(text[p:end])
    return "".join(out)


def spans(text, rules=secrets.RULES):
    found = []
    for k, r in enumerate(rules):
        pattern = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.get(r.kind, r.pattern)
        least = {"access": 20, "hex": 24}.get(r.kind, r.at_least)
        for m in re.finditer(pattern, text or ""):
            if len(m[r.value]) >= least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def redacted(text, mark="[SECRET]"):
    out, at = [], 0
    for s, _, e in spans(text):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if text is not None else None


def packed(docs, max_tokens, buckets, batch_tokens):
    """[(key, piece, start, n_tokens, bucket, padded_to, ids)] and the bounds of the buckets."""
    encode = packing.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    rows, histogram = [], {}
    for key, text in docs:
        ids = encode(text or "")
        for p in range(max(-(-len(ids) // max_tokens), 1)):
            own = ids[p * max_tokens : (p + 1) * max_tokens]
            rows.append((key, p, p * max_tokens, len(own), own))
            histogram[len(own)] = histogram.get(len(own), 0) + 1
    bounds = packing.optimal_bounds(histogram, buckets)
    place = lambda n: (0, 0) if n == 0 else next((k, b) for k, b in enumerate(bounds, 1) if n <= b)
    return [(*r[:4], *place(r[3]), r[4]) for r in rows], bounds


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
