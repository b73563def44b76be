"""Plain Python versions of the queries' contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def components(docs, shingle=4, distance=4):
    """doc_id -> (fingerprint, component_id)."""
    prints = {}
    for doc, text in docs:
        words = WORD.findall((text or "").translate(UPPER_TO_LOWER))
        runs = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    distinct = sorted(set(prints.values()))
    parent = {x: x for x in distinct}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[i + 1 :]:
            if (x ^ y).bit_count() <= distance:
                parent[root(x)] = root(y)
    least = {}
    for doc, x in prints.items():
        least[root(x)] = min(doc, least.get(root(x), doc))
    return {doc: (f"{x:016x}", least[root(x)]) for doc, x in prints.items()}


def lines(docs, least_chars=40, least_docs=5):
    """doc_id -> (n_lines, n_dropped, kept text)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER_TO_LOWER)
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = {}
    for doc, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= least_chars and len(holders[key(x)]) >= least_docs and max(holders[key(x)]) != doc)]
        out[doc] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


def contamination(docs, items, n=10):
    """doc_id -> (n_words, n_hit, item ids as sorted strings)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER_TO_LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (run := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[run]
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words, seen, dups = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(hit)
