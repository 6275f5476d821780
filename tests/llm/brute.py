"""Plain statements of what the operators compute, for small inputs."""

import hashlib
import re
from collections import defaultdict

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def substring_dedup(docs, window=20):
    """docs: (doc_id, text) in order of doc_id; the later of two with one id is the later in the list."""
    seen, out = set(), []
    for doc_id, text in docs:
        w = SPACE_WORDS.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out.append((doc_id, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def suffix_dedup(docs, length=400):
    count = defaultdict(int)
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] += 1
    out = []
    for doc_id, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def decontaminate(docs, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = ALNUM_WORDS.findall(lower(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w = ALNUM_WORDS.findall(lower(text))
        hit, names = [False] * len(w), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if k := wins.get(tuple(w[i : i + n])):
                    names |= k
                    hit[i : i + n] = [True] * n
        out.append((doc_id, len(w), sum(hit), len(names), sha(",".join(sorted(names))), any(hit)))
    return out


def shingles(text, k=5):
    w = SPACE_WORDS.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard_join(docs, percent=75):
    """Rows (doc_id, size, component): the smallest doc_id among the rows that links reach; null counts last."""
    sets = [shingles(t) for _, t in docs]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = components(len(docs), links)
    least = {}
    for (doc_id, _), c in zip(docs, comp):
        if doc_id is not None:
            least[c] = min(least.get(c, doc_id), doc_id)
    return [(doc_id, len(s), least.get(c)) for (doc_id, _), s, c in zip(docs, sets, comp)]
