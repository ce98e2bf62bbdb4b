"""Plain versions of the operators over small tables."""

import hashlib
import re
from collections import Counter, defaultdict


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeats(texts, size=200):
    """Of each text (bytes): removed places as a list of booleans."""
    seen = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                gone[k : k + size] = [True] * size
        out.append(gone)
    return out


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(zip(*[w[k:] for k in range(size)], strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def linked_components(docs, percent=75):
    """(doc_id, text) to {doc_id: (size, component)}."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def contamination(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(str(item))
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit[k : k + size] = [True] * size
                    found |= own
        out[doc] = (len(w), sum(hit), sorted(found))
    return out


def base_spans(text):
    kinds = ["assign", "access", "hex"]
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)]
