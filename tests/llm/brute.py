"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
import zlib
from array import array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def removed_windows(docs, width=20):
    """doc_id -> (n_words, n_removed, kept_sha256); ids are distinct."""
    seen, out = {}, {}
    for doc_id, text in sorted(docs):
        w = words(text)
        gone = set()
        for s in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[s:s + width]), (doc_id, s)) != (doc_id, s):
                gone.update(range(s, s + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near_components(docs, percent=85):
    """doc_id -> (n_shingles, component_id) by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    holders = {}
    for i in sorted(sets):
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    done = set()
    for group in holders.values():
        for k, a in enumerate(group):
            for b in group[k + 1:]:
                if (a, b) in done or root(a) == root(b):
                    continue
                done.add((a, b))
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())
