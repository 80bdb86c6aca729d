"""Plain single-machine versions of the contracts, written straight from their words."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def folded(text):
    return FOLDED.findall((text or "").translate(AZ))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def url(u, rules, hints):
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(AZ)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if any(re.search(p, host + path) for p in hints) else "allow"


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def contamination(docs, items, n=10):
    windows = defaultdict(set)
    for k, text in items:
        w = folded(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[i : i + n])].add(None if k is None else str(k))
    sizes = {len(x) for x in windows}
    out = {}
    for k, text in docs:
        w, hit, found = folded(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    found |= own
                    hit.update(range(i, i + size))
        out[k] = (len(w), len(hit), len(found), sha(",".join(sorted(x for x in found if x is not None))), bool(hit))
    return out


def repeats(docs, n=20):
    first = {}
    out = {}
    for k, text in sorted(docs):
        w, gone = words(text), set()
        for i in range(len(w) - n + 1):
            at = first.setdefault(tuple(w[i : i + n]), (k, i))
            if at != (k, i):
                gone.update(range(i, i + n))
        out[k] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def tie(text):
    """The 64-bit hash that Spark's xxhash64 gives a text's bytes, signed."""
    h = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def repeats_by_row(rows, n=20):
    """(id, words, removed, digest) of rows whose ids may be null or shared, in any order."""
    texts = defaultdict(set)
    for k, text in rows:
        texts[k].add(text or "")
    shared = any(len(own) > 1 for k, own in texts.items() if k is not None)
    order = sorted({(k is None, k if k is not None else 0, tie(t) if shared or k is None else 0, t) for k, own in texts.items() for t in own})
    done = repeats([(place, t) for place, (_, _, _, t) in enumerate(order)], n)
    by = {(None if none else k, t): done[place] for place, (none, k, _, t) in enumerate(order)}
    return sorted(((k, *by[k, t or ""]) for k, t in rows), key=str)


def near(docs, k=4, percent=80):
    sets = {}
    for d, text in docs:
        w = words((text or "").translate(AZ))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    by, parent = defaultdict(list), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    for d, s in sets.items():
        for e, n in Counter(e for g in s for e in by[g] if e < d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def shards(docs, n=8):
    rows = [(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in sorted(docs)]
    total, at, slots, out = sum(r[1] for r in rows), 0, Counter(), {}
    for k, size, crc in rows:
        s = at * n // total
        out[k] = (size, crc, s, slots[s])
        slots[s] += 1
        at += size
    return out
