"""Plain single-machine versions of the operators' contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

BASE = (("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24))


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def secrets(text):
    found = []
    for k, (name, pat, group, least) in enumerate(BASE):
        for m in pat.finditer(text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), k, m.end()))
    found.sort()
    return ([sum(f[1] == k for f in found) for k in range(3)],
            ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in found))


def _lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))


def contamination(docs, items):
    windows = defaultdict(set)
    for item, t in items:
        w = bench_words(t)
        size = min(len(w), 10)
        for i in range(len(w) - size + 1) if w else ():
            windows[tuple(w[i:i + size])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, t in docs:
        w = bench_words(t)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    names |= got
        out.append((doc, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def substrings(docs, size=50):
    raw = [(i, (t or "").encode()) for i, t in docs]
    top = 1 << 62
    least = {}
    for i, b in raw:
        i = top if i is None else i
        for k in range(len(b) - size + 1):
            w = b[k:k + size]
            if least.get(w, top + 1) > i:
                least[w] = i
    out = []
    for i, b in raw:
        n = top if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if least[b[k:k + size]] < n:
                gone[k:k + size] = b"\1" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def line_runs(docs, least_words=50):
    """doc -> kept text; docs in order of id, ids distinct."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    at = defaultdict(list)
    lines = {i: t.split("\n") for i, t in docs if t is not None}
    order = sorted(lines)
    for i in order:
        for k, line in enumerate(lines[i]):
            at[line].append((i, k))
    out = {}
    for i in order:
        own, gone = lines[i], set()
        for k in range(len(own)):
            best = 0
            for j, m in at[own[k]]:
                if (j, m) >= (i, k):
                    break
                n, other = 0, lines[j]
                while k + n < len(own) and m + n < len(other) and own[k + n] == other[m + n]:
                    n += 1
                best = max(best, n)
            if best and sum(len(word.findall(x)) for x in own[k:k + best]) >= least_words:
                gone.update(range(k, k + best))
        out[i] = (len(own), len(gone), "\n".join(x for k, x in enumerate(own) if k not in gone))
    return out


def near(docs, shingle=4, similar=80):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(t))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < shingle else [tuple(w[k:k + shingle]) for k in range(len(w) - shingle + 1)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    inv = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inv[x].append(i)
    for i, s in sets.items():
        common = Counter(j for x in s for j in inv[x] if j < i)
        for j, c in common.items():
            if 100 * c >= similar * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in sets]


def quality(text):
    t = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    w = word.findall(t)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if word.search(line):
            dup += line in seen
        seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep),
            len(w) < 50 or 100 * len(rep) > 50 * len(w))


def crc(ids):
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))
