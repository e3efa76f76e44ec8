"""Plain single-machine versions of conversation repair, token alignment and sharding."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repair(rows):
    """rows: (turn, role, text) in order -> the contract's columns behind conv_id."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(SPACE)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen
                      else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    count = Counter(faults)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    n = len(rows)

    @cache
    def best(i, state, inserts):
        """(cost, audit, lines) from row i on; at most three insertions in a row can be of use."""
        options = [(0, "", ())] if i == n and state in ("", "a") else []
        if inserts < 3:
            for role in ("user", "assistant"):
                if (to := grammar.get((state, role[0]))) is not None:
                    c, a, lines = best(i, to, inserts + 1)
                    options.append((2 + c, "I" + a, (f"{role}:", *lines)))
        if i < n:
            _, role, text = rows[i]
            c, a, lines = best(i + 1, state, 0)
            options.append((3 + c, "D" + a, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                for kind, paid, new in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if (to := grammar.get((state, new[:1]))) is not None:
                        c, a, lines = best(i + 1, to, 0)
                        options.append((paid + extra + c, kind + a, (f"{new}:{text}", *lines)))
        return min(options, key=lambda o: o[:2], default=(1 << 40, "", ()))

    cost, audit, lines = best(0, "", 0)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(lines))


def repaired(rows, damage=True):
    """conv_id -> the contract's other columns; rows (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in damaged(rows) if damage else rows:
        by[conv].append((turn, role, text))
    return {c: repair(sorted(by[c], key=lambda r: (r[0] is not None, r[0] or 0))) for c in {r[0] for r in rows}}


def aligned(docs):
    """Contract rows of op12, one per document in order, with sets and loops over single bytes."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    found, total = [], Counter()
    for text in docs:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        parts = [[bytes(byte[c] for c in t.id_to_token(i)) for i in a], [piece(i) for i in b]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            found.append(None)
            continue
        owner = [[k for k, p in enumerate(side) for _ in p] for side in parts]
        links = sorted(set(zip(*owner)))
        cut = lambda side: {sum(map(len, side[:0])) + x for x in _ends(side)}
        ends = sorted(cut(parts[0]) & cut(parts[1]))
        groups, begin = [], 0
        at = [_ends(p) for p in parts]
        for e in ends:
            sides = [",".join(str(i) for i, x in zip(ids, where) if begin < x <= e) for ids, where in zip((a, b), at)]
            groups.append("|".join(sides))
            begin = e
        ids = [(a[x], b[y]) for x, y in links]
        total.update(ids)
        found.append((len(a), len(b), len(groups), ids, sha(";".join(groups))))
    most = defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else
            (*f[:3], len(f[3]), sum(total[p] == most[p[1]] for p in f[3]), sum(total[p] for p in f[3]), f[4]) for f in found]


def _ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def _drawn(digits, *parts):
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:digits], 16)


def sharded(docs, shards=40, seed="interleave"):
    """Rows (doc_id, text, source) -> (doc_id, size, crc, shard, slot), one per row; equal rows in any order."""
    by = defaultdict(list)
    for i, t, s in docs:
        by[s].append((_drawn(15, seed, " " if i is None else str(i), hashlib.md5((t or "").encode()).hexdigest()),
                      i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16))
    line = []
    for s, rows in by.items():
        key = "" if s is None else "=" + s
        offset = (_drawn(8, seed, key) + 0.5) / 2**32
        for r, row in enumerate(sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2]))):
            line.append(((r + offset) / len(rows), key, r, row))
    line.sort()
    n, out, used = len(line), [], Counter()
    for p, (_, _, _, (_, i, crc, size)) in enumerate(line):
        shard = p * shards // n
        out.append((i, size, crc, shard, used[shard]))
        used[shard] += 1
    return out
