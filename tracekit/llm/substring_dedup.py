"""Exact substring de-duplication on bytes, with suffix arrays of the places in doubt.

Every string of ``window`` bytes has an anchor: its k-gram with the least hash. Equal
strings have equal anchors at equal places, so only strings around shared anchors can
repeat. An anchor with all bytes that any window over it can reach is its context.

1. Each part of the table sends its distinct (anchor, context hash, least id).
2. By anchor: a context that a smaller id has too is a repeat, whole. Where an anchor has
   several contexts, the places they share are in doubt.
3. The contexts in doubt meet by anchor. A hash of their windows drops those that match nothing;
   a suffix array of the rest (linear grouping construction) puts equal windows next to each
   other, and intervals with a common prefix of the window's length give each window its least id.
4. Each part takes the repeated bytes out of its texts.

Groups of copies are reduced to one entry a part before any shuffle. An anchor with very
many contexts in one part (the edge of a passage that everything shares) is not gathered: its windows are
reduced to hashes, which are aggregated.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm.common import id_text, partitions, written
from tracekit.llm.suffix_groups import suffix_array
from tracekit.session import scratch_path

WINDOW = 50
GRAM = 24                     # bytes of an anchor
REACH = WINDOW - GRAM         # bytes of context on either side
SUBPARTS = 4                  # parts a scan task's rows are split into
BUCKETS = 4                   # anchor buckets per shuffle partition
HOT_CONTEXTS = 64             # of one anchor in one part, before its windows are aggregated instead
HOT_TOTAL = 1_024             # of one anchor over all parts: beyond it too
SYMBOLS = 10_000              # of one suffix array
BLOCK = 1 << 19               # bytes hashed together
PAD = 0xFF                    # never in UTF-8
NO_ID = np.iinfo(np.int64).max
REPEATED, DOUBT, HOT = 1, 2, 4

_U = np.uint64
_MULTIPLY = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def _words_at(buffer: np.ndarray, start: int, count: int) -> np.ndarray:
    """The eight bytes at each of ``count`` successive places, as numbers (a view)."""
    return np.ndarray((count,), "<u8", buffer.data, start, (1,))


def _mixed(h: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ word) * _MULTIPLY[k % 3]
    h ^= h >> _U(29 + k % 3)
    return h


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` over each ``width`` successive values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return f(x[:len(x) - rest], x[rest:]) if rest else x


def anchor_places(buffer: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all windows in ``buffer[:size]`` that hold no PAD byte.

    ``buffer`` goes on for at least 2 * WINDOW PAD bytes after ``size``.
    """
    places, hashes = [], []
    span = REACH + 1                                    # anchors a window can choose from
    for at in range(0, size, BLOCK):
        starts = min(BLOCK, size - at)
        n = starts + span - 1
        h = _words_at(buffer, at, n) * _MULTIPLY[0]
        h ^= h >> _U(31)
        for k, off in enumerate(range(8, GRAM, 8), 1):
            h = _mixed(h, _words_at(buffer, at + off, n), k)
        h ^= h >> _U(32)
        least = _sliding(h, span, np.minimum)
        bad = np.cumsum(buffer[at:at + starts + WINDOW] == PAD)
        least[bad[WINDOW - 1:WINDOW - 1 + starts] - bad[:starts] + (buffer[at:at + starts] == PAD) > 0] = 0
        around = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
        chosen = np.flatnonzero((_sliding(around, span, np.maximum) == h) & (h > 0))
        places.append(chosen + at)
        hashes.append(h[chosen])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, keep = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[keep]


def _sorted(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Order by 48-bit anchor, then context: one sort of a joint key where that decides."""
    key = (anchor << _U(16)) | (context >> _U(48))
    order = np.argsort(key)
    k, c = key[order], context[order]
    if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():
        return np.lexsort((context, anchor))
    return order


class Part:
    """The texts of one part in one padded buffer, with their anchors and distinct entries."""

    def __init__(self, ids, texts):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        gap = bytes([PAD]) * WINDOW
        self.buffer = np.frombuffer(gap + gap.join(raw) + gap * 3, np.uint8)
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.starts = WINDOW + np.cumsum(self.lengths + WINDOW) - self.lengths - WINDOW
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        places, hashes = anchor_places(self.buffer, len(self.buffer) - 3 * WINDOW)
        self.places = places
        self.doc = self.ids[np.searchsorted(self.starts, places, "right") - 1]
        whole = _words_at(self.buffer, 0, len(self.buffer) - 7)
        context = np.full(len(places), 7, np.uint64)
        reach = range(-REACH, GRAM + REACH - 7, 8)
        for k, off in enumerate([*reach, GRAM + REACH - 8]):
            context = _mixed(context, whole[places + off], k)
        # least hashes are small; mixed again they spread over the buckets. 48 bits are sent
        anchor = _mixed(hashes, _U(0), 1) >> _U(16)
        context |= _U(1)                                # 0 marks a hot anchor
        # anchors with too many contexts here get one entry, context 0
        order = _sorted(anchor, context)
        a, c = anchor[order], context[order]
        fresh = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))[:len(a)]
        group = np.cumsum(np.append(True, a[1:] != a[:-1])[:len(a)]) - 1
        many = np.bincount(group, weights=fresh) > HOT_CONTEXTS if len(a) else np.empty(0, bool)
        hot = many[group] if len(a) else np.empty(0, bool)
        c = np.where(hot, _U(0), c)
        fresh = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))[:len(a)]
        entry = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        self.anchor, self.context = a[first], c[first]
        self.entry = np.empty(len(a), np.int64)         # of each place
        self.entry[order] = entry
        self.least = np.minimum.reduceat(self.doc[order], first) if len(a) else np.empty(0, np.int64)

    def buckets(self, count: int) -> np.ndarray:
        """Bucket of each entry: ascending, as the entries are sorted by anchor."""
        return ((self.anchor >> _U(16)) * _U(count) >> _U(32)).astype(np.int64)

    def hot_windows(self, flags: np.ndarray):
        """Distinct windows over hot anchors: (hash 1, hash 2, least id), and start, window number and id of each."""
        whole = _words_at(self.buffer, 0, len(self.buffer) - 7)
        hot = (flags[self.entry] & HOT > 0) | (self.context[self.entry] == 0)
        at = np.unique((self.places[hot][:, None] - np.arange(REACH + 1)).ravel())
        doc = np.maximum(np.searchsorted(self.starts, at, "right") - 1, 0)
        ok = (at >= self.starts[doc]) & (at + WINDOW <= self.starts[doc] + self.lengths[doc])
        at, doc = at[ok], doc[ok]
        keys = []
        for seed in (3, 11):
            h = np.full(len(at), seed, np.uint64)
            for k, off in enumerate([*range(0, WINDOW - 7, 8), WINDOW - 8]):
                h = _mixed(h, whole[at + off], k + seed)
            keys.append(h)
        order = np.lexsort((keys[1], keys[0]))
        x, y = keys[0][order], keys[1][order]
        fresh = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[:len(x)]
        first = np.flatnonzero(fresh)
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(fresh) - 1
        ids = self.ids[doc]
        least = np.minimum.reduceat(ids[order], first) if len(at) else np.empty(0, np.int64)
        return x[first], y[first], least, at, number, ids


def _planes(x: np.ndarray, size: int) -> bytes:
    """The numbers' lowest ``size`` bytes, plane by plane, so that small numbers compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unplanes(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.reshape(-1).view("<u8")


def _part_of(table: pa.Table) -> Part:
    return Part(table["doc_id"].to_pylist(), table["text"].to_pylist())


def _entries(buckets: int):
    """Step 1: a row for each part and bucket."""
    def run(table: pa.Table) -> pa.Table:
        part, number = _part_of(table), table["part"][0].as_py()
        b = part.buckets(buckets)
        cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))[:len(b)]
        ends = np.append(cut[1:], len(b)).astype(np.int64)
        spans = list(zip(cut.tolist(), ends.tolist()))
        # ids relative to the least: small numbers
        return pa.table({
            "bucket": pa.array(b[cut], pa.int32()), "part": pa.array([number] * len(cut), pa.int32()),
            "first": pa.array(cut, pa.int32()),
            "anchors": pa.array([_planes(part.anchor[s:e], 6) for s, e in spans], pa.binary()),
            "contexts": pa.array([_planes(part.context[s:e], 8) for s, e in spans], pa.binary()),
            "ids": pa.array([_planes(part.least[s:e].view(np.uint64), 8) for s, e in spans], pa.binary())})
    return run


def _compare(table: pa.Table) -> pa.Table:
    """Step 2, one bucket: flags and, for shared contexts, the least id, back to each part."""
    rows = list(zip(*(table[c].to_pylist() for c in ("part", "first", "anchors", "contexts", "ids"))))
    anchor = np.concatenate([_unplanes(r[2], 6) for r in rows])
    context = np.concatenate([_unplanes(r[3], 8) for r in rows])
    least = np.concatenate([_unplanes(r[4], 8) for r in rows]).view(np.int64)
    bounds = np.cumsum([0] + [len(r[2]) // 6 for r in rows])
    order = _sorted(anchor, context)
    a, c = anchor[order], context[order]
    new_anchor = np.append(True, a[1:] != a[:-1])
    new = new_anchor | np.append(True, c[1:] != c[:-1])
    first = np.flatnonzero(new)
    cls = np.cumsum(new) - 1
    class_least = np.minimum.reduceat(least[order], first)
    group = np.cumsum(new_anchor) - 1
    contexts = np.bincount(group, weights=new)
    hot = np.zeros(len(contexts), bool)
    hot[group[c == 0]] = True
    hot |= contexts > HOT_TOTAL
    shared = np.bincount(group) > 1
    flag = np.where(hot[group], np.where(shared[group], HOT, 0),
                    np.where(contexts[group] > 1, DOUBT, 0) | np.where(class_least[cls] < least[order], REPEATED, 0))
    flags = np.empty(len(a), np.uint8)
    flags[order] = flag
    lows = np.empty(len(a), np.int64)
    lows[order] = class_least[cls]
    out = []
    for r, s, e in zip(rows, bounds[:-1], bounds[1:]):
        at = np.flatnonzero(flags[s:e])
        if len(at):
            out.append((r[0], "flags", at + r[1], flags[s:e][at].astype(np.int64), lows[s:e][at]))
    return _numbers(out)


def _numbers(rows) -> pa.Table:
    """Rows ``part, kind, entry[], value[], low[]``: what parts are told."""
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.string()),
                     **{name: pa.array([_planes(np.asarray(r[k]).astype(np.int64).view(np.uint64), 8) for r in rows], pa.binary())
                        for k, name in ((2, "entry"), (3, "value"), (4, "low"))}})


TOLD = "part int, kind string, entry binary, value binary, low binary"


def _told(table: pa.Table, kind: str):
    rows = [(e, v, w) for k, e, v, w in zip(*(table[c].to_pylist() for c in ("kind", "entry", "value", "low"))) if k == kind]
    if not rows:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate([_unplanes(r[k], 8) for r in rows]).view(np.int64) for k in range(3))


def _flags_of(part: Part, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flags, lows = np.zeros(len(part.anchor), np.int64), part.least.copy()
    entry, value, low = _told(told, "flags")
    flags[entry], lows[entry] = value, low
    return flags, lows


OPEN = "part int, bucket int, number int, anchor long, id long, context binary, x long, y long"


def _open_cases(buckets: int):
    """Step 3a, one part: the contexts in doubt, from the part that holds their least id, and
    the distinct windows over hot anchors (rows without a context)."""
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        at = entries = places = np.empty(0, np.int64)
        x = y = np.empty(0, np.uint64)
        least = lows = np.empty(0, np.int64)
        number, bucket, anchor = 0, at, at
        size = GRAM + 2 * REACH
        raw = b""
        if table.num_rows and told.num_rows:
            part, number = _part_of(table), table["part"][0].as_py()
            flags, low = _flags_of(part, told)
            at = np.flatnonzero((flags[part.entry] & DOUBT > 0) & (part.doc == low[part.entry]))
            entries, keep = np.unique(part.entry[at], return_index=True)  # one place stands for all of an entry's
            places = part.places[at[keep]]
            raw = part.buffer[places[:, None] + np.arange(-REACH, GRAM + REACH)].tobytes()
            bucket, anchor, lows = part.buckets(buckets)[entries], part.anchor[entries].astype(np.int64), low[entries]
            x, y, least, _, _, _ = part.hot_windows(flags)
        n, m = len(entries), len(x)
        contexts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(
            (np.arange(n + 1, dtype=np.int32) * size).tobytes()), pa.py_buffer(raw)])

        def column(doubt, hot, kind):
            return pa.chunked_array([doubt if isinstance(doubt, pa.Array) else pa.array(doubt, kind),
                                     pa.nulls(m, kind) if hot is None else pa.array(hot, kind)])

        return pa.table({
            "part": column(np.full(n, number), np.full(m, number), pa.int32()), "bucket": column(bucket, None, pa.int32()),
            "number": column(entries, np.arange(m), pa.int32()), "anchor": column(anchor, None, pa.int64()),
            "id": column(lows, least, pa.int64()), "context": column(contexts, None, pa.binary()),
            "x": column(pa.nulls(n, pa.int64()), x.view(np.int64), pa.int64()),
            "y": column(pa.nulls(n, pa.int64()), y.view(np.int64), pa.int64())})
    return run


def equal_windows(group: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each context, a bit per window (by bytes left of the anchor) that a smaller id's context has too.

    ``group`` numbers equal anchors, ``rows`` holds REACH + GRAM + REACH bytes a context.
    """
    n = len(rows)
    out = np.zeros(n, np.int64)
    left = np.cumprod(rows[:, REACH - 1::-1] != PAD, axis=1).sum(axis=1)
    right = np.cumprod(rows[:, REACH + GRAM:] != PAD, axis=1).sum(axis=1)
    rows = np.ascontiguousarray(rows)
    low, high = np.full(n, REACH + 1), np.full(n, -1)
    for o in range(REACH + 1):                          # screening: windows whose hash occurs under another id
        some = np.flatnonzero((left >= o) & (right >= REACH - o))
        if not len(some):
            continue
        h = group.astype(np.uint64)
        begin = REACH - o
        for k, off in enumerate([*range(0, WINDOW - 7, 8), WINDOW - 8]):
            h = _mixed(h, np.ndarray((n,), "<u8", rows.data, begin + off, (rows.shape[1],)), k)
        h = h[some]
        order = np.argsort(h)
        x = h[order]
        new = np.append(True, x[1:] != x[:-1])
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        own = ids[some][order]
        differ = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
        hit = some[order[differ[number]]]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = np.maximum(high[hit], o)
    live = np.flatnonzero(high >= 0)
    live = live[np.argsort(group[live], kind="stable")]
    begin = 0
    cost = np.cumsum(high[live] + REACH - low[live] + 2)
    while begin < len(live):
        stop = int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + SYMBOLS, "right"))
        stop = max(stop, begin + 1)
        while stop < len(live) and group[live[stop]] == group[live[stop - 1]]:
            stop += 1                                   # an anchor's contexts stay together
        _decide(live[begin:stop], group, rows, ids, low, high, out)
        begin = stop
    return out


def _decide(live, group, rows, ids, low, high, out) -> None:
    """Set the bits of ``live`` contexts: equal windows are neighbours in the suffix array."""
    _, symbol = np.unique(group[live], return_inverse=True)
    parts, starts, owner, offset, at = [], [], [], [], 0
    for k, r in enumerate(live.tolist()):
        a, b = int(low[r]), int(high[r])                # bytes kept left: b, right: REACH - a
        line = np.empty(b + 1 + REACH - a + 1, np.int64)
        line[:b] = rows[r, REACH - b:REACH]
        line[b] = 257 + symbol[k]                       # the anchor, one symbol
        line[b + 1:-1] = rows[r, REACH + GRAM:REACH + GRAM + REACH - a]
        line[-1] = 256                                  # ends a context; no window holds it
        parts.append(line)
        starts.append(np.arange(at, at + b - a + 1))
        offset.append(np.arange(b, a - 1, -1))
        owner.append(np.full(b - a + 1, r))
        at += len(line)
    text = np.concatenate(parts)
    starts, owner, offset = np.concatenate(starts), np.concatenate(owner), np.concatenate(offset)
    rank = np.empty(len(text), np.int64)
    rank[suffix_array(text)] = np.arange(len(text))
    order = np.argsort(rank[starts])
    s = starts[order]
    same = np.ones(len(s) - 1, bool)
    for k in range(REACH + 1):                          # neighbours with a common prefix of a window's length
        same &= text[s[1:] + k] == text[s[:-1] + k]
    new = np.append(True, ~same)
    own = ids[owner[order]]
    least = np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
    repeated = least < own
    np.bitwise_or.at(out, owner[order][repeated], np.left_shift(1, offset[order][repeated]))


def _bits(table: pa.Table) -> pa.Table:
    """Step 3b, one bucket of contexts in doubt: a bit mask for each part's entries."""
    part, entry, anchor, ids = (table[c].to_numpy() for c in ("part", "number", "anchor", "id"))
    rows = np.frombuffer(b"".join(table["context"].to_pylist()), np.uint8).reshape(len(part), -1)
    keys = [anchor] + [np.ascontiguousarray(rows[:, REACH + k:REACH + k + 8]).view("<u8").ravel() for k in range(0, GRAM, 8)]
    order = np.lexsort(keys)                            # the anchor's bytes decide, not its hash
    new = np.zeros(len(part), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    group = np.empty(len(part), np.int64)
    group[order] = np.cumsum(new)
    bits = equal_windows(group, rows, ids)
    some = np.flatnonzero(bits)
    some = some[np.argsort(part[some], kind="stable")]
    cut = np.flatnonzero(np.append(True, part[some][1:] != part[some][:-1]))[:len(some)]
    return _numbers([(int(part[some[s]]), "bits", entry[some[s:e]], bits[some[s:e]], bits[some[s:e]])
                     for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(some)])])


def repeated_spans(part: Part, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends, in the part's buffer, of the maximal runs of bytes that go."""
    if not len(part.places):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flags, lows = _flags_of(part, told)
    known = (flags[part.entry] & HOT == 0) & (part.context[part.entry] != 0)
    # contexts that a smaller id has too, here or elsewhere: gone as a whole, up to the text's ends
    whole = np.flatnonzero(known & (lows[part.entry] < part.doc))
    text = np.searchsorted(part.starts, part.places[whole], "right") - 1
    begins = [np.maximum(part.places[whole] - REACH, part.starts[text])]
    ends = [np.minimum(part.places[whole] + GRAM + REACH, part.starts[text] + part.lengths[text])]
    # contexts in doubt: the windows found
    bits = np.zeros(len(part.anchor), np.int64)
    entry, value, _ = _told(told, "bits")
    bits[entry] = value
    some = np.flatnonzero(known & (lows[part.entry] == part.doc) & (bits[part.entry] != 0))
    place, mask = part.places[some], bits[part.entry[some]]
    begins += [place[(mask >> o) & 1 == 1] - o for o in range(REACH + 1)]
    # windows over hot anchors
    _, _, least, at, number, ids = part.hot_windows(flags)
    if len(at):
        entry, value, _ = _told(told, "hot")
        least[entry] = np.minimum(least[entry], value)
        begins.append(at[least[number] < ids])
    ends += [b + WINDOW for b in begins[1:]]
    begin, end = np.concatenate(begins), np.concatenate(ends)
    if not len(begin):
        return begin, end
    order = np.argsort(begin)
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _result(id_type: pa.DataType):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], id_type), "n_bytes": pa.array([], pa.int64()),
                             "spans": pa.array([], SPANS), "kept": pa.array([], pa.binary())})
        part = _part_of(table)
        begin, end = repeated_spans(part, told)
        text = np.searchsorted(part.starts, begin, "right") - 1
        cuts: dict[int, list] = {}
        for t, a, b in zip(text.tolist(), (begin - part.starts[text]).tolist(), (end - part.starts[text]).tolist()):
            cuts.setdefault(t, []).append((a, b))
        kept = []
        for t, (s, n) in enumerate(zip(part.starts.tolist(), part.lengths.tolist())):
            whole = part.buffer[s:s + n].tobytes()
            if t in cuts:
                edges = [0, *(x for c in cuts[t] for x in c), n]
                whole = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2]))
            kept.append(whole)
        spans = [[{"start": a, "end": b} for a, b in cuts.get(t, ())] for t in range(len(kept))]
        return pa.table({"doc_id": table["doc_id"].combine_chunks(), "n_bytes": pa.array(part.lengths, pa.int64()),
                         "spans": pa.array(spans, SPANS), "kept": pa.array(kept, pa.binary())})
    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, spans`` (removed byte ranges), ``kept`` (remaining bytes).

    A byte goes when a string of WINDOW bytes over it also starts in a row with a smaller id
    (matches within texts, judged on the input). Null text is empty. Ids must be integers; a null id
    is larger than all others, and rows with equal ids never count as smaller than each other.
    The texts are copied once, bucketed by part, and never shuffled.
    """
    d = id_text(docs, id_col, text_col)
    d = d.select(F.col("doc_id").cast("long"), "text", (F.spark_partition_id() * SUBPARTS + F.pmod(
        F.xxhash64("text"), F.lit(SUBPARTS)).cast("int")).alias("part"))
    n = max(2, partitions(spark))
    name = f"parts_{uuid.uuid4().hex[:16]}"
    d.write.option("compression", "zstd").bucketBy(n, "part").option(
        "path", scratch_path(spark, "parts")).saveAsTable(name)
    parts = spark.table(name)
    buckets = BUCKETS * n
    entries = parts.groupBy("part").applyInArrow(
        _entries(buckets), "bucket int, part int, first int, anchors binary, contexts binary, ids binary")
    told = written(spark, entries.repartition(n, "bucket").groupBy("bucket").applyInArrow(_compare, TOLD), "flags")
    with_told = lambda t: parts.groupBy("part").cogroup(t.groupBy("part"))
    cases = written(spark, with_told(told).applyInArrow(_open_cases(buckets), OPEN), "open")
    bits = cases.where("context is not null").select("part", "bucket", "number", "anchor", "id", "context")
    bits = written(spark, bits.repartition(n, "bucket").groupBy("bucket").applyInArrow(_bits, TOLD), "bits")
    hot = cases.where("context is null").select("part", "number", "x", "y", "id")
    low = hot.groupBy("x", "y").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot_told = hot.join(low, ["x", "y"]).where("low < id").groupBy("part").applyInArrow(_hot_told, TOLD)
    everything = told.unionByName(bits).unionByName(hot_told)
    return with_told(everything).applyInArrow(
        _result(pa.int64()), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _hot_told(table: pa.Table) -> pa.Table:
    part, number, low = (table[c].to_numpy() for c in ("part", "number", "low"))
    return _numbers([(int(part[0]), "hot", number, low, low)])


def digest_columns(removed: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                          F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
