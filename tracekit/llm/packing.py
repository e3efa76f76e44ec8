"""Order-preserving packing of token streams into windows, by dynamic programming.

Documents stay in table order. Candidate cuts are document ends, sentence ends
and, as truncations, a grid inside long sentences. The cost of a window is its
padding plus the penalty of the cut that ends it plus a small cost per window;
``best[j] = min over i of best[i] + window(i, j)`` with ``position[j] - position[i] <= window``.
Padding is linear in the window's start, so the minimum over the sliding range is
the head of a monotone queue; windows of exactly a power of two need no padding
and are looked up directly.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracekit.llm.common import id_text
from tracekit.llm.token_counts import SPLIT, byte_alphabet

CHUNK = 1 << 18              # tokens solved together; a task holds one chunk at a time
GRID, LONG = 16, 32          # truncation candidates inside sentences of more than LONG tokens
WINDOW_COST, SENTENCE_CUT, TRUNCATION = 8, 1, 64
SENTENCE_END = re.compile(rb"[.!?\n][\"')\]]*\s*$")

PIECE_COLUMNS = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class Tokens:
    """Token ids of the vocabulary file, encoded with its ranks; built once per Python worker."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = byte_alphabet()
        ranks = {"".join(back[c] for c in t).encode("latin-1"): i
                 for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        for token, i in ranks.items():
            self.ends[i] = bool(SENTENCE_END.search(token))

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of the whole text, then 0."""
        if not text:
            return np.zeros(1, np.uint32)
        return np.append(np.asarray(self.encoding.encode(text, allowed_special="all"), np.uint32), np.uint32(0))


_TOKENS: dict[str, Tokens] = {}


def cut_points(ends: np.ndarray, doc_ends: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts (token offsets, 0 and ``size`` included) and their penalties."""
    penalty = np.full(size + 1, -1, np.int16)
    penalty[1:][ends] = SENTENCE_CUT
    penalty[doc_ends] = 0
    penalty[0] = penalty[size] = 0
    at = np.flatnonzero(penalty >= 0)
    grid = min(GRID, window)
    for k in np.flatnonzero(np.diff(at) > min(LONG, window)).tolist():
        penalty[at[k] + grid:at[k + 1]:grid] = TRUNCATION
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Offsets of the chosen cuts, first 0 and last the total."""
    pos, pen = at.tolist(), penalty.tolist()
    n = len(pos)
    index = dict(zip(pos, range(n)))
    powers = [1 << k for k in range(4, window.bit_length()) if 1 << k < window]
    best, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])   # candidates i by position, keys best[i] + pos[i] ascending
    key = [0] * n
    for j in range(1, n):
        p = pos[j]
        low = p - window
        while pos[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        cost = key[i] + window - p
        for size in powers:
            h = index.get(p - size)
            if h is not None and best[h] < cost:
                cost, i = best[h], h
        best[j] = cost = cost + WINDOW_COST + pen[j]
        back[j] = i
        key[j] = k = cost + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [pos[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(pos[j])
    return cuts[::-1]


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 1024, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, PIECE_COLUMNS, ``padded`` (tokens the sequence is padded to).

    Every document is its ids and then id 0 (null or empty text: id 0 alone), so
    each row yields at least one piece; repeated rows and null ids are packed like
    any other. Sequences never span tasks: each task packs its own rows in order, in
    chunks of CHUNK tokens, so memory is bounded and a lost task is redone alone. A chunk's last window stays open and begins the next
    chunk, so only the end of a task's rows is a forced cut. A document longer than a chunk goes on in the next one. ``sequence_id`` is unique.
    """
    df = id_text(docs, id_col, text_col)
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _TOKENS:
            _TOKENS[vocabulary] = Tokens(vocabulary)
        tokens = _TOKENS[vocabulary]
        next_sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[object, int, int, np.ndarray]] = []  # id, first token's number, all tokens, ids
        size = 0

        def solve(parts, last):
            """Pieces of the windows of ``parts``, and what is left open: the last window, unless these are the last parts."""
            nonlocal next_sequence
            ids = np.concatenate([p[3] for p in parts])
            total = len(ids)
            bounds = np.cumsum([0] + [len(p[3]) for p in parts])
            whole = np.array([b for b, p in zip(bounds[1:], parts) if p[1] + len(p[3]) == p[2]], np.int64)
            at, penalty = cut_points(tokens.ends[ids], whole, total, window)
            cuts = np.array(best_cuts(at, penalty, window))
            left = []
            if not last and len(cuts) > 2:
                cuts = cuts[:-1]
                for (doc_id, begun, whole_size, part), lo in zip(parts, bounds):
                    skip = max(0, int(cuts[-1]) - int(lo))
                    if skip < len(part):
                        left.append((doc_id, begun + skip, whole_size, part[skip:]))
                total = int(cuts[-1])
            first = np.union1d(bounds[:-1][bounds[:-1] < total], cuts[:-1])
            last = np.append(first[1:], total)
            doc = np.searchsorted(bounds, first, "right") - 1
            seq = np.searchsorted(cuts, first, "right") - 1
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(first.tolist(), last.tolist())]
            used = np.diff(cuts)
            padded = np.where(used & (used - 1) == 0, used, window)
            begun = np.array([p[1] for p in parts])
            columns = [pa.array([parts[d][0] for d in doc.tolist()], batch_id_type),
                       pa.array(begun[doc] + first - bounds[doc], pa.int64()), pa.array(last - first, pa.int64()),
                       pa.array(crc, pa.int64()), pa.array(np.array([p[2] for p in parts])[doc], pa.int64()),
                       pa.array(next_sequence + seq, pa.int64()), pa.array(first - cuts[seq], pa.int64()),
                       pa.array(padded[seq], pa.int64())]
            next_sequence += len(used)
            return pa.RecordBatch.from_arrays(
                columns, names=["doc_id", *[c.split()[0] for c in PIECE_COLUMNS.split(", ")], "padded"]), left

        for batch in batches:
            batch_id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.ids(text.as_py())
                done = 0
                while done < len(ids):
                    part = ids[done:done + CHUNK - size]
                    held.append((doc_id, done, len(ids), part))
                    done += len(part)
                    size += len(part)
                    if size >= CHUNK:
                        out, held = solve(held, False)
                        size = sum(len(p[3]) for p in held)
                        yield out
        if held:
            yield solve(held, True)[0]

    return df.mapInArrow(run, f"doc_id {id_type}, {PIECE_COLUMNS}, padded long")
