"""Token counts: heap-and-linked-list byte-pair merging without emitting identifiers.

A pre-token starts as a doubly linked list of its bytes. The heap holds the
adjacent pairs that the vocabulary can merge, by (rank, position); the lowest
is popped again and again, stale entries are skipped, and the count is the
number of initial symbols minus the number of merges.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracekit.llm.common import map_texts

# Fixed value: the byte-level splitting rule of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points outside these ranges may have another class in another Unicode
# version; texts with one are split by the tokenizer's own splitter.
UNSURE = r"[^\x00-԰‐-⁞]"
CACHED_PRETOKENS = 300_000
CACHED_LENGTH = 48


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, str]:
    """Printable stand-ins of the vocabulary file -> the byte, as a Latin-1 character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in set(printable)):
        table[chr(256 + n)] = chr(b)
    return table


class PairMerger(dict):
    """Pre-token -> token count; missing ones are merged and kept in a bounded cache."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {("".join(back[c] for c in a), "".join(back[c] for c in b)): r for r, (a, b) in enumerate(pairs)}
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(SPLIT).findall
        self.unsure = re.compile(UNSURE).search
        self.path, self.splitter = path, None

    def __missing__(self, piece: str) -> int:
        n = self.merge_count(piece.encode("utf-8", "surrogatepass").decode("latin-1"))
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PRETOKENS:
                self.clear()
            self[piece] = n
        return n

    def merge_count(self, symbols: str) -> int:
        size = len(symbols)
        if size < 2:
            return size
        rank = self.rank.get
        sym = list(symbols)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = [(r, i) for i in range(size - 1) if (r := rank((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] is None or j >= size or rank((sym[i], sym[j])) != r:
                continue  # one of the two was merged meanwhile
            sym[i] += sym[j]
            sym[j] = None
            merges += 1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                if (q := rank((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (q, i))
            h = before[i]
            if h >= 0 and (q := rank((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (q, h))
        return size - merges

    def pretokens(self, text: str) -> list[str]:
        if not self.unsure(text):
            return self.split(text)
        if self.splitter is None:
            from tokenizers import Tokenizer
            self.splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self.special is not None:
            parts = self.special.split(text)
            total = len(parts) - 1  # each special string is one token
        for part in parts:
            total += sum(map(self.__getitem__, self.pretokens(part)))
        return total


_MERGERS: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    """One merger per Python worker."""
    if path not in _MERGERS:
        _MERGERS[path] = PairMerger(path)
    return _MERGERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, max_tokens: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row, whole text.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids give
    a row each. A pre-token of any length is merged in O(n log n).
    """
    def columns(texts: list) -> dict:
        m = merger(vocabulary)
        tokens = [m.count(t) if t else 0 for t in texts]
        return {"n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()),
                "over_limit": pa.array([n > max_tokens for n in tokens], pa.bool_())}

    return map_texts(docs, "n_bytes long, n_tokens long, over_limit boolean", columns, id_col, text_col)
