"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers cut the same bytes into tokens, each an interval. All tokens of both, sorted by start,
are scanned with a running maximum of their ends; where a start reaches it, both
tokenizers have ended a token and a group ends. Within groups every overlapping pair of tokens
is expanded: a token's partners are a run of the other side's tokens, so the work is linear in the links.

The documents of a slice lie one after the other on one line of bytes, so numpy aligns a slice at a time.
Corpus-wide counts of linked id pairs are sums of per-batch sums; they come back to the documents by a join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracekit.llm.common import id_text, partitions, row_count_at_most, tidy, written
from tracekit.llm.token_counts import SPLIT, byte_alphabet

SLICE_ROWS, SLICE_CHARS = 500, 1 << 20    # texts aligned together; a longer text is a slice by itself
BROADCAST_PAIRS = 2_000_000               # rows of 17 bytes

ALIGNED = ("n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, pair_links array<int>")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:-1], 16)]) if is_byte else piece.replace("▁", " ").encode()


class TwoTokenizers:
    """A byte-level vocabulary (A) and a piece model (B), with the bytes of every token."""

    def __init__(self, vocabulary: str, model: str):
        import sentencepiece
        import tiktoken
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        back = byte_alphabet()
        ranks = {"".join(back[c] for c in t).encode("latin-1"): i
                 for t, i in spec["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.n_a, self.n_b = max(ranks.values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.n_b)]
        self.a_size = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        # a token's text with what may follow it: next token, other side, next group, next document
        ids = [str(i) for i in (*range(self.n_a), *range(self.n_b))]
        self.written = [i + after for after in ",|;\n" for i in ids]

    def ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Token ids of both, or None when either does not give back the text's bytes."""
        raw = (" " + text).encode("utf-8")
        a, b = self.a(" " + text), self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return a, b


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The number of the group that each interval falls in, counted from 0 by start."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    opens = np.ones(len(order), bool)
    opens[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    return group


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in A and in B of all overlapping pairs; both sides are sorted and disjoint."""
    low = np.searchsorted(b_end, a_start, "right")
    n = np.searchsorted(b_start, a_end, "left") - low
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(n)), n), at + np.repeat(low, n)


def align_texts(tok: TwoTokenizers, texts: list) -> list[pa.Array]:
    """The columns ALIGNED of one slice of texts."""
    found = [tok.ids(t) if t else None for t in texts]
    some = [k for k, f in enumerate(found) if f is not None]
    counts = np.zeros((5, len(texts)), np.int64)        # n_a, n_b, n_groups, n_links, distinct pairs
    groups: list[str] = [""] * len(texts)
    pairs = links = np.empty(0, np.int64)
    if some:
        a_n, b_n = (np.array([len(found[k][s]) for k in some]) for s in (0, 1))
        a = np.concatenate([np.array(found[k][0], np.int64) for k in some])
        b = np.concatenate([np.array(found[k][1], np.int64) for k in some])
        a_end, b_end = np.cumsum(tok.a_size[a]), np.cumsum(tok.b_size[b])
        a_start, b_start = a_end - tok.a_size[a], b_end - tok.b_size[b]
        start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
        side = np.repeat(np.array([0, 1]), [len(a), len(b)])
        group = coalesce(start, end, side)
        a_doc, b_doc = (np.repeat(np.arange(len(some)), n) for n in (a_n, b_n))
        # groups as text, in order of group, side and start
        order = np.lexsort((start, side, group))
        g, s, doc = group[order], side[order], np.concatenate([a_doc, b_doc])[order]
        after = np.full(len(order), 3)
        after[:-1] = np.where(g[1:] != g[:-1], 2, s[1:] != s[:-1])
        after[:-1][doc[1:] != doc[:-1]] = 3
        code = after * (tok.n_a + tok.n_b) + np.concatenate([a, b + tok.n_a])[order]
        text = "".join(map(tok.written.__getitem__, code.tolist())).split("\n")
        for k, t in zip(some, text):
            groups[k] = t
        i, j = overlaps(a_start, a_end, b_start, b_end)
        space = tok.n_a * tok.n_b
        both, times = np.unique(a_doc[i] * space + a[i] * tok.n_b + b[j], return_counts=True)
        pairs, links = both % space, times
        last = np.cumsum(a_n) - 1
        counts[:, some] = [a_n, b_n, group[last] - group[last - a_n + 1] + 1, np.bincount(a_doc[i], minlength=len(some)),
                           np.bincount(both // space, minlength=len(some))]
    at = pa.array(np.concatenate([[0], np.cumsum(counts[4])]), pa.int32())
    return [*(pa.array(c, pa.int64()) for c in counts[:4]), pa.array(groups, pa.string()),
            pa.ListArray.from_arrays(at, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(at, pa.array(links, pa.int32()))]


def _text_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list]]:
    """Ids and texts of at most SLICE_ROWS rows and SLICE_CHARS characters, one row at least."""
    begin, held, size = 0, [], 0
    for k, t in enumerate(batch.column(1)):
        t = t.as_py()
        if held and (len(held) == SLICE_ROWS or size + len(t or "") > SLICE_CHARS):
            yield batch.column(0).slice(begin, len(held)), held
            begin, held, size = k, [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield batch.column(0).slice(begin, len(held)), held


_TOKENIZERS: dict[tuple[str, str], TwoTokenizers] = {}


def align(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and the columns ALIGNED.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of each smallest stretch of bytes on which both tokenizers agree.
    ``pairs`` holds the linked id pairs (A id * pieces of B + B id, ascending), ``pair_links`` how many of the
    document's links hold each. Null or empty texts, and texts whose bytes either
    tokenizer does not give back, have no tokens: zeros, an empty text and empty lists. Special strings are plain text.
    """
    df = id_text(docs, id_col, text_col)
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (vocabulary, model) not in _TOKENIZERS:
            _TOKENIZERS[vocabulary, model] = TwoTokenizers(vocabulary, model)
        tok = _TOKENIZERS[vocabulary, model]
        for batch in batches:
            for ids, texts in _text_slices(batch):
                yield pa.RecordBatch.from_arrays([ids, *align_texts(tok, texts)],
                                                 names=["doc_id", *[c.split()[0] for c in ALIGNED.split(", ")]])
        tidy()

    return df.mapInArrow(run, f"doc_id {id_type}, {ALIGNED}")


def pair_counts(spark: SparkSession, aligned: DataFrame, pieces: int) -> DataFrame:
    """Written ``pair, n, n_docs, best``: corpus-wide links and documents of every id pair, and whether its B id has none above it.

    Each Arrow batch sums its own pairs first. ``pieces`` is the number of B ids; one B id has no more pairs than A has ids.
    """
    def run(batches):
        for batch in batches:
            pairs, back = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            n = np.bincount(back, weights=batch.column(1).flatten().to_numpy(zero_copy_only=False), minlength=len(pairs))
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n.astype(np.int64)),
                                              pa.array(np.bincount(back, minlength=len(pairs)), pa.int64())],
                                             names=["pair", "n", "n_docs"])
        tidy()

    summed = aligned.select("pairs", "pair_links").mapInArrow(run, "pair long, n long, n_docs long") \
        .groupBy("pair").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    most = F.max("n").over(Window.partitionBy(F.col("pair") % pieces))
    return written(spark, summed.withColumn("best", F.col("n") == most), "pair-counts")


def pair_scores(spark: SparkSession, aligned: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``key, n_best, count_sum`` of the rows that have links, by their unique ``key``.

    The counts are broadcast when there are at most BROADCAST_PAIRS. Else only pairs in very many documents are (four a
    partition at most, as each holds that share of all entries), and the others are joined by shuffle.
    """
    entry = F.explode(F.arrays_zip("pairs", "pair_links")).alias("e")
    own = aligned.select(key, entry).select(key, F.col("e.pairs").alias("pair"), F.col("e.pair_links").cast("long").alias("links"))
    narrow = counts.select("pair", "n", "best")
    if row_count_at_most(counts, BROADCAST_PAIRS):
        met = own.join(F.broadcast(narrow), "pair")
    else:
        many = (counts.agg(F.sum("n_docs")).first()[0] or 0) / (4 * partitions(spark))
        hot = counts.where(F.col("n_docs") > many)
        common = F.broadcast(hot.select("pair"))
        met = own.join(F.broadcast(hot.select("pair", "n", "best")), "pair").unionByName(
            own.join(common, "pair", "left_anti").join(narrow.join(common, "pair", "left_anti"), "pair"))
    return met.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
                                F.sum(F.col("links") * F.col("n")).alias("count_sum"))


def alignment_report(spark: SparkSession, docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per input row: the counts and groups of ``align`` as a digest, with ``n_best`` and ``count_sum``.

    ``n_best`` counts the links whose pair is the commonest of its B id (ties included), ``count_sum`` adds the
    corpus-wide counts over all links. Rows are told apart by a number of their own, so null and repeated ids are kept apart.
    """
    import sentencepiece
    pieces = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    found = align(docs, vocabulary, model, id_col, text_col)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    rows = written(spark, found.withColumn("groups_sha256", digest).drop("groups")
                   .withColumn("_r", F.monotonically_increasing_id()), "aligned")
    scores = pair_scores(spark, rows, pair_counts(spark, rows, pieces), "_r")
    return rows.drop("pairs", "pair_links").join(scores, "_r", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
