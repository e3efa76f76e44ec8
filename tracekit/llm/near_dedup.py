"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 64-bit numbers give every signature coordinate: the first
scatters the shingles, the second, shifted circularly by the coordinate's
number, orders them. Equal shingle sets collapse to one class first. Classes that
share a band are candidates; each candidate pair that could still join two
components is verified on the full sets.

A shingle that one class alone holds is in no intersection. Its count bounds the similarity of a class
with any other, exactly, before a pair is made; copies with many edits leave the buckets that way.

Within a bucket the pairs are not made as rows. First every member meets one pivot of its bucket, in buckets of several
bands together, then of single bands; that links most of a large group. Buckets that still hold several components go on
with the shingle sets of their members: the largest component's members and the others are dealt into blocks, and a task
tests one block against another, pairs of one component left out. It returns no more links than it needs to
connect what it has found, so no link that banding finds is lost and nothing grows with the square of a bucket
but the tests themselves, which are spread over the blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm.common import forget, id_text, row_count_at_most, tidy, written
from tracekit.llm.components import components

SHINGLE = 4
SIMILAR = 80                 # per cent
BANDS, ROWS = 30, 5          # a pair at 0.8 is missed with probability (1 - 0.8**5) ** 30, about 7e-6
#: Bands joined to one key, a round of pivots each: joined bands are selective, so nearly all pairs in them are links.
PLAN = (3, 1)
MEMBERS = 512                # of a bucket tested together with as many others
COLUMNS = 2048               # shingles of a block counted at a time
CACHED_WORDS = 100_000
BLOCK = 1 << 15              # shingles hashed together, about what stays in a core's cache
BROADCAST_DOCUMENTS = 200_000

_U = np.uint64
_MULTIPLY = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_SHIFT = 0xD1B54A32D192ED03  # odd: multiples of it are distinct circular shifts


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = WordHashes()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; empty without words.

    A-Z are lower-cased, words are split at ASCII white space (bytes.split does just that).
    With fewer than ``size`` words the whole sequence is the one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    out = h[:n] * _MULTIPLY[0]
    for k in range(1, size):
        out ^= out >> _U(29)
        out += h[k:k + n]
        out *= _MULTIPLY[k % 3]
    out ^= out >> _U(32)
    return np.unique(out)


def _order(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers, in place."""
    np.right_shift(x, _U(32), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, _MULTIPLY[1], out=x)
    np.right_shift(x, _U(29), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, _MULTIPLY[2], out=x)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash: ``len(sets) x size``; all sets must hold something."""
    out = np.full((len(sets), size), np.iinfo(np.uint64).max, np.uint64)
    group: list[int] = []
    held = 0

    def flush():
        bounds = np.cumsum([0] + [len(sets[g]) for g in group])
        first = np.concatenate([sets[g] for g in group])
        first = _order(first * _MULTIPLY[0], np.empty_like(first))  # the first permutation
        for at in range(0, len(first), BLOCK):
            part = first[at:at + BLOCK]
            rows = np.searchsorted(bounds, at, "right") - 1
            stop = np.searchsorted(bounds, at + len(part), "left")
            starts = np.maximum(bounds[rows:stop] - at, 0)
            who = np.array(group[rows:stop])
            x, spare = np.empty_like(part), np.empty_like(part)
            for k in range(size):  # the second, shifted by k steps
                np.add(part, _U(k * _SHIFT & (1 << 64) - 1), out=x)
                least = np.minimum.reduceat(_order(x, spare), starts)
                out[who, k] = np.minimum(out[who, k], least)

    for g, s in enumerate(sets):
        group.append(g)
        held += len(s)
        if held >= BLOCK:
            flush()
            group, held = [], 0
    if group:
        flush()
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ROWS coordinates."""
    b = signature.reshape(len(signature), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MULTIPLY[0] + np.zeros((len(signature), 1), np.uint64)
    for r in range(ROWS):
        key = (key ^ b[:, :, r]) * _MULTIPLY[r % 3]
        key ^= key >> _U(31)
    return key.view(np.int64)


def sketch(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, _h, n_shingles, cls, bands``: cls names the shingle set (null when empty)."""
    d = id_text(docs, id_col, text_col)
    d = d.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    id_type = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [shingle_set(t.as_py(), shingle) for t in part.column(1)]
                some = [k for k, s in enumerate(sets) if len(s)]
                keys = band_keys(signatures([sets[k] for k in some], BANDS * ROWS)) if some else []
                bands = [None] * len(sets)
                for k, row in zip(some, keys):
                    bands[k] = row
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                              pa.binary()),
                     pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "_h", "n_shingles", "cls", "bands"])
        tidy()

    return d.mapInArrow(run, f"doc_id {id_type}, _h long, n_shingles long, cls binary, bands array<long>")


def _sets_of(spark, docs, wanted, shingle, id_col, text_col) -> DataFrame:
    """Written table ``cls, num, members`` (sorted 64-bit hashes as bytes) of the wanted classes' representatives."""
    d = id_text(docs, id_col, text_col).withColumn("_h", F.xxhash64("text"))
    w = wanted.select("cls", "num", F.col("rep.id").alias("w_id"), F.col("rep.h").alias("w_h"))
    if row_count_at_most(w, BROADCAST_DOCUMENTS):
        w = F.broadcast(w)
    texts = d.join(w, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("_h") == F.col("w_h"))).select("cls", "num", "text")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(
                        [shingle_set(t.as_py(), shingle).tobytes() for t in part.column(2)], pa.binary())],
                    names=["cls", "num", "members"])
        tidy()

    return written(spark, texts.mapInArrow(run, "cls binary, num long, members binary").dropDuplicates(["cls"]), "sets")


def _alone(sets: DataFrame) -> DataFrame:
    """``num, alone``: how many shingles of a class no other candidate class holds."""
    def run(batches):
        for b in batches:
            for num, members in zip(b.column(0).to_pylist(), b.column(1)):
                m = np.frombuffer(members.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), num), pa.int64()), pa.array(m, pa.int64())],
                                                 names=["num", "s"])
        tidy()

    rows = sets.select("num", "members").mapInArrow(run, "num long, s long")
    one = rows.groupBy("s").agg(F.min("num").alias("num"), F.max("num").alias("other")).where("num = other")
    return one.groupBy("num").agg(F.count(F.lit(1)).alias("alone"))


def _verified(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    with_b = pairs.join(sets.select(F.col("cls").alias("b"), F.col("members").alias("b_set")), "b")
    with_both = with_b.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("a_set")), "a")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = _in_both(p, q)
                keep.append(100 * common >= similar * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        tidy()

    return with_both.select("a", "b", "a_set", "b_set").mapInArrow(run, "a binary, b binary")


def _several(members: DataFrame, of: str) -> DataFrame:
    """The keys with more than one value of ``of``."""
    return members.groupBy("key").agg(F.min(of).alias("x"), F.max(of).alias("y")).where("x != y").select("key")


def _links(spark: SparkSession, docs, classes, shingle, similar, id_col, text_col) -> DataFrame | None:
    """Written ``node, comp`` of the classes that have a link; None when there is none."""
    keyed = classes.select("cls", F.explode("bands").alias("key"))
    wanted = keyed.join(_several(keyed, "cls"), "key").select("cls").distinct()
    wanted = written(spark, classes.join(wanted, "cls").withColumn("num", F.monotonically_increasing_id()), "wanted")
    if wanted.isEmpty():
        return None
    sets = _sets_of(spark, docs, wanted, shingle, id_col, text_col)
    # of n shingles, ``most`` can be in an intersection
    able = wanted.join(_alone(sets), "num", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0))) \
        .where(F.col("most") * 100 >= F.col("n") * similar).select("cls", "rep", "n", "most", "bands")
    able = written(spark, able, "able")
    forget(spark, wanted)
    labels = None
    for joined in PLAN:
        members = _still_open(spark, able, joined, labels)
        chosen = members.groupBy("key").agg(F.min(F.struct("rep", "cls", "n", "most", "comp")).alias("p"))
        met = members.join(chosen, "key").where(
            (F.col("p.comp") != F.col("comp"))
            & (F.least("p.most", "most") * (100 + similar) >= (F.col("p.n") + F.col("n")) * similar))
        pairs = met.select(F.least("p.cls", "cls").alias("a"), F.greatest("p.cls", "cls").alias("b")).distinct()
        found = written(spark, _verified(pairs, sets, similar), "links")
        forget(spark, members)
        labels = _relabelled(spark, labels, found)
    members = _still_open(spark, able, 1, labels)
    found = written(spark, _block_links(members, sets, similar), "links")
    forget(spark, members, sets, able)
    return _relabelled(spark, labels, found)


def _still_open(spark: SparkSession, able: DataFrame, joined: int, labels: DataFrame | None) -> DataFrame:
    """Written ``key, cls, rep, n, most, comp`` of the buckets that hold several components."""
    keys = F.col("bands") if joined == 1 else F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - joined), F.lit(joined)),
        lambda i: F.xxhash64(i, *[F.get("bands", i + k) for k in range(joined)]))
    if labels is None:
        own = able.withColumn("comp", F.col("cls"))
    else:
        own = able.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    m = own.select("cls", "rep", "n", "most", "comp", F.explode(keys).alias("key"))
    return written(spark, m.join(_several(m, "comp"), "key"), "members")


def _relabelled(spark: SparkSession, labels: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """Labels after new links ``a, b``: components of the labels, not of all classes, then one join. ``found`` goes."""
    if found.isEmpty():
        forget(spark, found)
        return labels
    if labels is None:
        out = components(spark, found)
        forget(spark, found)
        return out
    of = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    edges = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    moved = components(spark, edges)
    now = labels.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("_now")), "comp", "left") \
        .select("node", F.coalesce("_now", "comp").alias("comp"))
    new = moved.join(labels.select("node"), "node", "left_anti")
    out = written(spark, now.unionByName(new.select("node", "comp")), "labels")
    forget(spark, found, moved, labels)
    return out


def _block_links(members: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """``a, b``: links that connect what is similar in the buckets of ``members``, from tests of blocks against blocks."""
    by_comp = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = by_comp.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("big"), F.max("c").alias("n_big"), F.sum("c").alias("n_all"))
    blocks = lambda n: F.ceil(n / MEMBERS).cast("int")
    m = members.join(sizes, "key").withColumns({
        "is_big": F.col("comp") == F.col("big"), "n_g": blocks(F.col("n_big")), "n_o": blocks(F.col("n_all") - F.col("n_big"))})
    m = m.withColumn("block", F.pmod(F.xxhash64("cls", "key"), F.when(F.col("is_big"), F.col("n_g")).otherwise(F.col("n_o"))).cast("int"))
    group = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    b = F.col("block")
    groups = F.when(F.col("n_all") <= MEMBERS, F.array(group("all", F.lit(0), F.lit(0)))) \
        .when(F.col("is_big"), F.transform(upto("n_o"), lambda i: group("big", i, b))) \
        .otherwise(F.concat(F.transform(upto("n_g"), lambda j: group("big", b, j)),
                            F.transform(upto("n_o"), lambda k: group("others", F.least(b, k), F.greatest(b, k)))))
    rows = m.select("cls", "comp", "n", "most", "is_big", "block", "key", F.explode(groups).alias("g")) \
        .select("cls", "comp", "n", "most", "is_big", "block", "key", "g.kind", "g.i", "g.j")
    names = ["key", "kind", "i", "j"]
    dealt = rows.join(sets.select("cls", "members"), "cls").repartition(*names).sortWithinPartitions(*names) \
        .select(*names, "cls", "comp", "n", "most", "is_big", "block", "members")

    def run(batches):
        held: list[pa.RecordBatch] = []      # the group that may go on in the next batch
        now = None
        for batch in batches:
            ids = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            cuts = [k for k in range(1, len(ids)) if ids[k] != ids[k - 1]]
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if ids[lo] != now:
                    if held:
                        yield _connect(now, pa.Table.from_batches(held), similar)
                    held, now = [], ids[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield _connect(now, pa.Table.from_batches(held), similar)
        tidy()

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _connect(group: tuple, rows: pa.Table, similar: int) -> pa.RecordBatch:
    """Links between the two blocks of a group that join different components, a spanning forest of them."""
    kind, i, j = group[1:]
    cls, comp = rows.column("cls").to_pylist(), rows.column("comp").to_pylist()
    n, most = rows.column("n").to_numpy(), rows.column("most").to_numpy()
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(c, len(number)) for c in comp])
    block, big = rows.column("block").to_numpy(), rows.column("is_big").to_numpy(zero_copy_only=False)
    if kind == "big":
        first, second = np.flatnonzero(~big), np.flatnonzero(big)
    elif i != j:
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
    else:
        first = second = np.arange(len(cls))
    open_pair = (of[first][:, None] != of[second][None, :]) & (
        np.minimum(most[first][:, None], most[second][None, :]) * (100 + similar) >= (n[first][:, None] + n[second][None, :]) * similar)
    if first is second:
        open_pair &= np.arange(len(cls))[:, None] < np.arange(len(cls))[None, :]
    sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in rows.column("members")]
    x, y = np.nonzero(open_pair)
    if len(x) > 4 * (len(first) + len(second)):
        common = _common(sets, first, second)[x, y]
    else:
        common = np.array([_in_both(sets[first[p]], sets[second[q]]) for p, q in zip(x.tolist(), y.tolist())], np.int64)
    x, y = first[x], second[y]
    linked = 100 * common >= similar * (n[x] + n[y] - common)
    x, y = x[linked], y[linked]
    one = np.unique(of[x] * len(number) + of[y], return_index=True)[1]   # one link for each two components
    root = list(range(len(number)))

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links = []
    for k in one.tolist():
        p, q = find(of[x[k]]), find(of[y[k]])
        if p != q:
            root[p] = q
            links.append(sorted((cls[x[k]], cls[y[k]])))
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())],
                                      names=["a", "b"])


def _in_both(p: np.ndarray, q: np.ndarray) -> int:
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return int((q[at] == p).sum())


def _common(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many shingles each of ``first`` shares with each of ``second``, from products of 0/1 columns, COLUMNS at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shingles, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(first), len(second)), np.int64)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - lo] = 1
        out += (has[first] @ has[second].T).astype(np.int64)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, _h, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable over links (100 * intersection >= similar *
    union of the full shingle sets). Without words (null or empty text) the set is empty and linked with nothing.
    A null id is never the smallest unless the component has no other. ``kept`` says
    that the row has its component's id; rows that repeat that id are all kept.
    """
    rows = written(spark, sketch(docs, shingle, id_col, text_col), "sketch")
    classes = written(spark, rows.where("cls is not null").groupBy("cls").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_h").alias("h"))).alias("rep"),
        F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    labels = _links(spark, docs, classes, shingle, similar, id_col, text_col)
    own = classes.select("cls", F.col("rep.id").alias("id"))
    if labels is not None:
        own = own.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        least = own.where("comp is not null").groupBy("comp").agg(F.min("id").alias("comp_id"))
        own = own.join(least, "comp", "left").select("cls", F.coalesce("comp_id", "id").alias("component_id"))
    else:
        own = own.withColumnRenamed("id", "component_id")
    own = written(spark, own, "class-components")
    forget(spark, classes, labels)
    out = rows.drop("bands").join(own, "cls", "left")
    comp = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "_h", "n_shingles", comp.alias("component_id"),
                      F.col("doc_id").eqNullSafe(comp).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = 5, similar: int = SIMILAR, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, its columns unchanged.

    That is a row with the component's smallest id; rows that repeat both id and text
    count once. Rows without words (or with null text) have no component and all stay.
    """
    marks = written(spark, near_duplicates(spark, docs, shingle, similar, id_col, text_col), "marks")
    worded = marks.where("n_shingles > 0")
    one = worded.where("kept").groupBy(F.col("component_id")).agg(F.min("_h").alias("_first"), F.count(F.lit(1)).alias("n"))
    gone = worded.where("not kept").select("doc_id", "_h").unionByName(
        worded.where("kept").join(one.where("n > 1").select(F.col("component_id").alias("c"), "_first"),
                                  F.col("component_id").eqNullSafe(F.col("c")))
        .where("_h != _first").select("doc_id", "_h")).distinct()
    gone = gone.select(F.col("doc_id").alias("_g_id"), F.col("_h").alias("_g_h"))
    if row_count_at_most(gone, BROADCAST_DOCUMENTS):
        gone = F.broadcast(gone)
    h = F.xxhash64(F.col(text_col).cast("string"))
    left = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_g_id")) & (h == F.col("_g_h")), "left_anti")
    repeated = worded.where("kept").groupBy("doc_id", "_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return left
    return left.withColumn("_own", F.when(F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"),
                                                          lambda w: w != "")) > 0, h).otherwise(F.monotonically_increasing_id())) \
        .dropDuplicates([id_col, "_own"]).drop("_own")
