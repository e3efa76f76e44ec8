"""Conversation structure repair: cheapest edits, least audit, by prefix-doubling path ranking.

A conversation's rows, in order, pass an automaton for ``(s?(ua)+)?``: a node is (row, state), an arc an
edit. Min-plus dynamic programming gives every node its cheapest cost to the end; arcs that
keep to it are optimal. Each optimal node takes its arc of the least initial (a state leaves one target to
each initial). Nodes are then ranked by the first 1, 2, 4, ... initials of what they spell: a rank of
the next length is the pair of a node's rank and the rank of the node its doubled pointer reaches. When
every pointer has come to an end, the ranks order whole audits; each node's arc is the least by (initial, rank of its target), and the
doubled pointers give any step of any path at once.

A conversation is cut into blocks of at most BLOCK rows, so one that holds a third of all rows spreads over many tasks.
A block's costs between its ends are a 4 x 4 matrix; only these, and the state in which each path leaves a block, are chained
along a conversation, a row per block, streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm.common import ship, tidy, written
from tracekit.operators.positional import number_within

BLOCK = 4096                 # rows of a conversation solved together
SLICE = 1 << 16              # rows in numpy at a time
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
INITIALS = "DIKR"            # in ASCII order
BLANK = r"[^\x20\x09-\x0D]"
UNFINISHED = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. NEXT: after one more user or assistant turn.
NEXT = np.array([2, 2, 3, 2])
# KEPT[initial][state]: after keeping a row whose role begins with s, u, a or another letter; -1: not allowed.
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True
FAR = 1 << 40
ENDS = np.array([0, FAR, FAR, 0])   # cost of ending in a state


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults by crc32("conv_id:turn") % 20; nulls in role, text and that key are one space.

    0 drops the row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes it a user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return turns.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


class Blocks:
    """Blocks of coded rows (4 * role initial + fault; faults 0 none, 1 blank, 2 duplicate, 3 truncated) side by side.

    Node ``4 * (first layer of the block + layer) + state``; a block of n rows has layers 0 to n.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        self.first_row = np.cumsum(sizes) - sizes
        self.first_layer = self.first_row + np.arange(len(sizes))
        self.kind, self.fault = codes >> 2, codes & 3
        self.extra = TRUNCATED * (self.fault == 3)
        self.goes = (self.fault == 1) | (self.fault == 2)
        self.by_size = np.argsort(-sizes, kind="stable")

    def costs(self, ends: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Cheapest cost from every (layer, state), for each column of ``ends`` (block, state, column) behind the last layer.

        Turns can be inserted behind the last row only where ``last`` says that the conversation ends there.
        """
        cost = np.empty((self.sizes.sum() + len(self.sizes), *ends.shape[1:]), np.int64)
        cost[self.first_layer + self.sizes] = np.where(last[:, None, None], _with_inserts(ends), ends)
        sizes = self.sizes[self.by_size]
        for layer in range(int(sizes[0]) - 1, -1, -1):
            k = self.by_size[:np.searchsorted(-sizes, -layer, "left")]     # the blocks with more rows than that
            row, at = self.first_row[k] + layer, self.first_layer[k] + layer
            after = cost[at + 1]
            base = after + DELETE
            extra = self.extra[row][:, None, None]
            kept = KEPT[self.kind[row]]
            keep = np.where((kept >= 0)[..., None], np.take_along_axis(after, np.maximum(kept, 0)[..., None], 1), FAR) + extra
            edit = np.minimum(keep, after[:, NEXT] + REROLE + extra)
            base = np.where(self.goes[row][:, None, None], base, np.minimum(base, edit))
            cost[at] = _with_inserts(base)
        return np.minimum(cost, FAR)

    def arcs(self, cost: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every node: where each edit of INITIALS leads, and whether that arc is optimal (node, edit)."""
        n, state = cost.size, np.tile(np.arange(4), len(cost))
        node = np.arange(n)
        layer_block = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        at_end = np.zeros(len(cost), bool)
        at_end[self.first_layer + self.sizes] = True
        row = np.minimum(np.arange(len(cost)) - layer_block, max(len(self.kind) - 1, 0))
        has_row = np.repeat(~at_end, 4)
        cost, row = cost.ravel(), np.repeat(row, 4)
        kept = KEPT[self.kind[row], state]
        below = np.where(has_row, node + 4 - state, 0)
        edits = has_row & ~self.goes[row]
        to = np.stack([np.where(has_row, node + 4, node), node - state + NEXT[state], below + np.maximum(kept, 0), below + NEXT[state]], 1)
        paid = np.stack([np.full(n, DELETE), np.full(n, INSERT), self.extra[row], REROLE + self.extra[row]], 1)
        allowed = np.stack([has_row, has_row | np.repeat(last[layer_block], 4), edits & (kept >= 0), edits], 1)
        return to, allowed & (cost[to] + paid == cost[:, None]) & (cost < FAR)[:, None]


def _with_inserts(base: np.ndarray) -> np.ndarray:
    """Costs (block, state, column) when turns may be inserted before going on at ``base``."""
    out = base.copy()
    out[:, 2] = np.minimum(base[:, 2], INSERT + base[:, 3])
    out[:, 3] = np.minimum(base[:, 3], INSERT + base[:, 2])
    out[:, :2] = np.minimum(base[:, :2], INSERT + out[:, 2:3])
    return out


def rank_paths(to: np.ndarray, optimal: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Initial (0: the path ends here) and rank of every node, and pointers over 1, 2, 4, ... steps."""
    node = np.arange(len(to))
    some = optimal.any(1)
    least = optimal.argmax(1)
    initial = np.where(some, least + 1, 0)
    pointers = [np.where(some, to[node, least], node)]
    rank = initial
    while True:
        reached = pointers[-1]
        rank = np.unique(rank * (len(to) + 5) + rank[reached], return_inverse=True)[1]
        if not initial[reached].any():
            break
        pointers.append(reached[reached])
    # the least arc by initial and rank of its target: over whole audits now
    by = np.where(optimal, np.arange(1, 5) * (len(to) + 5) + rank[to], np.iinfo(np.int64).max)
    choice = by.argmin(1)
    pointers[0] = np.where(some, to[node, choice], node)
    return np.where(some, choice + 1, 0), rank, pointers


def paths(initial: np.ndarray, pointers: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the least path from each start: the end node, all nodes before it one path after the other, and their number."""
    steps = (initial > 0).astype(np.int64)
    for p in pointers:
        steps = steps + steps[p]
    n = steps[starts]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, end, left = np.repeat(starts, n), starts, n
    for k, p in enumerate(pointers):
        at = np.where(step >> k & 1, p[at], at)
        end = np.where(left >> k & 1, p[end], end)
    return end, at, n


def solve_blocks(codes: np.ndarray, sizes: np.ndarray, ends: np.ndarray, last: np.ndarray, entries: np.ndarray):
    """``cost, audit, plan, state at the end`` of each block from its state in ``entries``.

    A plan has an item per row, comma-joined: u and a are inserted turns, K the row as it is, U and A the
    row as user's or assistant's. Turns inserted behind the last row belong to its item.
    """
    b = Blocks(codes, sizes)
    cost = b.costs(ends[:, :, None], last)[:, :, 0]
    to, optimal = b.arcs(cost, last)
    initial, _, pointers = rank_paths(to, optimal)
    starts = 4 * b.first_layer + entries
    end, nodes, n = paths(initial, pointers, starts)
    label, state = initial[nodes], nodes & 3
    block = np.repeat(np.arange(len(sizes)), n)
    row = np.minimum((nodes >> 2) - b.first_layer[block], sizes[block] - 1)
    assistant = state == 2                      # what an edit from here would add
    shown = np.select([label == 2, label == 3, label == 4], [np.where(assistant, 2, 1), 3, np.where(assistant, 5, 4)], 0)
    audit = np.frombuffer(b"-DIKR", np.uint8)[label].tobytes().decode()
    # plan: an item's letters, and a comma before each further row
    comma = np.where(np.arange(len(row)) == np.repeat(np.cumsum(n) - n, n), row, np.diff(row, prepend=0))
    letters = ["", "u", "a", "K", "U", "A"]
    items = ["," * c + letters[x] for c, x in zip(comma.tolist(), shown.tolist())]
    bounds = np.concatenate([[0], np.cumsum(n)]).tolist()
    plans = ["".join(items[x:y]) for x, y in zip(bounds, bounds[1:])]
    audits = [audit[x:y] for x, y in zip(bounds, bounds[1:])]
    return cost.ravel()[starts], audits, plans, end & 3


def _block_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of blocks with their codes and sizes, SLICE rows at most unless one block has more."""
    column = batch.column(batch.schema.get_field_index("codes"))
    sizes = np.diff(column.offsets.to_numpy())
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        begin = ends[at] - sizes[at]
        stop = max(at + 1, int(np.searchsorted(ends, begin + SLICE, "right")))
        yield batch.slice(at, stop - at), flat[begin:ends[stop - 1]].astype(np.int64), sizes[at:stop].astype(np.int64)
        at = stop


def _faulty(rows: DataFrame) -> DataFrame:
    """``_c, turn, step, n_steps, kind, fault``: the first fault of every row; ``rows`` have their number ``step``."""
    first = rows.groupBy("_c", "role", "_h", "_h2").agg(F.min("step").alias("step")).select("_c", "step", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("unfinished"), 3).otherwise(0)
    narrow = rows.select("_c", "turn", "step", "n_steps", kind.alias("kind"), "blank", "unfinished")
    return narrow.join(first, ["_c", "step"], "left").select("_c", "turn", "step", "n_steps", "kind", fault.alias("fault"))


def _chained(spark: SparkSession, rows: DataFrame, order: Column, schema: str, advance, begin) -> DataFrame:
    """``_c, block, schema``: a state carried along each conversation's blocks, a row at a time.

    ``advance(state, value) -> (out, state)`` sees the row's ``value``; ``begin`` is the state before the first row.
    """
    name = schema.split()[0]
    kind = pa.list_(pa.int64()) if "array" in schema else pa.int64()

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for c, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if c != now:
                    now, state = c, begin
                given, state = advance(state, value)
                out.append(given)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["_c", "block", name])

    dealt = rows.select("_c", "block", "value").repartition("_c").sortWithinPartitions("_c", order)
    return written(spark, dealt.mapInArrow(run, f"_c string, block long, {schema}"), name)


def _matrices(blocks: DataFrame) -> DataFrame:
    """``_c, block, value``: costs from each state at a block's begin to each at its end, row by row."""
    def run(batches):
        for batch in batches:
            for part, codes, sizes in _block_slices(batch.select(["_c", "block", "codes"])):
                b = Blocks(codes, sizes)
                open_ends = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(sizes), 4, 4))
                cost = b.costs(open_ends, np.zeros(len(sizes), bool))[b.first_layer].reshape(len(sizes), 16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cost.tolist(), pa.list_(pa.int64()))],
                                                 names=["_c", "block", "value"])
        tidy()

    return blocks.mapInArrow(run, "_c string, block long, value array<long>")


def _earlier(costs: list[int], matrix: list[int]) -> tuple[list[int], list[int]]:
    """Blocks come last first: the costs behind this block, and those before it."""
    return costs, [min(FAR, *(matrix[4 * s + t] + costs[t] for t in range(4))) for s in range(4)]


def _solved(blocks: DataFrame) -> DataFrame:
    """``_c, block, n_blocks, illegal, costs, audits, plans, exits``: one entry for a conversation's first block, else one a state."""
    def run(batches):
        for batch in batches:
            for part, codes, sizes in _block_slices(batch):
                col = {n: part.column(k) for k, n in enumerate(part.schema.names)}
                own, block = col["n_own"].to_numpy(), col["block"].to_numpy()
                begins = np.cumsum(sizes) - sizes
                kind = codes >> 2
                wrong = np.append(~LEGAL[kind[:-1], kind[1:]], False)
                wrong[begins + sizes - 1] = False
                illegal = np.add.reduceat(wrong, begins)
                is_own = np.arange(len(codes)) - np.repeat(begins, sizes) < np.repeat(own, sizes)
                last = block == col["n_blocks"].to_numpy() - 1
                ends = np.array([ENDS if v is None else v for v in col["ends"].to_pylist()], np.int64)
                # all blocks from state 0, then the later ones from the others, too
                got: list[list] = [[[] for _ in sizes] for _ in range(4)]
                for entry in range(4):
                    some = np.flatnonzero((block > 0) | (entry == 0))
                    if not len(some):
                        break
                    of = np.isin(np.repeat(np.arange(len(sizes)), sizes), some) & is_own
                    result = solve_blocks(codes[of], own[some], ends[some], last[some], np.full(len(some), entry))
                    for values, into in zip(result, got):
                        for k, v in zip(some.tolist(), values):
                            into[k].append(v)
                longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [col["_c"], col["block"], col["n_blocks"], pa.array(illegal, pa.int64()), pa.array(got[0], longs),
                     pa.array(got[1], texts), pa.array(got[2], texts), pa.array(got[3], longs)],
                    names=["_c", "block", "n_blocks", "illegal", "costs", "audits", "plans", "exits"])
        tidy()

    return blocks.mapInArrow(run, "_c string, block long, n_blocks long, illegal long, costs array<long>, audits array<string>, "
                                  "plans array<string>, exits array<long>")


def _hashed(turns: DataFrame) -> DataFrame:
    """``_c, repaired_sha256`` of the newline-joined ``role:text`` lines, which are streamed in order and never gathered."""
    def run(batches):
        now, digest = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4))):
                if c != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())],
                                             names=["_c", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["_c", "repaired_sha256"])

    dealt = turns.select("_c", "step", "k", "role", "text").repartition("_c").sortWithinPartitions("_c", "step", "k")
    return dealt.mapInArrow(run, "_c string, repaired_sha256 string")


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("_c")


def repair(spark: SparkSession, turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Conversations and repaired turns of ``turns`` (``conv_id, turn, role, text``; other columns are not read).

    Conversations: ``_c`` (the id as text after "=", null: empty), ``gaps, blank, duplicate, truncated, illegal, cost, audit``.
    Turns: ``_c, step`` (number of the row, from 1), ``k`` (place in what the row became), ``role, text``. Rows are taken by turn, nulls
    first, ties by role and a hash of the text; null roles and texts are one space. An empty table gives no rows.
    """
    ship(spark)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = turns.select(_key("conv_id"), "turn", blank("role").alias("role"), blank("text").alias("text")).select(
        "*", F.xxhash64("text").alias("_h"), F.xxhash64(F.lit(7), F.reverse("text")).alias("_h2"),
        (~F.col("text").rlike(BLANK)).alias("blank"), F.col("text").rlike(UNFINISHED).alias("unfinished"))
    rows = written(spark, number_within(t, ["_c"], ["turn", "role", "_h", "_h2"], count_col="n_steps"), "turns")
    coded = written(spark, _faulty(rows), "coded")
    n = lambda f: F.count_if(F.col("fault") == f)
    counts = coded.groupBy("_c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        n(1).alias("blank"), n(2).alias("duplicate"), n(3).alias("truncated"))
    # a block also sees the first row of the next one, for the roles on both sides of the cut
    own = F.expr(f"(step - 1) div {block}")
    in_blocks = coded.select("_c", "step", "n_steps", (F.col("kind") * 4 + F.col("fault")).cast("byte").alias("code"), own.alias("own"),
                             F.explode(F.when((F.col("step") > 1) & ((F.col("step") - 1) % block == 0), F.array(own - 1, own))
                                       .otherwise(F.array(own))).alias("block"))
    codes = F.transform(F.array_sort(F.collect_list(F.struct("step", "code"))), lambda x: x["code"])
    blocks = written(spark, in_blocks.groupBy("_c", "block").agg(
        F.expr(f"(max(n_steps) - 1) div {block} + 1").alias("n_blocks"), F.count_if(F.col("own") == F.col("block")).alias("n_own"),
        codes.alias("codes")), "blocks")
    long = blocks.where("n_blocks > 1")
    if long.isEmpty():
        solved = blocks.withColumn("ends", F.lit(None).cast("array<long>"))
        entry = F.lit(0)
        solved = written(spark, _solved(solved), "solved").withColumn("entry", entry)
    else:
        cut = long.withColumn("codes", F.slice("codes", 1, F.col("n_own")))
        ends = _chained(spark, _matrices(cut), F.desc("block"), "ends array<long>", _earlier, _FINAL)
        solved = written(spark, _solved(blocks.join(ends, ["_c", "block"], "left")), "solved")
        entries = _chained(spark, solved.where("n_blocks > 1").select("_c", "block", F.col("exits").alias("value")), F.col("block"),
                           "entry long", lambda s, exits: (s, exits[s if len(exits) > 1 else 0]), 0)
        solved = solved.join(entries, ["_c", "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    pick = lambda c: F.get(c, F.when(F.col("block") > 0, F.col("entry")).otherwise(0).cast("int"))
    pieces = F.array_sort(F.collect_list(F.struct("block", pick("audits").alias("audit"))))
    found = solved.groupBy("_c").agg(F.sum("illegal").alias("illegal"), F.max(F.when(F.col("block") == 0, F.get("costs", F.lit(0)))).alias("cost"),
                                     F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    item = solved.select("_c", "block", F.posexplode(F.split(pick("plans"), ",", -1)).alias("at", "item")).where("item != ''").select(
        "_c", (F.col("block") * block + F.col("at") + 1).alias("step"), F.posexplode(F.split("item", "(?<=.)(?=.)")).alias("k", "letter"))
    letter = F.col("letter")
    role = F.when(letter == "K", F.col("role")).when(F.lower(letter) == "u", F.lit("user")).otherwise(F.lit("assistant"))
    repaired = item.join(rows.select("_c", "step", "role", "text"), ["_c", "step"]).select(
        "_c", "step", "k", role.alias("role"), F.when(letter.isin("u", "a"), F.lit("")).otherwise(F.col("text")).alias("text"))
    return counts.join(found, "_c"), repaired


_FINAL = [int(x) for x in _with_inserts(ENDS[None, :, None])[0, :, 0]]


def repair_report(spark: SparkSession, turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct ``conv_id`` of ``ids``: the counts, cost and audit of ``repair`` and the hash of the repaired turns.

    A conversation without rows in ``turns`` has zeros, an empty audit and the hash of nothing.
    """
    found, repaired = repair(spark, turns, block)
    out = ids.select("conv_id").distinct().withColumn("_c", _key("conv_id")) \
        .join(found, "_c", "left").join(_hashed(repaired), "_c", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
