"""Conversation repair, token alignment and sharding against plain versions."""

import os
import random
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute_new as brute  # noqa: E402

from tracekit.llm import conversations, queries, sharding, token_alignment  # noqa: E402

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
TURNS = "conv_id long, turn long, role string, text string, block long, step int, _c string, codes string"
SCHEMA = "doc_id long, text string, lang string, source string, shard int, slot long, pairs string, _r int, row int, n_a int"


def turns_frame(spark, rows):
    """Rows (conv, turn, role, text) with clashing extra columns."""
    return spark.createDataFrame([(*r, 9, 9, "x", "y") for r in rows], TURNS)


def docs_frame(spark, rows):
    """Rows (id, text, source) with clashing extra columns."""
    return spark.createDataFrame([(i, t, None, s, 1, 2, "p", 3, 4, 5) for i, t, s in rows], SCHEMA)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


ODD_TURNS = [
    (None, 0, "user", "Hello."), (None, 1, "assistant", "Yes."), (None, None, "system", None), (901, None, None, "What."),
    (901, 5, "user", ""), (901, 9, "tool", "Done"), (902, 1, "user", " \n\t"), (903, 1, "assistant", "A."), (903, 1, "assistant", "A."),
    (903, 4, "user", "B.\n "), (904, None, "user", "null only"), (905, 1, "", "no role!"), (906, 3, "User", "x?"),
    (907, 1, "system", "S."), (907, 2, "system", "S."), (908, 2, "user", "long. " * 20_000), (908, 3, "assistant", "y " * 20_000)]


def test_conversation_repair(spark):
    rows = [tuple(r) for r in table(spark, "conversations").select("conv_id", "turn", "role", "text").collect()] + ODD_TURNS
    t = turns_frame(spark, rows)
    out = conversations.repair_report(spark, conversations.damage(t), t).collect()
    want = brute.repaired(rows)
    assert len(out) == len(want)
    for r in out:
        assert tuple(r)[1:] == want[r.conv_id], r
    assert {c for r in out for c in r.audit} == set("DIKR") and len({r.audit for r in out}) > 40
    none = t.limit(0)
    assert conversations.repair_report(spark, conversations.damage(none), none).count() == 0
    # every row dropped by damage
    lost = [(k, 0, "user", "x.") for k in range(60)]
    gone = conversations.repair_report(spark, conversations.damage(turns_frame(spark, lost)), turns_frame(spark, lost)).collect()
    want = brute.repaired(lost)
    assert all(tuple(r)[1:] == want[r.conv_id] for r in gone) and any(r.audit == "" and r.cost == 0 for r in gone)


@pytest.mark.parametrize("block", [1, 3, 7])
def test_conversation_in_blocks(spark, block):
    """Conversations cut into blocks, one of which holds most rows, are solved as a whole."""
    rng = random.Random(block)
    roles = ["user", "assistant", "system", "tool"]
    rows = [(0, k, rng.choices(roles, (5, 5, 1, 1))[0], rng.choice(["a.", "b", " ", "c?", f"t{k}.", f"t{k}"])) for k in range(160)]
    rows += [(c, k, rng.choice(roles), rng.choice(["a.", "b", "", f"{k}!"])) for c in range(1, 40) for k in range(rng.randint(1, 9))]
    t = turns_frame(spark, rows)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_report(spark, t, t, block).collect()}
    assert got == brute.repaired(rows, damage=False)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", "C."), (1, 3, "assistant", "")]
    _, repaired = conversations.repair(spark, turns_frame(spark, rows))
    lines = [(r.role, r.text) for r in repaired.orderBy("step", "k").collect()]
    assert [r for r, _ in lines] == ["user", "assistant"] * (len(lines) // 2)


def test_rank_paths():
    """Ranks order nodes by all initials to the end; doubled pointers give every step."""
    import numpy as np
    rng = np.random.default_rng(5)
    sizes = np.array([1, 4, 9, 2])
    codes = rng.integers(0, 16, sizes.sum())
    b = conversations.Blocks(codes, sizes)
    last = np.ones(4, bool)
    cost = b.costs(np.broadcast_to(conversations.ENDS[None, :, None], (4, 4, 1)), last)[:, :, 0]
    initial, rank, pointers = conversations.rank_paths(*b.arcs(cost, last))

    def spelled(v):
        out = ""
        while initial[v]:
            out += "-DIKR"[initial[v]]
            v = pointers[0][v]
        return out
    words = [spelled(v) for v in range(cost.size)]
    order = sorted(set(words))
    assert [order.index(w) for w in words] == rank.tolist()
    end, nodes, n = conversations.paths(initial, pointers, np.arange(cost.size))
    assert n.tolist() == list(map(len, words)) and not initial[end].any()
    assert "".join("-DIKR"[initial[v]] for v in nodes) == "".join(words)


ODD_TEXTS = [(9001, None), (9002, ""), (9003, " "), (9004, "a▁b"), (9005, "<s>x</s><|endoftext|> <unk>"), (9006, "tab\tnl\n\n x"),
             (9007, "naïve café 北京 👩‍👩‍👧 ﬁ"), (9008, "\x00 null\x7f"), (9009, "word " * 30_000), (None, "shared words here"),
             (None, "shared words here"), (9010, "a" * 3000), (9011, "퟿  x")]


def test_token_alignment(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").where("doc_id < 150").collect()] + ODD_TEXTS
    want = Counter((i, *w) for (i, _), w in zip(rows, brute.aligned([t for _, t in rows])))
    df = docs_frame(spark, [(i, t, None) for i, t in rows])
    names = token_alignment.default_vocabularies()
    got = Counter(tuple(r) for r in token_alignment.alignment_report(spark, df, *names).collect())
    assert got == want
    assert token_alignment.alignment_report(spark, df.limit(0), *names).count() == 0


def test_token_alignment_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", 0)
    df = table(spark, "documents").where("doc_id < 60")
    names = token_alignment.default_vocabularies()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = Counter(tuple(r) for r in token_alignment.alignment_report(spark, df, *names).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, brute.aligned([t for _, t in rows])))


def test_groups_as_text(spark):
    """The groups give both id sequences back."""
    names = token_alignment.default_vocabularies()
    tok = token_alignment.TwoTokenizers(*names)
    for r in token_alignment.align(docs_frame(spark, [(1, "An  unlikely tokenisation, naïvely.", None)]), *names).collect():
        sides = [[i for g in r.groups.split(";") for i in map(int, g.split("|")[s].split(","))] for s in (0, 1)]
        assert tuple(sides) == tok.ids("An  unlikely tokenisation, naïvely.")


def test_sharding(spark):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, "documents").collect()]
    rows += [(None, None, None), (7001, "", None), (7002, "é" * 50_000, "own"), (None, "x", "own"), (7003, None, "")]
    rows += [(7004, "same", "copies")] * 300 + [(8000 + k, "copy", "copies") for k in range(300)]
    df = docs_frame(spark, rows)
    placed = sharding.interleave(spark, df).collect()
    got = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in placed)
    assert got == Counter(brute.sharded(rows))
    sizes = Counter(r.shard for r in placed)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    # every shard matches the mixture: a source's share of a shard is off by a few rows at most
    each, total = Counter((r.source, r.shard) for r in placed), Counter(r.source for r in placed)
    assert all(abs(each[s, k] - n / 40) <= 2.5 + len(total) * n / len(rows) / 2 for s, n in total.items() for k in range(40))
    assert sharding.interleave(spark, df.limit(0)).count() == 0
    few = sharding.interleave(spark, docs_frame(spark, rows[:3])).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_sharding_plan_is_native(spark):
    plan = queries.op13_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_written_shards(spark, tmp_path):
    rows = [(k, f"text {k}", "ab"[k % 3 == 0]) for k in range(95)]
    out = sharding.write_shards(spark, docs_frame(spark, rows), str(tmp_path / "shards"), shards=10)
    assert sorted((r.row.doc_id, r.row.text, r.row.source) for r in out.collect()) == rows
    assert sorted(os.listdir(tmp_path / "shards"))[-10:] == sorted(f"shard={k}" for k in range(10))
    slots = out.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert all(r.s == list(range(len(r.s))) and len(r.s) in (9, 10) for r in slots)


def test_near_blocks(spark, monkeypatch):
    """A large group of near copies in blocks against blocks, with pairs on both sides of the threshold."""
    import brute as old
    from tracekit.llm import near_dedup
    monkeypatch.setattr(near_dedup, "MEMBERS", 7)
    monkeypatch.setattr(near_dedup, "COLUMNS", 16)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    data = []
    for k in range(220):
        w = list(words)
        for _ in range(rng.choice([1, 1, 2, 2, 3])):
            w[rng.randrange(60)] = f"x{rng.randrange(400)}"
        data.append((k, " ".join(w)))
    data += [(1000 + k, " ".join(rng.choices(words, k=30))) for k in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, df).collect()}
    assert got == {i: c for i, _, c, _ in old.near(data)}
    assert len(set(got.values())) > 10


def test_quality_bounds_are_those_of_the_groups(spark):
    """``kept`` against exact quantiles: outside the rank error of the sketches the verdict must be theirs."""
    import math

    import numpy as np

    from tracekit.llm import quality
    docs = table(spark, "documents").collect()
    kept = {r.doc_id: r.kept for r in queries.op10_quality(spark, SF).collect()}
    rows = {}
    for d in docs:
        n, wc, sy, dup, rep, lines = quality.measure(d.text)
        if n >= 50 and 100 * rep <= 50 * n:
            share = lambda a, b: math.log((a + 1) / (b + 1))
            rows[d.doc_id] = (d.lang, d.source, (share(sy, wc), share(dup, lines), share(rep, n), wc / n))
        else:
            assert not kept[d.doc_id]
    own, by_lang = {}, {}
    for lang, source, v in rows.values():
        own.setdefault((lang, source), []).append(v)
        by_lang.setdefault(lang, []).append(v)
    sure = floors = bounds = rejected = 0
    for i, (lang, source, v) in rows.items():
        group = next(np.array(g) for g in (own[lang, source], by_lang[lang], [x for _, _, x in rows.values()]) if len(g) >= quality.MIN_GROUP)
        verdicts = []
        for slack in (-0.02, 0.02):          # tightest and loosest bounds within the rank error
            ok = True
            for k, (side, times, least) in enumerate(quality.RATIOS.values()):
                q = lambda r: np.quantile(group[:, k], r)
                low, high = q(0.25 - slack), q(0.75 + slack)
                spread = times * max(high - low, least)
                bounds, floors = bounds + 1, floors + (high - low < least)
                ok &= v[k] <= high + spread and (side == "high" or v[k] >= low - spread)
            verdicts.append(ok)
        if verdicts[0] == verdicts[1]:
            sure += 1
            assert kept[i] == verdicts[0], (i, v)
            rejected += not verdicts[0]
    assert sure > 0.95 * len(rows) and rejected > 20 and floors < 0.02 * bounds
    fixed = {i for i, (_, _, v) in rows.items() if v[0] <= math.log(0.05)}
    assert fixed != {i for i in rows if kept[i]}     # no one rule for all groups


def test_packing_cuts(spark):
    """Few cuts in mid-sentence, and a chunk's end is no cut."""
    import numpy as np

    from tracekit.llm import packing
    rng = np.random.default_rng(2)
    size = 50_000
    ends = np.flatnonzero(rng.random(size) < 1 / 25)
    doc_ends = np.flatnonzero(rng.random(size) < 1 / 700) + 1
    at, penalty = packing.cut_points(np.isin(np.arange(size), ends), doc_ends, size, 1024)
    cost = dict(zip(at.tolist(), penalty.tolist()))
    cuts = packing.best_cuts(at, penalty, 1024)
    assert sum(cost[c] == packing.TRUNCATION for c in cuts) < 0.05 * len(cuts)
    assert max(np.diff(cuts)) <= 1024


def test_packing_over_chunk_ends(spark, monkeypatch):
    from tracekit.llm import packing, token_counts
    monkeypatch.setattr(packing, "CHUNK", 1 << 14)      # some 70 chunks
    docs = table(spark, "documents").select("doc_id", "text").coalesce(1)
    whole = packing.pack_documents(docs, token_counts.default_vocabulary()).collect()
    used, padded = sum(r.length for r in whole), sum({r.sequence_id: r.padded for r in whole}.values())
    assert padded < 1.015 * used
    filled = {r.sequence_id: 0 for r in whole}
    for r in whole:
        filled[r.sequence_id] += r.length
    size = {r.sequence_id: r.padded for r in whole}
    assert sum(size[k] - n > 300 for k, n in filled.items()) <= 1   # only the end of the rows may leave a window half empty


def test_line_dedup_runs_of_several_lines(spark):
    """The query's floor makes runs of several short lines, which take doubling."""
    from tracekit.llm import line_dedup
    d = line_dedup._lines(table(spark, "documents"), "doc_id", "text")
    twice = d.groupBy("l1", "l2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("l1", "l2")
    rows = d.join(twice, ["l1", "l2"]).groupBy("doc_id", "_h").agg(F.array_sort(F.collect_list(F.struct("no", "words"))).alias("r"))
    w = line_dedup._windows(rows.select("doc_id", "_h", F.col("r.no").alias("nos"), F.col("r.words").alias("words")), queries.LINE_WORDS)
    assert w.where("size > 1").count() > 0
