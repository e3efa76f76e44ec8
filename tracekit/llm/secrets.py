"""Secret scan with multipart credential linking, in DataFrame operations only.

Strong findings (base kinds) stand alone. Weak candidates (an access identifier,
an unlabelled secret, an endpoint) are reported only when the complementary parts
of a credential lie within the same scope, found by an interval join on position
bins of the scope's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm.common import id_text, written

# The base kinds, in listed order: pattern, group measured, least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
# Weak candidates: pattern, group measured, least length.
WEAK = {
    "weak_access": (r"""(?i)\b(?:access_?key_?id|client_?id|user(?:_?name)?|login|account)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9._@+-]+)", 1, 3),
    "weak_secret": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])"
                    r"[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/_=-])", 0, 20),
    "weak_endpoint": (r"""(?i)\b(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
                      r"""|(?i)\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[a-z]{2,}""", 0, 8),
}
KINDS = [*BASE, *WEAK]
# Which part of a credential a finding of a kind is.
PART = {"assign": "secret", "hex": "secret", "access": "access",
        "weak_access": "access", "weak_secret": "secret", "weak_endpoint": "endpoint"}
# Parts that must co-occur before a weak candidate counts.
NEEDS = {"weak_access": ["secret"], "weak_secret": ["access"], "weak_endpoint": ["access", "secret"]}
SCOPE = 300                  # code points between the starts of parts of one credential
BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once (a lambda variable, never inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, kind number, end): leftmost non-overlapping matches with a long enough group.

    The parts between matches (``split``) and the matches give running positions. They are
    summed in blocks, so the work is about linear in the number of matches.
    """
    number = KINDS.index(kind)
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,size:int>>)")
    state = lambda pos, rows: F.struct(pos.cast("int").alias("pos"), rows.alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        row = F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + x["size"]).alias("end"),
                       x["group"].alias("size"))
        return state(start + x["size"], F.concat(acc["rows"], F.array(row)))

    def block(acc: Column, rows: Column) -> Column:
        return _let(F.aggregate(rows, state(acc["pos"], empty), step),
                    lambda inner: state(inner["pos"], F.concat(acc["rows"], inner["rows"])))

    def blocks(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")),
                           lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))

    everything = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                          F.regexp_extract_all(text, everything, F.lit(0)).alias("hit"),
                          F.regexp_extract_all(text, everything, F.lit(group)).alias("part"))
    sized = F.transform(F.filter(zipped, lambda z: z["hit"].isNotNull()),
                        lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("size"),
                                           F.length(z["part"]).alias("group")))
    summed = _let(sized, lambda rows: F.aggregate(blocks(rows), state(F.lit(0), empty), block))
    rows = F.transform(F.filter(summed["rows"], lambda r: r["size"] >= least),
                       lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def _joined(rows: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat_ws(
        ":", F.element_at(names, r["kind"] + 1), r["start"].cast("string"), r["end"].cast("string"))), ",")


def linked(findings: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak findings whose complementary parts co-occur: ``_row, weak`` (array of findings).

    ``findings`` has ``_row`` and ``parts`` (array of findings). Interval join: parts are
    reduced to the first and last start of each (row, part, bin) by partial aggregation,
    then every weak candidate meets its own and the two neighbouring bins. Both sides are keyed by
    bin, so a very long document spreads, and no pair of findings is ever made.
    """
    part_of = F.array(*[F.lit(PART[k]) for k in KINDS])
    needs = F.array(*[F.array(*[F.lit(p) for p in NEEDS.get(k, [])]) if k in NEEDS
                      else F.expr("cast(array() as array<string>)") for k in KINDS])
    rows = findings.where(F.exists("parts", lambda p: p["kind"] >= len(BASE))) \
        .select("_row", F.explode("parts").alias("p"))
    rows = rows.select("_row", "p", F.floor(F.col("p.start") / scope).cast("int").alias("bin"),
                       F.element_at(part_of, F.col("p.kind") + 1).alias("part"))
    reach = rows.groupBy(F.col("_row").alias("r_row"), F.col("part").alias("r_part"), F.col("bin").alias("r_bin")) \
        .agg(F.min("p.start").alias("low"), F.max("p.start").alias("high"))
    weak = rows.where(F.col("p.kind") >= len(BASE)).select(
        "_row", "p", "bin", F.explode(F.element_at(needs, F.col("p.kind") + 1)).alias("need"))
    weak = weak.select("_row", "p", "need", "bin", F.explode(
        F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("at"))
    on = ((F.col("_row") == F.col("r_row")) & (F.col("need") == F.col("r_part")) & (F.col("at") == F.col("r_bin"))
          & ((F.col("at") == F.col("bin"))
             | ((F.col("at") < F.col("bin")) & (F.col("high") >= F.col("p.start") - scope))
             | ((F.col("at") > F.col("bin")) & (F.col("low") <= F.col("p.start") + scope))))
    met = weak.join(reach, on).groupBy("_row", "p").agg(F.count_distinct("need").alias("met"))
    full = met.where(F.col("met") == F.size(F.element_at(needs, F.col("p.kind") + 1)))
    return full.groupBy("_row").agg(F.collect_list("p").alias("weak"))


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         scope: int = SCOPE) -> DataFrame:
    """One row per input row: ``doc_id``, base counts, ``base`` and ``findings`` (sorted arrays), ``n_weak``.

    Findings are (start, kind, end) in code points, end exclusive. Null text is empty and
    has no findings; repeated rows and null ids get a row each.
    """
    d = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    base = F.concat(*[found(F.col("text"), k, *BASE[k]) for k in BASE])
    weak = F.concat(*[found(F.col("text"), k, *WEAK[k]) for k in WEAK])
    narrow = written(spark, d.select("doc_id", F.monotonically_increasing_id().alias("_row"), base.alias("base"),
                                     weak.alias("candidates")), "findings")
    links = linked(narrow.select("_row", F.concat("base", "candidates").alias("parts")), scope)
    out = narrow.join(links, "_row", "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    counts = [F.size(F.filter(F.transform("base", lambda r: r["kind"]), F.lit(k).__eq__)).cast("long").alias(f"n_{name}")
              for k, name in enumerate(BASE)]
    return out.select("doc_id", *counts, F.array_sort("base").alias("base"),
                      F.array_sort(F.concat("base", F.coalesce("weak", none))).alias("findings"),
                      F.size(F.coalesce("weak", none)).cast("long").alias("n_weak"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    """``base_sha256`` and ``spans`` of scan()'s arrays."""
    return scanned.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                          _joined(F.col("findings")).alias("spans"), "n_weak")
