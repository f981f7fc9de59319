"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks of BLOCK rows, in an order given by a hash of the row. Slot t of the mixed stream holds one
block. Block j (from 0) of a source with weight w is released at floor(j / w) and due at ceil((j + 1) / w); among the
released blocks the earliest deadline goes first. With weights that sum to 1 every deadline is met, so after any number of
slots t each source has had less than one block more or less than w * t.

Weights are whole numbers of UNITS parts, so the schedule repeats every UNITS slots: one period is worked out on the
driver (its size depends on the number of sources alone, and more than MAX_SOURCES are refused) and block j's slot is read
off it. The rows are numbered by source without bringing a source together: counts per hash bucket are summed ahead of each
bucket, and rows are numbered inside their bucket only. Equal rows share a hash and so a bucket, however many they are;
they are spread over parts of it by their place in a written table, which tells them apart and changes nothing else, for
equal rows are interchangeable.

Nothing is dropped. When a source has run out, its later slots stay empty; the bound holds up to the first such slot
(column `balanced`), and the others keep their proportions to one another after it.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaspan.llm.scratch import table, written

BLOCK = 8
UNITS = 1000
#: Rows that a hash bucket holds on average, and equal rows of a part of one; a source's buckets grow with its rows.
BUCKET_ROWS, PART_ROWS = 512, 4096
#: Sources beyond this number are refused: the plan (some four numbers a source) is made on the driver and broadcast.
MAX_SOURCES = 50_000
#: Exponent of a source's share of rows in its default weight: below 1 small sources gain.
ALPHA = 0.5


def whole_weights(shares: dict[str, float], units: int) -> dict[str, int]:
    """Shares as whole parts of `units` (or of four per source, if more), by largest remainder; none below 1."""
    units = max(units, 4 * len(shares))
    total = sum(shares.values())
    exact = {k: v / total * units for k, v in shares.items()}
    parts = {k: max(1, int(v)) for k, v in exact.items()}
    order = sorted(shares, key=lambda k: (-(exact[k] - int(exact[k])), k))
    while sum(parts.values()) < units:
        for k in order[: units - sum(parts.values())]:
            parts[k] += 1
    while sum(parts.values()) > units:
        parts[max(parts, key=lambda k: (parts[k], k))] -= 1
    return parts


def period(parts: dict[str, int]) -> dict[str, list[int]]:
    """Earliest-deadline-first over one period of sum(parts) slots: source -> slots of its blocks, in order."""
    units = sum(parts.values())
    weight = {k: Fraction(n, units) for k, n in parts.items()}
    released: list[list[tuple]] = [[] for _ in range(units)]
    for k, n in parts.items():
        for j in range(n):
            released[int(j / weight[k])].append((ceil((j + 1) / weight[k]), k, j))
    ready: list[tuple] = []
    slots: dict[str, list[int]] = {k: [] for k in parts}
    for t in range(units):
        for x in released[t]:
            heapq.heappush(ready, x)
        due, k, _ = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        slots[k].append(t)
    return slots


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, units: int = UNITS, alpha: float = ALPHA, source: str = "source") -> DataFrame:
    """docs' rows with mix_source, mix_block, mix_slot, mix_place (in the block) and balanced; no row is lost.

    weights: target weights by source name (null is the source '\\0null'); all sources of docs need one. Without weights a
    source's is its share of rows to the power alpha. Rows are ordered in a source by a hash of doc_id and text; equal
    rows are interchangeable, and doc_ids that repeat or are null do no harm. Columns of docs with the names of the new ones
    are replaced, all others pass as they are. Sort by (mix_slot, mix_place) for the mixed stream. An empty table gives none.
    """
    spark = docs.sparkSession
    new = ("mix_source", "mix_block", "mix_slot", "mix_place", "balanced")
    name: Column = F.coalesce(F.col(source).cast("string"), F.lit("\0null"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    rows = docs.select(name.alias("mix_source"), F.xxhash64("doc_id", "text").alias("h"), F.struct(*kept).alias("row"))
    found = rows.groupBy("mix_source").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    counts = {r.mix_source: r.n for r in found}
    if not counts:
        return rows.select("row.*", "mix_source", F.lit(None).cast("long").alias("mix_block"), F.lit(None).cast("long").alias("mix_slot"), F.lit(None).cast("int").alias("mix_place"), F.lit(True).alias("balanced"))
    missing = sorted(set(counts) - set(weights or counts))
    if missing:
        raise ValueError(f"no weight for the sources {missing}")
    parts = whole_weights({k: weights[k] if weights else n**alpha for k, n in counts.items()}, units)
    total = sum(parts.values())
    slots = period(parts)
    plan = [(k, parts[k], counts[k], max(1, counts[k] // BUCKET_ROWS), slots[k]) for k in sorted(counts)]
    plan = spark.createDataFrame(plan, "mix_source string, parts int, rows long, buckets long, slots array<int>")
    plan = F.broadcast(plan)  # total numbers (UNITS, or four a source) and a row per source, of MAX_SOURCES at most

    rows = rows.join(plan.select("mix_source", "buckets"), "mix_source")
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 8), F.col("buckets"))).drop("buckets")
    light = rows.select("mix_source", "bucket", "h")
    again = light.groupBy("mix_source", "bucket", "h").agg(F.count("*").alias("n")).filter(F.col("n") > PART_ROWS)
    # hashes of very many equal rows; each takes more than PART_ROWS rows, so they are far fewer than rows
    again = written(again.select("mix_source", "h", F.ceil(F.col("n") / PART_ROWS).alias("cuts")), "again")
    if again.isEmpty():
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        rows = written(rows.withColumn("mark", F.monotonically_increasing_id()), "marked")  # written once, so marks stay
        rows = rows.join(again, ["mix_source", "h"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("mark"), F.col("cuts")), F.lit(0))).drop("mark", "cuts")
    # a bucket's parts are numbered one after another: what is in no cut group first
    ahead = rows.groupBy("mix_source", "bucket", "part", F.when(F.col("part") > 0, F.col("h")).alias("own")).agg(F.count("*").alias("n"))
    ahead = _running(written(ahead, "buckets"))
    rows = rows.withColumn("own", F.when(F.col("part") > 0, F.col("h")))
    place = F.row_number().over(Window.partitionBy("mix_source", "bucket", "part", "own").orderBy("h")) - 1
    rank = rows.withColumn("at", place).join(ahead.withColumnsRenamed({"mix_source": "s", "bucket": "b", "part": "p", "own": "o"}), F.expr("mix_source = s and bucket = b and part = p and own <=> o"))
    rank = rank.withColumn("rank", F.col("ahead") + F.col("at"))
    ends = [(counts[k] + block - 1) // block for k in sorted(counts)]
    # the first slot of a block that a source no longer has
    first_gap = min((e // parts[k]) * total + slots[k][e % parts[k]] for k, e in zip(sorted(counts), ends))
    out = rank.join(plan.select("mix_source", "parts", "slots"), "mix_source").withColumn("mix_block", F.floor(F.col("rank") / block))
    slot = F.floor(F.col("mix_block") / F.col("parts")) * total + F.element_at("slots", (F.col("mix_block") % F.col("parts") + 1).cast("int"))
    out = out.withColumn("mix_slot", slot.cast("long"))
    return out.select("row.*", "mix_source", "mix_block", "mix_slot", (F.col("rank") % block).cast("int").alias("mix_place"), (F.col("mix_slot") < first_gap).alias("balanced"))


def _running(counted: DataFrame, group: int = 256) -> DataFrame:
    """(mix_source, bucket, part, own, ahead): rows of the source in earlier buckets, or parts of the bucket. Sums run in two
    levels, so that no window holds more than about `group` buckets, or the sums of that many."""
    lap = F.floor(F.col("bucket") / group)
    counted = counted.withColumn("lap", lap)
    inner = F.sum("n").over(Window.partitionBy("mix_source", "lap").orderBy("bucket", "part", "own").rowsBetween(Window.unboundedPreceding, -1))
    laps = counted.groupBy("mix_source", "lap").agg(F.sum("n").alias("all"))
    outer = F.sum("all").over(Window.partitionBy("mix_source").orderBy("lap").rowsBetween(Window.unboundedPreceding, -1))
    laps = laps.select("mix_source", "lap", F.coalesce(outer, F.lit(0)).alias("base"))
    return counted.withColumn("inner", F.coalesce(inner, F.lit(0))).join(laps, ["mix_source", "lap"]).select("mix_source", "bucket", "part", "own", (F.col("base") + F.col("inner")).alias("ahead"))


def in_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed stream: rows ranged over files by slot and ordered inside them."""
    return mixed.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(*columns)


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents`, given its place in the mixed stream."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text"))
    return mix(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_place", "balanced")
