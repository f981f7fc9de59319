"""Graph operators over edge tables: closure, reach with hops, gated reach, components and downstream tasks."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaspan.operators.meta import cut


def reach(edges: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """(seed, node, hop): breadth first from each seed(node) along edges(src, dst); the least hop counts, cycles are safe.

    Seeds advance together: a hop is one join of the frontier with the edges, and nodes already seen by a seed drop out
    by an anti-join. Lineage is cut at every hop. The walk ends when nothing new is met, or after `limit` hops where the
    caller asks for no more.
    """
    seen = cut(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hop", F.lit(0)))
    wave = seen
    for hop in count(1) if limit is None else range(1, limit + 1):
        step = wave.select("seed", F.col("node").alias("src")).join(edges.select("src", "dst"), "src").select("seed", F.col("dst").alias("node")).distinct()
        wave = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if wave.isEmpty():
            return seen
        seen = cut(seen.unionByName(wave)) if hop % 4 == 0 else seen.unionByName(wave)
    return seen


def gated_reach(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, gate: str, passing: str, limit: int | None = None) -> DataFrame:
    """(seed, node, state, hop) over states (node, PRE / GATE).

    nodes(node, db): a null db is unresolved. A walk goes on from unresolved nodes only behind the gate; reaching a node
    of the gate database turns the state to GATE; in it only nodes of the `passing` database are expanded further, and
    all others are ends. The walk ends as that of reach does.
    """
    placed = edges.join(nodes.select(F.col("node").alias("dst"), "db"), "dst", "left").select("src", "dst", "db")
    start = seeds.join(nodes, "node", "left").select(F.col("node").alias("seed"), "node", F.when(F.col("db") == gate, "GATE").otherwise("PRE").alias("state"), "db")
    seen = cut(start.distinct().withColumn("hop", F.lit(0)))
    wave = seen
    for hop in count(1) if limit is None else range(1, limit + 1):
        grows = (F.col("hop") == 0) | ((F.col("state") == "PRE") & F.col("db").isNotNull()) | ((F.col("state") == "GATE") & (F.col("db") == passing))
        step = wave.filter(F.coalesce(grows, F.lit(False))).select("seed", "state", F.col("node").alias("src")).join(placed, "src")
        step = step.select("seed", F.col("dst").alias("node"), F.when((F.col("state") == "GATE") | (F.col("db") == gate), "GATE").otherwise("PRE").alias("state"), "db").distinct()
        wave = cut(step.join(seen.select("seed", "node", "state"), ["seed", "node", "state"], "left_anti").withColumn("hop", F.lit(hop)))
        if wave.isEmpty():
            break
        seen = cut(seen.unionByName(wave)) if hop % 4 == 0 else seen.unionByName(wave)
    return seen.select("seed", "node", "state", "hop")


def gated_edges(edges: DataFrame, reached: DataFrame, nodes: DataFrame, passing: str) -> DataFrame:
    """The edges a gated walk took: from states that grow, to nodes that were reached."""
    grown = reached.join(nodes, "node", "left").filter("hop = 0 or (state = 'PRE' and db is not null) or (state = 'GATE' and db = '" + passing + "')")
    return edges.join(grown.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(reached.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")


def groups(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): connected groups named by their least node; minima travel and take jumps, so rounds grow with
    the logarithm of a group's width for most shapes."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    label = cut(both.select(F.col("x").alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(rounds):
        near = both.join(label.select(F.col("node").alias("y"), F.col("component").alias("c")), "y").groupBy(F.col("x").alias("node")).agg(F.min("c").alias("c"))
        low = label.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("was"))
        low = cut(low)
        jump = low.join(low.select(F.col("node").alias("component"), F.col("component").alias("up")), "component").select("node", F.least("component", "up").alias("component"), "was")
        jump = cut(jump)
        if jump.filter("component <> was").isEmpty():
            return jump.select("node", "component")
        label = jump.select("node", "component")
    raise RuntimeError("groups did not settle")


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 6, levels: int = 4) -> DataFrame:
    """(node, community): communities of edges(a, b, w) by modularity, in levels; a community is named by its least node.

    On each level nodes start alone and move to the neighbouring community of the best gain; by a hash of the round half of the
    nodes move at a time, so that neighbours do not swap places for ever. Communities are then cut into their connected
    parts, which are the nodes of the next level, until a level joins nothing. Every step is a join and a pre-aggregated sum; no
    community is brought together. Results are those of this method, not of another one's random order.
    """
    once = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").filter("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"))
    links = cut(once.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").unionByName(once.select(F.col("b").alias("x"), F.col("a").alias("y"), "w")))
    nodes = cut(links.groupBy(F.col("x").alias("node")).agg(F.sum("w").alias("k")))
    all_ = nodes.agg(F.sum("k")).first()[0]
    named = nodes.select("node", F.col("node").alias("community"))
    for _ in range(levels):
        state, quiet = nodes.withColumn("c", F.col("node")), 0
        for r in range(rounds):
            weight = state.groupBy("c").agg(F.sum("k").alias("s"))
            near = links.join(state.select(F.col("node").alias("y"), "c"), "y").groupBy(F.col("x").alias("node"), "c").agg(F.sum("w").alias("wc"))
            half = state.filter(F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0).select("node", "k", F.col("c").alias("own"))
            pull = resolution * F.col("k") / all_
            seen = half.join(near, "node").join(weight, "c").select("node", "own", "c", (F.col("wc") - pull * (F.col("s") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0))).alias("gain"))
            alone = half.join(weight, half["own"] == weight["c"]).select("node", "own", F.col("own").alias("c"), (-pull * (F.col("s") - F.col("k"))).alias("gain"))
            stay = F.max(F.when(F.col("c") == F.col("own"), F.col("gain")))
            best = seen.unionByName(alone).groupBy("node").agg(stay.alias("stay"), F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("b"))
            moves = best.filter(-F.col("b.g") > F.col("stay") + 1e-12).select("node", F.col("b.c").alias("to"))
            state = cut(state.join(moves, "node", "left").select("node", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")))
            quiet = 0 if not state.filter("moved").isEmpty() else quiet + 1
            state = state.drop("moved")
            if quiet == 2:
                break
        inner = links.join(state.select(F.col("node").alias("x"), F.col("c").alias("cx")), "x").join(state.select(F.col("node").alias("y"), F.col("c").alias("cy")), "y").filter("cx = cy and x < y")
        if inner.isEmpty():
            break
        parts = nodes.join(groups(inner.select(F.col("x").alias("a"), F.col("y").alias("b"))), "node", "left").select("node", "k", F.coalesce("component", "node").alias("part"))
        parts = cut(parts)
        named = cut(named.join(parts.select(F.col("node").alias("community"), "part"), "community").select("node", F.col("part").alias("community")))
        to = lambda n: parts.select(F.col("node").alias(n), F.col("part").alias(f"p{n}"))
        links = cut(links.join(to("x"), "x").join(to("y"), "y").filter("px <> py").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.sum("w").alias("w")))
        nodes = cut(parts.groupBy(F.col("part").alias("node")).agg(F.sum("k").alias("k")))
    return named


def modularity(edges: DataFrame, named: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row with q, the modularity of named(node, community) over edges(a, b, w)."""
    once = edges.filter("a <> b")
    ends = once.select(F.col("a").alias("node"), "w").unionByName(once.select(F.col("b").alias("node"), "w")).join(named, "node").groupBy("community").agg(F.sum("w").alias("k"))
    of = lambda c: named.select(F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    inner = once.join(of("a"), "a").join(of("b"), "b").filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("i"))
    total = ends.agg(F.sum("k").alias("m2"))
    return ends.join(inner, "community", "left").join(F.broadcast(total)).agg(F.sum(2 * F.coalesce("i", F.lit(0.0)) / F.col("m2") - resolution * (F.col("k") / F.col("m2")) ** 2).alias("q"))


def short_name(column):
    return F.lower(F.element_at(F.split(column, r"\."), -1))


def direct_downstream(io: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, task_id, dataset, match, status): tasks that read a seed and what they write.

    io(task_id, direction, dataset): a read matches a seed by its whole name (lower case), else by its short name when
    exactly one seed has that short name. Writes of the seed itself are skipped; a task that writes nothing is PARTIAL.
    """
    s = seeds.select(F.lower("dataset").alias("seed"), short_name(F.col("dataset")).alias("short")).distinct()
    reads = io.filter("direction = 'READ'").select("task_id", F.lower("dataset").alias("name"), short_name(F.col("dataset")).alias("short"))
    exact = reads.join(s.select("seed"), reads["name"] == s["seed"]).select("seed", "task_id", "name", F.lit("EXACT").alias("match"))
    lone = s.groupBy("short").agg(F.min("seed").alias("seed"), F.count("*").alias("n")).filter("n = 1").select("short", "seed")
    rest = reads.filter(~F.col("name").contains(".")).join(s.select(F.col("seed").alias("name")), "name", "left_anti")
    loose = rest.join(lone, "short").select("seed", "task_id", "name", F.lit("SHORT_NAME").alias("match"))
    hits = exact.unionByName(loose).groupBy("seed", "task_id").agg(F.min("match").alias("match"))
    writes = io.filter("direction = 'WRITE'").select("task_id", F.lower("dataset").alias("dataset")).distinct()
    out = hits.join(writes, "task_id", "left").filter("dataset is null or dataset <> seed")
    return out.select("seed", "task_id", "dataset", "match", F.when(F.col("dataset").isNull(), "PARTIAL").otherwise("CANDIDATE").alias("status"))


def transitive_downstream(io: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """(seed, dataset, hop, tasks): datasets downstream of each seed with their least hop and the tasks that give them
    at that hop, sorted; datasets seen before by a seed are not entered again."""
    reads = io.filter("direction = 'READ'").select("task_id", F.lower("dataset").alias("src"))
    writes = io.filter("direction = 'WRITE'").select("task_id", F.lower("dataset").alias("dst"))
    flows = reads.join(writes, "task_id").filter("src <> dst").select("src", "dst", "task_id").distinct()
    walked = reach(flows.select("src", "dst").distinct(), seeds.select(F.lower("dataset").alias("node")), limit)
    ends = walked.filter("hop > 0")
    before = walked.select("seed", F.col("node").alias("src"), (F.col("hop") + 1).alias("hop"))
    via = ends.join(flows.withColumnRenamed("dst", "node"), "node").join(before, ["seed", "src", "hop"], "left_semi")
    return via.groupBy("seed", F.col("node").alias("dataset"), "hop").agg(F.array_sort(F.collect_set("task_id")).alias("tasks"))


def degree(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out) over distinct edges."""
    e = edges.select("src", "dst").distinct()
    rows = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return rows.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def last_status(log: DataFrame, key: str, order: str) -> DataFrame:
    """The latest record per key, later retries replacing earlier ones."""
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
