"""Embedding near-dedup: a navigable small-world graph per shard, every shard queried, links verified, components united.

Vectors are compared only with those of an equal label (and length). Equal vectors are one node with its number of ids. A
label's nodes are cut into shards of at most CAP by hash; each shard gets a graph, written once. For each two shards of a
label (and each shard with itself) a task queries the first one's graph with the other's vectors, of which no graph is sent,
verifies what was found by cosine in double precision, widens a query's beam by every link verified, and audits queries against all of the other
shard, a vector's match with itself left out: as many as it takes to see LINKS true links. While recall on them is below
RECALL all beams double; if it still is when a beam is as wide as the shard, or if there are too few links to audit, all
of the two shards is compared by blocks. A task returns a row per node: how many ids it
links to, and the least node of its group in the task; so groups of any size cost a row per node and no list of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaspan.llm.components import components
from metaspan.llm.hnsw import Graph
from metaspan.llm.scratch import prepare, table, written

COSINE = 0.93
#: Nodes of a shard; a task holds two.
CAP = 8192
BEAM, RECALL, AUDITED = 32, 0.98, 256
#: True links that an audit must hold to tell recall.
LINKS = 256


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = (flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; first by their largest component, so that no finite row over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _build(t: pa.Table) -> pa.Table:
    t = t.sort_by("node")
    n = t.num_rows
    ids = t["node"].to_numpy()
    g = Graph(unit(_matrix(t["v"], n)).astype(np.float32), ids)
    packed = [[layer[i].tobytes() for layer in g.links[: g.level[i] + 1]] for i in range(n)]
    return t.append_column("links", pa.array(packed, pa.list_(pa.binary())))


def _load(t: pa.Table, graph: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph | None]:
    t = t.sort_by("node")
    n = t.num_rows
    x = unit(_matrix(t["v"], n))
    ids = t["node"].to_numpy()
    if not graph:
        return ids, t["ids"].to_numpy(), x, None
    packed = t["links"].to_pylist()
    layers: list[np.ndarray] = []
    for layer in range(max(len(p) for p in packed)):
        width = max(len(p[layer]) for p in packed if len(p) > layer) // 4
        links = np.full((n, width), -1, np.int32)
        for i, p in enumerate(packed):
            if len(p) > layer:
                links[i] = np.frombuffer(p[layer], np.int32)
        layers.append(links)
    return ids, t["ids"].to_numpy(), x, Graph(x.astype(np.float32), ids, layers)


def _grow(graph: Graph, own: np.ndarray, query: np.ndarray, found: np.ndarray, cosine: float) -> None:
    """Widen one query's beam by every verified link: points next to links are tried in turn until none is new."""
    wave = np.flatnonzero(found)
    tried = found.copy()
    near = graph.links[0]
    while len(wave):
        next_ = near[wave].ravel()
        next_ = np.unique(next_[next_ >= 0])
        next_ = next_[~tried[next_]]
        tried[next_] = True
        wave = next_[own[next_] @ query >= cosine]
        found[wave] = True


def _true_links(own: np.ndarray, other: np.ndarray, rows: np.ndarray, cosine: float, same: bool) -> np.ndarray:
    """(rows, points) table of all links of some queries; `same` where queries and points are one list."""
    found = other[rows] @ own.T >= cosine
    if same:
        found[np.arange(len(rows)), rows] = False
    return found


def _query(graph: Graph, own: np.ndarray, other: np.ndarray, cosine: float, audited: int, same: bool = False) -> np.ndarray:
    """(queries, points) table of verified links from other (queries) to own (the graph's points)."""
    order, step = np.random.default_rng(0).permutation(len(other)), max(1, audited)
    parts, links, at = [], 0, 0
    while at < len(other) and links < LINKS:
        parts.append(_true_links(own, other, order[at : at + step], cosine, same))
        links, at = links + int(parts[-1].sum()), at + step
    truth, sample = np.concatenate(parts), order[:at]
    if at >= len(other):  # the audit has compared all
        found = np.empty_like(truth)
        found[order] = truth
        return found
    beam = BEAM
    while True:
        ids, _ = graph.search(other.astype(np.float32), beam)
        found = np.zeros((len(other), len(own)), bool)
        rows = np.repeat(np.arange(len(other)), ids.shape[1])
        cols = ids.ravel()
        rows, cols = rows[cols >= 0], cols[cols >= 0]
        for a in range(0, len(rows), 1 << 18):
            r, c = rows[a : a + (1 << 18)], cols[a : a + (1 << 18)]
            ok = np.einsum("ij,ij->i", other[r], own[c]) >= cosine
            found[r[ok], c[ok]] = True
        for q in np.flatnonzero(found.any(1)):
            _grow(graph, own, other[q], found[q], cosine)
        if (found[sample] & truth).sum() >= RECALL * links:
            return found
        if beam >= len(own):  # points that no link leads to
            for a in range(0, len(other), 512):
                found[a : a + 512] = _true_links(own, other, np.arange(a, min(a + 512, len(other))), cosine, same)
            return found
        beam *= 2


def _groups(links: np.ndarray) -> np.ndarray:
    """Least index of each point's group in a symmetric table of links."""
    label = np.full(len(links), -1, np.int64)
    for i in range(len(links)):
        if label[i] >= 0:
            continue
        label[i] = i
        wave = np.array([i])
        while len(wave):
            wave = np.flatnonzero(links[wave].any(0) & (label < 0))
            label[wave] = i
    return label


def _link_task(cosine: float, audited: int):
    def run(t: pa.Table) -> pa.Table:
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        shard = t["shard"].to_numpy()
        a_ids, a_n, ax, ag = _load(t.filter(pa.array(shard == lo)))
        if lo == hi:
            links = _query(ag, ax, ax, cosine, audited, True)
            np.fill_diagonal(links, False)
            links |= links.T
            ids, count = a_ids, links @ a_n
            group = a_ids[_groups(links)]
        else:
            other = t.filter(pa.array(shard == hi))
            if not other.num_rows:
                return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
            b_ids, b_n, bx, _ = _load(other, False)
            cross = _query(ag, ax, bx, cosine, audited).T
            ids = np.concatenate((a_ids, b_ids))
            count = np.concatenate((cross @ b_n, cross.T @ a_n))
            n = len(a_ids)
            label = np.full(len(ids), -1, np.int64)
            for i in range(len(ids)):
                if label[i] >= 0:
                    continue
                label[i], wave = i, np.array([i])
                while len(wave):
                    left, right = wave[wave < n], wave[wave >= n] - n
                    reach = np.concatenate((cross[:, right].any(1), cross[left].any(0)))
                    wave = np.flatnonzero(reach & (label < 0))
                    label[wave] = i
            group = ids[label]
        keep = count > 0
        return pa.table({"node": pa.array(ids[keep]), "n": pa.array(count[keep].astype(np.int64)), "least": pa.array(group[keep])})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cap: int = CAP, audited: int = AUDITED) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept.

    n_links counts the other ids linked directly; component_id is the least vec_id reachable; kept is whether that is the
    row's own. Vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a null label or vec_id,
    link with nothing. Rows that share vec_id, label and vector are one vector. Other columns are ignored; an empty table
    gives none.
    """
    prepare(vectors.sparkSession)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("label"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = base.filter(good)
    nodes = usable.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("ids")).withColumn("dim", F.size("v"))
    nodes = written(nodes, "nodes")
    shards = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / cap).cast("int").alias("shards"))
    sharded = nodes.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    kinds = dict(sharded.dtypes)
    order = ["label", "dim", "shard", "shards", "node", "ids", "v"]
    graphs = sharded.select(*order).groupBy("label", "dim", "shard").applyInArrow(_build, ", ".join(f"{c} {kinds[c]}" for c in order) + ", links array<binary>")
    graphs = written(graphs, "graphs")
    tasks = graphs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    tasks = tasks.withColumn("lo", F.least("shard", "other")).withColumn("hi", F.greatest("shard", "other")).drop("other")
    tasks = tasks.withColumn("links", F.when(F.col("shard") == F.col("lo"), F.col("links")))
    found = written(tasks.groupBy("label", "dim", "lo", "hi").applyInArrow(_link_task(cosine, audited), "node long, n long, least long"), "links")
    united = components(found.select("node", "least"), "node", "least")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    facts = nodes.join(counts, "node", "left").join(united, "node", "left")
    facts = facts.select("label", "v", (F.col("ids") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = usable.join(facts, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = base.filter(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: all of `embeddings`, cosine 0.93."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
