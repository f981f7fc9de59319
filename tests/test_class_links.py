"""complete_link_clusters works on classes of copies: its clusters are those of complete_link() over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from metaspan.operators import meta as M
from metaspan.queries import QUERIES


def plain(of, blocks, near, block):
    """complete_link() of one block, pair by pair."""
    pairs = [(-near[of[i]][of[j]], i, j) for i in range(len(of)) for j in range(i + 1, len(of)) if blocks[i] == block and of[j] in near[of[i]]]
    linked = {(i, j) for _, i, j in pairs} | {(j, i) for _, i, j in pairs}
    held = {i: {i} for i, _ in linked}
    for _, i, j in sorted(pairs):
        x, y = held[i], held[j]
        if x is not y and all((a, b) in linked for a in x for b in y):
            x |= y
            for m in y:
                held[m] = x
    return {i: min(c) for i, c in held.items()}


def test_classes_link_like_their_items():
    rng = random.Random(2)
    for trial in range(1500):
        kinds, n, brands = rng.randint(1, 6), rng.randint(1, 24), rng.choice([1, 2, 2, 3, 5])
        near = [{} for _ in range(kinds)]
        for a in range(kinds):
            for b in range(a, kinds):
                if rng.random() < (0.9 if a == b else 0.5):
                    near[a][b] = near[b][a] = 1.0 if a == b and rng.random() < 0.8 else rng.choice([0.6, 0.7, 0.8])
        of = [rng.randrange(kinds) for _ in range(n)]
        blocks = [rng.randrange(brands) for _ in range(n)]
        at, paired = M.link_classes(np.array(of), np.array(blocks) == 0, near)
        assert {i: int(at[i]) for i in range(n) if paired[i]} == plain(of, blocks, near, 0), trial


def test_clusters_are_those_of_all_pairs(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").limit(200).withColumn("p_size", F.col("p_size") % 4)
    terms = parts.select(F.col("p_partkey").alias("d"), F.explode(F.split("p_name", " ")).alias("w"), "p_size").select("d", F.concat_ws("_", "w", "p_size").alias("w")).distinct()
    classes, members = M.alike(terms, "d", "w")
    near = M.cut(M.class_cosines(classes, 0.3).withColumn("score", F.round("cosine", 7)).drop("cosine"))
    brands = parts.select(F.col("p_partkey").alias("d"), F.when(F.col("p_partkey") % 5 > 0, F.substring("p_brand", 7, 1)).alias("block"))  # some without
    pairs = M.expand_pairs(near, members, "d").join(brands.withColumnRenamed("d", "a"), "a")
    want = sorted(map(tuple, M.complete_link(pairs, "block", 0.5).collect()), key=str)
    got = sorted(map(tuple, M.class_complete_link(near, members, brands, "d", "block", 0.5).collect()), key=str)
    assert got == want and len({r[:2] for r in want}) < len(want)


def test_clusters_of_very_many_copies(spark, tmp_path):
    """Their pairs (1.8 billion) are not made."""
    n = 60_000
    brand = F.when(F.col("id") < n, "Brand#1").otherwise("Brand#2")
    rows = spark.range(n + 2).select(F.col("id").alias("p_partkey"), F.lit("hot bolt").alias("p_name"), brand.alias("p_brand"), F.lit("SMALL").alias("p_type"), F.lit(1).alias("p_size"), F.lit(9.0).alias("p_retailprice"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["complete_link_clusters"](spark, str(tmp_path)).groupBy("block", "cluster").count()
    assert sorted(map(tuple, got.collect())) == [("Brand#1", 0, n + 1), ("Brand#1", n + 1, 1), ("Brand#2", n, 2)]
