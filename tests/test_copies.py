"""Pair queries over tables with very many equal rows: copies cost a row each, and pairs are made only where they are the result."""

import os

import pytest
from pyspark.sql import functions as F

from metaspan.operators import meta as M
from metaspan.queries import QUERIES

COPIES = 60_000
LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """COPIES equal parts, which make 1.8 billion pairs, and a lone one."""
    home = tmp_path_factory.mktemp("copies")
    rows = spark.range(COPIES + 1).select(F.col("id").alias("p_partkey"), F.when(F.col("id") < COPIES, "hot bolt").otherwise("old ring").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL").alias("p_type"), F.lit(1).alias("p_size"), F.lit(9.0).alias("p_retailprice"))
    rows.write.parquet(f"{home}/part.parquet")
    for t in os.listdir(LARGE):
        if t != "part.parquet":
            os.symlink(f"{LARGE}/{t}", f"{home}/{t}")
    return str(home)


def test_best_neighbours_of_copies(spark, copies):
    top = QUERIES["primary_and_alternative"](spark, copies)
    assert {(r.a, r.b, r.rank) for r in top.filter("a < 3").collect()} == {(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2), (2, 0, 1), (2, 1, 2)}
    assert top.count() == 2 * COPIES


def test_mutual_best_of_copies(spark, copies):
    got = {(r.a, r.b) for r in QUERIES["mutual_top_k"](spark, copies).collect()}
    assert got == {(a, b) for b in range(4) for a in range(b)}


def test_groups_of_copies(spark, copies):
    assert QUERIES["connected_groups"](spark, copies).groupBy("component").count().collect() == [(0, COPIES)]


def test_sparse_edges_of_copies(spark, copies):
    got = [(r.a, r.b) for r in QUERIES["sparse_edges"](spark, copies).collect()]
    assert sorted(got) == sorted((a, b) for a in range(200) for b in range(a + 1, a + 4))[:400]


def test_family_of_copies(spark, copies):
    got = QUERIES["family_status"](spark, copies).groupBy("status", "role", "score").count().collect()
    assert {tuple(r) for r in got} == {("CANDIDATE", "CORE", 1.0, COPIES), ("CANDIDATE", "EDGE", 0.0, 1)}


def test_difficulty_of_copies(spark, copies):
    (got,) = QUERIES["review_difficulty"](spark, copies).collect()
    # a copy's mean is all but one other, and the lone part shares the type with each (1 of 5 words)
    want = (COPIES * ((COPIES - 1 + 0.2) / COPIES) + 0.2) / (COPIES + 1)
    assert got.n == COPIES + 1 and got.cohesion == round(want, 6) and got.outlier_ratio == 0.0


@pytest.mark.parametrize("name", ["blocked_pairs", "cosine_pairs", "weighted_jaccard", "edge_filter"])
def test_pairs_are_made_last(spark, copies, name):
    plan = QUERIES[name](spark, copies)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(ys") < plan.index("Exchange")  # plans are printed from their end


def test_expanded_pairs_of_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 4)
    terms = spark.createDataFrame([(d, w) for d in range(23) for w in (("x", "y") if d % 2 else ("x", "z") if d % 3 else ("q",))], "d long, w string")
    of = {}
    for d, w in terms.collect():
        of.setdefault(d, set()).add(w)
    classes, members = M.alike(terms, "d", "w")
    got = [(r.a, r.b, r.signals) for r in M.expand_pairs(M.class_signals(classes), members, "d").collect()]
    assert sorted(got) == [(a, b, len(of[a] & of[b])) for a in sorted(of) for b in sorted(of) if a < b and of[a] & of[b]]
