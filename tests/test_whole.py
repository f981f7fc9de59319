"""Whole jobs: results where a limit on tokens, pairs, hops or text would have cut them."""

import math
import os
import re
import unicodedata

import duckdb
import pytest

from pyspark.sql import functions as F

from metaspan.operators import graph as G
from metaspan.operators import meta as M
from metaspan.operators import relational as R
from metaspan.plans import facts as P
from metaspan.queries import ORACLES, QUERIES

LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def large():
    c = duckdb.connect()
    for t in os.listdir(LARGE):
        c.execute(f"create view {t.split('.')[0]} as select * from '{LARGE}/{t}{'/*.parquet' if os.path.isdir(f'{LARGE}/{t}') else ''}'")
    return c


def test_cosine_pairs_are_exact_for_frequent_terms(spark):
    docs = {d: {f"t{d % m}_{m}" for m in (2, 3, 5, 7)} | ({"all"} if d % 4 else set()) for d in range(60)}
    rows = [(d, w) for d, ws in docs.items() for w in ws]
    weights = M.tfidf(spark.createDataFrame(rows, "d int, w string"), "d", "w")
    of = {}
    for r in weights.collect():
        of.setdefault(r.d, {})[r.w] = r.weight
    for least in (0.05, 0.3, 0.7):
        want = {}
        for a in of:
            for b in of:
                dot = sum(x * of[b].get(w, 0.0) for w, x in of[a].items())
                if a < b and dot >= least:
                    want[a, b] = dot
        got = {(r.a, r.b): r.cosine for r in M.cosine_pairs(weights, "d", "w", least).collect()}
        assert want and got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


@pytest.mark.parametrize("name", ["blocked_pairs", "tfidf_weights", "cosine_pairs", "primary_and_alternative", "mutual_top_k", "weighted_jaccard"])
def test_similarity_at_larger_scale(spark, large, name):
    got = QUERIES[name](spark, LARGE)
    value = next((c for c in ("cosine", "score", "weight") if c in got.columns), "1")
    n, total = got.selectExpr("count(*)", f"sum({value})").first()
    want, all_ = large.execute(f"select count(*), sum({value}) from ({ORACLES[name]})").fetchone()
    assert n == want > 0 and math.isclose(total, all_, rel_tol=1e-6)


@pytest.mark.parametrize("name", ["connected_groups", "complete_link_clusters"])
def test_groups_at_larger_scale(spark, name):
    assert QUERIES[name](spark, LARGE).count() > 0


def test_closures_follow_long_chains(spark):
    n = 64
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(n)], "src string, dst string")
    seed = spark.createDataFrame([("n000",)], "node string")
    assert {(r.node, r.hop) for r in G.reach(chain, seed).collect()} == {(f"n{i:03}", i) for i in range(n + 1)}
    nodes = spark.createDataFrame([(f"n{i:03}", "STG") for i in range(n + 1)], "node string, db string")
    assert {(r.node, r.hop) for r in G.gated_reach(chain, nodes, seed, "DM", "PASS").collect()} == {(f"n{i:03}", i) for i in range(n + 1)}


def test_downstream_and_ancestors_follow_long_chains(spark):
    n = 64
    io = [(f"t{i}", way, f"d{i + k}") for i in range(n) for way, k in (("READ", 0), ("WRITE", 1))]
    out = G.transitive_downstream(spark.createDataFrame(io, "task_id string, direction string, dataset string"), spark.createDataFrame([("d0",)], "dataset string"))
    assert {(r.dataset, r.hop, *r.tasks) for r in out.collect()} == {(f"d{i + 1}", i + 1, f"t{i}") for i in range(n)}
    edges = spark.createDataFrame([("s", i, i + 1) for i in range(n)], "statement_id string, from_relation_id int, to_relation_id int")
    assert P.ancestors(edges).count() == n * (n + 1) // 2


def test_normalised_text_is_that_of_whole_documents(spark, sf):
    def plain(s):
        s = unicodedata.normalize("NFKC", s)
        kind = [unicodedata.category(c) for c in s] + ["", ""]
        out = ""
        for i, c in enumerate(s):
            out += c
            if kind[i + 1] == "Lu" and (kind[i] in ("Ll", "Nd") or kind[i] == "Lu" and kind[i + 2] == "Ll"):
                out += " "
        return re.sub(r"[ \t\n\r\f\v_\-./]+", " ", out).strip(" ").lower()

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.normalised for r in QUERIES["normalised_text"](spark, sf).collect()}
    assert any("\n" in x for x in texts.values()) and got == {d: plain(x) for d, x in texts.items()}


def test_reach_over_all_orders(spark, sf):
    out = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_orderkey").collect():
        for a, b in ((f"s{r.l_suppkey}", f"p{r.l_partkey}"), (f"p{r.l_partkey}", f"o{r.l_orderkey}"), (f"o{r.l_orderkey}", f"s{r.l_suppkey % 7}")):
            out.setdefault(a, set()).add(b)
    want = {}
    for seed in ("s1", "s2"):
        want[seed, seed], wave = 0, [seed]
        while wave:
            step = {y for x in wave for y in out.get(x, ()) if (seed, y) not in want}
            want |= {(seed, y): want[seed, wave[0]] + 1 for y in step}
            wave = list(step)
    assert {(r.seed, r.node): r.hop for r in QUERIES["reach_hops"](spark, sf).collect()} == want


def test_degrees_of_all_rows(spark, large):
    whole = QUERIES["degrees"](spark, LARGE).selectExpr("count(*)", "sum(n_in + n_out)").first()
    assert tuple(whole) == large.execute(f"select count(*), sum(n_in + n_out) from ({ORACLES['degrees']})").fetchone()


@pytest.mark.parametrize("adaptive, advisory", [("false", "64MB"), ("true", "1MB"), ("true", "4MB"), ("true", "64MB")])
def test_numbers_of_many_rows(spark, adaptive, advisory):
    """Every row keeps its columns and has its number in the order, however the shuffle is cut."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = spark.read.parquet(f"{LARGE}/lineitem.parquet")
        order = ["l_extendedprice", "l_orderkey", "l_linenumber"]
        got = R.numbered(rows, order).toArrow().sort_by("_row")
        want = rows.toArrow().sort_by([(c, "ascending") for c in order])
        assert got.num_rows == 600_000 and got["_row"].to_pylist() == list(range(600_000))
        assert got.drop_columns("_row").select(want.column_names).equals(want)
        assert R.top_percent(rows, 90, *order).count() == 540_000
        keys = rows.select(*[F.col(c).alias(f"k_{c}") for c in order])
        both = R.positional_join(rows, keys, order, [f"k_{c}" for c in order])
        assert both.filter(" and ".join(f"{c} = k_{c}" for c in order)).count() == both.count() == 600_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_plan_facts_of_a_table(spark, tmp_path):
    tasks = {f"k{i}": f"SELECT a + {i % 7} AS c FROM t; SELECT b FROM t WHERE a > {i % 3}" for i in range(40)}
    catalog = {"t": ["a", "b"]}
    table = spark.createDataFrame(list(tasks.items()), "task_id string, sql string")
    one, many = P.plan_facts(spark, tasks, catalog), P.write_plan_facts(spark, table, str(tmp_path / "facts"), catalog)
    for name in ("column_lineage", "dataset_io"):
        plain = lambda df: sorted(tuple(r) for r in df.drop("statement_id").collect())
        assert plain(many[name]) == plain(one[name])
    assert many["statements"].select("statement_id").distinct().count() == 80
    assert all(df.isEmpty() for df in P.validate(many).values())
