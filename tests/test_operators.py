"""Small cases with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from metaspan.operators import graph as G
from metaspan.operators import meta as M
from metaspan.operators import relational as R
from metaspan.plans import facts as P
from metaspan.plans import lexer
from metaspan.plans.analyse import analyse, analyse_script, grains
from metaspan.sources import facts as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_asof_join(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (1, 1), (2, 7), (3, None)], "k int, at int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 8, "b"), (2, 9, "c")], "k int, at int, v string")
    got = R.asof_join(left, right, "at", "at", ["k"], ["v"])
    assert rows(got) == sorted([(1, 10, "b"), (1, 5, "a"), (1, 1, None), (2, 7, None), (3, None, None)], key=repr)
    assert (1, 5, None) in rows(R.asof_join(left, right, "at", "at", ["k"], ["v"], inclusive=False))


def test_positional_join_and_numbers(spark):
    a, b = spark.createDataFrame([(c,) for c in "dbac"], "x string"), spark.createDataFrame([(i,) for i in (3, 1, 2, 9, 7)], "y int")
    assert rows(R.positional_join(a, b, ["x"], ["y"])) == sorted([("a", 1), ("b", 2), ("c", 3), ("d", 7), (None, 9)], key=repr)


def test_star_modifiers(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id int, name string, id_2 double")
    assert R.star_ilike(df, "ID%").columns == ["id", "id_2"]
    assert R.star_replace(df, name=F.upper("name")).collect()[0].name == "A"
    with pytest.raises(ValueError):
        R.star_replace(df, other=F.lit(1))


def test_assert_rows_stops_the_query(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    with pytest.raises(Exception, match="broken"):
        R.assert_rows(df, F.col("x") > 0, "broken").collect()


def test_connect_by_cycle_is_an_error(spark):
    df = spark.createDataFrame([(1, 2), (2, 1)], "k int, p int")
    with pytest.raises(RuntimeError):
        R.connect_by(df, "k", "p", "k = 1", limit=5).collect()


def test_match_recognize(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate("xyyxyyyx")], "k string, i int, s string")
    got = R.match_recognize(df, ["k"], ["i"], {"Y": F.col("s") == "y", "X": F.col("s") == "x"}, "XY+")
    assert rows(got) == [("a", 1, 0, 2, 3), ("a", 2, 3, 6, 4)]


def test_components_and_reach(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)], "a int, b int")
    assert set(rows(G.groups(edges).select("component").distinct())) == {(0,), (100,)}
    walk = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "src string, dst string")
    assert rows(G.reach(walk, spark.createDataFrame([("a",)], "node string"))) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1)]
    assert G.reach(walk, spark.createDataFrame([], "node string")).count() == 0


def test_complete_link_needs_all_pairs(spark):
    pairs = spark.createDataFrame([("x", 1, 2, 0.9), ("x", 2, 3, 0.8), ("x", 4, 5, 0.7), ("x", 1, 3, 0.1)], "block string, a int, b int, score double")
    assert rows(M.complete_link(pairs, "block", 0.5)) == [("x", 1, 1), ("x", 1, 2), ("x", 3, 3), ("x", 4, 4), ("x", 4, 5)]


def test_packing_skips(spark):
    items = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 4), ("g", 4, 1)], "g string, o int, c int")
    assert [r.o for r in M.pack_within_budget(items, "g", "o", "c", 10).collect()] == [1, 3, 4]


def test_propagation_freezes_and_stays_in_range(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "a int, b int, w double")
    seeds = spark.createDataFrame([(1, "x", 1.0)], "node int, label string, score double")
    got = {r.node: r.score for r in M.propagate_labels(edges, seeds, 0.5, 1e-6, 40).collect()}
    assert got[1] == 1.0 and 0 < got[3] < got[2] < 1
    assert got[2] == pytest.approx(0.5 * (1 + got[3]) / 2, abs=1e-4)


def test_normalised_text(spark):
    df = spark.createDataFrame([("ＦｕｌｌWidth_nameID",), (None,)], "t string")
    assert [r.n for r in df.select(M.normalised_text(F.col("t")).alias("n")).collect()] == ["full width name id", None]


def test_lexer_is_lossless():
    text = "SELECT 'a;''b', `x;y`, \"q\" -- c;\nFROM t /* ; */ WHERE a<=>1; BEGIN SELECT 1; END; ${x} @"
    assert "".join(t.text for t in lexer.tokens(text)) == text
    for s in lexer.split(text):
        assert text[s.start : s.end] == s.text
    masked, places = lexer.mask("a ${b} {{ c }}")
    assert len(masked) == len("a ${b} {{ c }}") and [p[2] for p in places] == ["${b}", "{{ c }}"]


@pytest.mark.parametrize("sql", ["", "SELECT", "((", "SELECT * FROM", "'", "WITH a AS (", "SELECT 1;", "MERGE INTO t USING u ON t.a = u.a WHEN MATCHED THEN DELETE", "DESCRIBE t", "FROM t |> WHERE a > 1 |> SELECT a"])
def test_analysis_never_raises(spark, sql):
    assert analyse(spark, sql).status in ("OK", "FAILURE", "NOT_EVALUABLE")


def test_one_broken_statement_leaves_its_neighbours(spark):
    got = [a.status for _, a in analyse_script(spark, "SELECT a FROM t; SELECT a FROM (; SELECT b FROM u")]
    assert got == ["OK", "FAILURE", "OK"]


def test_grain_of_semi_joins_and_sets(spark):
    a = analyse(spark, "SELECT k FROM (SELECT k FROM t GROUP BY k) x LEFT SEMI JOIN u ON x.k = u.k")
    assert grains(a.relations)[a.relations[-1].id] == ["k"]
    b = analyse(spark, "SELECT k FROM t GROUP BY k UNION ALL SELECT k FROM t GROUP BY k")
    assert grains(b.relations)[b.relations[-1].id] is None
    assert grains(analyse(spark, "SELECT count(*) AS n FROM t").relations)["q.aggregate"] == []


def test_ambiguous_names_stay_unknown(spark):
    a = analyse(spark, "SELECT b FROM t JOIN u ON t.a = u.a", {"t": ["a", "b"], "u": ["a", "b"]})
    assert not a.outputs[0].known and ("AMBIGUOUS_COLUMN", "b") in a.unknowns
    a = analyse(spark, "SELECT t.b FROM t JOIN nowhere n ON t.a = n.a", {"t": ["a", "b"]})
    assert a.outputs[0].origins == {("t", "b")}


def test_empty_facts_are_typed(spark):
    facts = P.plan_facts(spark, {})
    assert all(df.count() == 0 and df.columns for df in facts.values())
    assert all(df.count() == 0 for df in P.validate(facts).values())


def test_sources(spark, tmp_path):
    import json

    for name in S.SCHEMAS:
        (tmp_path / f"{name}.json").write_text(json.dumps([]))
    (tmp_path / "failures.json").write_text(json.dumps([{"target_id": "a", "failure_status": "F", "error_category": None}]))
    found = S.read_json_facts(spark, str(tmp_path))
    assert found["failures"].count() == 1 and found["objects"].count() == 0 and "asset_id" in found["objects"].columns
    df = spark.range(10).withColumn("s", F.lit("x"))
    S.write_csv_parts(df, str(tmp_path / "csv"), 3)
    assert S.read_csv_parts(spark, str(tmp_path / "csv" / "*.csv"), "id long, s string").count() == 10
    for _ in range(2):
        S.replace_atomically(df, str(tmp_path / "swap"))
    assert spark.read.json(str(tmp_path / "swap")).count() == 10
    task = df.withColumn("task_id", (F.col("id") % 2).cast("string"))
    S.publish_bundle({"f": task}, str(tmp_path / "bundle"), {"none": df.filter("id < 0")})
    assert rows(S.task_index(spark, str(tmp_path / "bundle"), "f").selectExpr("cast(task_id as string)")) == [("0",), ("1",)]
    with pytest.raises(ValueError):
        S.publish_bundle({"f": task}, str(tmp_path / "bundle"), {"some": df})
    (tmp_path / "q.sql").write_text("SELECT 1")
    assert S.read_sql_texts(spark, str(tmp_path / "*.sql")).collect()[0].text == "SELECT 1"


def test_stream_equals_batch(spark, tmp_path):
    from metaspan.streaming.windows import tumbling

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    job = tumbling(stream, "ts", "1 hour", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    job.awaitTermination(120)
    assert rows(spark.table("hourly")) == rows(tumbling(events, "ts", "1 hour", ["event_type"]))
