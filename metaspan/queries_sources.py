"""Queries for sources, sinks and the extension surface: round trips through files, functions of one's own, graph patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaspan.functions import extension as X
from metaspan.plans import analyse as A
from metaspan.queries_meta import _COLS, _EDGES, catalog, graph_edges
from metaspan.queries_relational import Tables
from metaspan.queries_sql import values
from metaspan.sources import facts as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return wrap


@query(f"SELECT 'local:main:TABLE:' || t AS asset_id, c AS column_name, CAST(o AS INTEGER) AS ordinal_position FROM {_COLS}")
def json_facts_round_trip(t):
    place = S.shared_folder(t.spark)
    objects, columns, constraints, dependencies = catalog(t)
    none = {n: t.spark.createDataFrame([], S.SCHEMAS[n]) for n in ("indexes", "object_definitions", "failures")}
    S.write_json_facts({"objects": objects, "columns": columns, "constraints": constraints, "dependencies": dependencies, **none}, place)
    found = S.read_json_facts(t.spark, place, lines=True)
    return found["columns"].join(found["objects"].select("asset_id"), "asset_id").select("asset_id", "column_name", "ordinal_position")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def jsonl_replace_round_trip(t):
    """A second writing takes the place of the first."""
    path = S.shared_folder(t.spark) + "/orders"
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    S.replace_atomically(rows, path)
    S.replace_atomically(rows.filter("o_orderkey % 2 = 0"), path)
    return S.read_jsonl(t.spark, path, "o_orderkey long, o_custkey long, o_orderstatus string")


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_parts_round_trip(t):
    path = S.shared_folder(t.spark) + "/parts"
    S.write_csv_parts(t.part.select("p_partkey", "p_name", "p_size", "p_retailprice"), path, 70)
    return S.read_csv_parts(t.spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def parquet_facts_round_trip(t):
    place = S.shared_folder(t.spark)
    S.write_parquet({"customers": t.customer.select("c_custkey", "c_name", "c_acctbal")}, place)
    return t.spark.read.parquet(f"{place}/customers")


@query("SELECT CAST(o_custkey % 10 AS INTEGER) AS task_id, o_orderkey, CASE WHEN o_custkey % 10 IN (3, 6) THEN 'new' ELSE o_orderstatus END AS v FROM orders")
def bundle_publish(t):
    """Publishing some tasks again replaces their rows and leaves the others'."""
    place = S.shared_folder(t.spark)
    rows = t.orders.select((F.col("o_custkey") % 10).cast("int").alias("task_id"), "o_orderkey", F.col("o_orderstatus").alias("v"))
    checks = lambda df: {"no_key": df.filter("o_orderkey is null")}
    S.publish_bundle({"f": rows}, place, checks(rows))
    again = rows.filter("task_id in (3, 6)").withColumn("v", F.lit("new"))
    S.publish_bundle({"f": again}, place, checks(again))
    return t.spark.read.parquet(f"{place}/f").select("task_id", "o_orderkey", "v")


@query("SELECT DISTINCT CAST(o_custkey % 10 AS INTEGER) AS task_id FROM orders")
def task_index(t):
    place = S.shared_folder(t.spark)
    rows = t.orders.select((F.col("o_custkey") % 10).cast("int").alias("task_id"), "o_orderkey")
    S.publish_bundle({"f": rows}, place, {})
    return S.task_index(t.spark, place, "f")


@query("SELECT 'SELECT ' || n_nationkey || ' AS k FROM nation' || chr(10) AS text, sha256('SELECT ' || n_nationkey || ' AS k FROM nation' || chr(10)) AS sha256 FROM nation")
def sql_text_scan(t):
    place = S.shared_folder(t.spark)
    texts = t.nation.select(F.concat(F.lit("SELECT "), F.col("n_nationkey").cast("string"), F.lit(" AS k FROM nation")).alias("text"), "n_nationkey")
    texts.repartition(5).write.partitionBy("n_nationkey").text(f"{place}/sql")  # a file per statement
    return S.read_sql_texts(t.spark, f"{place}/sql/*/*.txt").select("text", "sha256")


@query(values("name, value", ("top_k", "5"), ("taxonomy.duty", "big,small"), ("weights.name", "0.25")))
def config_scan(t):
    found = S.load_config("top_k: 5\ntaxonomy:\n  duty: [big, small]\nweights: {name: 0.25}\n")
    rows = [(k, str(v)) for k, v in found.items() if not isinstance(v, dict)]
    rows += [(f"{k}.{n}", ",".join(v) if isinstance(v, list) else str(v)) for k, inner in found.items() if isinstance(inner, dict) for n, v in inner.items()]
    return t.spark.createDataFrame(rows, "name string, value string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_shorthand(t):
    return t.spark.sql("TABLE {nation}", nation=t.nation)


@query("SELECT n_nationkey, n_nationkey + 7 AS k FROM nation WHERE n_regionkey = 2")
def session_variable(t):
    t.spark.sql("DECLARE OR REPLACE VARIABLE metaspan_region INT DEFAULT 1")
    t.spark.sql("SET VARIABLE metaspan_region = metaspan_region + 1")
    return t.spark.sql("SELECT n_nationkey, n_nationkey + 7 AS k FROM {nation} WHERE n_regionkey = session.metaspan_region", nation=t.nation)


@query("SELECT p_partkey, CAST(i - 1 AS INTEGER) AS place, string_split(p_name, ' ')[i] AS word FROM part, generate_series(1, 2) g(i)")
def udtf_call(t):
    X.register(t.spark)
    return t.spark.sql("SELECT p_partkey, w.place, w.word FROM {part}, LATERAL split_words(p_name) w", part=t.part)


@query("SELECT o_orderkey, greatest(CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS DOUBLE), o_totalprice / 100) AS g FROM orders")
def registered_udf(t):
    X.register(t.spark)
    return t.spark.sql("SELECT o_orderkey, greater_of(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END, o_totalprice / 100) AS g FROM {orders}", orders=t.orders)


@query(f"WITH {_EDGES} SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src IN ('s1', 's3') AND b.dst LIKE 'o%'")
def graph_table(t):
    return X.match_path(graph_edges(t), 2, "n0 in ('s1', 's3')", "n2 like 'o%'")


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey + 1000000, upper(p_name) FROM part WHERE p_size > 45")
def pipe_sinks(t):
    """EXPORT DATA, then INSERT into what was written, with the columns in another order."""
    path = S.shared_folder(t.spark) + "/out"
    S.export(t.part.filter("p_size > 10").select("p_partkey", "p_name"), path)
    return S.append(t.part.filter("p_size > 45").select(F.upper("p_name").alias("p_name"), (F.col("p_partkey") + 1000000).alias("p_partkey")), path)


@query("WITH b AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, n FROM customer JOIN b ON c_custkey = o_custkey WHERE n > 12")
def pipe_with(t):
    """|> WITH binds a name for the stages that follow."""
    bound = {"b": t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))}
    return t.customer.join(bound["b"], F.col("c_custkey") == F.col("o_custkey")).filter("n > 12").select("c_custkey", "n")


class _Refs:
    def relation(self, call: str) -> str | None:
        return {"ref('orders')": "orders", "source('raw', 'customer')": "customer"}.get(call)


@query(values("output, origin_table, origin_column", ("seg", "customer", "c_mktsegment"), ("o_totalprice", "orders", "o_totalprice")))
def templated_sources(t):
    text = "SELECT c.c_mktsegment AS seg, o_totalprice FROM {{ ref('orders') }} JOIN {{ source('raw', 'customer') }} c ON o_custkey = c_custkey WHERE o_custkey = {{ var('y') }}"
    found = A.analyse(t.spark, X.render(text, _Refs()), {"orders": ["o_custkey", "o_totalprice"], "customer": ["c_custkey", "c_mktsegment"]})
    return t.spark.createDataFrame([(c.name, a, b) for c in found.outputs for a, b in sorted(c.origins)], "output string, origin_table string, origin_column string")


@query(values("text", ("SELECT a FROM t WHERE x",), ("SELECT a FROM t",), ("SELECT b, c FROM t WHERE x",), ("SELECT b, c FROM t",), ("SELECT b FROM t WHERE x",), ("SELECT b FROM t",)))
def template_variants(t):
    text = "SELECT {% if p %}a{% else %}b{% if q %}, c{% endif %}{% endif %} FROM t{% if r %} WHERE x{% endif %}"
    return t.spark.createDataFrame([(x,) for x in X.variants(text)], "text string")


@query("SELECT 'p_' || c AS view_column, t AS type FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) v(c, t)")
def catalog_provider(t):
    t.nation.selectExpr(*[f"{c} as p_{c}" for c in t.nation.columns]).createOrReplaceTempView("metaspan_provider_view")
    found = X.SparkCatalog(t.spark).facts()["columns"].filter("asset_id like '%metaspan_provider_view'")
    return found.select(F.col("column_name").alias("view_column"), F.col("data_type").alias("type"))
