"""Queries for the relational operators: sources, expressions, joins, aggregates, windows, set operations and pipes.

Each entry pairs a Spark query with the SQL that an independent engine runs on the same tables. Doubles are rounded, and
sums of doubles are taken over decimals, so that the order of rows does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaspan.operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(oracle: str | None, name: str | None = None):
    """Register a query over Tables, with its SQL."""

    def wrap(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[key] = oracle
        return f

    return wrap


def sql(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """Register a query written in Spark SQL; without oracle the same text serves both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in spark_sql}
        return spark.sql(spark_sql, **frames)

    QUERIES[name] = run
    text = oracle or spark_sql
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    ORACLES[name] = text


dec = lambda c: F.col(c).cast("decimal(18,4)")
total = lambda c: F.sum(dec(c)).cast("double")

# ---- flagship
sql("seg_revenue", "SELECT c_mktsegment, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE), 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment")

# ---- sources
sql("scan_table", "SELECT * FROM {nation}")
sql("inline_values", "SELECT a, CAST(b AS DOUBLE) AS b FROM VALUES (1, 2), (7, 77.7) AS v(a, b)", "SELECT a, CAST(b AS DOUBLE) AS b FROM (VALUES (1, 2), (7, 77.7)) AS v(a, b)")
sql("subquery_source", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM {customer} GROUP BY c_mktsegment) s WHERE n > 10")
sql("cte_chain", "WITH a(k, v) AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 1000), b AS (SELECT k, count(*) AS n FROM a GROUP BY k) SELECT n, count(*) AS customers FROM b GROUP BY n")
sql("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
sql("lateral_view_explode", "SELECT p_partkey, w FROM {part} LATERAL VIEW explode(split(p_name, ' ')) v AS w", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
sql("posexplode", "SELECT p_partkey, pos, w FROM {part} LATERAL VIEW posexplode(split(p_type, ' ')) v AS pos, w", "SELECT p_partkey, CAST(unnest(generate_series(0, len(string_split(p_type, ' ')) - 1)) AS INTEGER) AS pos, unnest(string_split(p_type, ' ')) AS w FROM part")
sql("json_table", "SELECT event_id, j.k FROM (SELECT event_id, from_json(props, 'k BIGINT') AS j FROM {events})", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 = 3")
def systematic_sample(t):
    return t.orders.filter(F.col("o_orderkey") % 10 == 3).select("o_orderkey", "o_totalprice")


@query(None)
def tablesample(t):
    return t.orders.sample(0.1, seed=7)


@query("WITH RECURSIVE x AS (SELECT n_nationkey AS key, CAST(NULL AS INTEGER) AS parent FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, CAST((n.n_nationkey - 1) // 2 AS INTEGER) FROM nation n JOIN x ON (n.n_nationkey - 1) // 2 = x.key AND n.n_nationkey > 0), y AS (SELECT key, 1 AS level FROM x WHERE parent IS NULL UNION ALL SELECT x.key, y.level + 1 FROM x JOIN y ON x.parent = y.key) SELECT key, level FROM y")
def connect_by_level(t):
    tree = t.nation.select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") > 0, F.floor((F.col("n_nationkey") - 1) / 2)).cast("int").alias("parent"))
    return R.connect_by(tree, "key", "parent", "parent is null").select("key", "level")


# ---- projections and expressions
@query("SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
def star_except(t):
    return t.customer.drop("c_name", "c_acctbal")


@query("SELECT * REPLACE (upper(n_name) AS n_name) FROM nation")
def star_replace(t):
    return R.star_replace(t.nation, n_name=F.upper("n_name"))


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def star_rename(t):
    return R.star_rename(t.nation, n_nationkey="id", n_name="name")


@query("SELECT p_partkey, p_retailprice FROM part")
def star_ilike(t):
    return R.star_ilike(t.part, "P_%P%R%").select("p_partkey", "p_retailprice")


sql("typed_literals", "SELECT r_regionkey, 42 AS i, 2.5 AS d, 'x' AS s, true AS b, DATE '2020-02-29' AS day FROM {region}")
QUERIES["parameters"] = lambda spark, d: spark.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > :low AND o_orderpriority = :p", args={"low": 1000.0, "p": "1-URGENT"}, orders=spark.read.parquet(f"{d}/orders.parquet"))
ORACLES["parameters"] = "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000.0 AND o_orderpriority = '1-URGENT'"
sql("arithmetic", "SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS a, l_linenumber * 3 AS m, l_orderkey % 7 AS r, l_orderkey div 7 AS q, l_linenumber / 4 AS f, -l_linenumber AS neg FROM {lineitem}", "SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS a, l_linenumber * 3 AS m, l_orderkey % 7 AS r, l_orderkey // 7 AS q, l_linenumber / 4 AS f, -l_linenumber AS neg FROM lineitem")
sql("integer_division_mode", "SELECT o_orderkey, o_custkey div 10 AS q FROM {orders}", "SELECT o_orderkey, o_custkey // 10 AS q FROM orders")
sql("string_concat", "SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM {customer}")
sql("null_safe_equal", "SELECT a, b, a <=> b AS same FROM VALUES (1, 1), (1, 2), (NULL, 1), (NULL, NULL) AS v(a, b)", "SELECT a, b, a IS NOT DISTINCT FROM b AS same FROM (VALUES (1, 1), (1, 2), (NULL, 1), (NULL, NULL)) AS v(a, b)")
sql("is_distinct_from", "SELECT n_nationkey FROM {nation} WHERE n_regionkey IS DISTINCT FROM 2")
sql("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 3000 THEN 'high' WHEN o_totalprice > 1000 THEN 'mid' ELSE 'low' END AS band FROM {orders}")
sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM {orders}")
sql("casts", "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12,1)) AS d, p_size::string AS s, try_cast(p_name AS INT) AS i FROM {part}", "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(12,1)) AS d, p_size::varchar AS s, try_cast(p_name AS INT) AS i FROM part")
sql("scalar_subquery", "SELECT c_custkey FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer})")
sql("correlated_scalar_subquery", "SELECT n_name, (SELECT count(*) FROM {customer} c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM {nation} n")
sql("exists_semi", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 3000)")
sql("not_exists_anti", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
sql("predicate_is_null", "SELECT count(*) AS n FROM {events} WHERE user_id IS NOT NULL AND (value > 0) IS TRUE")
sql("predicate_in_list", "SELECT p_partkey FROM {part} WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
sql("predicate_in_subquery", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')")
sql("predicate_between", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08")
sql("predicate_like", "SELECT p_partkey, p_type FROM {part} WHERE p_type LIKE '%A%' OR p_name ILIKE '%RED%'")
sql("predicate_rlike", "SELECT p_partkey FROM {part} WHERE p_brand RLIKE '#[1-3][24]$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[1-3][24]$')")
sql("like_any_all", "SELECT p_partkey FROM {part} WHERE p_name LIKE ANY ('%a%', '%b%') AND p_name LIKE ALL ('%e%', '%r%')", "SELECT p_partkey FROM part WHERE (p_name LIKE '%a%' OR p_name LIKE '%b%') AND p_name LIKE '%e%' AND p_name LIKE '%r%'")
sql("quantified_any", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)", "SELECT s_suppkey FROM supplier WHERE s_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("lambda_transform", "SELECT p_partkey, transform(split(p_type, ' '), x -> length(x)) AS lens, filter(split(p_type, ' '), x -> length(x) > 4) AS long FROM {part}", "SELECT p_partkey, list_transform(string_split(p_type, ' '), lambda x: CAST(length(x) AS INTEGER)) AS lens, list_filter(string_split(p_type, ' '), lambda x: length(x) > 4) AS long FROM part")
sql("higher_order_reduce", "SELECT p_partkey, aggregate(transform(split(p_name, ' '), x -> length(x)), 0, (a, x) -> a + x) AS chars FROM {part}", "SELECT p_partkey, CAST(list_sum(list_transform(string_split(p_name, ' '), lambda x: length(x))) AS INTEGER) AS chars FROM part")
sql("subscript", "SELECT p_partkey, split(p_type, ' ')[0] AS first, map('a', p_size)['a'] AS size FROM {part}", "SELECT p_partkey, string_split(p_type, ' ')[1] AS first, p_size AS size FROM part")


@query("SELECT vec_id, len(embedding[3:9:2]) AS n, embedding[3:9:2][2] AS second FROM embeddings")
def list_slice_step(t):
    s = R.slice_list(F.col("embedding"), 3, 9, 2)
    return t.embeddings.select("vec_id", F.size(s).cast("long").alias("n"), F.element_at(s, 2).alias("second"))


sql("struct_navigation", "SELECT s.a.b AS b, s.c AS c FROM (SELECT named_struct('a', named_struct('b', n_name), 'c', n_regionkey) AS s FROM {nation})", "SELECT s.a.b AS b, s.c AS c FROM (SELECT {'a': {'b': n_name}, 'c': n_regionkey} AS s FROM nation)")
sql("expression_with", "SELECT o_orderkey, x * x AS sq FROM (SELECT o_orderkey, o_orderkey % 100 AS x FROM {orders})")
sql("where_pushdown", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice < 500")
sql("having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15")
sql("select_distinct", "SELECT DISTINCT p_brand, p_size FROM {part}")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def qualify(t):
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return R.qualify(t.orders, {"rn": rn}, "rn = 1").select("o_custkey", "o_orderkey")


# ---- joins
J = "SELECT o_orderkey, c_name FROM {orders} %s JOIN {customer} ON o_custkey = c_custkey AND c_acctbal > 5000"
for kind in ("INNER", "LEFT", "RIGHT", "FULL"):
    sql(f"join_{kind.lower()}", J % kind)
sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
sql("join_comma", "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey")
sql("join_left_semi", "SELECT * FROM {nation} LEFT SEMI JOIN {customer} ON n_nationkey = c_nationkey AND c_acctbal > 9000", "SELECT * FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE n_nationkey = c_nationkey AND c_acctbal > 9000)")
sql("join_left_anti", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
sql("join_natural", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM {nation}) NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM {region})")
sql("join_using", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM {nation}) x LEFT JOIN (SELECT r_regionkey AS k, r_name AS b FROM {region} WHERE r_regionkey < 3) y USING (k)")
sql("join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_range", "SELECT r.lo, count(*) AS n FROM {part} JOIN (VALUES (1, 10), (11, 20), (21, 50)) r(lo, hi) ON p_size BETWEEN r.lo AND r.hi GROUP BY r.lo", "SELECT r.lo, count(*) AS n FROM part JOIN (VALUES (1, 10), (11, 20), (21, 50)) r(lo, hi) ON p_size BETWEEN r.lo AND r.hi GROUP BY r.lo")
sql("join_lateral", "SELECT n_name, top FROM {nation}, LATERAL (SELECT max(c_acctbal) AS top FROM {customer} WHERE c_nationkey = n_nationkey)")


@query("SELECT a.event_id, b.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def join_asof(t):
    clicks = t.events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = t.events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"))
    return R.asof_join(clicks, buys, "ts", "ts", ["user_id"], ["purchase_id"]).select("event_id", "purchase_id")


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_extendedprice, a.l_shipdate, b.o_orderkey, b.o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS i FROM lineitem) a FULL JOIN (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders) b USING (i)")
def join_positional(t):
    out = R.positional_join(t.lineitem, t.orders, ["l_shipdate", "l_orderkey", "l_linenumber"], ["o_totalprice", "o_orderkey"])
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", "o_orderkey", "o_totalprice")


sql("join_apply", "SELECT n_name, o.c_custkey FROM {nation} LEFT JOIN LATERAL (SELECT min(c_custkey) AS c_custkey FROM {customer} WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) o ON true", "SELECT n_name, o.c_custkey FROM nation LEFT JOIN LATERAL (SELECT min(c_custkey) AS c_custkey FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) o ON true")
sql("join_chain", "SELECT r_name, count(*) AS n FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name")


@query("SELECT 'missing' AS side, o_custkey AS key FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'unexpected', c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def key_set_difference(t):
    have, want = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("key")), t.orders.select(F.col("o_custkey").alias("key")).distinct()
    side = lambda df, s: df.select(F.lit(s).alias("side"), "key")
    return side(want.join(have, "key", "left_anti"), "missing").unionByName(side(have.join(want, "key", "left_anti"), "unexpected"))


# ---- aggregation
PRICE = "round(CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE), 2)"
sql("group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE), 2) AS price, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
sql("global_aggregate", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, max(o_totalprice) AS top FROM {orders}")
for kind in ("ROLLUP", "CUBE"):
    sql(f"group_{kind.lower()}", f"SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n FROM {{lineitem}} GROUP BY {kind} (l_returnflag, l_linestatus)")
sql("grouping_sets", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS g, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql("group_by_all", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY ALL")
sql("distinct_aggregate", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, sum(DISTINCT l_linenumber) AS d FROM {lineitem} GROUP BY l_returnflag")
sql("aggregate_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) AS n FROM {orders} GROUP BY o_orderpriority")
sql("within_group_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("percentile_disc", "SELECT o_orderpriority, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS med FROM {orders} GROUP BY o_orderpriority", "SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS med FROM orders GROUP BY o_orderpriority")
sql("percentile_cont", "SELECT o_orderpriority, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q FROM {orders} GROUP BY o_orderpriority", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q FROM orders GROUP BY o_orderpriority")
sql("sum_widening", "SELECT sum(l_linenumber) AS s, avg(l_linenumber) AS a FROM {lineitem}", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_linenumber) AS a FROM lineitem")
sql("statistics", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_linenumber), 6) AS c FROM {lineitem} GROUP BY l_returnflag")
sql("min_max_by", "SELECT c_nationkey, max_by(c_custkey, struct(c_acctbal, c_custkey)) AS top FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, arg_max(c_custkey, {'a': c_acctbal, 'b': c_custkey}) AS top FROM customer GROUP BY c_nationkey")
sql("collect_sorted", "SELECT n_regionkey, sort_array(collect_list(n_name)) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY n_regionkey")
sql("bool_aggregates", "SELECT o_orderpriority, bool_and(o_totalprice > 100) AS every_, bool_or(o_totalprice > 4000) AS some_ FROM {orders} GROUP BY o_orderpriority")
sql("bit_aggregates", "SELECT l_returnflag, bit_or(l_linenumber) AS o, bit_xor(l_orderkey) AS x FROM {lineitem} GROUP BY l_returnflag")
sql("regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, regr_count(l_extendedprice, l_quantity) AS n FROM {lineitem} GROUP BY l_returnflag")


# sketches estimate: each row has the true number, and whether the estimate is within the sketch's error of it
_COUNTS = "SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS exact, true AS within FROM lineitem GROUP BY 1, 2"


def _within(estimate, exact, error: float):
    return (F.abs(estimate - exact) <= F.greatest(F.lit(1.0), error * exact)).alias("within")


@query(_COUNTS)
def approx_count_distinct(t):
    out = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("exact"))
    return out.select("l_returnflag", "l_linestatus", "exact", _within(F.col("a"), F.col("exact"), 0.08))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS within FROM lineitem GROUP BY 1")
def hll_sketch_merge(t):
    parts = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.hll_sketch_agg("l_partkey", 14).alias("s"))
    merged = parts.groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("a"))
    exact = t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    return merged.join(exact, "l_returnflag").select("l_returnflag", "exact", _within(F.col("a"), F.col("exact"), 0.05))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS within FROM lineitem GROUP BY 1")
def theta_sketch_merge(t):
    parts = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.theta_sketch_agg("l_partkey", 14).alias("s"))
    merged = parts.groupBy("l_returnflag").agg(F.theta_sketch_estimate(F.theta_union_agg("s")).alias("a"))
    exact = t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    return merged.join(exact, "l_returnflag").select("l_returnflag", "exact", _within(F.col("a"), F.col("exact"), 0.05))


@query("SELECT l_returnflag, count(*) AS n, true AS within FROM lineitem GROUP BY 1")
def approx_percentile(t):
    """The median's estimate holds half of the rows, give or take the accuracy."""
    mid = t.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("m"))
    rows = t.lineitem.join(F.broadcast(mid), "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_extendedprice") <= F.col("m")).alias("k"))
    return rows.select("l_returnflag", "n", (F.abs(F.col("k") / F.col("n") - 0.5) <= 0.01).alias("within"))


@query("SELECT l_returnflag, l_suppkey, count(*) AS exact, true AS within FROM lineitem WHERE l_suppkey < 5 GROUP BY 1, 2")
def count_min(t):
    """A count-min sketch never counts too few, and at most 1 percent of all rows too many."""
    from metaspan.operators.relational import count_min_estimate

    s = t.lineitem.groupBy("l_returnflag").agg(F.count_min_sketch("l_suppkey", F.lit(0.01), F.lit(0.99), F.lit(7)).alias("s"), F.count("*").alias("all"))
    exact = t.lineitem.filter("l_suppkey < 5").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("exact"))
    out = exact.join(s, "l_returnflag").withColumn("a", count_min_estimate(F.col("s"), F.col("l_suppkey")))
    return out.select("l_returnflag", "l_suppkey", "exact", ((F.col("a") >= F.col("exact")) & (F.col("a") <= F.col("exact") + 0.01 * F.col("all"))).alias("within"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def pivot_static(t):
    out = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.select("o_orderpriority", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in "FOP"])


@query("SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building FROM customer GROUP BY c_nationkey")
def pivot_dynamic(t):
    out = t.customer.groupBy("c_nationkey").pivot("c_mktsegment").count()
    return out.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"))


@query("SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot(t):
    return t.part.withColumn("p_size", F.col("p_size").cast("double")).unpivot(["p_partkey"], ["p_size", "p_retailprice"], "name", "value")


# ---- windows
W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
for name, call in {
    "row_number": "row_number()", "rank": "rank()", "dense_rank": "dense_rank()", "ntile": "ntile(3)", "lag": "lag(o_orderkey, 1)", "lead": "lead(o_orderkey, 2)",
    "first_value": "first_value(o_orderkey)", "nth_value": "nth_value(o_orderkey, 2)",
}.items():
    sql(f"window_{name}", f"SELECT o_orderkey, CAST({call} OVER ({W}) AS BIGINT) AS v FROM {{orders}}")
for name in ("percent_rank", "cume_dist"):
    sql(f"window_{name}", f"SELECT o_orderkey, round({name}() OVER ({W}), 9) AS v FROM {{orders}}")
sql("window_running_rows", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS v FROM {{orders}}")
sql("window_last_value_frame", f"SELECT o_orderkey, last_value(o_orderkey) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM {{orders}}")
sql("window_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM {events}")
sql("window_named", "SELECT c_custkey, rank() OVER w AS r, count(*) OVER w AS n FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)")
sql("window_aggregate", "SELECT s_suppkey, s_acctbal = max(s_acctbal) OVER (PARTITION BY s_nationkey) AS top FROM {supplier}")


@query("SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS share FROM customer")
def ratio_to_report(t):
    return t.customer.select("c_custkey", F.round(F.col("c_acctbal") / F.sum("c_acctbal").over(Window.partitionBy("c_nationkey")), 6).alias("share"))


@query("SELECT event_id, CAST(sum(CASE WHEN event_type <> p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS change, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS bought FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def conditional_events(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    # the change flag first: a window function cannot hold another
    flagged = t.events.withColumn("c", F.when(F.col("event_type") != F.lag("event_type").over(w), 1).otherwise(0))
    return flagged.select("event_id", F.sum("c").over(w).alias("change"), R.true_event(F.col("event_type") == "purchase", w).alias("bought"))


@query("SELECT user_id, count(*) AS runs, CAST(max(n) AS INTEGER) AS longest FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts, event_id) AS g FROM events) WHERE event_type = 'click' GROUP BY user_id, g HAVING count(*) >= 2) GROUP BY user_id")
def match_recognize(t):
    hits = R.match_recognize(t.events, ["user_id"], ["ts", "event_id"], {"C": F.col("event_type") == "click"}, "C{2,}")
    return hits.groupBy("user_id").agg(F.count("*").alias("runs"), F.max("match_rows").alias("longest"))


# ---- sort, limit, sets
sql("order_limit", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
sql("order_offset", "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 10 OFFSET 5")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 1 OFFSET 9)")
def top_with_ties(t):
    return R.top_with_ties(t.part, 10, "-p_size").select("p_partkey", "p_size")


@query("SELECT * EXCLUDE (i, n) FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS i, count(*) OVER () AS n FROM lineitem) WHERE i <= ceil(n * 0.9)")
def top_percent(t):
    return R.top_percent(t.lineitem, 90, "l_extendedprice", "l_orderkey", "l_linenumber")


sql("top_k_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM {customer}) WHERE k <= 3")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def distribute_sort_by(t):
    return t.orders.repartition("o_custkey").sortWithinPartitions("o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


A, B = "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 0", "SELECT s_nationkey AS k FROM {supplier}"
for name, op in {"union_all": "UNION ALL", "union": "UNION", "intersect": "INTERSECT", "intersect_all": "INTERSECT ALL", "except": "EXCEPT", "except_all": "EXCEPT ALL"}.items():
    sql(f"set_{name}", f"{A} {op} {B}")


@query("SELECT n_nationkey AS k, n_name AS a FROM nation UNION ALL BY NAME SELECT r_name AS b, r_regionkey AS k FROM region")
def union_by_name(t):
    return R.union_by_name(t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a")), t.region.select(F.col("r_name").alias("b"), F.col("r_regionkey").alias("k")))


# ---- pipes
PIPE = "FROM {orders} |> WHERE o_totalprice > 500 |> EXTEND o_totalprice * 2 AS twice |> SET twice = twice + 1 |> DROP o_orderdate |> AS q |> AGGREGATE count(*) AS n, max(twice) AS top GROUP BY o_orderpriority |> WHERE n > 1 |> ORDER BY o_orderpriority |> LIMIT 4"
sql("pipe_stages", PIPE, "SELECT o_orderpriority, count(*) AS n, max(o_totalprice * 2 + 1) AS top FROM orders WHERE o_totalprice > 500 GROUP BY o_orderpriority HAVING count(*) > 1 ORDER BY o_orderpriority LIMIT 4")
sql("pipe_join_setop", "FROM {nation} |> JOIN {region} ON n_regionkey = r_regionkey |> SELECT r_name AS name |> UNION ALL (SELECT c_mktsegment FROM {customer})", "SELECT r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_mktsegment FROM customer")
sql("pipe_pivot", "FROM {orders} |> SELECT o_orderpriority, o_orderstatus, 1 AS one |> PIVOT (count(one) FOR o_orderstatus IN ('F' AS f, 'O' AS o)) |> SELECT o_orderpriority, coalesce(f, 0) AS f, coalesce(o, 0) AS o", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_orderpriority")
sql("pipe_unpivot", "FROM {supplier} |> SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS a, s_acctbal AS b |> UNPIVOT (v FOR n IN (a, b))", "SELECT s_suppkey, 'a' AS n, CAST(s_nationkey AS DOUBLE) AS v FROM supplier UNION ALL SELECT s_suppkey, 'b', s_acctbal FROM supplier")


@query("SELECT DISTINCT c_mktsegment AS segment FROM customer")
def pipe_rename_distinct(t):
    return t.customer.withColumnsRenamed({"c_mktsegment": "segment"}).select("segment").distinct()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 0")
def pipe_assert(t):
    return R.assert_rows(t.orders, F.col("o_orderkey").isNotNull(), "an order without key").filter("o_totalprice >= 0").select("o_orderkey")


@query("SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey UNION ALL SELECT n_nationkey, 1 FROM nation WHERE n_nationkey < 3")
def pipe_fork_tee(t):
    out = R.fork(t.nation, counts=lambda d: d.groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n")), heads=lambda d: d.filter("n_nationkey < 3").select(F.col("n_nationkey").alias("k"), F.lit(1).cast("long").alias("n")))
    return out["counts"].unionByName(out["heads"])


@query("SELECT * FROM (VALUES (0, 'r_regionkey', 'int'), (1, 'r_name', 'string')) AS v(ordinal, name, type)")
def pipe_static_describe(t):
    return R.static_describe(t.region).select("ordinal", "name", "type")


@query("SELECT count(*) AS n FROM region WHERE r_regionkey < 2")
def pipe_if(t):
    return R.pipe_if(t.region, True, lambda d: d.filter("r_regionkey < 2")).agg(F.count("*").alias("n"))


@query("WITH RECURSIVE w(k, d) AS (SELECT 1, 0 UNION ALL SELECT k * 2, d + 1 FROM w WHERE k < 500) SELECT k, d FROM w")
def pipe_recursive_union(t):
    start = t.spark.createDataFrame([(1, 0)], "k int, d int")
    return R.recursive_union(start, lambda w: w.filter("k < 500").select((F.col("k") * 2).alias("k"), (F.col("d") + 1).alias("d")))


# ---- streaming windows in batch (an extension)
sql("tumbling_window", "SELECT date_trunc('HOUR', window(CAST(ts AS TIMESTAMP), '1 hour').start)::timestamp_ntz AS start, event_type, count(*) AS n FROM {events} GROUP BY 1, 2", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
sql("sliding_window", "SELECT CAST(w.start AS TIMESTAMP_NTZ) AS start, count(*) AS n FROM (SELECT window(CAST(ts AS TIMESTAMP), '1 hour', '30 minutes') AS w FROM {events}) GROUP BY w.start", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY s")
sql("session_window", "SELECT user_id, count(*) AS n FROM (SELECT user_id, session_window(CAST(ts AS TIMESTAMP), '1 hour') AS w FROM {events} GROUP BY user_id, session_window(CAST(ts AS TIMESTAMP), '1 hour')) GROUP BY user_id", "SELECT user_id, count(*) AS n FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL '1 hour' GROUP BY user_id")
