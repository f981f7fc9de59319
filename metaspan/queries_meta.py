"""Queries for the metadata and graph operators, pointed at the rows of the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metaspan.operators import graph as G
from metaspan.operators import meta as M
from metaspan.queries_relational import QUERIES as _RELATIONAL
from metaspan.queries_relational import Tables, sql as _sql
from metaspan.queries_relational import ORACLES as _REL_ORACLES
from metaspan.sources import facts as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
#: Declared keys of the star schema: (table, kind, columns, referenced table).
KEYS = [
    ("region", "PRIMARY_KEY", ["r_regionkey"], None), ("nation", "PRIMARY_KEY", ["n_nationkey"], None), ("nation", "FOREIGN_KEY", ["n_regionkey"], "region"),
    ("customer", "PRIMARY_KEY", ["c_custkey"], None), ("customer", "FOREIGN_KEY", ["c_nationkey"], "nation"), ("supplier", "PRIMARY_KEY", ["s_suppkey"], None),
    ("supplier", "FOREIGN_KEY", ["s_nationkey"], "nation"), ("part", "UNIQUE_KEY", ["p_partkey"], None), ("orders", "PRIMARY_KEY", ["o_orderkey"], None),
    ("orders", "FOREIGN_KEY", ["o_custkey"], "customer"), ("lineitem", "PRIMARY_KEY", ["l_orderkey", "l_linenumber"], None),
    ("lineitem", "FOREIGN_KEY", ["l_orderkey"], "orders"), ("lineitem", "FOREIGN_KEY", ["l_partkey"], "part"), ("lineitem", "FOREIGN_KEY", ["l_suppkey"], "supplier"),
]


def query(oracle: str | None):
    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return wrap


def sql(name: str, spark_sql: str, oracle: str | None = None) -> None:
    _sql(name, spark_sql, oracle)
    QUERIES[name], ORACLES[name] = _RELATIONAL.pop(name), _REL_ORACLES.pop(name)


def catalog(t: Tables):
    asset = lambda n: f"local:main:TABLE:{n}"
    objects, columns = S.catalog_facts(t.spark, t.sf_dir, STAR)
    rows = [(asset(n), f"{n}_{i}", f"{n}_{i}", kind, [f"{asset(n)}:COLUMN:{c}" for c in cols], asset(ref) if ref else None, "ENABLED", None, "OK") for i, (n, kind, cols, ref) in enumerate(KEYS)]
    constraints = t.spark.createDataFrame(rows, S.SCHEMAS["constraints"])
    depends = [(asset(n), asset(ref), "FOREIGN_KEY", False) for n, _, _, ref in KEYS if ref]
    return objects, columns, constraints, t.spark.createDataFrame(depends, S.SCHEMAS["dependencies"])


_COLS = "(SELECT table_name AS t, column_name AS c, ordinal_position AS o, CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS ty FROM information_schema.columns WHERE table_name IN ('region','nation','customer','supplier','part','orders','lineitem'))"
_KEYS = "(VALUES " + ", ".join(f"('{n}', '{k}', {len(c)}, {repr(r) if r else 'NULL'})" for n, k, c, r in KEYS) + ") AS k(t, kind, n, ref)"


@query(f"SELECT 'local:main:TABLE:' || t AS asset_id, c AS column_name, CAST(o AS INTEGER) AS ordinal_position, ty AS data_type FROM {_COLS}")
def catalog_columns(t):
    return catalog(t)[1].select("asset_id", "column_name", "ordinal_position", "data_type")


@query(f"SELECT 'local:main:TABLE:' || x.t AS asset_id, x.t AS object_name, x.n AS n_columns, 0 AS n_commented, coalesce(k.n, 0) AS n_constraints, coalesce(k.f, 0) AS n_foreign, coalesce(k.f, 0) AS n_out FROM (SELECT t, count(*) AS n FROM {_COLS} GROUP BY t) x LEFT JOIN (SELECT t, count(*) AS n, count(*) FILTER (WHERE kind = 'FOREIGN_KEY') AS f FROM {_KEYS} GROUP BY t) k USING (t)")
def object_profile(t):
    return M.object_profile(*catalog(t))


@query(f"SELECT 'local:main:TABLE:' || t AS asset_id, substr(sha256(string_agg(c || ':' || ty || ':True', '|' ORDER BY o)), 1, 16) AS fingerprint FROM {_COLS} GROUP BY t")
def structure_fingerprint(t):
    return M.structure_fingerprint(catalog(t)[1])


@query("SELECT p_partkey, regexp_extract_all(upper(p_brand || '-' || p_type), '[A-Z0-9]+') AS tokens FROM part")
def name_tokens(t):
    return t.part.select("p_partkey", M.name_tokens(F.concat_ws("-", "p_brand", "p_type")).alias("tokens"))




@query("WITH d AS (SELECT DISTINCT l_suppkey, o_custkey, s_nationkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), s AS (SELECT s_nationkey, c_nationkey, count(DISTINCT l_suppkey) AS sources, count(DISTINCT o_custkey) AS targets, count(*) AS n FROM d GROUP BY s_nationkey, c_nationkey), k AS (SELECT s_nationkey, c_nationkey, l_suppkey, row_number() OVER (PARTITION BY s_nationkey, c_nationkey ORDER BY m DESC, l_suppkey) AS r FROM (SELECT s_nationkey, c_nationkey, l_suppkey, count(*) AS m FROM d GROUP BY 1, 2, 3)), f AS (SELECT s_nationkey, c_nationkey, list_sort(list(l_suppkey)) AS top FROM k JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey WHERE r <= 10 GROUP BY 1, 2) SELECT s.*, coalesce(f.top, []) AS top FROM s LEFT JOIN f USING (s_nationkey, c_nationkey)")
def dependency_summary(t):
    deps = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    deps = deps.select("l_suppkey", "o_custkey", "s_nationkey", "c_nationkey").distinct()
    key = ["s_nationkey", "c_nationkey"]
    sums = deps.groupBy(*key).agg(F.count_distinct("l_suppkey").alias("sources"), F.count_distinct("o_custkey").alias("targets"), F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy(F.desc("count"), "l_suppkey")
    top = deps.groupBy(*key, "l_suppkey").count().withColumn("r", F.row_number().over(w)).filter("r <= 10")  # ten first, then the known ones
    known = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    top = top.join(known, "l_suppkey").groupBy(*key).agg(F.array_sort(F.collect_list("l_suppkey")).alias("top"))
    return sums.join(top, key, "left").withColumn("top", F.coalesce("top", F.array().cast("array<bigint>")))




@query("WITH f AS (SELECT t, list(DISTINCT c) AS cs FROM (SELECT t, unnest(string_split(c, '_')) AS c FROM " + _COLS + ") GROUP BY t) SELECT a.t AS a, b.t AS b, round(0.25 * 0 + 0.5 * len(list_intersect(a.cs, b.cs)) / len(list_distinct(list_concat(a.cs, b.cs))) + 0.2 * 1.0 + 0.05 * 1.0, 9) AS score FROM f a JOIN f b ON a.t < b.t")
def structural_similarity(t):
    columns = catalog(t)[1].withColumn("asset", F.element_at(F.split("asset_id", ":"), -1))
    parts = columns.withColumn("p", F.explode(F.split("column_name", "_"))).groupBy("asset").agg(F.collect_set("p").alias("columns"))
    none = F.array().cast("array<string>")
    return M.structural_similarity(parts.select("asset", F.array("asset").alias("names"), "columns", none.alias("keys"), none.alias("neighbours"))).withColumn("score", F.round("score", 9))


_TOK = "(SELECT DISTINCT p_partkey AS d, unnest(string_split(p_name, ' ')) || '_' || p_size AS w FROM part)"


def part_terms(t, *by):
    return t.part.select(F.col("p_partkey").alias("d"), *by, F.explode(F.split("p_name", " ")).alias("w"), "p_size").select("d", *by, F.concat_ws("_", "w", "p_size").alias("w")).distinct()


@query(f"WITH x AS {_TOK} SELECT DISTINCT a.d AS a, b.d AS b FROM x a JOIN x b ON a.w = b.w AND a.d < b.d")
def blocked_pairs(t):
    classes, members = M.alike(part_terms(t), "d", "w")
    return M.expand_pairs(M.class_signals(classes).select("a", "b"), members, "d")


@query(f"WITH x AS {_TOK}, n AS (SELECT count(DISTINCT d) AS n FROM x) SELECT w, count(*) AS df, round(ln((1 + any_value(n.n)) / (1 + count(*))) + 1, 9) AS idf FROM x, n GROUP BY w")
def inverse_frequency(t):
    return M.inverse_frequency(part_terms(t), "d", "w").withColumn("idf", F.round("idf", 9))


_TFIDF = f"x AS {_TOK}, n AS (SELECT count(DISTINCT d) AS n FROM x), i AS (SELECT w, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 AS idf FROM x, n GROUP BY w), v AS (SELECT d, w, ln(2) * idf AS u FROM x JOIN i USING (w)), z AS (SELECT d, w, u / sqrt(sum(u * u) OVER (PARTITION BY d)) AS u FROM v)"


@query(f"WITH {_TFIDF} SELECT d, w, round(u, 7) AS weight FROM z")
def tfidf_weights(t):
    return M.tfidf(part_terms(t), "d", "w").withColumn("weight", F.round("weight", 7))


_COS = f"{_TFIDF}, c AS (SELECT a.d AS a, b.d AS b, round(sum(a.u * b.u), 7) AS cosine FROM z a JOIN z b ON a.w = b.w AND a.d < b.d GROUP BY a.d, b.d HAVING sum(a.u * b.u) >= 0.3)"


def part_pairs(t, *by):
    """All near classes of parts with equal words (and equal columns `by`), over tokens of any frequency, and the parts of
    each class."""
    classes, members = M.alike(part_terms(t, *by), "d", "w", *by)
    return M.class_cosines(classes, 0.3).withColumn("cosine", F.round("cosine", 7)), classes, members


@query(f"WITH {_COS} SELECT a, b, cosine FROM c")
def cosine_pairs(t):
    pairs, _, members = part_pairs(t)
    return M.expand_pairs(pairs, members, "d")


_TOP = f"{_COS}, u AS (SELECT a, b, cosine FROM c UNION ALL SELECT b, a, cosine FROM c), k AS (SELECT a, b, cosine, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS r FROM u)"


@query(f"WITH {_TOP} SELECT a, b, cosine, CAST(r AS INTEGER) AS rank FROM k WHERE r <= 2")
def primary_and_alternative(t):
    pairs, _, members = part_pairs(t)
    return M.class_neighbours(pairs, members, "d", 2)


@query(f"WITH {_TOP} SELECT x.a, x.b, x.cosine FROM k x JOIN k y ON x.a = y.b AND x.b = y.a WHERE x.r <= 3 AND y.r <= 3 AND x.a < x.b")
def mutual_top_k(t):
    pairs, _, members = part_pairs(t)
    return M.mutual(M.class_neighbours(pairs, members, "d", 3))


@query(None)
def connected_groups(t):
    pairs, _, members = part_pairs(t)
    near = M.cut(pairs.filter("cosine >= 0.6").select("a", "b"))
    found = G.groups(near.filter("a <> b"))
    copies = near.filter("a = b").select(F.col("a").alias("node")).join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    groups = found.select("node", "component").unionByName(copies).withColumnRenamed("node", "c")
    return members.join(groups, "c").select(F.col("d").alias("node"), "component")


@query(None)
def complete_link_clusters(t):
    near, _, members = part_pairs(t)
    brands = t.part.select(F.col("p_partkey").alias("d"), F.col("p_brand").alias("block"))
    return M.class_complete_link(near.withColumnRenamed("cosine", "score"), members, brands, "d", "block", 0.5)


@query(f"WITH {_TFIDF}, p AS (SELECT DISTINCT a.d AS a, b.d AS b FROM x a JOIN x b ON a.w = b.w AND a.d < b.d), l AS (SELECT p.a, p.b, sum(least(za.u, zb.u)) AS lo FROM p JOIN z za ON za.d = p.a JOIN z zb ON zb.d = p.b AND zb.w = za.w GROUP BY p.a, p.b), s AS (SELECT d, sum(u) AS s FROM z GROUP BY d) SELECT p.a, p.b, round(lo / (sa.s + sb.s - lo), 7) AS score FROM p JOIN l USING (a, b) JOIN s sa ON sa.d = p.a JOIN s sb ON sb.d = p.b")
def weighted_jaccard(t):
    classes, members = M.alike(part_terms(t), "d", "w")
    scores = M.weighted_jaccard(M.class_tfidf(classes), M.cut(M.class_signals(classes).select("a", "b")), "c", "term")
    return M.expand_pairs(scores.withColumn("score", F.round("score", 7)), members, "d")


@query("SELECT p_partkey, CASE WHEN p_size > 5 OR p_retailprice > 900 THEN round((coalesce(CASE WHEN p_size > 5 THEN CAST(p_size AS DOUBLE) / 50 END * 0.7::DOUBLE, 0) + coalesce(CASE WHEN p_retailprice > 900 THEN p_retailprice / 2000 END * 0.3::DOUBLE, 0)) / (CASE WHEN p_size > 5 THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN p_retailprice > 900 THEN 0.3::DOUBLE ELSE 0 END), 6) END AS m FROM part")
def available_mean(t):
    parts = {"size": (F.when(F.col("p_size") > 5, F.col("p_size") / 50), 0.7), "price": (F.when(F.col("p_retailprice") > 900, F.col("p_retailprice") / 2000), 0.3)}
    return t.part.select("p_partkey", F.round(M.available_mean(parts), 6).alias("m"))


@query("WITH t(term, label) AS (VALUES ('a', 'A'), ('b', 'B'), ('ed', 'ED')), c AS (SELECT p_partkey, label, max(CASE WHEN contains(lower(p_name), term) THEN 1.0 ELSE 0.8 END) AS score FROM part JOIN t ON contains(lower(p_name), term) OR contains(lower(p_type), term) GROUP BY p_partkey, label) SELECT p_partkey, label, CAST(score AS DOUBLE) AS score FROM c")
def weak_labels(t):
    terms = F.broadcast(t.spark.createDataFrame([("a", "A"), ("b", "B"), ("ed", "ED")], "term string, label string"))  # a fixed taxonomy
    hit = t.part.join(terms, F.lower("p_name").contains(F.col("term")) | F.lower("p_type").contains(F.col("term")))
    return hit.groupBy("p_partkey", "label").agg(F.max(F.when(F.lower("p_name").contains(F.col("term")), 1.0).otherwise(0.8)).alias("score"))


@query("WITH c AS (SELECT o_custkey, o_orderpriority AS label, count(*) / 10.0 AS score FROM orders GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, label) AS r FROM c WHERE score >= 0.3), b AS (SELECT o_custkey, max(score) FILTER (WHERE r = 1) AS s1, max(score) FILTER (WHERE r = 2) AS s2, max(label) FILTER (WHERE r = 1) AS label, count(*) AS n FROM k GROUP BY o_custkey), o AS (SELECT c.o_custkey, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN s1 - s2 < 0.15 THEN 'COMPETING' ELSE 'SINGLE_CANDIDATE' END AS outcome, coalesce(n, 0) AS candidates, label FROM (SELECT DISTINCT o_custkey FROM c) c LEFT JOIN b USING (o_custkey)) SELECT o_custkey, outcome, candidates, CASE WHEN outcome = 'SINGLE_CANDIDATE' THEN label END AS label FROM o")
def outcome_status(t):
    c = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("label")).agg((F.count("*") / 10.0).alias("score"))
    return M.outcome(c, ["o_custkey"], "score", 0.3, 0.15)


@query("WITH RECURSIVE e AS (SELECT p_partkey AS a, (p_partkey + 1) % (SELECT count(*) FROM part) AS b FROM part), l(i, node, s) AS (SELECT 0, p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM part UNION ALL SELECT l.i + 1, l.node, least(1.0, greatest(CASE WHEN l.node % 8 = 0 THEN 1.0 ELSE 0.0 END, 0.2 * CASE WHEN l.node % 8 = 0 THEN 1.0 ELSE 0.0 END + 0.8 * (p.s + q.s) / 2)) FROM l JOIN e f ON f.a = l.node JOIN l p ON p.node = f.b JOIN e g ON g.b = l.node JOIN l q ON q.node = g.a WHERE l.i < 6) SELECT node, round(s, 7) AS score FROM l WHERE i = 6")
def propagate_labels(t):
    """Parts on a ring, every eighth a seed."""
    n = t.part.count()
    ring = t.part.select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") + 1) % n).alias("b"), F.lit(1.0).alias("w"))
    seeds = t.part.filter("p_partkey % 8 = 0").select(F.col("p_partkey").alias("node"), F.lit("x").alias("label"), F.lit(1.0).alias("score"))
    return M.propagate_labels(ring, seeds, 0.8, 1e-9, 6).select("node", F.round("score", 7).alias("score"))


FK = "SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS n_null, count(k) AS n_keys, CAST(coalesce(sum(n) FILTER (WHERE k IS NOT NULL AND m IS NULL), 0) AS BIGINT) AS n_unmatched, max(n) AS most, (SELECT max(m) = 1 FROM p) AS parent_unique, (SELECT max(m) = 1 FROM p) AND coalesce(sum(n) FILTER (WHERE k IS NOT NULL AND m IS NULL), 0) = 0 AS eligible FROM c LEFT JOIN p USING (k)"


@query(f"WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT c_custkey AS k, count(*) AS m FROM customer GROUP BY 1) {FK}")
def referential_profile_orders(t):
    return M.referential_profile(t.orders, t.customer, "o_custkey", "c_custkey")


@query(f"WITH c AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT p_partkey AS k, count(*) AS m FROM part WHERE p_size < 40 GROUP BY 1) {FK}")
def referential_profile_unmatched(t):
    return M.referential_profile(t.lineitem, t.part.filter("p_size < 40"), "l_partkey", "p_partkey")


@query("SELECT c_nationkey, a.n AS actual, e.n AS expected, CASE WHEN a.n IS NULL THEN 'MISSING' WHEN e.n IS NULL THEN 'UNEXPECTED' WHEN a.n = e.n THEN 'MATCH' ELSE 'DIFFERENT' END AS status FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS c_nationkey, count(*) AS n FROM supplier GROUP BY 1) e USING (c_nationkey)")
def reconcile_counts(t):
    a = t.customer.filter("c_acctbal > 0").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return M.reconcile(a, t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n")), ["c_nationkey"], "n")


@query("SELECT * FROM (VALUES ('a', 'PASS'), ('b', 'FAIL'), ('c', 'PASS'), ('d', 'FAIL'), ('e', 'NOT_EVALUABLE'), ('f', 'PASS'), ('g', 'FAIL')) AS v(case_id, verdict)")
def evaluate_gold(t):
    gold = [("a", "SINGLE_CANDIDATE", ["x", "y"], ["z"]), ("b", "SINGLE_CANDIDATE", ["x"], []), ("c", "COMPETING", ["x", "y"], []), ("d", "COMPETING", ["x", "y"], []), ("e", "UNKNOWN", [], []), ("f", "UNKNOWN", [], []), ("g", "SINGLE_CANDIDATE", ["x"], ["z"])]
    answers = [("a", "SINGLE_CANDIDATE", ["y"]), ("b", "SINGLE_CANDIDATE", ["q"]), ("c", "COMPETING", ["y", "x", "w"]), ("d", "COMPETING", ["x"]), ("f", "UNKNOWN", []), ("g", "SINGLE_CANDIDATE", ["x", "z"])]
    g = t.spark.createDataFrame(gold, "case_id string, outcome string, accepted array<string>, unacceptable array<string>")
    return M.evaluate_gold(t.spark.createDataFrame(answers, "case_id string, outcome string, values array<string>"), g)


@query("SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'ADDED' WHEN b.o_orderkey IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0) b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.s <> b.s")
def run_diff(t):
    a = t.orders.filter("o_orderkey % 5 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    b = t.orders.filter("o_orderkey % 7 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return M.run_diff(a, b, ["o_orderkey"], ["s"])


@query("SELECT c AS check, n AS violations, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT 'orders_have_customer' AS c, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS n UNION ALL SELECT 'balance_not_negative', (SELECT count(*) FROM customer WHERE c_acctbal < 0) UNION ALL SELECT 'keys_unique', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)))")
def quality_gates(t):
    return M.quality_gates({
        "orders_have_customer": t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "balance_not_negative": t.customer.filter("c_acctbal < 0"),
        "keys_unique": t.orders.groupBy("o_orderkey").count().filter("count > 1"),
    })


@query("WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), w(o_custkey, i, used, o_orderkey, took) AS (SELECT o_custkey, i, CASE WHEN c <= 6000 THEN c ELSE 0 END, o_orderkey, c <= 6000 FROM o WHERE i = 1 UNION ALL SELECT o.o_custkey, o.i, CASE WHEN used + c <= 6000 THEN used + c ELSE used END, o.o_orderkey, used + c <= 6000 FROM w JOIN o ON o.o_custkey = w.o_custkey AND o.i = w.i + 1) SELECT o_custkey, o_orderkey FROM w WHERE took")
def pack_within_budget(t):
    items = t.orders.withColumn("c", F.floor("o_totalprice").cast("long"))
    return M.pack_within_budget(items, "o_custkey", "o_orderkey", "c", 6000).select("o_custkey", "o_orderkey")




@query(None)
def normalised_text(t):
    return t.documents.select("doc_id", M.normalised_text(F.col("text")).alias("normalised"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_status(t):
    e = t.events.withColumn("at", F.struct("ts", "event_id"))
    return G.last_status(e, "user_id", "at").select("event_type", "event_id")


# ---- graphs: supplier -> part -> order edges
_EDGES = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem UNION SELECT DISTINCT 'o' || l_orderkey, 's' || (l_suppkey % 7) FROM lineitem)"


def graph_edges(t):
    li = t.lineitem
    pair = lambda a, b: li.select(a.alias("src"), b.alias("dst"))
    s, p, o = (F.concat(F.lit(x), F.col(c).cast("string")) for x, c in (("s", "l_suppkey"), ("p", "l_partkey"), ("o", "l_orderkey")))
    return pair(s, p).union(pair(p, o)).union(pair(o, F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")))).distinct()


@query(None)
def reach_hops(t):
    return G.reach(graph_edges(t), t.spark.createDataFrame([("s1",), ("s2",)], "node string"))


@query(f"WITH {_EDGES} SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node")
def degrees(t):
    return G.degree(graph_edges(t))


GN = [("a", "ODS"), ("b", "STG"), ("x", None), ("c", "DM"), ("d", "PASS"), ("e", "DM"), ("y", None), ("f", "STG"), ("z", "STG")]
GE = [("a", "b"), ("a", "x"), ("x", "z"), ("b", "c"), ("c", "e"), ("b", "d"), ("d", "e"), ("d", "y"), ("b", "a"), ("e", "f")]


@query("SELECT * FROM (VALUES ('a','a','PRE',0), ('a','b','PRE',1), ('a','x','PRE',1), ('a','c','GATE',2), ('a','d','PRE',2), ('a','e','GATE',3), ('a','y','PRE',3), ('c','c','GATE',0), ('c','e','GATE',1)) AS v(seed, node, state, hop)")
def gated_reach(t):
    nodes, edges = t.spark.createDataFrame(GN, "node string, db string"), t.spark.createDataFrame(GE, "src string, dst string")
    return G.gated_reach(edges, nodes, t.spark.createDataFrame([("a",), ("c",)], "node string"), "DM", "PASS")


IO = [("t1", "READ", "ods.seed"), ("t1", "WRITE", "dw.a"), ("t1", "WRITE", "dw.a"), ("t2", "READ", "seed"), ("t2", "WRITE", "dw.b"), ("t3", "READ", "ods.seed_extra"), ("t3", "WRITE", "dw.c"), ("t4", "READ", "DW.A"), ("t4", "WRITE", "dw.d"), ("t4", "WRITE", "ods.seed"), ("t5", "READ", "ods.seed"), ("t6", "READ", "dw.d"), ("t6", "WRITE", "dw.a")]


def io(t):
    return t.spark.createDataFrame(IO, "task_id string, direction string, dataset string")


@query("SELECT * FROM (VALUES ('ods.seed','t1','dw.a','EXACT','CANDIDATE'), ('ods.seed','t2','dw.b','SHORT_NAME','CANDIDATE'), ('ods.seed','t5',NULL,'EXACT','PARTIAL')) AS v(seed, task_id, dataset, match, status)")
def direct_downstream(t):
    return G.direct_downstream(io(t), t.spark.createDataFrame([("ods.seed",)], "dataset string"))


@query("SELECT * FROM (VALUES ('ods.seed','dw.a',1,'t1'), ('ods.seed','dw.d',2,'t4')) AS v(seed, dataset, hop, tasks)")
def transitive_downstream(t):
    out = G.transitive_downstream(io(t), t.spark.createDataFrame([("ods.seed",)], "dataset string"))
    return out.withColumn("tasks", F.array_join("tasks", ","))
