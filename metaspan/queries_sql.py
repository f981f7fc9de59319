"""Queries for the SQL-analysis operators over a fixed list of statements.

The SQL side lists the rows by hand, read off the statements themselves; it is not taken from this engine's output.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metaspan.operators import graph as G
from metaspan.plans import facts as P
from metaspan.plans import lexer
from metaspan.plans import inference as I
from metaspan.plans.analyse import analyse, explain, fingerprint
from metaspan.queries_relational import Tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return wrap


def values(columns: str, *rows: tuple) -> str:
    """A SQL VALUES list; None is NULL."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows) + f") AS v({columns})"


CATALOG = {"t": ["a", "b"], "u": ["x", "b"], "orders": ["o_orderkey", "o_custkey", "o_totalprice"], "customer": ["c_custkey", "c_mktsegment"], "dw.x": ["k", "v"], "dw.z": ["only"], "dw.p": ["v", "day", "hour"], "st": {"s": "struct<f:int,g:struct<h:string>>"}}
TASKS = {
    "t01": "SELECT o_totalprice + o_custkey AS c FROM orders",
    "t02": "WITH c (x) AS (SELECT o_custkey FROM orders) SELECT x FROM c",
    "t03": "WITH c AS (SELECT * FROM customer) SELECT * FROM c",
    "t04": "SELECT a FROM t UNION SELECT b FROM u",
    "t05": "SELECT (SELECT max(x) FROM u) AS m, 1 AS one FROM t",
    "t06": "SELECT c_mktsegment AS seg, sum(o_totalprice) AS tot FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "t07": "SELECT t.a, g.mb FROM t LEFT JOIN (SELECT x, max(b) AS mb FROM u GROUP BY x) g ON t.a = g.x WHERE t.b > 0",
    "t08": "SELECT a, y FROM t LATERAL VIEW explode(b) v AS y",
    "t09": "SELECT a FROM t ASOF JOIN u ON t.a = u.x",
    "t10": "SELECT a FROM t; SELEC nothing; SELECT b FROM u",
    "t11": "INSERT OVERWRITE TABLE dw.x SELECT a, b FROM t WHERE a > '${day}'",
    "t12": "CREATE TABLE dw.y AS SELECT x FROM dw.x JOIN u ON k = x",
    "t13": "SELECT q, b FROM t JOIN u ON a = x",
    "t14": "SELECT CASE WHEN a > 0 THEN b END AS r, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM t",
    "t15": "SELECT DISTINCT b FROM t EXCEPT ALL SELECT b FROM u",
    "t16": "INSERT INTO dw.z SELECT a, b FROM t",
    "t17": "INSERT INTO dw.x (v, k) SELECT a, b FROM t",
    "t18": "SELECT a FROM t LEFT SEMI JOIN u ON a = x",
    "t19": "SELECT v.w FROM VALUES (1) AS v(w)",
    "t20": "SELECT * EXCEPT (o_totalprice) FROM orders",
    "t21": "WITH s AS (SELECT c_mktsegment, c_custkey FROM customer) SELECT * FROM s PIVOT (max(c_custkey) FOR c_mktsegment IN ('FURNITURE' AS f, 'MACHINERY'))",
    "t22": "SELECT * FROM t UNPIVOT (val FOR col IN (a, b))",
    "t23": "FROM orders |> WHERE o_totalprice > 5 |> AGGREGATE sum(o_totalprice) AS s GROUP BY o_custkey |> EXTEND s * 2 AS d |> DROP s",
    "t24": "MERGE INTO dw.x USING u ON dw.x.k = u.x WHEN MATCHED THEN UPDATE SET v = u.b WHEN NOT MATCHED THEN INSERT (k, v) VALUES (u.x, u.b)",
    "t25": "UPDATE dw.x SET v = k + 1 WHERE k > 2",
    "t26": "DELETE FROM dw.x WHERE k IN (SELECT x FROM u)",
    "t27": "INSERT OVERWRITE TABLE dw.p PARTITION (day = '${day}', hour) SELECT a, b FROM t",
    "t28": "SELECT st.s.f, s.nope FROM st",
    "t29": "SELECT a FROM t, LATERAL (SELECT x FROM u WHERE u.b = t.b) l",
    "t30": "FROM t |> SET a = b |> SELECT a",
}


def facts(t: Tables):
    return P.plan_facts(t.spark, TASKS, CATALOG)


LINEAGE = [
    ("t01", "c", "orders", "o_totalprice"), ("t01", "c", "orders", "o_custkey"), ("t02", "x", "orders", "o_custkey"), ("t03", "c_custkey", "customer", "c_custkey"), ("t03", "c_mktsegment", "customer", "c_mktsegment"),
    ("t04", "a", "t", "a"), ("t04", "a", "u", "b"), ("t05", "m", "u", "x"), ("t06", "seg", "customer", "c_mktsegment"), ("t06", "tot", "orders", "o_totalprice"), ("t07", "a", "t", "a"), ("t07", "mb", "u", "b"),
    ("t08", "a", "t", "a"), ("t08", "y", "t", "b"), ("t10", "a", "t", "a"), ("t10", "b", "u", "b"), ("t11", "a", "t", "a"), ("t11", "b", "t", "b"), ("t12", "x", "u", "x"),
    ("t14", "r", "t", "a"), ("t14", "r", "t", "b"), ("t14", "n", "t", "a"), ("t14", "n", "t", "b"), ("t15", "b", "t", "b"), ("t15", "b", "u", "b"), ("t16", "a", "t", "a"), ("t16", "b", "t", "b"),
    ("t17", "a", "t", "a"), ("t17", "b", "t", "b"), ("t18", "a", "t", "a"), ("t20", "o_orderkey", "orders", "o_orderkey"), ("t20", "o_custkey", "orders", "o_custkey"),
    ("t21", "f", "customer", "c_custkey"), ("t21", "f", "customer", "c_mktsegment"), ("t21", "MACHINERY", "customer", "c_custkey"), ("t21", "MACHINERY", "customer", "c_mktsegment"), ("t22", "val", "t", "a"), ("t22", "val", "t", "b"),
    ("t23", "o_custkey", "orders", "o_custkey"), ("t23", "d", "orders", "o_totalprice"), ("t24", "v", "u", "b"), ("t24", "k", "u", "x"), ("t25", "v", "dw.x", "k"), ("t27", "a", "t", "a"), ("t27", "b", "t", "b"),
    ("t28", "f", "st", "s"), ("t28", "nope", "st", "s"), ("t29", "a", "t", "a"), ("t30", "a", "t", "b"),
]


@query(values("task_id, output, origin_table, origin_column", *LINEAGE))
def column_lineage(t):
    return facts(t)["column_lineage"].select("task_id", "output", "origin_table", "origin_column")


WRITING = {"t11": "dml", "t16": "dml", "t17": "dml", "t12": "ddl", "t24": "dml", "t25": "dml", "t26": "dml", "t27": "dml"}


@query(values("task_id, statement_index, category, status", *[(k, 0, WRITING.get(k, "query"), "NOT_EVALUABLE" if k == "t09" else "OK") for k in TASKS], ("t10", 1, "other", "FAILURE"), ("t10", 2, "query", "OK")))
def statement_status(t):
    return facts(t)["statements"].select("task_id", "statement_index", "category", "status")


@query(values("task_id, reason, subject", ("t13", "UNKNOWN_COLUMN", "q"), ("t13", "AMBIGUOUS_COLUMN", "b"), ("t28", "UNKNOWN_FIELD", "s.nope")))
def unknown_columns(t):
    return facts(t)["unknowns"].select("task_id", "reason", "subject")


#: Each statement's relations as chains from input to result, read off the statement; a chain names a relation once more to join it.
CHAINS = {
    "t01": ["q.read q.project"], "t02": ["q.c.read q.c.project q.project"], "t03": ["q.c.read q.c.project q.project"], "t04": ["q.0.read q.0.project q.setop", "q.1.read q.1.project q.setop"],
    "t05": ["q.read q.project", "q.sub.read q.sub.aggregate q.sub.project"], "t06": ["q.read q.join q.aggregate q.project", "q.read.2 q.join"], "t07": ["q.read q.join q.filter q.project", "q.g.read q.g.aggregate q.g.project q.join"],
    "t08": ["q.read q.expand q.project"], "t10": ["q.read q.project"], "t11": ["q.read q.filter q.project"], "t12": ["q.read q.join q.project", "q.read.2 q.join"], "t13": ["q.read q.join q.project", "q.read.2 q.join"],
    "t14": ["q.read q.project"], "t15": ["q.0.read q.0.project q.0.distinct q.setop", "q.1.read q.1.project q.setop"], "t16": ["q.read q.project"], "t17": ["q.read q.project"], "t18": ["q.read q.join q.project", "q.read.2 q.join"],
    "t19": ["q.v.values q.project"], "t20": ["q.read q.project"], "t21": ["q.s.read q.s.project q.pivot q.project"], "t22": ["q.read q.unpivot q.filter q.project"], "t23": ["q.read q.filter q.aggregate q.project q.project.2 q.project.3"],
    "t24": ["q.read q.merge"], "t25": ["q.update"], "t26": ["q.sub.read q.sub.project", "q.delete"], "t27": ["q.read q.project"], "t28": ["q.read q.project"],
    "t29": ["q.read q.join q.project", "q.lateral.l.read q.lateral.l.filter q.lateral.l.project q.join"], "t30": ["q.read q.project q.project.2"],
}
NODES = [(k, n) for k, chains in CHAINS.items() for n in dict.fromkeys(" ".join(chains).split()) for _ in range(2 if k == "t10" else 1)]
LINKS = [(k, a, b) for k, chains in CHAINS.items() for c in chains for a, b in zip(c.split(), c.split()[1:])]
_kind = lambda n: next(p for p in reversed(n.split(".")) if not p.isdigit())


@query(f"SELECT type, count(*) AS n FROM ({values('type', *[(_kind(n),) for _, n in NODES])}) GROUP BY type")
def relation_counts(t):
    return facts(t)["relations"].groupBy("type").agg(F.count("*").cast("int").alias("n"))


#: What is not the rule of its kind: a grain other than none, a cardinality other than the kind's.
GRAINS = {("t05", "q.sub.aggregate"): "", ("t05", "q.sub.project"): "", ("t06", "q.aggregate"): "c_mktsegment", ("t07", "q.g.aggregate"): "x", ("t07", "q.g.project"): "x", ("t23", "q.aggregate"): "o_custkey", ("t23", "q.project"): "o_custkey", ("t23", "q.project.2"): "o_custkey", ("t23", "q.project.3"): "o_custkey"}
SIZES = {"project": "EQUAL", "filter": "NON_INCREASING", "aggregate": "NON_INCREASING", "distinct": "NON_INCREASING", "pivot": "NON_INCREASING", "expand": "FANOUT", "unpivot": "FANOUT"}
SIZED = {("t07", "q.join"): "NON_INCREASING", ("t18", "q.join"): "NON_INCREASING", ("t15", "q.setop"): "NON_INCREASING"}


@query(values("task_id, relation_id, grain, cardinality", *[(k, n, GRAINS.get((k, n)), SIZED.get((k, n), SIZES.get(_kind(n), "UNKNOWN"))) for k, n in NODES]))
def grain_and_cardinality(t):
    return facts(t)["relations"].select("task_id", "relation_id", F.array_join("grain", ",").alias("grain"), "cardinality")


IO_ROWS = [
    ("t11", "READ", "t"), ("t11", "WRITE", "dw.x"), ("t12", "READ", "dw.x"), ("t12", "READ", "u"), ("t12", "WRITE", "dw.y"), ("t16", "READ", "t"), ("t16", "WRITE", "dw.z"), ("t17", "READ", "t"), ("t17", "WRITE", "dw.x"),
    ("t24", "READ", "u"), ("t24", "WRITE", "dw.x"), ("t25", "WRITE", "dw.x"), ("t26", "READ", "u"), ("t26", "WRITE", "dw.x"), ("t27", "READ", "t"), ("t27", "WRITE", "dw.p"),
]


@query(values("task_id, direction, dataset", *IO_ROWS))
def dataset_io(t):
    found = facts(t)["dataset_io"]
    return found.join(found.filter("direction = 'WRITE'").select("task_id").distinct(), "task_id").select("task_id", "direction", "dataset")


BOUND = [
    ("t11", "a", "k", "RESOLVED"), ("t11", "b", "v", "RESOLVED"), ("t12", "x", None, "TARGET_UNKNOWN"), ("t16", "a", "only", "SCHEMA_DRIFT"), ("t16", "b", None, "SCHEMA_DRIFT"), ("t17", "a", "v", "RESOLVED"), ("t17", "b", "k", "RESOLVED"),
    ("t24", "v", "v", "RESOLVED"), ("t24", "k", "k", "RESOLVED"), ("t25", "v", "v", "RESOLVED"), ("t27", "a", "v", "RESOLVED"), ("t27", "b", "hour", "DYNAMIC_PARTITION"),
]


@query(values("task_id, output, target_field, status", *BOUND))
def output_field_bindings(t):
    return facts(t)["output_field_bindings"].select("task_id", "output", "target_field", "status")


@query(values("check_name, n", ("duplicate_relation", 0), ("dangling_edge", 0), ("bad_span", 0), ("lineage_without_output", 0)))
def bundle_validation(t):
    rows = [df.agg(F.count("*").cast("int").alias("n")).select(F.lit(k).alias("check_name"), "n") for k, df in P.validate(facts(t)).items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(f"WITH RECURSIVE e AS ({values('k, a, b', *[x for x in LINKS if x[0] != 't10'])}), r(k, a, b) AS (SELECT k, a, b FROM e UNION SELECT r.k, e.a, r.b FROM r JOIN e ON e.k = r.k AND e.b = r.a) SELECT k AS task_id, b AS relation_id, a AS ancestor FROM r")
def relation_ancestors(t):
    edges = facts(t)["relation_edges"].filter("task_id <> 't10'")  # whose two statements have one shape
    tasks = edges.select("statement_id", "task_id").distinct()
    return P.ancestors(edges).join(tasks, "statement_id").select("task_id", "relation_id", "ancestor")


@query(values("seed, dataset, hop, tasks", ("t", "dw.x", 1, "t11,t17"), ("t", "dw.z", 1, "t16"), ("t", "dw.p", 1, "t27"), ("t", "dw.y", 2, "t12")))
def sql_task_downstream(t):
    out = G.transitive_downstream(facts(t)["dataset_io"].select("task_id", "direction", "dataset"), t.spark.createDataFrame([("t",)], "dataset string"))
    return out.withColumn("tasks", F.array_join("tasks", ","))


_TARGET = {k: d for k, way, d in IO_ROWS if way == "WRITE"}
PROJECTED = (
    [("FIELD_TO_EXPRESSION", f"{t}.{c}", f"{k}.{o}") for k, o, t, c in LINEAGE]
    + [("EXPRESSION_TO_FIELD", f"{k}.{o}", f"{_TARGET[k]}.{f}") for k, o, f, _ in BOUND if f]
    + [("TASK_DATASET_FLOW", d, _TARGET[k]) for k, way, d in IO_ROWS if way == "READ"]
)


@query(values("edge, src, dst", *PROJECTED))
def graph_projection(t):
    f = facts(t)
    wrote = f["dataset_io"].filter("direction = 'WRITE'").select("statement_id", F.col("dataset").alias("target"))
    a = f["column_lineage"].select(F.lit("FIELD_TO_EXPRESSION").alias("edge"), F.concat_ws(".", "origin_table", "origin_column").alias("src"), F.concat_ws(".", "task_id", "output").alias("dst"))
    b = f["output_field_bindings"].filter("target_field is not null").join(wrote, "statement_id").select(F.lit("EXPRESSION_TO_FIELD").alias("edge"), F.concat_ws(".", "task_id", "output").alias("src"), F.concat_ws(".", "target", "target_field").alias("dst"))
    c = f["dataset_io"].filter("direction = 'READ'").join(wrote, "statement_id").select(F.lit("TASK_DATASET_FLOW").alias("edge"), F.col("dataset").alias("src"), F.col("target").alias("dst"))
    return a.unionByName(b).unionByName(c)


@query(values("path_id, producer, consumer, source_field, target_field, status", ("p1", "t11", "t12", "t.a", "dw.x.k", "PASS"), ("p2", "t11", "t12", "t.z", "dw.x.k", "FAIL")))
def value_flow_paths(t):
    """Producer write -> dataset flow -> consumer read, with a path failing where a step is missing."""
    f = facts(t)
    paths = t.spark.createDataFrame([("p1", "t11", "t12", "t.a", "dw.x.k"), ("p2", "t11", "t12", "t.z", "dw.x.k")], "path_id string, producer string, consumer string, source_field string, target_field string")
    wrote = f["dataset_io"].filter("direction = 'WRITE'").select(F.col("statement_id"), F.col("dataset").alias("target"))
    feeds = f["column_lineage"].join(f["output_field_bindings"].select("statement_id", "ordinal", "target_field"), ["statement_id", "ordinal"]).join(wrote, "statement_id")
    feeds = feeds.select(F.col("task_id").alias("producer"), F.concat_ws(".", "origin_table", "origin_column").alias("source_field"), F.concat_ws(".", "target", "target_field").alias("target_field"), F.col("target"), F.lit(True).alias("write_ok"))
    reads = f["dataset_io"].filter("direction = 'READ'").select(F.col("task_id").alias("consumer"), F.col("dataset").alias("target"), F.lit(True).alias("read_ok"))
    out = paths.join(feeds, ["producer", "source_field", "target_field"], "left").join(reads, ["consumer", "target"], "left")
    gaps = F.array_compact(F.array(F.when(F.col("write_ok").isNull(), "WRITE"), F.when(F.col("read_ok").isNull(), "READ")))
    return out.select("path_id", "producer", "consumer", "source_field", "target_field", F.when(F.size(gaps) == 0, "PASS").otherwise("FAIL").alias("status"))


@query(values("task_id, spine", *[(k, ">".join(_kind(n) for n in chains[-1 if k in ("t26",) else 0].split())) for k, chains in CHAINS.items() if k != "t10"]))
def model_fingerprint(t):
    rows = [(k, ">".join(fingerprint(analyse(t.spark, q, CATALOG))["spine"])) for k, q in TASKS.items() if k not in ("t09", "t10")]  # no plan, several plans
    return t.spark.createDataFrame(rows, "task_id string, spine string")


@query(values("line", ("project",), ("  aggregate c_mktsegment",), ("    join inner",), ("      read orders",), ("      read customer",)))
def explain_tree(t):
    return t.spark.createDataFrame([(x,) for x in explain(analyse(t.spark, TASKS["t06"], CATALOG)).split("\n")], "line string")


@query(values("kind, text, start, end_", ("word", "SELECT", 0, 6), ("quoted", "`a b`", 7, 12), ("operator", ",", 12, 13), ("string", "'x;y'", 14, 19), ("word", "FROM", 35, 39), ("word", "t", 40, 41)))
def tokenise(t):
    rows = [(k.kind, k.text, k.start, k.end) for k in lexer.code("SELECT `a b`, 'x;y' /* ; comment */FROM t")]
    return t.spark.createDataFrame(rows, "kind string, text string, start int, end_ int")


@query(values("original, masked", ("SELECT * FROM ${db}.t WHERE d = '${x}'", "SELECT * FROM p____.t WHERE d = 'p___'"), ("SELECT {{ f('y') }} FROM t", "SELECT p___________ FROM t")))
def mask_placeholders(t):
    texts = ["SELECT * FROM ${db}.t WHERE d = '${x}'", "SELECT {{ f('y') }} FROM t"]
    return t.spark.createDataFrame([(x, lexer.mask(x)[0]) for x in texts], "original string, masked string")


@query(values("idx, category, start", (0, "utility", 0), (1, "query", 9), (2, "dml", 33), (3, "compound", 56), (4, "dcl", 99)))
def split_statements(t):
    text = "SET a=1; SELECT ';' FROM t -- ;\n;INSERT INTO x VALUES 1;BEGIN SELECT CASE WHEN 1=1 THEN 2 END; END;GRANT SELECT ON t TO u"
    return t.spark.createDataFrame([(s.index, s.category, s.start) for s in lexer.split(text)], "idx int, category string, start int")


TYPED = "SELECT i + 1 AS a, i / 2 AS b, d * 2 AS c, sum(i) AS s, avg(d) AS m, count(*) AS n, max(st) AS x, array(i) AS arr, CAST(i AS STRING) AS str, 2.5 AS lit FROM typed GROUP BY i, d"


@query(values("output, type, nullability", ("a", "int", "nullable"), ("b", "double", "nullable"), ("c", "decimal(6,1)", "nullable"), ("s", "bigint", "nullable"), ("m", "decimal(8,5)", "nullable"), ("n", "bigint", "notnull"), ("x", "string", "nullable"), ("arr", "array<int>", "notnull"), ("str", "string", "nullable"), ("lit", "decimal(2,1)", "notnull")))
def infer_types(t):
    return t.spark.createDataFrame(P.types(t.spark, TYPED, {"typed": "i int, d decimal(4,1), st string"}), "output string, type string, nullability string")


@query(values("output, type, nullability", ("*", "unknown", "AnalysisException")))
def infer_types_unknown(t):
    return t.spark.createDataFrame(P.types(t.spark, "SELECT nope FROM typed", {"typed": "i int"}), "output string, type string, nullability string")


E1 = "SELECT a + 1 AS x, coalesce(b, 'z') AS y FROM t WHERE a BETWEEN 2 AND 5 AND b LIKE 'q%' AND NOT a IS NULL"


@query(values("kind, text", ("OPERATOR", "+"), ("COLUMN", "a"), ("LITERAL", "1"), ("FUNCTION", "coalesce"), ("COLUMN", "b"), ("LITERAL", "'z'"), ("PREDICATE", "and"), ("PREDICATE", "and"), ("PREDICATE", "between"), ("COLUMN", "a"), ("LITERAL", "2"), ("LITERAL", "5"), ("LITERAL", "'q%'"), ("COLUMN", "b"), ("PREDICATE", "like"), ("PREDICATE", "not"), ("PREDICATE", "isnull"), ("COLUMN", "a")))
def expression_facts(t):
    return t.spark.createDataFrame(I.expressions(t.spark, E1), "kind string, text string")


W1 = "SELECT sum(a) OVER w AS s, row_number() OVER (PARTITION BY a ORDER BY b DESC NULLS LAST, a) AS n FROM t WINDOW w AS (PARTITION BY b ORDER BY a NULLS FIRST)"


@query(values("call, role, col, direction, nulls", (0, "VALUE", "a", None, None), (0, "WINDOW_PARTITION", "b", None, None), (0, "WINDOW_ORDER", "a", "ASC", "FIRST"), (1, "WINDOW_PARTITION", "a", None, None), (1, "WINDOW_ORDER", "b", "DESC", "LAST"), (1, "WINDOW_ORDER", "a", "ASC", "UNSPECIFIED")))
def window_inputs(t):
    return t.spark.createDataFrame(I.window_inputs(t.spark, W1), "call int, role string, col string, direction string, nulls string")


@query(values("relation, output, input, kind", ("q.c.project", "k", "a", "RENAME"), ("q.c.project", "b", "b", "PASS"), ("q.project", "k", "k", "PASS"), ("q.project", "s", "k", "EXPRESSION"), ("q.project", "s", "b", "EXPRESSION"), ("q.project", "one", None, "TERMINAL")))
def hop_lineage(t):
    rows = I.hops(t.spark, "WITH c AS (SELECT a AS k, b FROM t) SELECT k, k + b AS s, 1 AS one FROM c", CATALOG)
    return t.spark.createDataFrame(rows, "relation string, output string, input string, kind string")


NULLS = {"t": {"nn": "notnull", "nl": "nullable", "plain": "unknown"}, "t2": {"b": "notnull"}}


@query(values("idx, output, state", (0, "nn", "notnull"), (0, "nl", "nullable"), (0, "p", "unknown"), (0, "c", "notnull"), (0, "s", "nullable"), (0, "i", "notnull"), (0, "k", "nullable"), (1, "nn", "notnull"), (1, "b", "nullable"), (2, "nn", "nullable"), (2, "b", "notnull"), (3, "n", "notnull"), (3, "m", "nullable"), (4, "x", "notnull"), (4, "m", "notnull"), (5, "nn", "nullable"), (6, "f", "unknown")))
def infer_nullability(t):
    texts = [
        "SELECT nn, nl, plain AS p, coalesce(nl, nn) AS c, nn + nl AS s, nl IS NULL AS i, CASE WHEN nn > 1 THEN nn END AS k FROM t",
        "SELECT t.nn, t2.b FROM t LEFT JOIN t2 ON t.nn = t2.b", "SELECT t.nn, t2.b FROM t RIGHT JOIN t2 ON t.nn = t2.b", "SELECT count(*) AS n, max(nn) AS m FROM t",
        "SELECT nn AS x, max(nn) AS m FROM t GROUP BY nn", "SELECT nn FROM t UNION ALL SELECT nl FROM t", "SELECT mystery(nn) AS f FROM t",
    ]
    rows = [(i, n, s) for i, q in enumerate(texts) for n, s in I.nullability(t.spark, q, NULLS)]
    return t.spark.createDataFrame(rows, "idx int, output string, state string")


@query(values("join_id, filter_id", ("q.join", "q.g.filter")))
def rowset_control_paths(t):
    rows = I.rowset_controls(t.spark, "SELECT t.a FROM t LEFT JOIN (SELECT x FROM u WHERE b = 'off') g ON t.a = g.x WHERE g.x IS NULL", CATALOG)
    return t.spark.createDataFrame(rows, "join_id string, filter_id string")


@query(values("node, db, by_", ("n1", "D", "DETAIL"), ("n2", "E", "EDGE"), ("n3", "S", "SEED"), ("n4", "L", "UNIQUE_LOCAL"), ("n5", None, None)))
def database_resolution(t):
    """The first source that names one database wins: detail, edge, seed, then a unique local name."""
    make = lambda rows, ddl: t.spark.createDataFrame(rows, ddl)
    nodes = make([("n1", "a"), ("n2", "b"), ("n3", "c"), ("n4", "d"), ("n5", "e")], "node string, name string")
    found = make([("n1", "DETAIL", "D"), ("n1", "EDGE", "X"), ("n2", "EDGE", "E"), ("n2", "SEED", "Y"), ("n3", "SEED", "S")], "node string, source string, db string")
    local = make([("d", "L"), ("e", "L1"), ("e", "L2")], "name string, db string").groupBy("name").agg(F.min("db").alias("db"), F.count_distinct("db").alias("n")).filter("n = 1")
    order = F.array_position(F.array(*[F.lit(x) for x in ("DETAIL", "EDGE", "SEED")]), F.col("source"))
    best = found.groupBy("node").agg(F.min_by(F.struct("db", "source"), order).alias("b"))
    out = nodes.join(best, "node", "left").join(local.select("name", F.col("db").alias("l")), "name", "left")
    return out.select("node", F.coalesce("b.db", "l").alias("db"), F.coalesce("b.source", F.when(F.col("l").isNotNull(), "UNIQUE_LOCAL")).alias("by_"))


@query(values("table_name, column_name, type", ("t", "a", "bigint"), ("t", "b", "string")))
def schema_evidence_merge(t):
    """Of several records of one column the better one stays: with a type, then from DDL, then the latest."""
    rows = [("t", "a", None, "DDL", 9), ("t", "a", "int", "GUESS", 5), ("t", "a", "bigint", "DDL", 1), ("t", "b", "string", "GUESS", 2), ("t", "b", "int", "GUESS", 1)]
    seen = t.spark.createDataFrame(rows, "table_name string, column_name string, type string, origin string, at int")
    w = Window.partitionBy("table_name", "column_name").orderBy(F.col("type").isNull(), F.col("origin") != "DDL", F.desc("at"))
    return seen.withColumn("r", F.row_number().over(w)).filter("r = 1").select("table_name", "column_name", "type")


@query(values("src, dst", ("a", "b"), ("a", "x"), ("b", "a"), ("b", "c"), ("b", "d"), ("d", "e"), ("d", "y"), ("c", "e")))
def gated_edges(t):
    from metaspan.queries_meta import GE, GN

    nodes, edges = t.spark.createDataFrame(GN, "node string, db string"), t.spark.createDataFrame(GE, "src string, dst string")
    reached = G.gated_reach(edges, nodes, t.spark.createDataFrame([("a",), ("c",)], "node string"), "DM", "PASS")
    return G.gated_edges(edges, reached, nodes, "PASS")
