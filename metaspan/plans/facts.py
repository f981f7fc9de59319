"""Fact tables of many statements as DataFrames; empty lists still give typed tables."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from itertools import count, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaspan.operators.meta import cut
from metaspan.plans import analyse as A

SCHEMAS = {
    "statements": "task_id string, statement_id string, statement_index int, category string, span struct<start:int,end:int>, raw_sql string, status string, message string",
    "relations": "task_id string, statement_id string, relation_id string, type string, detail map<string,string>, columns array<string>, grain array<string>, cardinality string, confidence string",
    "relation_edges": "task_id string, statement_id string, from_relation_id string, to_relation_id string, ordinal int",
    "column_lineage": "task_id string, statement_id string, ordinal int, output string, origin_table string, origin_column string",
    "output_status": "task_id string, statement_id string, ordinal int, output string, status string",
    "dataset_io": "task_id string, statement_id string, direction string, dataset string",
    "unknowns": "task_id string, statement_id string, reason string, subject string",
    "output_field_bindings": "task_id string, statement_id string, ordinal int, output string, target_field string, status string",
}


def _rows_of(spark: SparkSession, task: str, text: str, catalog: dict[str, list[str]]) -> dict[str, list]:
    """The fact rows of one script."""
    rows: dict[str, list] = {k: [] for k in SCHEMAS}
    for s, a in A.analyse_script(spark, text, catalog):
        sid = hashlib.sha256(f"{task}|{s.index}|{s.text}".encode()).hexdigest()[:16]
        rows["statements"].append((task, sid, s.index, s.category, (s.start, s.end), s.text, a.status, a.message))
        grain, card = A.grains(a.relations), A.cardinalities(a.relations)
        for r in a.relations:
            rows["relations"].append((task, sid, r.id, r.type, {k: str(v) for k, v in r.detail.items() if v is not None}, r.columns, grain[r.id], *card[r.id]))
            rows["relation_edges"] += [(task, sid, i, r.id, k) for k, i in enumerate(r.inputs)]
        for i, c in enumerate(a.outputs):
            rows["column_lineage"] += [(task, sid, i, c.name, t, n) for t, n in sorted(c.origins)]
            rows["output_status"].append((task, sid, i, c.name, "RESOLVED" if c.known else "UNKNOWN"))
        rows["dataset_io"] += [(task, sid, "READ", d) for d in a.reads] + [(task, sid, "WRITE", d) for d in a.writes]
        rows["unknowns"] += [(task, sid, r, x) for r, x in a.unknowns]
        if a.writes:
            target = catalog.get(a.writes[0])
            rows["output_field_bindings"] += [(task, sid, *b) for b in A.bind_outputs(a, None if target is None else list(target))]
    return rows


#: Scripts parsed before their rows leave the driver, and threads that parse.
BATCH, THREADS = 256, 8


def _batches(spark: SparkSession, scripts, catalog: dict):
    """Fact rows of BATCH scripts at a time. Spark's parser runs in the driver's JVM; threads wait on it side by side."""
    scripts = iter(scripts)
    with ThreadPoolExecutor(THREADS) as pool:
        while some := list(islice(scripts, BATCH)):
            rows: dict[str, list] = {k: [] for k in SCHEMAS}
            for one in pool.map(lambda x: _rows_of(spark, x[0], x[1], catalog), some):
                for k, v in one.items():
                    rows[k] += v
            yield rows


def plan_facts(spark: SparkSession, tasks: dict[str, str], catalog: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """tasks: id -> SQL script; a dictionary of them is small. write_plan_facts takes a table of any size."""
    rows: dict[str, list] = {k: [] for k in SCHEMAS}
    for some in _batches(spark, sorted(tasks.items()), catalog or {}):
        for k, v in some.items():
            rows[k] += v
    return {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}


def write_plan_facts(spark: SparkSession, tasks: DataFrame, folder: str, catalog: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Facts of tasks(task_id, sql) as Parquet tables under folder. Scripts come to the driver a partition at a time, and the
    rows of BATCH scripts are appended before the next are parsed, so the driver's memory does not grow with the table. A
    script whose text was analysed before, under any task, is parsed once: its rows are copied."""
    texts = tasks.groupBy(F.sha2("sql", 256).alias("sha")).agg(F.min("sql").alias("sql"))
    for rows in _batches(spark, ((r.sha, r.sql) for r in texts.toLocalIterator()), catalog or {}):
        for k, v in rows.items():
            spark.createDataFrame(v, SCHEMAS[k]).write.mode("append").parquet(f"{folder}/by_text/{k}")
    named = tasks.select(F.col("task_id").alias("task"), F.sha2("sql", 256).alias("task_id"))
    for k, ddl in SCHEMAS.items():
        own = spark.read.schema(ddl).parquet(f"{folder}/by_text/{k}").join(named, "task_id")
        own = own.withColumn("statement_id", F.substring(F.sha2(F.concat_ws("|", "task", "statement_id"), 256), 1, 16)).withColumn("task_id", F.col("task")).drop("task")
        own.write.mode("overwrite").parquet(f"{folder}/{k}")
    return {k: spark.read.schema(ddl).parquet(f"{folder}/{k}") for k, ddl in SCHEMAS.items()}


def validate(facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Constraint queries; a valid bundle has no row in any."""
    ids = facts["relations"].select("statement_id", F.col("relation_id").alias("from_relation_id"))
    return {
        "duplicate_relation": facts["relations"].groupBy("statement_id", "relation_id").count().filter("count > 1"),
        "dangling_edge": facts["relation_edges"].filter("from_relation_id <> 'recursive'").join(ids, ["statement_id", "from_relation_id"], "left_anti"),
        "bad_span": facts["statements"].filter("span.start < 0 or span.end <= span.start or span.end - span.start <> length(raw_sql)"),
        "lineage_without_output": facts["column_lineage"].join(facts["output_status"], ["statement_id", "ordinal"], "left_anti"),
    }


def ancestors(edges: DataFrame) -> DataFrame:
    """(statement_id, relation_id, ancestor): closure of relation edges towards the inputs, until nothing new is met."""
    step = cut(edges.select("statement_id", F.col("to_relation_id").alias("relation_id"), F.col("from_relation_id").alias("ancestor")).distinct())
    found, wave = step, step
    up = step.select("statement_id", F.col("relation_id").alias("ancestor"), F.col("ancestor").alias("next"))
    for hop in count(1):
        wave = wave.join(up, ["statement_id", "ancestor"]).select("statement_id", "relation_id", F.col("next").alias("ancestor")).distinct()
        wave = cut(wave.join(found, ["statement_id", "relation_id", "ancestor"], "left_anti"))
        if wave.isEmpty():
            return found
        found = cut(found.unionByName(wave)) if hop % 4 == 0 else found.unionByName(wave)


def types(spark: SparkSession, sql: str, tables: dict[str, str]) -> list[tuple[str, str, str]]:
    """(output, type, nullability) through Spark's analyser; tables: name -> DDL of columns. UNKNOWN rows where it fails."""
    for name, ddl in tables.items():
        spark.createDataFrame([], ddl).createOrReplaceTempView(name)
    try:
        schema = spark.sql(sql).schema
        return [(f.name, f.dataType.simpleString(), "nullable" if f.nullable else "notnull") for f in schema.fields]
    except Exception as e:
        return [("*", "unknown", type(e).__name__)]
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
