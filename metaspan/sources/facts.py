"""Fact tables: typed reading and writing, and facts about the tables of a folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Explicit schemas: an empty list still makes a typed table.
SCHEMAS = {
    "objects": "run_id string, asset_id string, source_label string, schema_name string, object_name string, object_type string, object_comment string, in_panorama_scope boolean, is_boundary boolean, boundary_for_case_ids array<string>, extraction_status string, error_category string",
    "columns": "asset_id string, column_id string, column_name string, ordinal_position int, data_type string, data_length int, data_precision int, data_scale int, nullable_declared boolean, default_expression string, column_comment string",
    "constraints": "asset_id string, constraint_id string, constraint_name string, constraint_type string, column_ids array<string>, referenced_asset_id string, declared_status string, search_condition string, extraction_status string",
    "indexes": "asset_id string, index_name string, is_unique boolean, index_type string, column_ids array<string>, expressions array<string>",
    "object_definitions": "asset_id string, definition_type string, definition_text string, extraction_status string, error_category string",
    "dependencies": "source_asset_id string, target_asset_id string, dependency_type string, target_is_boundary boolean",
    "failures": "target_id string, failure_status string, error_category string",
}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder in the cluster's shared one (spark.checkpoint.dir); where none is set, one of this machine for a
    session that runs on this machine alone. It goes when the driver's JVM ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/metaspan-facts"
    path = f"{found.rstrip('/')}/facts-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def write_json_facts(frames: dict[str, DataFrame], folder: str) -> None:
    """`<folder>/<name>.json` for each table, one object a line."""
    for name, df in frames.items():
        replace_atomically(df, f"{folder}/{name}.json")


def load_config(text: str) -> dict:
    """A YAML mapping; anything else is an error."""
    import yaml

    found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("a configuration must be a mapping")
    return found


def export(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """`|> EXPORT DATA`: writes the rows and passes on what was written; a path that is there is an error."""
    df.write.format(fmt).options(**options).mode("errorifexists").save(path)
    return df.sparkSession.read.format(fmt).options(**options).schema(df.schema).load(path)


def append(df: DataFrame, path: str) -> DataFrame:
    """`|> INSERT`: appends to a Parquet table by column name and passes on the whole table."""
    have = df.sparkSession.read.parquet(path).schema
    df.select(*have.names).write.mode("append").parquet(path)
    return df.sparkSession.read.schema(have).parquet(path)


def read_json_facts(spark: SparkSession, folder: str, lines: bool = False) -> dict[str, DataFrame]:
    """The seven fact tables from `<folder>/<name>.json` (a list each, or with `lines` an object a line); a missing file or a
    broken row is an error."""
    reader = spark.read.option("multiLine", not lines).option("mode", "FAILFAST")
    return {name: reader.schema(schema).json(f"{folder}/{name}.json") for name, schema in SCHEMAS.items()}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv_parts(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Sharded CSV files with header lines."""
    return spark.read.schema(schema).option("header", True).csv(pattern)


def write_csv_parts(df: DataFrame, path: str, rows: int) -> None:
    """CSV files of at most `rows` rows each, with header lines."""
    df.write.option("header", True).option("maxRecordsPerFile", rows).mode("overwrite").csv(path)


def write_parquet(frames: dict[str, DataFrame], folder: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def replace_atomically(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write beside the target and swap by rename; the old data come back if the swap fails."""
    spark = df.sparkSession
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, mark = path.rstrip("/"), uuid.uuid4().hex
    stage, old = Path(f"{target}.new-{mark}"), Path(f"{target}.old-{mark}")
    df.write.format(fmt).save(stage.toString())
    fs = stage.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(Path(target))
    if had and not fs.rename(Path(target), old):
        raise OSError(f"cannot move {target}")
    if not fs.rename(stage, Path(target)):
        if had:
            fs.rename(old, Path(target))
        raise OSError(f"cannot replace {target}")
    if had:
        fs.delete(old, True)


def read_sql_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, text, sha256) of whole SQL files."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("sha256"))


def publish_bundle(frames: dict[str, DataFrame], folder: str, checks: dict[str, DataFrame], key: str = "task_id") -> None:
    """Validate, then overwrite the partitions of the tasks at hand; any row of a check stops the publication."""
    bad = {name: df.limit(5).collect() for name, df in checks.items()}
    if found := {k: v for k, v in bad.items() if v}:
        raise ValueError(f"bundle is not valid: {found}")
    for name, df in frames.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{folder}/{name}")


def task_index(spark: SparkSession, folder: str, name: str, key: str = "task_id") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}").select(key).distinct()


def asset_id(source: str, schema: str, kind: str, name: str):
    return F.concat_ws(":", F.lit(source), F.lit(schema), F.lit(kind), F.lit(name))


def catalog_facts(spark: SparkSession, sf_dir: str, names: list[str], source: str = "local", schema: str = "main") -> tuple[DataFrame, DataFrame]:
    """(objects, columns) of Parquet tables, from their footers."""
    objects, columns = [], []
    for n in names:
        asset = f"{source}:{schema}:TABLE:{n}"
        objects.append(("run", asset, source, schema, n, "TABLE", None, True, False, [], "OK", None))
        for i, f in enumerate(spark.read.parquet(f"{sf_dir}/{n}.parquet").schema.fields):
            columns.append((asset, f"{asset}:COLUMN:{f.name}", f.name, i + 1, f.dataType.simpleString(), None, None, None, f.nullable, None, None))
    return spark.createDataFrame(objects, SCHEMAS["objects"]), spark.createDataFrame(columns, SCHEMAS["columns"])
