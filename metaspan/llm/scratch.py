"""Places and settings the operators share: written tables that cut lineage, and shipping of this package."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows per Arrow batch: bounds a Python worker's memory when texts are long.
ARROW_ROWS = "512"
#: Spark's setting by which a finished query's shuffle files go.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors once per application, and bound the Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = Path(tempfile.mkdtemp(prefix="metaspan-ship-")) / "metaspan_code.zip"  # Spark's file server hands it out
    path.write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def ship_file(spark: SparkSession, path: str) -> str:
    """Hand a file of the driver's machine out to all executors, once per application; its name there is for shipped()."""
    key = f"{spark.sparkContext.applicationId} {path}"
    if key not in _SHIPPED:
        spark.sparkContext.addFile(path)
        _SHIPPED.add(key)
    return os.path.basename(path)


def shipped(name: str) -> str:
    """Where an executor keeps a file that ship_file handed out."""
    return SparkFiles.get(name)


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set, a folder of this machine serves a session
    that runs on this machine alone; a cluster without a shared folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "metaspan-scratch")
    return found.rstrip("/")


_PLACES: dict[int, tuple[DataFrame, str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and a lost executor costs nothing.

    The shuffles behind it leave the executors' disks as soon as it stands, rather than when the driver next collects
    garbage. The files go when release() is told that nothing reads them any more, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/metaspan-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    hadoop, fs = _place(spark, path)
    fs.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[id(out)] = (out, path)
    return out


def _place(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(*frames: DataFrame | None) -> None:
    """Delete written tables that no later plan reads."""
    for df in frames:
        if df is not None and (kept := _PLACES.pop(id(df), None)):
            hadoop, fs = _place(df.sparkSession, kept[1])
            fs.delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
