"""The extension surface: user functions, table functions, providers of schemas and metadata, templates, graph patterns."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SchemaProvider(Protocol):
    """Columns of a table by its name, or None where it is not known."""

    def columns(self, table: str) -> list[str] | dict[str, str] | None: ...


class MetadataProvider(Protocol):
    """Fact tables by name, as sources.facts.SCHEMAS has them."""

    def facts(self) -> dict[str, DataFrame]: ...


class TemplateProvider(Protocol):
    """The relation behind a template call such as ref('x'), or None."""

    def relation(self, call: str) -> str | None: ...


class SparkCatalog:
    """Both providers over the tables and views of a Spark session."""

    def __init__(self, spark: SparkSession, database: str | None = None):
        self.spark, self.database = spark, database

    def columns(self, table: str) -> dict[str, str] | None:
        if not self.spark.catalog.tableExists(table):
            return None
        return {f.name: f.dataType.simpleString() for f in self.spark.table(table).schema.fields}

    def facts(self) -> dict[str, DataFrame]:
        from metaspan.sources.facts import SCHEMAS

        objects, columns = [], []
        for t in self.spark.catalog.listTables(self.database):
            schema = ".".join(t.namespace or []) or "session"
            kind = "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "TABLE"
            asset = f"spark:{schema}:{kind}:{t.name}"
            objects.append(("run", asset, "spark", schema, t.name, kind, t.description, True, False, [], "SUCCESS", None))
            for i, (c, ty) in enumerate((self.columns(t.name) or {}).items()):
                columns.append((asset, f"{asset}:COLUMN:{c}", c, i + 1, ty, None, None, None, True, None, None))
        return {"objects": self.spark.createDataFrame(objects, SCHEMAS["objects"]), "columns": self.spark.createDataFrame(columns, SCHEMAS["columns"])}


def render(text: str, provider: TemplateProvider) -> str:
    """Replace each `{{ call }}` that the provider knows by its relation; others stay."""
    return re.sub(r"\{\{(.*?)\}\}", lambda m: provider.relation(m.group(1).strip()) or m.group(0), text, flags=re.S)


_TAG = re.compile(r"\{%-?\s*(if|elif|else|endif)\b.*?%\}", re.S)


def variants(text: str, most: int = 64) -> list[str]:
    """All texts that the `{% if %}` arms of a template can give, in order of the arms; an if without else may give nothing.
    More than `most` are an error."""

    def parse(at: int) -> tuple[list[str], int, str]:
        """(texts, place behind the tag that ends them, that tag)."""
        texts = [""]
        while True:
            m = _TAG.search(text, at)
            texts = [x + text[at : m.start() if m else len(text)] for x in texts]
            if m is None or m.group(1) != "if":
                return texts, m.end() if m else len(text), m.group(1) if m else ""
            arms, at, tag, otherwise = [], m.end(), "if", False
            while tag not in ("endif", ""):
                otherwise = otherwise or tag == "else"
                some, at, tag = parse(at)
                arms += some
            texts = [x + a for x in texts for a in (arms if otherwise else [*arms, ""])]
            if len(texts) > most:
                raise ValueError(f"more than {most} variants")

    return list(dict.fromkeys(parse(0)[0]))


def register(spark: SparkSession) -> None:
    """Functions under their names: greater_of(a, b), the greater of two numbers, nulls aside; and the table function
    split_words(text), a row (place, word) per word."""
    from pyspark.sql.functions import pandas_udf, udtf

    @pandas_udf("double")
    def greater_of(a, b):
        import pandas as pd

        return pd.concat([a.astype("float64"), b.astype("float64")], axis=1).max(axis=1)

    class Words:
        def eval(self, text: str):
            for i, w in enumerate((text or "").split()):
                yield i, w

    spark.udf.register("greater_of", greater_of)
    spark.udtf.register("split_words", udtf(Words, returnType="place int, word string"))


def match_path(edges: DataFrame, hops: int, start: str = "true", end: str = "true") -> DataFrame:
    """GRAPH_TABLE's fixed-length pattern (a)-[]->(b)-[]->...: n0..n<hops> along edges(src, dst), with conditions on the first
    and the last node (named n0 and n<hops>); one join a hop, the start's condition first."""
    path = edges.select(F.col("src").alias("n0"), F.col("dst").alias("n1")).filter(start)
    for k in range(1, hops):
        path = path.join(edges.select(F.col("src").alias(f"n{k}"), F.col("dst").alias(f"n{k + 1}")), f"n{k}")
    return path.filter(end).select(*[f"n{k}" for k in range(hops + 1)])
