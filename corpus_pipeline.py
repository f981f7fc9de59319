"""A training-corpus pipeline of five stages over `documents`; each calls one operator of metaspan.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Extra
columns pass through. Null texts count as empty. The stages work alike on an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaspan.llm import bpe, jaccard_join, pfair_mix, pu_quality, suffix_dedup
from metaspan.llm.scratch import prepare, written

#: Near copies: five-word shingles, similarity 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects (score below 0.3) go."""
    prepare(spark)
    model = pu_quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return pu_quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id stays (null last; of one doc_id the first read).

    Every row is a document of its own: where rows share a doc_id, or have none, rows are known by their place in a written
    copy of the table and compared by their texts like all others. Rows without words link with nothing and stay.
    """
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():  # ids name the rows
        found = written(jaccard_join.jaccard_components(docs.select("doc_id", "text"), SHINGLE, PERCENT), "groups")
        return docs.join(found.filter("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    keyed = written(docs.select(F.monotonically_increasing_id().alias("place"), F.struct(*docs.columns).alias("row")), "keyed")
    texts = keyed.select(F.col("place").alias("doc_id"), F.col("row.text").alias("text"))
    found = written(jaccard_join.jaccard_components(texts, SHINGLE, PERCENT).select(F.col("doc_id").alias("place"), "component_id"), "groups")
    many = found.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select("component_id")
    members = found.join(many, "component_id").join(keyed.select("place", F.col("row.doc_id").alias("id")), "place")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "place")
    first = members.groupBy("component_id").agg(F.min(order).alias("first")).select("component_id", F.col("first.place").alias("place"))
    gone = members.join(first, ["component_id", "place"], "left_anti").select("place")
    return keyed.join(gone, "place", "left_anti").select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a 200-byte string that starts anywhere else is cut out of text; n_chars follows. No row goes."""
    out = suffix_dedup.remove_repeats(docs, as_text=True)
    columns = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come in the order of the Pfair schedule: by file, and by row inside a file."""
    return pfair_mix.in_order(pfair_mix.mix(docs), docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as token ids, with their number and digests."""
    return bpe.encode_texts(docs, bpe.default_path())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("mixing sources", mixing),
    ("BPE encoding", encoding),
]
#: SQL can express neither the classifier nor the suffix arrays; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
