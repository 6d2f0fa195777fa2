"""Stages of the corpus pipeline. Each takes and returns whole documents: doc_id, text, lang, source, n_chars."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_words, shared_dir, table
from .mixing import mix
from .near_dedup import near_duplicates
from .pieces import encode
from .pii import pii_spans, redacted
from .quality import quality_rules


#: Columns that stages add and take away again; one of docs that is named alike keeps its values.
OWN = "_stage_"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row: its id and its text. Rows alike in both fare alike."""
    return docs.withColumn(_name(docs, "key"), _hash("doc_id", "text"))


def _hash(*names: str) -> Column:
    """A hash of columns in which a null and its place count, so that what moves from one column to another changes it."""
    return F.xxhash64(*[F.col(n).isNull() for n in names], *names)


def _name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    own = OWN + name
    while own.lower() in {c.lower() for c in docs.columns}:
        own = "_" + own
    return own


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject.

    Null and empty texts go, for want of words; null doc_id, lang or source stay what they are, and repeated rows stay or go
    together. Very long texts are judged whole. Other columns are kept, whatever their names. Empty input: no rows.
    """
    k = _name(docs, "key")
    keyed = _keyed(docs)
    judged = quality_rules(keyed.select(F.col(k).alias("id"), "text", "lang", "source")).where("kept")
    # Rows alike in id and text may differ in lang or source: one that is kept keeps them all.
    return keyed.join(judged.select(F.col("id").alias(k)).distinct(), k, "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest id, of several texts with that id that of least key.

    Rows are judged by their texts, whatever their ids: different texts under one id or under none stay, unless they are
    near copies. A row without an id represents its group only where none has one. Rows alike in id and text are one. Null and wordless
    texts are in no group and stay, one for each id. Very long texts are compared whole. Other columns are kept, whatever their names. Empty input: no rows.
    """
    k = _name(docs, "key")
    keyed = _keyed(docs)
    found = near_duplicates(keyed.select(F.col(k).alias("id"), "text")).select(F.col("id").alias("key"), "component_id").distinct()
    rows = keyed.select(F.col(k).alias("key"), "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    keep = found.join(rows, "key").groupBy("component_id").agg(first).select(F.col("first.key").alias(k)).distinct()
    return keyed.join(keep, k, "left_semi").dropDuplicates([k, "doc_id", "text"]).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the names of its kinds, and n_chars by the new lengths.

    Null texts stay null, with n_chars 0. Rows, repeated or not, are treated one by one, texts whole. Other columns are kept, whatever their names. Empty input: no rows.
    """
    own = _name(docs, "spans")
    clean = docs.withColumn(own, pii_spans(F.col("text"))).withColumn("text", redacted(F.col("text"), F.col(own)))
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and wordless texts are never taken. A null source is one of its own. After near_dedup no two rows are alike in id, text and
    source; elsewhere such rows share their copies, rounded up. Other columns are kept, whatever their names. Empty input: no rows.
    """
    k, c = _name(docs, "key"), _name(docs, "copies")
    keyed = docs.withColumn(k, _hash("doc_id", "text", "source"))
    taken = mix(keyed.select(F.col(k).alias("key"), "source", n_words(F.col("text")).alias("size"))).where("copies > 0")
    each = taken.groupBy(F.col("key").alias(k)).agg(F.ceil(F.sum("copies") / F.count("*")).cast("int").alias(c))
    return keyed.join(each, k).withColumn(c, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids: the text as SentencePiece ids. Null texts: null ids, no tokens.

    Long texts are encoded whole, repeated rows one by one. Other columns, whatever their names, are left out. Empty input: no rows.
    """
    coded = encode(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage before it is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
