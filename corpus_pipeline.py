"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and returns documents with the columns it was given;
the last returns the pieces of the packed sequences. ``run`` writes every stage's rows and
reads them again, so a lost executor repeats part of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.decontaminate import find_leaks
from basketlens.llm.jaccard_join import jaccard_classes
from basketlens.llm.packing import pack_documents
from basketlens.llm.quality import classify
from basketlens.llm.secret_scan import redact, scan_secrets
from basketlens.llm.tables import few, table
from basketlens.sources.scratch import written


def _columns(frame: DataFrame, like: DataFrame) -> DataFrame:
    return frame.select(*[F.col(f"`{c}`") for c in like.columns])


def _without(docs: DataFrame, unwanted: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text key are in ``unwanted`` (doc_id, text_key)."""
    gone = few(written(unwanted.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct(), "unwanted"))
    return _columns(docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (_key() == F.col("_k")), "left_anti"), docs)


def _key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    judged = classify(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), table(spark, sf_dir, "labels"))
    return judged.where("accepted").select("_row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: the one with the smallest id.

    Of rows that repeat id and text one stays. Rows without an id come after all others of
    their class.
    """
    classes = written(jaccard_classes(docs), "classes")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    first = classes.where("class_id is not null").groupBy("class_id").agg(F.min(row).alias("first"))
    members = classes.join(first, "class_id")
    gone = members.where(~row.eqNullSafe(F.col("first")))
    kept = _without(docs, gone)
    repeated = written(
        classes.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_key"), "repeated"
    )
    if repeated.isEmpty():
        return kept
    again = few(repeated.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (_key() == F.col("_k"))
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _without(docs, find_leaks(plain, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; ``n_chars`` follows the text."""
    found = scan_secrets(docs)
    clean = found.withColumn("text", redact(F.col("text"), F.col("secret_spans")))
    if "n_chars" in docs.columns:
        hit = F.size("secret_spans") > 0
        clean = clean.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _columns(clean, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 2048 tokens."""
    packed = pack_documents(docs.select("doc_id", "text"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

ORACLE_SQL = None  # the classifier and the exact packing are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
