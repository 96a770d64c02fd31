"""The corpus pipeline: documents filtered, deduplicated, decontaminated, redacted and packed.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and all but the
last return the columns of documents. Each result is written as Parquet below the folder in
``spark.checkpoint.dir`` and read again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import op4_pii, op5_jaccard, op6_quality, op9_packing, op10_decontamination
from faultline.llm.common import BROADCAST_BYTES, cut, release, shared_dir, small, table
from faultline.llm.queries import PATTERN, TOKENIZER

QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. The model is fitted on the documents
    of this input that have a label and are not held out; the scores cover all of them."""
    labels = table(spark, sf_dir, "labels")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    model = op6_quality.train(op6_quality.feature_rows(docs), labels, ids=ids)
    return op6_quality.keep_good(docs, model, QUALITY_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents: that of the smallest id. A document is a
    row's id and text, taken by its 64-bit hash, so texts that share an id are documents of their
    own and of equal rows one stays. Documents without words or without an id link with nothing and
    stay. Texts are not shuffled for this but those of equal rows, as long as the keys of the rows
    that go and of the equal ones can be broadcast."""
    key = f"key_{uuid.uuid4().hex}"
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.withColumn(key, F.when(doc_id.isNotNull(),
                                        F.xxhash64(doc_id, F.col("text").cast("string"))))
    classes = op5_jaccard.components(keyed.select(F.col(key).alias("doc_id"), "text"))
    linked = cut(classes.filter("component_id != doc_id")
                 .select(F.col("doc_id").alias(key), "component_id").distinct())
    roots = linked.select(F.col("component_id").alias(key), "component_id").distinct()
    ids = keyed.filter(F.col(key).isNotNull()).select(key, doc_id.alias("doc_id"))
    members = cut(linked.union(roots).join(ids, key).distinct())
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", key))[key].alias(key))
    extra = cut(members.select(key).join(first.select(key), key, "left_anti"))
    kept = keyed.join(small(extra, 16), key, "left_anti")
    again = cut(ids.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(key))
    release(spark)
    if again.count() * 16 > BROADCAST_BYTES:
        equal, others = kept.filter(F.col(key).isNotNull()), kept.filter(F.col(key).isNull())
    else:
        again = F.broadcast(again)
        equal, others = kept.join(again, key), kept.join(again, key, "left_anti")
    return equal.dropDuplicates([key]).select(*docs.columns).union(others.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    return op10_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal spans of the text replaced by their kind; n_chars follows."""
    redacted = op4_pii.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return redacted.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                               .otherwise(n_chars)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return op9_packing.pack(docs, TOKENIZER, PATTERN)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]

# Scores, tokens and packing have no SQL form; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
