"""Sharding as vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts form a group that stays together. The many small groups are gathered by
hash into bundles; a group that alone weighs more than a bundle is an item of its own. Only a group
of more bytes than a shard's share cannot stay whole: it is cut by the hash of its ids into parts
of about a bundle. Bundles, large groups and parts
are at most a fixed number of items per shard, whatever the size of the corpus, and go to the
driver as three sums each. There they are placed from large to small, each in the shard where the
dot product of its vector with the residual capacities is highest.

Tasks join the items back to the rows and number the rows of every shard from 0 without gaps.

Edge cases: a NULL text has no bytes and is one group, apart from empty texts only by its hash;
repeated rows are rows of their own; one row larger than a shard's share makes that shard larger;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import cut, number_within

ROW_BYTES = 16
# Bundles per shard; a group of more than the share of a bundle is an item of its own.
BUNDLES = 128
# How much each dimension counts in the dot product. Bytes lead, for they bound the files.
WEIGHTS = (1.0, 0.05, 0.05)


def text_tokens(text: Column) -> Column:
    """An estimate that needs no tokenizer: white space characters plus one, 0 without text."""
    spaces = F.length(text) - F.length(F.translate(text, " \t\n\r", ""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(spaces + 1).cast("long")


def place(items: np.ndarray, shards: int, weights=WEIGHTS) -> np.ndarray:
    """The shard of each item, a row of (bytes, tokens, rows). Items go from large to small to
    the shard with the highest weighted dot product of item and residual capacity."""
    items = np.asarray(items, float).reshape(-1, 3)
    share = np.maximum(items.sum(0) / shards, 1e-9)
    sizes = items / share
    residual = np.ones((shards, 3))
    out = np.zeros(len(items), np.int64)
    scale = np.array(weights)
    for i in np.lexsort((np.arange(len(items)), -(sizes * scale).sum(1))):
        out[i] = int(np.argmax(residual @ (sizes[i] * scale)))
        residual[out[i]] -= sizes[i]
    return out


def assign(documents: DataFrame, shards: int = 40, weights=WEIGHTS) -> DataFrame:
    """Per row: doc_id, size, tokens, text_crc32 and shard, without the texts."""
    spark = documents.sparkSession
    text = F.col("text").cast("string")
    rows = cut(documents.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        text_tokens(text).alias("tokens"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text, F.isnull(text)).alias("group")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundles = shards * BUNDLES
    share = max(total / bundles, 1)

    # At most ``bundles`` groups weigh more than the share of a bundle, and their parts are no more.
    large = (rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
             .filter(F.col("bytes") > share))
    parts = F.when(F.col("bytes") * shards <= total, 1).otherwise(
        F.least(F.ceil(F.col("bytes") / share), F.col("n"))).cast("long")
    large = spark.createDataFrame(large.select("group", parts.alias("parts")).collect(),
                                  "group long, parts long")
    part = F.pmod(F.xxhash64("doc_id", "size"), F.col("parts"))
    item = F.when(F.col("parts").isNull(), F.pmod("group", F.lit(bundles))).otherwise(
        F.pmod(F.xxhash64("group", part), F.lit(2**62)) + bundles)
    rows = rows.join(large, "group", "left").withColumn("item", item).drop("parts", "group")

    sums = (rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"),
                                     F.count(F.lit(1)).alias("n")).orderBy("item").collect())
    placed = place(np.array([(r.bytes, r.tokens, r.n) for r in sums]), shards, weights)
    shard_of = spark.createDataFrame([(r.item, int(s)) for r, s in zip(sums, placed)],
                                     "item long, shard int")
    return rows.join(shard_of, "item")


def shard(documents: DataFrame, shards: int = 40, weights=WEIGHTS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot and grown_shard, under the law that
    sizes are near equal."""
    rows = cut(assign(documents, shards, weights))
    numbered = number_within(rows, "shard", ["doc_id", "text_crc32", "size"], "slot", rows.count())
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(documents: DataFrame, path: str, shards: int = 40) -> None:
    """The rows of ``documents`` as Parquet, one folder per shard. Rows that share id and text
    go together."""
    keys = assign(documents, shards).select("doc_id", "text_crc32", "size", "shard").distinct()
    text = F.col("text").cast("string")
    keyed = (documents.withColumn("_crc", F.crc32(F.coalesce(text, F.lit(""))))
             .withColumn("_size", (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES)))
    same = (keyed["doc_id"].eqNullSafe(keys["doc_id"]) & (keyed["_crc"] == keys["text_crc32"])
            & (keyed["_size"] == keys["size"]))
    (keyed.join(keys.select("doc_id", "text_crc32", "size", F.col("shard").alias("_shard")), same)
     .select(*(keyed[c] for c in documents.columns), "_shard")
     .repartition("_shard", F.pmod(F.xxhash64(keyed["doc_id"]), F.lit(16)))
     .write.partitionBy("_shard").parquet(path))
