"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Rows of equal text form a group and stay in one shard. Items are packed largest first, each into the shard where the
dot product of its size vector with the residual capacity is highest. Sizes are shares of a shard's fair load, with
bytes weighted above words and rows, for the law that holds is ``bytes``.

Only a bounded number of items reaches the driver, whatever the input: groups above ``1/per_shard`` of a shard's load
stand for themselves (at most ``3 * shards * per_shard``), all others are dealt by hash into ``parcels`` items of many
groups. A group larger than a shard's fair load cannot stay whole; it is dealt by id into ``pieces`` items.

A null text counts as an empty one. Empty tables give an empty result; repeated ids get slots of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.staging import stage

#: Weights of bytes, words and rows in the dot product.
WEIGHTS = (8.0, 1.0, 1.0)
_GROUP = ["group", "text_crc32", "size"]


def pack(sizes: np.ndarray, shards: int, weights=WEIGHTS) -> np.ndarray:
    """The shard of each item; ``sizes`` has a row per item and a column per resource."""
    capacity = np.maximum(sizes.sum(axis=0) / shards, 1e-9)
    share = sizes / capacity
    residual = np.ones((shards, sizes.shape[1]))
    placed = np.zeros(len(sizes), np.int64)
    weighed = np.asarray(weights)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        best = int(np.argmax((residual * weighed) @ share[i]))
        placed[i] = best
        residual[best] -= share[i]
    return placed


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.char_length(text) - F.char_length(F.translate(text, " \t\n\r", ""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        (blank.cast("long") + 1).alias("words"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )


def assign(docs: DataFrame, shards: int = 16, parcels: int = 4096, per_shard: int = 64, pieces: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every document."""
    spark = docs.sparkSession
    rows = stage(
        _measured(docs).withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).cast("int")), "shard-rows"
    )
    groups = rows.groupBy(*_GROUP).agg(F.sum("words").alias("words"), F.count("*").alias("rows"))
    groups = stage(groups.withColumn("bytes", F.col("rows") * F.col("size")), "shard-groups")
    measures = ("bytes", "words", "rows")
    total = groups.agg(*(F.sum(m).alias(m) for m in measures)).first()
    fair = [max(1, total[m] or 0) / shards for m in measures]
    share = F.greatest(*(F.col(m) / F.lit(f) for m, f in zip(measures, fair, strict=True)))
    groups = groups.withColumn("share", share)
    own = groups.filter(F.col("share") > 1 / per_shard)

    split = own.filter("share > 1").select(*_GROUP)
    in_pieces = rows.join(F.broadcast(split), _GROUP).groupBy(*_GROUP, "piece").agg(
        (F.count("*") * F.first("size")).alias("bytes"), F.sum("words").alias("words"), F.count("*").alias("rows")
    )
    parcel = F.pmod(F.xxhash64("group"), F.lit(parcels)).cast("int")
    small = groups.filter(F.col("share") <= 1 / per_shard).groupBy(parcel.alias("parcel"))
    items = [
        *((None, r.group, r.text_crc32, r.size, -1, *(r[m] for m in measures)) for r in own.filter("share <= 1").collect()),
        *((None, r.group, r.text_crc32, r.size, r.piece, *(r[m] for m in measures)) for r in in_pieces.collect()),
        *((r.parcel, None, None, None, -1, *(r[m] for m in measures))
          for r in small.agg(*(F.sum(m).alias(m) for m in measures)).collect()),
    ]
    items.sort(key=lambda item: tuple((x is not None, x or 0) for x in item))
    sizes = np.array([item[5:] for item in items], float).reshape(len(items), 3)
    shard_of = pack(sizes, shards)
    placed = [(*item[:5], int(s)) for item, s in zip(items, shard_of, strict=True)]
    table = spark.createDataFrame(
        placed, "parcel int, group long, text_crc32 long, size long, piece int, shard int"
    )
    of_group = table.filter("group is not null").drop("parcel")
    split_group = of_group.filter("piece >= 0").withColumnRenamed("shard", "piece_shard")
    whole_group = of_group.filter("piece < 0").drop("piece").withColumnRenamed("shard", "group_shard")
    of_parcel = table.filter("parcel is not null").select("parcel", F.col("shard").alias("parcel_shard"))
    found = (
        rows.withColumn("parcel", parcel)
        .join(F.broadcast(whole_group), _GROUP, "left")
        .join(F.broadcast(split_group), [*_GROUP, "piece"], "left")
        .join(F.broadcast(of_parcel), "parcel", "left")
        .select(
            "doc_id", "size", "text_crc32", F.coalesce("group_shard", "piece_shard", "parcel_shard").alias("shard")
        )
    )
    return _numbered(found)


def _numbered(found: DataFrame) -> DataFrame:
    """Adds ``slot``: rows are counted per shard and bucket, so no task numbers a whole shard."""
    spark = found.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stage(found.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")), "shard-found")
    offsets, at = [], {}
    for r in found.groupBy("shard", "bucket").count().orderBy("shard", "bucket").collect():
        offsets.append((r["shard"], r["bucket"], at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["count"]
    base = spark.createDataFrame(offsets, "shard int, bucket int, base long")
    rank = F.expr("row_number() over (partition by shard, bucket order by doc_id, text_crc32)")
    return (
        found.withColumn("rank", rank)
        .join(F.broadcast(base), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"))
    )
