"""Sharding by proportional stratified interleaving; the law that holds is `rows`: counts at most one apart.

In each source the rows are ranked by a seeded hash; a row's fractional rank is (rank + u) / n with u in [0, 1) a hash
of the source, so that sources of one row spread out as well. Sorting all rows by it interleaves the sources in
proportion, and contiguous cuts of the sorted list match the mixture. Ranks come from counts of hash buckets: no source,
however large, meets in one task. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RANK_BUCKETS, hash_bucket, materialize, position_in_group, text_or_empty

SHARDS, SEED = 8, 20240229


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard. Null text: size 1 and the CRC of no bytes.

    A null source is a stratum of its own; rows that are equal in doc_id are ordered by their size and CRC; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("stratum"),
                       (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
                       F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    # not xxhash64(doc_id) with Spark's own seed alone: the seed is part of the hashed value
    rows = materialize(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")).withColumn("bucket", hash_bucket(F.col("h"))), "shard-rows")
    order = [F.col("h"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    ranked = position_in_group(rows, ["stratum"], "bucket", order, "rank", "n")
    shift = F.pmod(F.xxhash64(F.lit(seed + 1), "stratum"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    ranked = ranked.withColumn("at", (F.col("rank") + shift) / F.col("n"))
    ranked = ranked.withColumn("slice", F.least(F.floor(F.col("at") * RANK_BUCKETS), F.lit(RANK_BUCKETS - 1)).cast("int"))
    ranked = materialize(ranked.drop("bucket"), "shard-ranks")
    placed = position_in_group(ranked, [], "slice", [F.col("at"), F.col("stratum"), F.col("rank")], "place", "rows")
    shard = F.expr(f"cast(place * {shards} div rows as int)")
    first = F.expr(f"(cast(place * {shards} div rows as long) * rows + {shards - 1}) div {shards}")
    return placed.select("doc_id", F.expr("if(stratum = 'n', null, substring(stratum, 2))").alias("source"), "size", "text_crc32",
                         F.lit("rows").alias("law"), shard.alias("shard"), (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return interleave(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
