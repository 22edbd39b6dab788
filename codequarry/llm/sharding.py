"""Operator 5: reproducible sharding through a Feistel permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import root_buckets, running_start, table, text_or_empty, with_feistel

SEED = 20


def number_rows(df: DataFrame, order: list[str], out: str = "row_no") -> DataFrame:
    """Add global row numbers 0..n-1 that depend on the rows alone, not on their partitions.

    ``order`` names columns that tell rows apart. Rows alike in all of them are numbered
    next to each other, in no fixed order among themselves.
    """
    n = df.count()
    one = df.withColumn("__q_one", F.lit(1).cast("long"))
    return running_start(one, [], order, "__q_one", root_buckets(n), out).drop("__q_one")


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = SEED) -> DataFrame:
    """Shuffle the rows of ``df`` reproducibly and deal them out to ``shards`` shards.

    Row number r goes to place p = feistel(r); its shard is p mod shards and its slot is
    p div shards. So shard sizes differ by one row at most, slots run from 0 without gaps,
    and both can be computed for any row number without reading a row. Null and empty
    values are values like any other; an empty table gives an empty table; very long texts move as they are. Rows alike in all of
    ``order`` are numbered in one task. Columns added: row_no, shard, slot, in place of columns of these names; the others stay as they are.
    """
    n = df.count()
    numbered = number_rows(df, order)
    placed = with_feistel(numbered, "__q_place", F.col("row_no"), F.lit(n), F.lit(seed))
    shard, slot = F.pmod(F.col("__q_place"), F.lit(shards)).cast("int"), F.floor(F.col("__q_place") / shards).cast("long")
    return placed.withColumn("shard", shard).withColumn("slot", slot).drop("__q_place")


def write_shards(df: DataFrame, path: str, order: list[str], shards: int, seed: int = SEED) -> None:
    """Write the shards as folders shard=0.., each sorted by slot within its files."""
    out = shard_rows(df, order, shards, seed)
    out.repartition(F.col("shard"), F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law ``rows``: counts at most one apart."""
    text = text_or_empty()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    return shard_rows(docs, ["doc_id", "size", "text_crc32"], 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op5_sharding": op5_sharding}
