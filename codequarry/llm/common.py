"""Helpers that the operators of this folder share.

Columns these operators add to a caller's rows on the way start with ``__q_``,
so extra columns with ordinary names never clash with them.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space as the contracts define it, as a Java character class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir. Where that is unset, one of our own serves a
    single machine, as in tests; on a cluster, whose executors would not see it, that is an error."""
    if path := spark.conf.get("spark.checkpoint.dir", ""):
        return path
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="codequarry-"))
    return _own_dir[0]


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Within it, an action's shuffle files go as soon as the action ends."""
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
    except Exception as e:  # an older Spark has no such setting
        if "CONFIG" not in str(e).upper():
            raise
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def save(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return what reads it back.

    This cuts the lineage: what follows never recomputes what came before, also
    when executors are lost. The table stays until the application's folder goes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffle_cleanup(spark):
        (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["saved_path"] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that save() wrote; nothing may read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["saved_path"])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(c: Column | str = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(c: Column) -> Column:
    """The words of a text, runs of anything but white space."""
    bare = F.btrim(c, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def count_words(c: Column) -> Column:
    bare = F.btrim(c, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_CLASS + "+"))).cast("long")


def root_buckets(n: int) -> int:
    """So many buckets that both a bucket and the list of buckets have about sqrt(n) rows."""
    return max(1, math.isqrt(max(0, n - 1)) + 1)


def feistel_side(n: Column) -> Column:
    """The least a with a * a >= n, for whole n >= 0."""
    guess = F.floor(F.sqrt(n.cast("double"))).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.when(guess * guess >= n, guess).otherwise(guess + 1))


def _feistel_once(x: Column, side: Column, seed: Column, rounds: int) -> Column:
    halves = F.struct(F.floor(x / side).cast("long").alias("l"), F.pmod(x, side).cast("long").alias("r"))
    turn = lambda acc, k: F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + F.pmod(F.xxhash64(seed, k, acc["r"]), side), side).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), halves, turn, lambda acc: acc["l"] * side + acc["r"])


#: Steps of a walk. A square domain has at most 2 * sqrt(n) + 1 points from n on, so a step
#: leaves it with a probability of 1 - 2 / sqrt(n); for n < 900 this many steps visit them all.
WALK = 64


def with_feistel(df: DataFrame, out: str, x: Column, n: Column, seed: Column, rounds: int = 4) -> DataFrame:
    """Add ``out``: x under a permutation of 0..n-1. It is a Feistel network on the least square
    a * a >= n, which walks its cycle until the value is below n again. A walk that were
    not over after WALK steps would raise an error, never give a wrong value."""
    side, first, n_, seed_ = F.col("__q_side"), F.col("__q_first"), F.col("__q_n"), F.col("__q_seed")
    df = df.withColumn("__q_n", n.cast("long")).withColumn("__q_seed", seed).withColumn("__q_side", feistel_side(n_))
    df = df.withColumn("__q_first", _feistel_once(x, side, seed_, rounds))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda acc, _: F.when(acc < n_, acc).otherwise(_feistel_once(acc, side, seed_, rounds)))
    df = df.withColumn("__q_walked", F.when(first < n_, first).otherwise(walked))
    late = F.raise_error(F.lit("the walk did not end")).cast("long")
    return df.withColumn(out, F.when(F.col("__q_walked") < n_, F.col("__q_walked")).otherwise(late)).drop("__q_n", "__q_seed", "__q_side", "__q_first", "__q_walked")


def count_up(df: DataFrame, count: str, out: str) -> DataFrame:
    """Each row once for each of 0..count-1, in three levels, so that no row holds a long list and
    one row with a huge count is dealt out to all tasks."""
    level = 1024
    big = F.floor((F.col(count) - 1) / (level * level)).cast("long")
    df = df.where(F.col(count) > 0).withColumn("__q_a", F.explode(F.sequence(F.lit(0).cast("long"), big)))
    rest = F.col(count) - F.col("__q_a") * level * level
    mid = F.floor((F.least(rest, F.lit(level * level)) - 1) / level).cast("long")
    df = df.withColumn("__q_b", F.explode(F.sequence(F.lit(0).cast("long"), mid)))
    df = df.withColumn("__q_base", (F.col("__q_a") * level + F.col("__q_b")) * level).drop("__q_a", "__q_b")
    # A fixed number: by their size, Spark would put these few rows into one partition before they become many.
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    df = df.repartition(parts, *df.columns)
    last = F.least(F.col(count) - F.col("__q_base"), F.lit(level).cast("long")) - 1
    return df.withColumn("__q_c", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(out, F.col("__q_base") + F.col("__q_c")).drop("__q_base", "__q_c")


def running_start(df: DataFrame, keys: list[str], order: list[str], size: str, buckets: int, start: str, place: str | None = None) -> DataFrame:
    """Add ``start``: the sum of ``size`` over the rows before this one, for each value of ``keys``.

    The order is that of hashed buckets and of ``order`` within one, so no task ever holds
    more than a bucket of a key: first each bucket's own running sum, then the sums of whole
    buckets, of which a key has ``buckets`` at most. ``place`` gets the row's place in its bucket.
    """
    df = df.withColumn("__q_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    by = [*keys, "__q_bucket"]
    totals = df.groupBy(*by).agg(F.sum(size).alias("__q_total"))
    over = Window.partitionBy(*keys).orderBy("__q_bucket") if keys else Window.orderBy("__q_bucket")
    totals = totals.withColumn("__q_before", F.coalesce(F.sum("__q_total").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).drop("__q_total")
    inside = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("__q_in", F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    if place:
        df = df.withColumn(place, F.row_number().over(inside))
    return df.join(totals, by).withColumn(start, F.col("__q_before") + F.col("__q_in")).drop("__q_before", "__q_in", *([] if place else ["__q_bucket"]))
