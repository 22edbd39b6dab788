"""Operator 9: exact duplicates by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.llm.common import UPPER, ascii_lower, root_buckets, save, table, text_or_empty

#: Bytes of a block. A text of n bytes takes log2(n / BLOCK) rounds of pairing.
BLOCK = 4096
#: Copies of a row that are written out together.
COPIES = 1 << 12
#: Stands for a null doc_id within the operator.
NO_ID = -(2**63)


def _keyed(docs: DataFrame) -> DataFrame:
    norm = ascii_lower(text_or_empty())
    return docs.withColumn("__q_norm", norm).withColumn("__q_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__q_h", F.xxhash64("__q_norm"))


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """A row for each fixed-size block of each text; an empty text has one empty block."""
    rows = _keyed(docs).select("__q_id", "__q_h", F.encode("__q_norm", "UTF-8").alias("b"))
    last = F.greatest(F.floor((F.octet_length("b") - 1) / block), F.lit(0)).cast("int")
    cut = lambda i: F.substring(F.col("b"), i * block + 1, F.lit(block))
    return rows.select("__q_id", "__q_h", (last + 1).alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), last), cut)).alias("pos", "block"))


def _first_names(blocks: DataFrame) -> DataFrame:
    """Give each block the place of its first occurrence, which only equal blocks share.

    The texts of blocks that occur once need no second look: only the others are joined back.
    The join has one more key than the aggregation, so that Spark deals both sides anew
    and can split the partition of a hot block.
    """
    me = F.struct("__q_id", "__q_h", "pos")
    odd = F.pmod(F.octet_length("block"), F.lit(7))
    twice = blocks.groupBy("block").agg(F.min(me).alias("rep"), F.count("*").alias("k")).where("k > 1").select("block", "rep", odd.alias("odd"))
    out = blocks.withColumn("odd", odd).join(twice, ["block", "odd"], "left")
    return out.select("__q_id", "__q_h", "n", "pos", F.coalesce("rep", me).alias("rep"))


def _integers(rows: DataFrame, keys: list[Column], buckets: int) -> DataFrame:
    """Replace ``keys`` by an integer name: sorted within hashed buckets, bucket * 2^32 + rank."""
    named = rows.select("*", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    cols = [f"k{i}" for i in range(len(keys))]
    distinct = named.select(*cols).distinct().withColumn("bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*cols)).cast("long")
    names = distinct.select(*[F.col(c).alias(f"n{c}") for c in cols], (F.shiftleft("bucket", 32) + rank).alias("name"))
    on = None
    for c in cols:
        same = F.col(c).eqNullSafe(F.col(f"n{c}"))
        on = same if on is None else on & same
    return named.join(names, on).drop(*cols, *[f"n{c}" for c in cols])


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each (doc_id, text): ``level`` and ``name``, equal for equal texts alone.

    Blocks of one size get integer names; adjacent names are paired and named again, until
    one name stands for the text. Rounds: the logarithm of the longest text's blocks.
    """
    size = F.octet_length(text_or_empty())
    longest, many = docs.agg(F.max(F.ceil(size / block)), F.sum(F.ceil(size / block) + 1)).first()
    buckets, left = root_buckets(int(many or 0)), max(1, int(longest or 1))
    first = save(_first_names(_blocks(docs, block)), "block-names")
    rows = save(_integers(first, [F.col("rep")], buckets).select("__q_id", "__q_h", "n", "pos", "name").distinct(), "names-0")
    done, level = None, 0
    while True:
        ready = rows.where("n = 1").select("__q_id", "__q_h", F.lit(level).alias("level"), "name")
        done = ready if done is None else done.unionByName(ready)
        if left <= 1:
            return done
        pairs = (
            rows.where("n > 1")
            .groupBy("__q_id", "__q_h", F.floor((F.col("n") + 1) / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("r"))
        )
        level, left = level + 1, (left + 1) // 2
        rows = save(_integers(pairs, [F.col("l"), F.col("r")], buckets).select("__q_id", "__q_h", "n", "pos", "name"), f"names-{level}")


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row
    with the largest doc_id of a group stays (a null doc_id is the smallest); of rows alike
    in doc_id and text one stays. Other columns are not looked at. An empty table gives no rows; a very long text is blocks
    like those of any other.
    """
    ids = identities(docs, block)
    # The same doc_id and text may come in many rows: they are counted before any join.
    rows = _keyed(docs).select("__q_id", "__q_h", F.sha2("__q_norm", 256).alias("sha")).groupBy("__q_id", "__q_h", "sha").agg(F.count("*").alias("copies"))
    rows = save(rows.join(ids, ["__q_id", "__q_h"]), "identities")
    stats = rows.groupBy("level", "name").agg(F.sum("copies").alias("group_size"), F.max("__q_id").alias("keep"), F.min("sha").alias("sha"))
    out = rows.join(stats, ["level", "name", "sha"])
    nullable = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    # In two steps, so that no row makes a list of all its copies.
    out = out.withColumn("__q_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    upto = F.least(F.col("copies") - F.col("__q_part") * COPIES, F.lit(COPIES))
    out = out.withColumn("__q_nth", F.explode(F.sequence(F.lit(1).cast("long"), upto.cast("long")))).withColumn("copy", F.col("__q_part") * COPIES + F.col("__q_nth"))
    return out.select(
        nullable("__q_id").alias("doc_id"),
        nullable("keep").alias("keep_id"),
        "group_size",
        ((F.col("__q_id") == F.col("keep")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text, with all their columns."""
    kept = exact_groups(docs, block).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__q_id"), F.col("text_sha256").alias("__q_sha"))
    rows = docs.withColumn("__q_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__q_sha", F.sha2(ascii_lower(text_or_empty()), 256))
    return rows.join(kept, ["__q_id", "__q_sha"], "left_semi").dropDuplicates(["__q_id", "__q_sha"]).drop("__q_id", "__q_sha")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = {
    "op9_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)"""
}
QUERIES = {"op9_exact_dedup": op9_exact_dedup}
