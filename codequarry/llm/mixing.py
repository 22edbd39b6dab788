"""Operator 1: mixing sources to target weights, in fixed-length blocks.

The words of a source, in a fixed order of its documents, are cut into blocks of one
length. The mix is a list of output shards, each a list of slots, and a slot takes one block.

For each shard, the number of slots of each source is drawn from the multinomial law of the targets:
each slot's seeded uniform names a source. The totals of independent draws stray from the targets, and
could ask for a block more often than the limit allows. So a source drawn more often than its target
asks for gives slots back, from all shards in proportion, and these are redrawn, through a Feistel
permutation, among the sources that lack blocks. Then the counts of each shard hand out draws: draw d of a
source maps to a block through that source's own pseudorandom permutation of block indices, a new one
for each pass over the source, and blocks are joined to slots by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.llm.common import SPACE_CHARS, SPACE_CLASS, count_up, count_words, discard, root_buckets, running_start, save, table, text_or_empty, with_feistel

BLOCK_WORDS = 64
#: Sources of a mix, at most.
SOURCES = 100_000
SHARDS = 64
SEED = 10
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK_WORDS) -> DataFrame:
    """A row for each source: source, source_no, source_size, target, blocks, draws, first_draw.

    ``sizes`` has source and size. Sources by code point, null last, take ``weights`` in
    turn. Together they get ``share`` of all sizes, in proportion to their weights; a target
    stops at ``most`` times its source's size, and what is over goes to the others by
    weight. That is the level L with sum(min(most * size, L * weight)) = share * total: sorted
    by most * size / weight, L is the largest of the levels that remain once the sources
    before each have their all. There is one row for each source, so the windows over all
    sources stay as small as the list of sources.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("source_no", F.row_number().over(order))
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int")))
    all_rows = Window.partitionBy()
    filled = Window.orderBy(F.col("source_size") * most / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    had, had_w = F.coalesce(F.sum("source_size").over(filled), F.lit(0)) * most, F.coalesce(F.sum("w").over(filled), F.lit(0.0))
    by = by.withColumn("level", (F.sum("source_size").over(all_rows) * share - had) / (F.sum("w").over(all_rows) - had_w))
    by = by.withColumn("target", F.least(F.col("source_size") * most, F.max("level").over(all_rows) * F.col("w")))
    # Whole passes over the source, then as many blocks as come nearest to the rest.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round((F.col("target") - passes * F.col("source_size")) / block)
    by = by.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    by = by.withColumn("draws", (passes * F.col("blocks") + F.least(rest, F.col("blocks"))).cast("long"))
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("first_draw", F.coalesce(F.sum("draws").over(before), F.lit(0)).cast("long")).withColumn("all_draws", F.sum("draws").over(all_rows))
    return by.select("source", "source_no", "source_size", "target", "blocks", "draws", "first_draw", "all_draws")


def _named(x: Column, starts: list[int]) -> Column:
    """The last place of the ascending list ``starts`` whose value is at most x, by bisection. The list has a value for each source."""
    bounds = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    span = F.struct(F.lit(0).alias("low"), F.lit(len(starts) - 1).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["low"] + acc["high"] + 1, 1)
        up = F.get(bounds, mid) <= x
        return F.struct(F.when(up, mid).otherwise(acc["low"]).alias("low"), F.when(up, acc["high"]).otherwise(mid - 1).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(starts).bit_length()))), span, halve, lambda acc: acc["low"])


def shard_counts(targets: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """source_no, shard, n: slots of each source in each shard, with source_no, blocks and first, the draws of earlier shards.

    ``targets`` has source_no, blocks, draws, first_draw, all_draws; of these, a row for each source
    is held by the driver. Shards are of one length, but for the last. Each source gets ``draws`` in all.
    """
    spark = targets.sparkSession
    rows = sorted(targets.select("source_no", "blocks", "draws", "first_draw", "all_draws").limit(SOURCES + 1).collect())
    if len(rows) > SOURCES:
        raise ValueError(f"a mix of more than {SOURCES} sources; the driver holds a row for each")
    if not rows:
        return spark.createDataFrame([], "source_no int, shard int, n long, blocks long, first long")
    total = rows[0]["all_draws"]
    length = max(1, -(-total // shards))
    place = F.col("place")
    slots = count_up(spark.createDataFrame([(total,)], "total long"), "total", "place")
    drawn = _named(F.pmod(F.xxhash64(F.lit(seed), place), F.lit(max(1, total))), [r["first_draw"] for r in rows])
    drawn = slots.select(F.get(F.array(*[F.lit(r["source_no"]) for r in rows]), drawn).alias("source_no"), F.floor(place / length).cast("int").alias("shard"))
    # From here on there are at most ``shards`` rows for each source.
    first = save(drawn.groupBy("source_no", "shard").agg(F.count("*").alias("n")), "shard-draws")
    quota = spark.createDataFrame([(r["source_no"], r["draws"], r["blocks"]) for r in rows], "source_no int, draws long, blocks long")
    up_to, all_of = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("source_no")
    of = first.join(quota, "source_no").withColumn("upto", F.sum("n").over(up_to)).withColumn("got", F.sum("n").over(all_of))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    share = lambda c: F.floor(c * wide("draws") / wide("got")).cast("long")
    stays = F.when(F.col("got") <= F.col("draws"), F.col("n")).otherwise(share(wide("upto")) - share(wide("upto") - wide("n")))
    of = save(of.withColumn("stays", stays).select("source_no", "shard", "n", "stays"), "shard-kept")
    before = lambda *by: Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    begin = lambda c, *by: F.coalesce(F.sum(c).over(before(*by)), F.lit(0)).cast("long")
    free = of.groupBy("shard").agg(F.sum(F.col("n") - F.col("stays")).alias("free")).withColumn("begin", begin("free", "shard"))
    lack = quota.join(of.groupBy("source_no").agg(F.sum("n").alias("got")), "source_no", "left")
    lack = lack.select("source_no", F.greatest(F.col("draws") - F.coalesce("got", F.lit(0)), F.lit(0)).alias("lack")).withColumn("begin", begin("lack", "source_no"))
    many = free.agg(F.coalesce(F.sum("free"), F.lit(0))).first()[0]
    seats = with_feistel(count_up(free, "free", "i"), "index", F.col("begin") + F.col("i"), F.lit(max(1, many)), F.lit(seed + 1)).select("shard", "index")
    calls = count_up(lack, "lack", "i").select("source_no", (F.col("begin") + F.col("i")).alias("index"))
    again = seats.join(calls, "index").groupBy("source_no", "shard").agg(F.count("*").alias("n"))
    n = of.select("source_no", "shard", F.col("stays").alias("n")).unionByName(again).groupBy("source_no", "shard").agg(F.sum("n").alias("n")).where("n > 0")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    out = save(n.withColumn("first", earlier).join(quota.select("source_no", "blocks"), "source_no"), "shard-counts")
    discard(first)
    discard(of)
    return out


def mix_slots(targets: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: a row for each slot, with source_no, shard, block and pass (0, 1, ..).

    ``block`` is coalesced so that no filter on null blocks is made of a join by it: that would walk each permutation twice.
    """
    counts = shard_counts(targets, shards, seed).select("source_no", "shard", "blocks", "first", "n")
    drawn = count_up(counts, "n", "j").withColumn("d", F.col("first") + F.col("j"))
    n = F.col("blocks")
    drawn = drawn.withColumn("pass", F.floor(F.col("d") / n).cast("long"))
    drawn = with_feistel(drawn, "block", F.pmod(F.col("d"), n), n, F.xxhash64(F.lit(seed), "source_no", "pass"))
    return drawn.select("source_no", "shard", F.coalesce("block", F.lit(-1).cast("long")).alias("block"), "pass")


def source_streams(docs: DataFrame, targets: DataFrame, buckets: int, extra: list[str]) -> DataFrame:
    """Each document's place in its source's stream of words: source_no, start; with ``extra`` columns.

    ``docs`` has doc_id, source, size. Of rows alike in doc_id and size none goes before the
    other in a fixed order. Spark splits the hot source's part of the join.
    """
    named = docs.join(targets.select(F.col("source").alias("__q_source"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("__q_source"))).drop("__q_source")
    return running_start(named, ["source_no"], ["doc_id", "size", *extra], "size", buckets, "start", "place")


def pieces(streams: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The parts of documents in each block: block, from_word (in the document), n_words.

    A document without words keeps one row with a null block.
    """
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    rows = streams.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return rows.withColumn("from_word", begin - F.col("start")).withColumn("n_words", end - begin)


def mix(docs: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, extra: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The pieces of all documents by block, and the slots of the mix that draw those blocks.

    ``docs`` has doc_id, source, size (words), and the ``extra`` columns that tell rows
    with the same doc_id apart. Join both by source_no and block for the mix itself. Null
    sources are one source, the last; rows may repeat; an empty table mixes to nothing. A very
    long text has a piece for each block it reaches into.
    """
    extra = extra or []
    targets = save(source_targets(docs.select("source", "size"), block=block), "targets")
    streams = source_streams(docs, targets, root_buckets(docs.count()), extra)
    return pieces(streams, block), mix_slots(targets, shards, seed)


def taken_words(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED, extra: list[str] | None = None, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), n_shards (that take any).

    ``docs`` as for mix(). Documents without words, null texts among them, take nothing. Rows alike in doc_id
    and ``extra`` are documents of their own. At most 64 shards.
    """
    if shards > 64:  # a shard is a bit of a long
        raise ValueError("taken_words() tells apart 64 shards at most")
    parts, slots = mix(docs, block, shards, seed, extra)
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), shard)")
    # The hint: Spark takes the slots for few, as it can't tell how many rows count_up() makes, and would broadcast them.
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"), F.bit_or(bit).alias("bits")).hint("merge")
    keys = ["source_no", "__q_bucket", "place"]
    got = parts.join(times, ["source_no", "block"], "left").groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")],
        F.coalesce(F.sum(F.col("times") * F.col("n_words")), F.lit(0)).cast("long").alias("taken"),
        F.coalesce(F.bit_count(F.bit_or("bits")), F.lit(0)).cast("long").alias("n_shards"),
    )
    return got.select("doc_id", "size", "source_size", "target", "taken", "n_shards")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null texts have none), __q_h of each row, saved, so that texts are read and counted once.
    Other columns are left out; an empty table stays empty."""
    return save(docs.select("doc_id", "source", count_words(text_or_empty()).alias("size"), F.xxhash64("text").alias("__q_h")), "sizes")


def taken_runs(docs: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """__q_id, __q_h2, __q_turn2 (of rows alike in both), __q_runs: for each document of which the mix takes any,
    the runs (from_word, n_words, times) of neighbouring pieces that are taken equally often."""
    parts, slots = mix(sized(docs), block, shards, seed, ["__q_h"])
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times")).hint("merge")
    keys = ["source_no", "__q_bucket", "place"]
    drawn = parts.select(*keys, "block", "doc_id", "__q_h", "from_word", "n_words").join(times, ["source_no", "block"])
    # A document's pieces alone are in order: as many as its length asks for.
    order = Window.partitionBy(*keys).orderBy("from_word")
    goes_on = (F.lag("times").over(order) == F.col("times")) & (F.lag(F.col("from_word") + F.col("n_words")).over(order) == F.col("from_word"))
    run = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order)
    runs = drawn.withColumn("run", run).groupBy(*keys, "run").agg(
        F.first("doc_id").alias("__q_id"), F.first("__q_h").alias("__q_h2"), F.min("from_word").alias("from_word"), F.sum("n_words").alias("n_words"), F.first("times").alias("times")
    )
    runs = runs.groupBy(*keys).agg(F.first("__q_id").alias("__q_id"), F.first("__q_h2").alias("__q_h2"), F.array_sort(F.collect_list(F.struct("from_word", "n_words", "times"))).alias("__q_runs"))
    # Rows alike in doc_id and text differ in place alone; their runs are joined in turn.
    turn = Window.partitionBy("__q_id", "__q_h2").orderBy(*keys)
    return runs.select("__q_id", "__q_h2", F.row_number().over(turn).alias("__q_turn2"), "__q_runs")


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix as rows with the columns of ``docs``: what it takes of each document, in one row for
    each run of its blocks that is taken equally often, as many times as the mix takes it.

    Neighbouring pieces of a document are put together again, so a document that the mix
    takes whole stays whole. text holds the run's words, n_chars (if there is such a column) its length;
    the other columns, whatever their names, are the document's. Documents of which nothing is drawn, null and
    empty texts among them, are not in the mix; an empty table mixes to nothing. The words of a
    text are parted once, however many runs it has.
    """
    rows = docs.withColumn("__q_h", F.xxhash64("text"))
    rows = rows.withColumn("__q_turn", F.row_number().over(Window.partitionBy("doc_id", "__q_h").orderBy(F.col("source").asc_nulls_last())))
    same = F.col("doc_id").eqNullSafe(F.col("__q_id")) & (F.col("__q_h") == F.col("__q_h2")) & (F.col("__q_turn") == F.col("__q_turn2"))
    out = rows.join(taken_runs(docs, block, shards, seed).hint("merge"), same)
    # Generators, so that the optimizer leaves the expression where it is: in the lambda below, it would run for each run.
    units = F.regexp_extract_all("text", F.lit(f"{SPACE_CLASS}*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    out = out.withColumn("__q_units", F.explode(F.array(units)))
    n = F.size("__q_units")
    piece = lambda r: F.when((r["from_word"] == 0) & (r["n_words"] == n), F.col("text")).otherwise(
        F.ltrim(F.array_join(F.slice("__q_units", (r["from_word"] + 1).cast("int"), r["n_words"].cast("int")), ""), F.lit(SPACE_CHARS))
    )
    out = out.withColumn("__q_run", F.explode(F.transform("__q_runs", lambda r: F.struct(piece(r).alias("text"), r["times"].alias("times")))))
    rest = [c for c in docs.columns if c != "text"]
    out = out.select(*rest, F.col("__q_run")["text"].alias("text"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("__q_run")["times"])).alias("__q_copy"))
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(sized(table(spark, sf_dir, "documents")), extra=["__q_h"])


QUERIES = {"op1_source_mixing": op1_source_mixing}
