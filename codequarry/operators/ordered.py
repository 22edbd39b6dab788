"""Ranks, running sums, islands, floor quantiles, as-of and interval joins.

What goes over a key in order would sort all of it in one task. So keys with very many rows
are cut into parts by quantiles of the order, and what a part needs from those before it is carried over.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows from which on one key is too much for a task that sorts it, and into how many parts such keys are cut.
HOT_ROWS, PARTS = 1_000_000, 64
#: Bytes of a row, about.
ROW_BYTES = 64


def input_bytes(df: DataFrame) -> int:
    """What the planner takes for the size of all tables under ``df``, as they are stored."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> Column | None:
    """Whether a row is of one of the largest keys with over ``hot_rows`` rows; None where there is no such key.

    PARTS keys are looked at, at most: any other has less than 1 / PARTS of all rows. Tables of less than ROW_BYTES for
    each of ``hot_rows`` are not counted: one task can order all of them.
    """
    if input_bytes(df) < ROW_BYTES * hot_rows:
        return None
    found = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).orderBy(F.desc("_n")).limit(PARTS).collect()
    hit = [reduce(and_, [F.col(k).eqNullSafe(F.lit(r[k])) for k in keys], F.lit(True)) for r in found]
    return reduce(or_, hit) if hit else None


def in_parts(df: DataFrame, keys: list[str], order: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """``df`` with _part: 0, but for hot keys, which are cut by quantiles of ``order`` (a number or a time) into PARTS parts that
    follow one another. Equal values share a part. None where no key is hot."""
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return None
    bounds = df.where(hot).agg(F.percentile_approx(order, [k / PARTS for k in range(1, PARTS)], 10_000)).first()[0] or []
    part = reduce(add, [(F.col(order) >= F.lit(b)).cast("int") for b in sorted(set(bounds))], F.lit(0))
    return df.withColumn("_part", F.when(hot, F.coalesce(part, F.lit(0))).otherwise(0))


def _same(keys: list[str], other: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys]


def _with_parts(df: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with what ``sums`` has for its key and part."""
    own = [*keys, "_part"]
    return df.join(sums.withColumnsRenamed({k: f"_s_{k}" for k in own}), _same(own, "_s_")).drop("_part", *[f"_s_{k}" for k in own])


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of a key up to this one. ``order`` tells its rows apart.

    A hot key is summed part by part, in any task; sums of whole parts, PARTS a key, are carried over.
    """
    upto = lambda *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = in_parts(df, keys, order, hot_rows)
    if parts is None:
        return df.withColumn(out, F.sum(value).over(upto(*keys)))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum")).withColumn("_carry", F.sum("_sum").over(earlier)).drop("_sum")
    inside = parts.withColumn("_in", F.sum(value).over(upto(*keys, "_part")))
    done = _with_parts(inside, sums, keys)
    return done.withColumn(out, F.when(F.col("_in").isNull(), F.col("_carry")).otherwise(F.coalesce("_carry", F.lit(0)) + F.col("_in"))).drop("_in", "_carry")


def islands(df: DataFrame, keys: list[str], at: str, reach: int, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``out``: the first place of the island that a row stands on. Places of a key over ``reach`` apart, with none between them, are on different islands.

    Of a hot key, each part finds the gaps within it; where parts begin and end tells the gaps between them.
    """
    parts = in_parts(df, keys, at, hot_rows)
    by = [*keys, "_part"] if parts is not None else keys
    rows = df if parts is None else parts
    w = Window.partitionBy(*by).orderBy(at)
    gap = F.col(at) - F.lag(at).over(w) > reach
    rows = rows.withColumn("_gap", F.when(F.coalesce(gap, F.lit(parts is None)), F.col(at)))
    inside = F.max("_gap").over(w.rangeBetween(Window.unboundedPreceding, 0))
    if parts is None:
        return rows.withColumn(out, inside).drop("_gap")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.max("_gap").alias("_last"))
    ends = ends.withColumn("_to", F.max("_hi").over(earlier)).withColumn("_first", F.when(F.col("_to").isNull() | (F.col("_lo") - F.col("_to") > reach), F.col("_lo")))
    ends = ends.withColumn("_begin", F.coalesce("_first", F.max(F.coalesce("_last", "_first")).over(earlier)))
    done = _with_parts(rows.withColumn("_in", inside), ends.select(*by, "_begin"), keys)
    return done.withColumn(out, F.coalesce("_in", "_begin")).drop("_in", "_begin", "_gap")


def numbered(df: DataFrame, keys: list[str], order: str, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``out``: a row's number in its key, from 1, by ``order``, which tells rows apart. A hot key is numbered part by part."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", out, hot_rows).drop("_one")


def floor_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, tuple[int, int]], hot_rows: int = HOT_ROWS) -> DataFrame:
    """keys, n, and for each name the element floor(n * num / den) (0-based) of the sorted values that are not null.

    Rows are dealt by key once, and counting equal values, running sums over them and the last step all run where they
    are. With a hot key, values are counted before any row moves, and the running sums go part by part.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    hot = hot_keys(rows, keys, hot_rows) is not None
    counts = (rows if hot or not keys else rows.repartition(*keys)).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    at = lambda num, den: F.floor(F.col("n") * num / den)
    picks = [F.max(F.when((F.col("_end") > at(*f)) & (F.col("_end") - F.col("_c") <= at(*f)), F.col("_v"))).alias(name) for name, f in shares.items()]
    if not hot:
        every, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        ends = counts.withColumn("n", F.sum("_c").over(every)).withColumn("_end", F.sum("_c").over(upto))
    else:
        totals = counts.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.sum("_c").alias("n"))
        ends = running_sum(counts, keys, "_v", "_c", "_end", hot_rows).join(totals, _same(keys, "_t_") or F.lit(True))
    return ends.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; ties go by the order's last columns, never by chance."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def forward_asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each left row the first right row with right_ts >= left_ts, and of those of one time the least value.

    The times of both sides run in one ordered window, so there is no range join: what is sorted are the different times of a key, not whole
    rows. Of a hot key, each part looks among its own times, and takes what is left open from the parts that follow.
    """
    times = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v")).unionByName(right.select(*keys, F.col(right_ts).alias("_t"), F.col(value).alias("_v")))
    times = times.where(F.col("_t").isNotNull()).groupBy(*keys, "_t").agg(F.min("_v").alias("_v"))
    late = lambda *by: Window.partitionBy(*by).orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, 0)
    parts = in_parts(times, keys, "_t", hot_rows)
    if parts is None:
        found = times.withColumn("_next", F.last("_v", ignorenulls=True).over(late(*keys)))
    else:
        later = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
        heads = parts.groupBy(*keys, "_part").agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_head"))
        heads = heads.withColumn("_carry", F.last("_head", ignorenulls=True).over(later)).drop("_head")
        found = _with_parts(parts.withColumn("_in", F.last("_v", ignorenulls=True).over(late(*keys, "_part"))), heads, keys)
        found = found.withColumn("_next", F.coalesce("_in", "_carry"))
    found = found.select(*[F.col(k).alias(f"_f_{k}") for k in keys], "_t", F.col("_next").alias("next_" + value))
    return left.join(found, [*_same(keys, "_f_"), F.col(left_ts) == F.col("_t")], "left").drop("_t", *[f"_f_{k}" for k in keys])


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left_semi", bin_size: int = 64) -> DataFrame:
    """Rows of left whose [s, e] meets some [rs, re] of right under the same keys ("left_semi"), or none ("left_anti").

    Both are dealt to bins of ``bin_size``, so the join is on equal bins, not on all pairs of a key. Equal rows of left
    are rows of their own: they are numbered, and numbers that meet anything are what stays or goes.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.col(b) / bin_size)))
    distinct = left.select(*keys, "s", "e").distinct()
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "rs", "re").distinct().withColumn("_r_bin", bins("rs", "re"))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_bin") == F.col("_r_bin"), F.col("s") <= F.col("re"), F.col("e") >= F.col("rs")]
    hit = distinct.withColumn("_bin", bins("s", "e")).join(r, on, "left_semi").select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col("s").alias("_h_s"), F.col("e").alias("_h_e")).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in [*keys, "s", "e"]]
    return left.join(hit, same, how)


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], bin_size: int = 64) -> DataFrame:
    """Each row of left with each row of right whose [rs, re] meets its [s, e] under the same keys. Right has other columns than left, but for the keys.

    Both are dealt to bins; a pair that shares several is made in the first of them alone.
    """
    first, last = lambda a: F.floor(F.col(a) / bin_size), lambda b: F.floor(F.col(b) / bin_size)
    bins = lambda a, b: F.explode(F.sequence(first(a), last(b)))
    l, r = left.withColumn("_bin", bins("s", "e")), right.withColumnsRenamed({k: f"_r_{k}" for k in keys}).withColumn("_r_bin", bins("rs", "re"))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_bin") == F.col("_r_bin"), F.col("s") <= F.col("re"), F.col("e") >= F.col("rs"), F.col("_bin") == F.greatest(first("s"), first("rs"))]
    return l.join(r, on).drop("_bin", "_r_bin", *[f"_r_{k}" for k in keys])


def enclosing(df: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """Rows that strictly enclose another of the same keys: it begins no earlier, ends no later, and is shorter.

    In the order of (start descending, end), a row encloses an earlier one exactly if the least end seen so far
    is no later than its own, but for rows of the same bounds; so one ordered window does, without pairs.
    """
    spans = df.select(*keys, start, end).distinct()
    w = Window.partitionBy(*keys).orderBy(F.desc(start), F.col(end)).rowsBetween(Window.unboundedPreceding, -1)
    hit = spans.where("1 = 1").withColumn("_least", F.min(end).over(w)).where(F.col("_least") <= F.col(end))
    hit = hit.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col(start).alias("_h_s"), F.col(end).alias("_h_e"))
    same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys] + [F.col(start) == F.col("_h_s"), F.col(end) == F.col("_h_e")]
    return df.join(hit, same, "left_semi")


def contains_any(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose open interval (s, e) holds some [rs, re] of right: s < rs and re < e.

    Both sides run in one window ordered by start, latest first, that carries the least end of
    the right intervals which start later; no pairs are made.
    """
    rows = left.select(*keys, F.col("s").alias("_at"), F.col("e").alias("_e"), F.lit(None).cast("long").alias("_re"), F.lit(0).alias("_side")).distinct()
    rows = rows.unionByName(right.groupBy(*keys, F.col("rs").alias("_at")).agg(F.min("re").cast("long").alias("_re")).select(*keys, "_at", F.lit(None).cast(dict(rows.dtypes)["_e"]).alias("_e"), "_re", F.lit(1).alias("_side")))
    # Of equal starts, left rows come first: what starts with them does not lie within them.
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = rows.withColumn("_least", F.min("_re").over(w)).where("_side = 0 AND _least < _e")
    hit = hit.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col("_at").alias("_h_s"), F.col("_e").alias("_h_e")).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys] + [F.col("s") == F.col("_h_s"), F.col("e") == F.col("_h_e")]
    return left.join(hit, same, "left_semi")
