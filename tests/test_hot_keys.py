"""Ordered operators on keys that hold most rows: cut into parts, they give what they give whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.operators import matching, ordered

SMALL = 20  # rows that make a key hot here


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot"] * 9 + ["a", "b", None]), rng.choice([None, 0, 0, *range(60), *range(1000, 9000)]), rng.choice([None, 1, 2, 3])) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k string, line long, v long").repartition(5)


def test_running_sum_and_numbers(table):
    whole, cut = (ordered.running_sum(table, ["k"], "id", "v", "s", n) for n in (10**9, SMALL))
    assert rows_of(whole, "id", "s") == rows_of(cut, "id", "s")
    whole, cut = (ordered.numbered(table, ["k", "line"], "id", "n", n) for n in (10**9, SMALL))
    assert rows_of(whole, "id", "n") == rows_of(cut, "id", "n")


def test_islands(table):
    lines = table.where("line IS NOT NULL")
    whole, cut = (ordered.islands(lines, ["k"], "line", 40, "i", n) for n in (10**9, SMALL))
    assert rows_of(whole, "id", "i") == rows_of(cut, "id", "i")
    by = {}
    for r in lines.select("k", "line").distinct().collect():
        by.setdefault(r.k, []).append(r.line)
    first = {}
    for k, at in by.items():
        at.sort()
        for i, x in enumerate(at):
            first[k, x] = x if i == 0 or x - at[i - 1] > 40 else first[k, at[i - 1]]
    assert all(r.i == first[r.k, r.line] for r in cut.collect())


def test_floor_quantiles_and_asof(table):
    shares = {"q1": (1, 4), "q2": (1, 2), "q3": (3, 4)}
    whole, cut = (ordered.floor_quantiles(table, ["k"], "line", shares, n) for n in (10**9, SMALL))
    assert rows_of(whole, "k", "n", *shares) == rows_of(cut, "k", "n", *shares)
    left, right = table.where("id % 2 = 0"), table.where("id % 3 = 0").select("k", F.col("line").alias("ts"), F.col("id").alias("rid"))
    whole, cut = (ordered.forward_asof(left, right, ["k"], "line", "ts", "rid", n) for n in (10**9, SMALL))
    assert rows_of(whole, "id", "next_rid") == rows_of(cut, "id", "next_rid")
    known = [tuple(r) for r in right.collect()]
    for r in cut.collect():
        later = [(t, i) for k, t, i in known if k == r.k and t is not None and r.line is not None and t >= r.line]
        assert r.next_rid == (min(later)[1] if later else None)


def test_a_hot_key_is_spread(spark):
    """One key with 10^6 rows: no part, and no task of the matcher, gets more than a small share of it."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("f").alias("file"), F.lit("r").alias("rule"), F.lit("m").alias("message"), (F.pmod(F.xxhash64("id"), F.lit(60 * n)) + 1).alias("line"), "id")
    before, after = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    parts = ordered.in_parts(rows, ["file"], "line", 100_000).groupBy("_part").count().collect()
    assert len(parts) == ordered.PARTS and max(p["count"] for p in parts) < 3 * n / ordered.PARTS
    sides = matching._sides(before, after, [F.col("file")])
    placed = ordered.islands(sides, ["k1", "k2"], "line", 40, "island", 100_000)
    assert placed.groupBy("k1", "k2", "island").count().agg(F.max("count")).first()[0] < 100
    tasks = placed.repartition(16, "k1", "k2", "island").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 16 and max(t["count"] for t in tasks) < 2 * n / 16
    order = [np.array([tuple(r) for r in df.select("line", "id").collect()]) for df in (before, after)]
    b, a = (x[np.lexsort((x[:, 1], x[:, 0]))] for x in order)
    for got, want in (
        (matching.nearest_greedy(before, after, ["file", "rule"], 40, 100_000), matching.nearest_pairs(b[:, 0].tolist(), a[:, 0].tolist(), 40)),
        (matching.tolerant_greedy(before, after, 5, 100_000), matching.tolerant_pairs(b[:, 0].tolist(), a[:, 0].tolist(), 5)),
    ):
        assert sorted(map(tuple, got.collect())) == sorted((int(b[i, 1]), int(a[j, 1])) for i, j in want)


def test_tolerant_greedy_over_keys(spark):
    """Against nested loops, with many rows at line 0 on either side, and nulls."""
    rng = random.Random(11)
    for trial in range(3):
        zeros = ([0] * 40, [0, None] * 4, [None])[trial]
        rows = [(i, rng.choice(["x", "y", None]), rng.choice([*zeros, *range(1, 60)])) for i in range(150)]
        df = spark.createDataFrame(rows, "id long, file string, line long").withColumn("rule", F.lit(None).cast("string")).withColumn("message", F.lit("m"))
        want = []
        for f in ("x", "y", None):
            b, a = (sorted((r[2] or 0, r[0]) for r in rows if r[1] == f and r[0] % 3 // 2 == s) for s in (0, 1))
            used = set()
            for line, i in b:
                hit = next((j for other, j in a if j not in used and (line == 0 or other == 0 or abs(line - other) <= 5)), None)
                if hit is not None:
                    used.add(hit)
                    want.append((i, hit))
        for hot in (10**9, SMALL):
            assert sorted(map(tuple, matching.tolerant_greedy(df.where("id % 3 < 2"), df.where("id % 3 = 2"), 5, hot).collect())) == sorted(want)
