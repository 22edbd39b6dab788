"""Operator 11: exact top-k search by inner product, as a Voronoi join.

A query (q, 0) and a row (x, sqrt(M - |x|^2)), where M is the largest |x|^2, are at a squared distance of |q|^2 + M - 2 q.x,
so the nearest rows are those of the highest product. Pivots cut this space into cells. From each
cell's nearest distances to its pivot and the triangle inequality follows how far the k-th row of a
cell's queries can be at most; a row goes to those cells alone that it may be near enough to.
Cells that lie together share a group, so a row goes to a group once; groups meet rows block by block.

Equal vectors are one row with its k + 1 least ids (more can't matter, as a query leaves only itself out), and equal queries are asked once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.llm.common import discard, save, table

#: Factor, neighbours, and who asks.
SCALE, K, EVERY = 64, 20, 20
#: Pivots at most, different vectors that they are chosen from, queries of a group, rows of a block, about.
PIVOTS, SAMPLE, GROUP_QUERIES, BLOCK_ROWS = 1024, 8192, 1024, 16_384
#: Rows whose products are held at once.
AT_ONCE = 2048
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width that holds them all, which goes first: equal vectors have equal bytes."""
    low, high = (int(v.min()), int(v.max())) if len(v) else (0, 0)
    kind = next(k for k in _WIDTHS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + v.astype(np.dtype(kind).newbyteorder("<")).tobytes()


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim), np.int64)
    for k, raw in enumerate(rows):
        out[k] = np.frombuffer(raw, f"<i{raw[0]}", offset=1)
    return out


def quantized(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, v, dim, norm (the product with itself) of rows whose vector has no null and no component that isn't finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, vectors, dims, norms = [], [], [], []
            for k, x in enumerate(b.column("v")):
                values = x.values
                if values is None or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64) * scale
                if not np.isfinite(x).all():
                    continue
                whole = np.floor(x)
                if len(x) and float((whole * whole).sum()) >= 2.0**62:
                    raise ValueError("a vector's scores are beyond 64 bits")
                whole = whole.astype(np.int64)
                keep.append(k)
                vectors.append(packed(whole))
                dims.append(len(whole))
                norms.append(int((whole * whole).sum()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(keep, pa.int64())), pa.array(vectors, pa.binary()), pa.array(dims, pa.int32()), pa.array(norms, pa.int64())], names=["vec_id", "v", "dim", "norm"])

    return rows.mapInArrow(run, "vec_id long, v binary, dim int, norm long")


def choose_pivots(sample: np.ndarray, n: int, rounds: int = 2) -> np.ndarray:
    """n of the sample, each moved to the middle of what is nearest to it."""
    pivots = sample[:n].copy()
    for _ in range(rounds):
        near = distances(sample, pivots).argmin(1)
        sums, count = np.zeros_like(pivots), np.bincount(near, minlength=n)
        np.add.at(sums, near, sample)
        pivots[count > 0] = sums[count > 0] / count[count > 0, None]
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0))


def lifted(v: np.ndarray, most: int, query: bool) -> np.ndarray:
    """The vectors in the space where distance follows product."""
    v = v.astype(np.float64)
    last = np.zeros(len(v)) if query else np.sqrt(np.maximum(most - (v * v).sum(1), 0))
    return np.concatenate([v, last[:, None]], 1)


class Cells:
    """What all tasks know: pivots and, by cell, how far its queries reach (radius), how near their k-th row is (bound), and its group."""

    def __init__(self, pivots: np.ndarray, most: int, dim: int):
        self.pivots, self.most, self.dim = pivots, most, dim
        self.between = distances(pivots, pivots)
        #: Distances are rounded; a bound is loose by more than they can be off.
        self.slack = 1e-5 * (1 + math.sqrt(max(0, most)) + float(np.sqrt((pivots * pivots).sum(1)).max(initial=0)))

    def summarize(self, queries: dict[int, tuple[int, float]], nearest: list[tuple[int, float]], k: int, group_queries: int) -> None:
        """queries: number and largest distance by cell; nearest: (cell, distance) of the k + 1 rows next to each pivot."""
        n = len(self.pivots)
        self.count, self.radius = np.zeros(n, np.int64), np.zeros(n)
        for cell, (count, far) in queries.items():
            self.count[cell], self.radius[cell] = count, far
        cell, d = (np.array(x) for x in zip(*nearest, strict=True))
        self.bound = np.full(n, np.inf)
        if len(cell) > k:
            for i in np.flatnonzero(self.count):
                self.bound[i] = np.partition(self.radius[i] + self.between[i, cell] + d, k)[k]
        # Cells in the order of a walk from each to the nearest that is left, cut where a group is full.
        left, walk = list(np.flatnonzero(self.count)), []
        while left:
            at = int(np.argmin(self.between[walk[-1], left])) if walk else 0
            walk.append(left.pop(at))
        self.first, self.parts, group, held = np.zeros(n, np.int64), np.ones(n, np.int64), 0, 0
        for i in walk:
            if held and held + self.count[i] > group_queries:
                group, held = group + 1, 0
            self.first[i], self.parts[i] = group, max(1, -(-self.count[i] // group_queries))
            held += self.count[i]
            if self.parts[i] > 1:
                group, held = group + self.parts[i], 0

    def groups_of_rows(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and group of each group that a row may matter to."""
        used = np.flatnonzero(self.count)
        d = distances(lifted(v, self.most, False), self.pivots)
        own = d.argmin(1)
        near = d[np.arange(len(v)), own]
        # At least as far as from the pivot to the row less the queries' radius, and as the plane between both cells.
        least = d[:, used] - self.radius[used]
        apart = self.between[own][:, used]
        plane = np.divide(d[:, used] ** 2 - near[:, None] ** 2, 2 * apart, out=np.zeros_like(apart), where=apart > 0)
        row, cell = np.nonzero(np.maximum(least, plane) <= self.bound[used] + self.slack)
        cell = used[cell]
        n = self.parts[cell]
        row, group = np.repeat(row, n), np.repeat(self.first[cell], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        both = np.unique(row * (1 << 32) + group)
        return both >> 32, both & 0xFFFFFFFF


def best_rows(queries: np.ndarray, blocks: Iterator[tuple[np.ndarray, list, list]], k: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Query, score, id of the k rows of each query with the highest scores, then the least ids (null last). A block: vectors, ids, and which row each id is of."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    floor = np.full(len(queries), np.iinfo(np.int64).min)
    norm = float((queries.astype(np.float64) ** 2).sum(1).max(initial=0))
    for v, ids, of in blocks:
        exact = norm * float((v.astype(np.float64) ** 2).sum(1).max(initial=0)) < 2.0**104  # then all products are below 2^52
        scores = (queries.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64) if exact else queries @ v.T
        least = np.partition(scores, -k, 1)[:, -k] if len(v) > k else np.full(len(queries), np.iinfo(np.int64).min)
        q, row = np.nonzero(scores >= np.maximum(least, floor)[:, None])
        order = np.argsort(of, kind="stable")
        n = np.bincount(of, minlength=len(v))
        start = np.cumsum(n) - n
        times = n[row]
        at = order[np.repeat(start[row], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
        new = (np.repeat(q, times), np.repeat(scores[q, row], times), np.array([x is None for x in ids], bool)[at], np.array([x or 0 for x in ids], np.int64)[at])
        q, score, null, name = (np.concatenate(x) for x in zip(held, new, strict=True))
        order = np.lexsort((name, null, -score, q))
        q, score, null, name = q[order], score[order], null[order], name[order]
        begin = np.searchsorted(q, np.arange(len(queries)))
        keep = np.arange(len(q)) - begin[q] < k
        held = q, score, null, name = q[keep], score[keep], null[keep], name[keep]
        full = np.bincount(q, minlength=len(queries)) >= k
        last = np.searchsorted(q, np.arange(len(queries)), "right") - 1
        floor[full] = score[last[full]]
    q, score, null, name = held
    return q, score, [None if x else int(y) for x, y in zip(null, name, strict=True)]


def _search(vectors: DataFrame, dim: int, k: int, group_queries: int, block_rows: int, max_pivots: int) -> DataFrame:
    """name, best (array of score and vec_id) of each different query vector; ``vectors``: name, v, norm, ids, asks, all of one length."""
    total, most = vectors.agg(F.count("*"), F.max("norm")).first()
    sample = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    sample = lifted(unpacked([r["v"] for r in sample], dim), most, False)
    cells = Cells(choose_pivots(sample, min(max_pivots, len(sample), max(1, math.isqrt(total)))), most, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = unpacked(b.column("v").to_pylist(), dim)
            out = []
            for query in (False, True):
                d = distances(lifted(v, most, query), cells.pivots)
                cell = d.argmin(1)
                out += [pa.array(cell), pa.array(d[np.arange(len(v)), cell])]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("name", "v", "ids", "asks")], *out], names=["name", "v", "ids", "asks", "cell", "d", "q_cell", "q_d"])

    kept = vectors.select("name", "v", "ids", "asks")
    ids = kept.schema["ids"].dataType.simpleString()
    placed = save(kept.mapInArrow(assign, f"name long, v binary, ids {ids}, asks boolean, cell long, d double, q_cell long, q_d double"), "vectors-by-cell")
    queries = {r["q_cell"]: (r["n"], r["far"]) for r in placed.where("asks").groupBy("q_cell").agg(F.count("*").alias("n"), F.max("q_d").alias("far")).collect()}
    next_to = placed.select("cell", "d", F.row_number().over(Window.partitionBy("cell").orderBy("d")).alias("r")).where(F.col("r") <= k + 1)
    cells.summarize(queries, [(r["cell"], r["d"]) for r in next_to.collect()], k, group_queries)  # k + 1 rows a pivot
    blocks = max(1, -(-total // block_rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, group = cells.groups_of_rows(unpacked(b.column("v").to_pylist(), dim))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(group), *[b.column(c).take(at) for c in ("block", "v", "ids")]], names=["grp", "block", "v", "ids"])

    block = F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("block")
    rows = placed.select(block, "v", "ids").mapInArrow(deal, f"grp long, block long, v binary, ids {ids}")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, name = b.column("q_cell").to_numpy(), b.column("name").to_numpy()
            group = cells.first[cell] + name % cells.parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(group), b.column("name"), b.column("v")], names=["grp", "name", "v"])

    asked = placed.where("asks").select("name", "v", "q_cell").mapInArrow(ask, "grp long, name long, v binary")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        names, lists = left.column("name").to_numpy(), right.column("ids").combine_chunks()

        def parts():
            for k0 in range(0, len(right), AT_ONCE):
                own = lists.slice(k0, AT_ONCE)
                yield unpacked(right.column("v").slice(k0, AT_ONCE).to_pylist(), dim), own.flatten().to_pylist(), np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())

        q, score, ids = best_rows(unpacked(left.column("v").to_pylist(), dim), parts(), k + 1)
        return pa.table({"name": pa.array(names[q], pa.int64()), "score": pa.array(score, pa.int64()), "vec_id": pa.array(ids, pa.int64())})

    found = asked.groupBy("grp", "block").cogroup(rows.groupBy("grp", "block")).applyInArrow(solve, "name long, score long, vec_id long")
    first = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    lists = found.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("r", "score", "vec_id"))).alias("best"))
    return lists.join(placed.where("asks").select("name", "v"), "name").select("v", "best")


def top_k_by_product(rows: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS, max_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest products of each query with all other rows, ties to the lesser vec_id (null last).

    ``rows`` and ``queries``: vec_id and v (array of numbers); ``queries`` are rows of ``rows``, and each leaves one row like itself out.
    Components count as floor(scale * x). Vectors that are null, or hold a null or a component that is not finite, take no
    part; only vectors of one length meet (each length is a search of its own). Ids may be null or repeat; other columns are not
    read. With fewer than k others, all are given; an empty table gives no rows. Scores beyond 64 bits are an error.
    """
    spark = rows.sparkSession
    every = save(quantized(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v"), scale), "vectors")
    asked = save(quantized(queries.select(F.col("vec_id").cast("long").alias("vec_id"), "v"), scale), "queries")
    nth = F.row_number().over(Window.partitionBy("v", "dim").orderBy(F.col("vec_id").asc_nulls_last()))
    different = every.withColumn("r", nth).where(F.col("r") <= k + 1).groupBy("v", "dim", "norm").agg(F.collect_list(F.struct("vec_id")).alias("ids"))
    marked = different.select("v", "dim", "norm", F.transform("ids", lambda x: x["vec_id"]).alias("ids")).join(asked.select("v", "dim").distinct().withColumn("asks", F.lit(True)), ["v", "dim"], "left")
    vectors = save(marked.select(F.monotonically_increasing_id().alias("name"), "v", "dim", "norm", "ids", F.coalesce("asks", F.lit(False)).alias("asks")), "different-vectors")
    discard(every)
    out = None
    for dim in sorted(r["dim"] for r in vectors.where("asks").select("dim").distinct().collect()):  # lengths of vectors; one, as a rule
        lists = _search(vectors.where(F.col("dim") == dim), dim, k, group_queries, block_rows, max_pivots)
        part = asked.where(F.col("dim") == dim).join(lists, "v")
        out = part if out is None else out.unionByName(part)
    discard(vectors)  # each search has its own copy, by cell
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = F.array_position(F.transform("best", lambda x: (x["vec_id"] == F.col("vec_id")) & (x["score"] == F.col("norm"))), True)
    others = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("own")), 1, k)
    out = out.withColumn("own", F.coalesce(own, F.lit(0))).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return top_k_by_product(rows, rows.where(F.col("vec_id") % EVERY == 0))


SQL = {
    "op11_exact_topk": """
WITH v AS (SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.row_no, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.row_no <> c.row_no WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, row_no ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
}
QUERIES = {"op11_exact_topk": op11_exact_topk}
