"""Operator 10: near-duplicates by SimHash fingerprints and vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from codequarry.llm.common import ascii_lower, save, table, text_or_empty, words
from codequarry.llm.exact_dedup import NO_ID
from codequarry.llm.vptree import build, link_near, route

#: At most so many fingerprints, and at most a tenth of all, shape the tree at the driver.
SAMPLE = 65_536
#: Fingerprints at home in a leaf, about; more once the sample can't give that many leaves.
LEAF_ROWS = 1024
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 17


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A further 64 bits of a hash; the first are the hash itself."""
    if k == 0:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray, ends: np.ndarray, bits: int = 64) -> np.ndarray:
    """A fingerprint for each run of hashes: bits that are set in over half of them. No hash: zero."""
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros((len(ends), bits // 64), np.uint64)
    for k in range(bits // 64):
        set_bits = np.zeros((len(ends), 64), np.int64)
        for begin in range(0, len(hashes), AT_ONCE):
            end = min(len(hashes), begin + AT_ONCE)
            full = np.flatnonzero((starts < end) & (ends > begin) & (ends > starts))
            if not len(full):
                continue
            unpacked = np.unpackbits(_mixed(hashes[begin:end], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_bits[full] += np.add.reduceat(unpacked, np.maximum(starts[full] - begin, 0), axis=0, dtype=np.int32)
        packed = np.packbits(2 * set_bits > (ends - starts)[:, None], axis=1, bitorder="little")
        out[:, k] = np.ascontiguousarray(packed).view(np.uint64).ravel()
    return out


def shingles(docs: DataFrame, shingle: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, ``extra``, h (hashes of the shingles) of each row.

    A-Z are lower-cased; a text of fewer than ``shingle`` words is one shingle, a text without
    words has none. Null is empty.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), words(ascii_lower(text_or_empty())).alias("w"), *extra)
    n = F.greatest(F.size("w") - (shingle - 1), F.lit(1))
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice("w", i, shingle), " ")))
    return rows.select("doc_id", F.size("w").alias("n_words"), *extra, F.when(F.size("w") > 0, hashes).otherwise(F.array().cast("array<bigint>")).alias("h"))


def fingerprints(rows: DataFrame, bits: int = 64) -> DataFrame:
    """``rows`` with fp (big-endian bytes) in place of h: each hash counts as often as it occurs, none gives zero."""
    kept = [c for c in rows.columns if c != "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h")
            ends = np.cumsum(np.diff(h.offsets.to_numpy()))
            fp = majority(h.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ends, bits) if len(ends) else np.zeros((0, bits // 64), np.uint64)
            raw = fp.astype(">u8").tobytes()
            size = bits // 8
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], pa.array([raw[i * size : (i + 1) * size] for i in range(len(ends))], pa.binary())], names=[*kept, "fp"]
            )

    return rows.mapInArrow(run, StructType([*[rows.schema[c] for c in kept], StructField("fp", BinaryType())]))


def _matrix(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), ">u8").reshape(len(fps), -1).astype(np.uint64) if fps else np.zeros((0, 1), np.uint64)


def near_edges(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b), a > b, of a forest whose trees are the groups of ``nodes`` within ``radius`` of each other, leaf by leaf.

    ``nodes`` is a saved table: node, fp. A leaf gives at most an edge for each row in it, so no group
    makes all its pairs. The tree is fitted to a bounded sample; every node goes through it.
    """
    n = nodes.count()
    share = min(0.1, SAMPLE / max(n, 1)) if n > 1000 else 1.0
    picked = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < int(share * 1_000_000)).select("fp").limit(2 * SAMPLE)
    sample = _matrix([bytes(r["fp"]) for r in picked.collect()])
    root, _ = build(sample, max(8, math.ceil(LEAF_ROWS * len(sample) / max(n, 1)))) if len(sample) else build(np.zeros((0, 1), np.uint64), 8)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, node, fp = _matrix(b.column("fp").to_pylist()), b.column("node"), b.column("fp")
            at, leaf, home = route(root, rows, np.ones(len(rows), bool), radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(home), node.take(pa.array(at)), fp.take(pa.array(at))], names=["leaf", "home", "node", "fp"])

    def meet(t: pa.Table) -> pa.Table:
        node, home = t.column("node").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
        label = link_near(_matrix(t.column("fp").to_pylist()), home, radius)
        order = np.lexsort((node, label))
        first = np.concatenate([[True], np.diff(label[order]) != 0])
        least = node[order][first][np.cumsum(first) - 1]
        mine = node[order]
        return pa.table({"a": pa.array(mine[mine != least]), "b": pa.array(least[mine != least])})

    dealt = nodes.select("node", "fp").mapInArrow(deal, "leaf int, home boolean, node long, fp binary")
    return dealt.groupBy("leaf").applyInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of each node on an edge.

    Large star and small star in turn: each node hands its neighbours on to the least of
    them, until nothing changes. Every round is saved, so that a lost executor costs a
    round at most; the number of rounds grows with the logarithm of the largest group.
    """

    def linked(e: DataFrame, both: bool) -> DataFrame:
        sides = e.select("a", "b")
        if both:
            sides = sides.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.pmod(F.col("a"), F.lit(7)).alias("odd"))
        out = sides.withColumn("odd", F.pmod(F.col("a"), F.lit(7))).join(least, ["a", "odd"])
        moved = out.where(F.col("b") > F.col("a") if both else F.lit(True)).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not both:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    sign = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    edges = save(edges, "edges")
    now, before = sign(edges), None
    while now != before and now[0]:
        edges, before = save(linked(linked(edges, True), False), "edges"), now
        now = sign(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_components(docs: DataFrame, shingle: int = 3, bits: int = 64, radius: int = 2) -> DataFrame:
    """doc_id, fp, n_words, component_id of each row: documents whose fingerprints differ in ``radius``
    bits or fewer are linked, component_id is the least doc_id reachable.

    Equal fingerprints are put together first, so a group of copies is one node however large.
    Rows with one doc_id count as one document with several texts; a null doc_id is the least. Null and empty texts have
    fingerprint zero, which links like any other; other columns are not read; an empty table gives no rows; a very
    long text is hashed whole, in one task.
    """
    prints = save(fingerprints(shingles(docs, shingle), bits), "fingerprints")
    nodes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(near_edges(nodes, radius).unionByName(same_document(prints, nodes, ["fp"])))
    return labelled(prints, nodes, found, ["fp"]).select("doc_id", "fp", "n_words", "component_id")


def labelled(prints: DataFrame, nodes: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``prints`` with the component_id of the node that has their ``keys``."""
    odd = F.pmod(F.xxhash64(*keys), F.lit(7)).alias("odd")
    ends = nodes.join(found, "node", "left").select(*keys, odd, F.coalesce("root", "node").alias("root"))
    out = prints.withColumn("odd", odd).join(ends, [*keys, "odd"])
    nullable = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(nullable("doc_id").alias("doc_id"), *[c for c in prints.columns if c != "doc_id"], nullable("root").alias("component_id"))


def same_document(prints: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Edges between the nodes of a doc_id that has several."""
    many = prints.select("doc_id", *keys).distinct().groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", F.lit(1).alias("odd"))
    rows = prints.withColumn("odd", F.lit(1)).join(many, ["doc_id", "odd"]).select("doc_id", *keys).distinct().join(nodes, keys)
    least = rows.groupBy("doc_id").agg(F.min("node").alias("b"))
    return rows.join(least, "doc_id").where("node != b").select(F.col("node").alias("a"), "b").distinct()


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
