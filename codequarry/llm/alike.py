"""Operator 10 as a pipeline stage, and what its radius can't reach: five-word shingles, a similarity of 0.8 or more.

near_stage() links texts whose SimHash fingerprints the vantage-point tree finds within RADIUS_TREE bits
of each other, as op10 does, and all that share 0.8 of their shingles. At that similarity fingerprints lie so far
apart that no tree over them can prune (its triangle bounds need a radius small against the distance of
unrelated texts). So for the second kind of link, documents first meet by a key, and wider fingerprints are compared within
the texts that share one:

1. Any two sets with at least 4 of 5 shingles in common share one of the first n - ceil(0.8 n) + 1
   of each, in any order that holds for all sets. The order puts shingles whose hash
   bucket is rare in the corpus first, so passages that many texts share are hardly ever keys.
2. Texts that share a key, whose sizes allow a share of 0.8, and whose fingerprints differ in RADIUS bits or fewer
   are candidates. RADIUS is so wide that a pair at 0.8 falls out with a probability of less than 10^-12.
3. Within groups of candidates, the share of common shingles is counted exactly, and links by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import discard, save, text_or_empty
from codequarry.llm.exact_dedup import NO_ID
from codequarry.llm.simhash import components, labelled, majority, near_components, same_document
from codequarry.llm.word_hashes import hashed_words, mix64, release

#: Words of a shingle; texts are alike that share ALIKE[0] of ALIKE[1] of their shingles or more.
SHINGLE, ALIKE = 5, (4, 5)
#: Bits of a fingerprint, and how many may differ. A bit of two sets of 8 or more shingles at 0.8 differs with a probability of 0.1612 at most
#: (12 of 15), of shorter ones 0.1875 (4 of 5); more than RADIUS, or RADIUS_SHORT, of BITS then do less than once in
#: 10^12 pairs. Of unrelated sets, RADIUS lets 2 in 10,000 pass, RADIUS_SHORT 6 in 1,000.
BITS, RADIUS, SHORT, RADIUS_SHORT = 192, 71, 8, 78
#: op10's own shingles, bits and radius, for the tree.
SHINGLE_TREE, BITS_TREE, RADIUS_TREE = 3, 64, 2
#: Buckets whose counts order the shingles (a power of two): what is gathered of the corpus.
SLOTS = 1 << 16
#: Characters of texts taken at once; keys held before they are dealt; keys of a task, about, and at most
#: (a task of more is split in blocks, each two of which meet).
AT_ONCE, HELD, TASK_KEYS, MOST_KEYS = 1 << 20, 1 << 18, 1 << 18, 1 << 21
#: Groups of a key up to this size are compared side by side with others.
SIDE = 48
#: Distinct sets that a task remembers having dealt already.
REMEMBERED = 100_000
#: Distinct shingles that are compared exactly in one task, about; two blocks of a larger group meet in a task.
TOGETHER, BLOCK = 1 << 20, 1 << 22
_MULTIPLIERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, SHINGLE + 1)]
_KEY = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<u4"), ("fp", "<u8", (BITS // 64,))])


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct hashed shingles of each text, sorted. A-Z are lower-cased; a text of fewer than
    SHINGLE words is one shingle, one without words has none; null is empty."""
    words, ends = hashed_words(texts)
    h = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    fives = mix64(sum(m * h[k : len(h) - SHINGLE + k] for k, m in enumerate(_MULTIPLIERS)))
    out, at = [], 0
    for stop in ends.tolist():
        if stop == at:
            out.append(fives[:0])
        elif stop - at >= SHINGLE:
            out.append(np.unique(fives[at : stop - SHINGLE + 1]))
        else:
            out.append(mix64(sum(m * h[at + k : at + k + 1] for k, m in enumerate(_MULTIPLIERS[: stop - at]))))
        at = stop
    return out


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch with a bounded sum of characters (a longer text is a part of its own), with their sets."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = 0
    while begin < batch.num_rows:
        stop, size = begin, 0
        while stop < batch.num_rows and (stop == begin or size + sizes[stop] <= AT_ONCE):
            size += sizes[stop]
            stop += 1
        part = batch.slice(begin, stop - begin)
        yield part, shingle_sets(part.column(column))
        begin = stop


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit names of sets, as two signed columns."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)


def _n_keys(n: int) -> int:
    """Of a set of n; sets of fewer than four have no partner but their equals."""
    return n + (-ALIKE[0] * n // ALIKE[1]) + 1 if n >= ALIKE[0] else 0


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (doc_id, name1, name2, n), then one for each slot: its count of shingles."""
    counts, names = np.zeros(SLOTS, np.int64), ["doc_id", "name1", "name2", "n", "slot"]
    for batch in batches:
        for part, sets in _slices(batch, "text"):
            counts += np.bincount((np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
            name, n = _names(sets), pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), n, pa.nulls(len(sets), pa.int32())], names=names)
    slot = np.flatnonzero(counts)
    none = pa.nulls(len(slot), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.array(counts[slot]), pa.array(slot.astype(np.int32))], names=names)
    release()


def _deal(rank: np.ndarray, buckets: int):
    """Of each different set, its rarest shingles as keys: bucket, keys (key, node and fingerprint of each, packed)."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        bucket = (mix64(rows["key"]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(rows)]])
        raw, size = rows.tobytes(), _KEY.itemsize
        packed = [raw[a * size : b * size] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array(packed, pa.binary())], names=["bucket", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n_held = set(), [], 0
        for batch in batches:
            for _, sets in _slices(batch, "text"):
                sets = [s for s in sets if len(s) >= ALIKE[0]]
                name, new = _names(sets), []
                for i, x in enumerate(name[:, 0].tolist()):
                    if x not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(x)
                        new.append(i)
                if not new:
                    continue
                mine = [sets[i] for i in new]
                fps = majority(np.concatenate(mine), np.cumsum([len(s) for s in mine]), BITS)
                for i, s, fp in zip(new, mine, fps, strict=True):
                    key, m = (rank[(s & np.uint64(SLOTS - 1)).astype(np.int64)] << np.uint64(48)) | (s >> np.uint64(16)), _n_keys(len(s))
                    rows = np.empty(m, _KEY)
                    rows["key"] = np.partition(key, m - 1)[:m]
                    rows["node"], rows["n"], rows["fp"] = name[i, 0], len(s), fp
                    held.append(rows)
                    n_held += m
                if n_held >= HELD:
                    yield flush(held)
                    held, n_held = [], 0
        if held:
            yield flush(held)
        del held
        release()

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deal the keys of buckets with k > 1 out to blocks (by node); each two blocks i <= j meet in a task."""
    for b in batches:
        out = []
        for bucket, packed, k in zip(*[b.column(c).to_pylist() for c in ("bucket", "keys", "k")], strict=True):
            if k == 1:
                out.append((bucket, 0, 0, packed))
                continue
            rows = np.frombuffer(packed, _KEY)
            block = (mix64(rows["node"].astype(np.uint64)) % np.uint64(k)).astype(np.int64)
            for i in np.unique(block).tolist():
                part = rows[block == i].tobytes()
                out.extend((bucket, min(i, j), max(i, j), part) for j in range(k))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "i", "j", "keys"])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups that edges (a, b) make, as one edge (node, least node) of each node but the least."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = flat[: len(a)], flat[len(a) :], np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def may_be_alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether keys' sets can share ALIKE, by their sizes and fingerprints. ``a`` may be a single key."""
    m, n = a["n"].astype(np.int64), b["n"].astype(np.int64)
    apart = np.bitwise_count(a["fp"] ^ b["fp"]).sum(-1, dtype=np.int32)
    num, den = ALIKE
    return (apart <= np.where(np.minimum(m, n) < SHORT, RADIUS_SHORT, RADIUS)) & (den * m >= num * n) & (den * n >= num * m)


def _near(rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Edges (i, others) of a forest whose trees are the groups of candidates. What was reached is
    compared with what was not alone, so a group of copies makes few comparisons."""
    left, out = np.arange(len(rows)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = may_be_alike(rows[i], rows[left])
            if near.any():
                out.append((i, left[near]))
                queue.extend(left[near].tolist())
                left = left[~near]
    return out


def _meet(t: pa.Table) -> pa.Table:
    """Edges between the nodes of a bucket that share a key and may be alike, as stars."""
    rows = np.frombuffer(b"".join(t.column("keys").to_pylist()), _KEY)
    rows = rows[np.lexsort((rows["node"], rows["key"]))]
    key, node = rows["key"], rows["node"]
    rows = rows[np.concatenate([[True], (np.diff(key) != 0) | (np.diff(node) != 0)])] if len(rows) else rows
    key, node = rows["key"], rows["node"]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(rows) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(rows)))
    small = np.repeat((sizes > 1) & (sizes <= SIDE), sizes)
    few = rows[small]
    k, n = few["key"], few["node"]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, SIDE):
        at = np.flatnonzero(k[d:] == k[:-d])
        if not len(at):
            break
        at = at[may_be_alike(few[at], few[at + d])]
        a.append(n[at])
        b.append(n[at + d])
    for g in np.flatnonzero(sizes > SIDE):
        own = slice(starts[g], starts[g] + sizes[g])
        for i, others in _near(rows[own]):
            a.append(np.full(len(others), node[own][i]))
            b.append(node[own][others])
    high, low = stars(np.concatenate(a), np.concatenate(b))
    del rows, key, node, few, k, n, small
    release()
    return pa.table({"a": pa.array(high), "b": pa.array(low)})


def candidate_groups(docs: DataFrame, slots: DataFrame) -> DataFrame:
    """node (the first name of a set), root: the groups of candidates. ``docs`` has text, ``slots`` slot and count.

    What is held of the corpus is one rank for each slot. A bucket of keys has TASK_KEYS, about. One with
    over MOST_KEYS, which takes a set of keys that a huge group shares, is split in blocks.
    """
    got = slots.groupBy("slot").agg(F.sum("n").alias("n")).collect()  # SLOTS rows at most
    counts = np.zeros(SLOTS, np.int64)
    for slot, n in got:
        counts[slot] = n
    rank = np.empty(SLOTS, np.uint64)
    rank[np.lexsort((np.arange(SLOTS), counts))] = np.arange(SLOTS, dtype=np.uint64)
    buckets = max(1, math.ceil(int(counts.sum()) * (1 - ALIKE[0] / ALIKE[1]) / TASK_KEYS))
    dealt = save(docs.select("text").mapInArrow(_deal(rank, buckets), "bucket long, keys binary"), "near-keys")
    sizes = dealt.groupBy("bucket").agg((F.sum(F.octet_length("keys")) / _KEY.itemsize).alias("m"))
    large = save(sizes.where(F.col("m") > MOST_KEYS).select("bucket", F.ceil(F.col("m") / MOST_KEYS).cast("long").alias("k")), "large-buckets")
    if large.isEmpty():
        tasks = dealt.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        with_k = dealt.join(large, "bucket", "left").select("bucket", "keys", F.coalesce("k", F.lit(1)).alias("k"))
        tasks = with_k.mapInArrow(_spread, "bucket long, i long, j long, keys binary")
    edges = save(tasks.groupBy("bucket", "i", "j").applyInArrow(_meet, "a long, b long").distinct(), "near-edges")
    discard(dealt)
    found = components(edges)
    return save(found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct(), "candidates")


def link_alike(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, mark: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Edges (i, others) of a forest whose trees are the groups of alike sets.

    Set i is flat[starts[i] : starts[i] + sizes[i]], places in ``mark``, which is all False. A set that
    was reached is compared with those not reached yet alone, so a group of copies makes few pairs.
    """
    num, den = ALIKE
    left, out = np.arange(len(sizes)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            others = left[(den * sizes[left] >= num * sizes[i]) & (den * sizes[i] >= num * sizes[left])]
            if not len(others):
                continue
            mine, n = flat[starts[i] : starts[i] + sizes[i]], sizes[others]
            ends = np.cumsum(n)
            mark[mine] = True
            both = np.add.reduceat(mark[flat[np.repeat(starts[others] - ends + n, n) + np.arange(ends[-1])]], ends - n, dtype=np.int64)
            mark[mine] = False
            hit = others[den * both >= num * (sizes[i] + n - both)]
            if len(hit):
                out.append((i, hit))
                queue.extend(hit.tolist())
                left = left[~np.isin(left, hit)]
    return out


def _compare(t: pa.Table) -> pa.Table:
    """Edges between the alike texts of each root in a task, as a forest."""
    node, root = t.column("node").to_numpy(), t.column("root").to_numpy()
    sets = [s for b in t.select(["text"]).combine_chunks().to_batches() for _, part in _slices(b, "text") for s in part]
    sizes = np.array([len(s) for s in sets], np.int64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts, mark, order = np.cumsum(sizes) - sizes, np.zeros(len(names), bool), np.argsort(root, kind="stable")
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        rows = rows[sizes[rows] >= ALIKE[0]]
        for i, hit in link_alike(flat, starts[rows], sizes[rows], mark):
            a.append(np.full(len(hit), node[rows[i]]))
            b.append(node[rows[hit]])
    a, b = np.concatenate(a), np.concatenate(b)
    del sets, names, flat
    release()
    return pa.table({"a": pa.array(np.maximum(a, b)[a != b]), "b": pa.array(np.minimum(a, b)[a != b])})


def alike_edges(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, of a forest whose trees are the groups of alike texts within each group of ``linked``.

    ``linked`` has node (a doc_id), n (distinct shingles) and root, the group. Only these documents'
    texts are taken up again. Small groups share tasks; a large one is dealt out in blocks, each two of
    which meet, so that no task holds more than two.
    """
    groups = linked.groupBy("root").agg(F.sum("n").alias("total")).withColumn("k", F.ceil(F.col("total") / BLOCK))
    tasks = max(1, math.ceil((linked.agg(F.sum("n")).first()[0] or 0) / TOGETHER))
    ids = linked.select(F.col("node").alias("__q_id"), "root").distinct().join(groups, "root").select("__q_id", "root", "k")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("node"), "text")
    # The hint: one way at every size, for the candidates grow with the corpus.
    sets = keyed.join(ids.hint("merge"), F.col("node") == F.col("__q_id"))
    block, other = F.pmod(F.xxhash64("node"), F.col("k")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    sets = sets.withColumn("block", block).withColumn("other", other)
    own = F.col("k") > 1
    task = F.when(own, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(tasks)))
    sets = sets.select("node", "root", "text", task.alias("task"), F.when(own, F.least("block", "other")).otherwise(-1).alias("i"), F.greatest("block", "other").alias("j"))
    return sets.groupBy("task", "i", "j").applyInArrow(_compare, "a long, b long").distinct()


def group_edges(prints: DataFrame, nodes: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b), a > b, between the nodes of documents that ``groups`` (doc_id, component_id) puts together."""
    ids = groups.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("x"), F.coalesce("component_id", F.lit(NO_ID)).alias("y")).where("x != y").distinct()
    # A document with several texts has several nodes, which same_document() links: any of them will do.
    asked = save(ids.select(F.col("x").alias("doc_id")).unionByName(ids.select(F.col("y").alias("doc_id"))).distinct(), "in-groups")
    own = prints.join(asked.hint("merge"), "doc_id").join(nodes.hint("merge"), keys).groupBy("doc_id").agg(F.min("node").alias("own"))
    own = save(own, "own-nodes")
    a, b = own.select(F.col("doc_id").alias("x"), F.col("own").alias("p")), own.select(F.col("doc_id").alias("y"), F.col("own").alias("q"))
    return ids.join(a, "x").join(b, "y").where("p != q").select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()


def near_stage(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group: that with the least doc_id.

    Links are op10's (near_components(): fingerprints within RADIUS_TREE bits, by the tree) and those of near_dedup(), and are
    transitive across both. Rows, nulls, extra columns and empty tables are treated as there.
    """
    return near_dedup(docs, near_components(docs, SHINGLE_TREE, BITS_TREE, RADIUS_TREE))


def near_dedup(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group: that with the least doc_id.

    ``groups`` (doc_id, component_id) are documents that are linked already, as near_components() gives them; without it, shingles alone decide.
    A text is the set of its five-word shingles; two that share 0.8 of them or more are linked, and
    links are transitive. Equal sets are one node, also those of fewer than four shingles, which are
    alike only if equal. Null texts are empty, and all texts without words are equal. Rows with one
    doc_id are one document with several texts; a null doc_id is the least. Extra columns pass
    through, whatever their names; an empty table stays empty. A very long text is one part of
    a task on its own: a task holds some 40 bytes for each of its words.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_or_empty().alias("text"))
    survey = save(texts.mapInArrow(_survey, "doc_id long, name1 long, name2 long, n long, slot int"), "near-survey")
    prints = survey.where("slot is null").drop("slot")
    keys = ["name1", "name2", "n"]
    nodes = save(prints.groupBy(*keys).agg(F.min("doc_id").alias("node")), "near-nodes")
    same = save(same_document(prints, nodes, keys), "same-document")
    candidates = candidate_groups(texts, survey.where("slot is not null").select("slot", "n"))
    linked = save(nodes.join(candidates.select(F.col("node").alias("name1"), "root"), "name1").select("node", "n", "root"), "linked")
    edges = alike_edges(docs, linked).unionByName(same)
    found = components(edges if groups is None else edges.unionByName(group_edges(prints, nodes, groups, keys)))
    found = labelled(prints, nodes, found, keys).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__q_id")).distinct()
    return docs.withColumn("__q_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(gone.hint("merge"), "__q_id", "left_anti").drop("__q_id")
