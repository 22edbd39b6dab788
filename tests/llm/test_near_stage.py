"""The near-duplicate stage against all pairs."""

import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import alike
from codequarry.llm.simhash import majority

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """doc_ids that stay by all pairs, blocked by a common shingle."""
    sets = [(d, sets_of(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at = {}
    for i, (d, s) in enumerate(sets):
        for x in s or {None}:
            at.setdefault(x, []).append(i)
        at.setdefault(("doc", d), []).append(i)
    pairs = {(g[0], j) if isinstance(x, tuple) and x[0] == "doc" and len(x) == 2 else (i, j) for x, g in at.items() for n, i in enumerate(g) for j in g[n + 1 :]}
    for i, j in pairs:
        a, b = sets[i][1], sets[j][1]
        if sets[i][0] == sets[j][0] or 5 * len(a & b) >= 4 * len(a | b):
            root[find(i)] = find(j)
    key = lambda d: -(2**63) if d is None else d
    best = {}
    for i, (d, _) in enumerate(sets):
        best[find(i)] = min(best.get(find(i), 2**63), key(d))
    return sorted(key(d) for i, (d, _) in enumerate(sets) if key(d) == best[find(i)])


def stays(df):
    return sorted(-(2**63) if r.doc_id is None else r.doc_id for r in alike.near_dedup(df).collect())


def test_all_documents_of_a_folder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = survivors([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(want) < docs.count()
    assert stays(docs) == want


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(7, None), (6, ""), (5, " \t\n"), (4, "One two"), (3, "one  TWO"), (2, "one two three"), (8, long), (9, long + " x"), (10, "É b c d e f"), (11, "é b c d e f"), (12, "q r s t u"), (12, "other words of the same document here"), (13, "Q r s t u"), (None, "q r s t u"), (14, "a"), (14, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "key", "node", "bucket", "root", "name1", "slot", "k")})
    out = alike.near_dedup(df)
    assert out.columns == df.columns
    assert stays(df) == survivors(rows)
    assert alike.near_dedup(df.where("1 = 0")).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_groups_in_blocks(spark, monkeypatch, small):
    """Chains, families of copies and a passage that all share; with small limits, they are split in blocks."""
    rng = np.random.default_rng(2)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(120):
        w = list(base) if k % 3 else [f"v{k}x{i}" for i in range(60)] + base[:60]
        for i in rng.integers(0, 120, k % 6):
            w[i] = f"x{k}y{i}"
        rows.append((k, " ".join(w)))
    want = survivors(rows)
    assert 1 < len(want) < 120
    if small:
        for name, value in (("BLOCK", 1500), ("MOST_KEYS", 400), ("TASK_KEYS", 100), ("SIDE", 4), ("HELD", 50), ("REMEMBERED", 3), ("AT_ONCE", 500)):
            monkeypatch.setattr(alike, name, value)
    assert stays(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_texts_just_above_and_below_the_share(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (222, 1302, 1451, 6020, 3666, 9814)").select("doc_id", "text")
    assert stays(rows) == [222, 1302, 1451, 3666, 6020]


def test_no_pair_at_the_share_falls_out():
    """200,000 pairs at exactly 0.8, the shortest sets included: all are candidates by sizes and fingerprints, and share a key."""
    rng, lost, pairs = np.random.default_rng(8), 0, 0
    for common, more, less, times in ((4, 1, 0, 100_000), (8, 1, 1, 30_000), (12, 3, 0, 40_000), (12, 2, 1, 20_000), (20, 3, 2, 8_000), (400, 50, 50, 2_000)):
        total = common + more + less
        h = rng.integers(0, 1 << 63, (times, total), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sides = h[:, : common + more], np.concatenate([h[:, :common], h[:, common + more :]], 1)
        rows = []
        for x in sides:
            out = np.zeros(times, alike._KEY)
            out["n"], out["fp"] = x.shape[1], majority(x.ravel(), np.arange(1, times + 1) * x.shape[1], alike.BITS)
            rows.append(out)
        lost += int((~alike.may_be_alike(*rows)).sum())
        pairs += times
        for a, b in zip(*(np.sort(x[:500], 1) for x in sides), strict=True):
            assert set(a[: alike._n_keys(len(a))].tolist()) & set(b[: alike._n_keys(len(b))].tolist())
    assert (lost, pairs) == (0, 200_000)


def test_the_stage_of_the_pipeline_links_by_the_tree_too(spark):
    """A phrase that comes 200 times makes the fingerprints of 1, 2 and one text of 5 equal, though they share few shingles. 3 shares 0.8 with 2 alone."""
    phrase = "one two three four five six seven eight nine " * 200
    tail = lambda x: " ".join(f"{x}{i}" for i in range(100))
    rows = [(1, phrase + tail("a")), (2, phrase + tail("b")), (3, tail("b")), (4, tail("c")), (5, tail("d")), (5, phrase + tail("e")), (None, tail("f"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {None, 1, 4}
    assert {r.doc_id for r in alike.near_dedup(docs).collect()} == {None, 1, 2, 4, 5}
    assert corpus_pipeline.near_duplicates(spark, docs.where("1 = 0"), "").count() == 0
