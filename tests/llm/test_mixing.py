"""The mix against a brute-force walk over its slots."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codequarry.llm import mixing

D = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level(sizes, weights, share, most):
    """Targets by water-filling, one source after another."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        over = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) > most * sizes[s] + 1e-9}
        if not over:
            total = sum(w[x] for x in open_)
            target |= {s: left * w[s] / total for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def test_targets_sizes_and_limits(docs):
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    out = mixing.taken_words(mixing.sized(docs), extra=["__q_h"]).collect()
    again = mixing.taken_words(mixing.sized(docs.repartition(5)), extra=["__q_h"]).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    sizes, taken = Counter(), Counter()
    for r in out:
        text, source = texts[r.doc_id]
        assert r.size == len(WORD.findall(text or ""))
        assert 0 <= r.taken <= 2 * r.size
        sizes[source] += r.size
        taken[source] += r.taken
    want = level(sizes, (3, 1, 2), 1.5, 2.0)
    for r in out:
        source = texts[r.doc_id][1]
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
    assert all(abs(taken[s] - want[s]) <= 64 * 3 for s in sizes)


def test_taken_words_are_those_of_the_slots(docs):
    """Each slot's block walked word by word."""
    sized = mixing.sized(docs.limit(300))
    parts, slots = mixing.mix(sized, 64, 64, mixing.SEED, ["__q_h"])
    drawn = defaultdict(list)
    for r in slots.collect():
        drawn[r.source_no, r.block].append(r.shard)
    words, shards = Counter(), defaultdict(set)
    for r in parts.collect():
        for shard in drawn[r.source_no, r.block]:
            words[r.doc_id] += r.n_words
            shards[r.doc_id].add(shard)
    for r in mixing.taken_words(sized, extra=["__q_h"]).collect():
        assert (r.taken, r.n_shards) == (words[r.doc_id], len(shards[r.doc_id]))


def test_shards_draw_from_the_multinomial_law(spark):
    rows = [(1, 4000, 6000, 0, 20_000), (2, 5000, 10_000, 6000, 20_000), (3, 9000, 4000, 16_000, 20_000)]
    targets = spark.createDataFrame(rows, "source_no int, blocks long, draws long, first_draw long, all_draws long")
    got = mixing.shard_counts(targets, 40).collect()
    by_shard, by_source = Counter(), Counter()
    for r in got:
        by_shard[r.shard] += r.n
        by_source[r.source_no] += r.n
    assert set(by_shard.values()) == {500}
    assert by_source == {1: 6000, 2: 10_000, 3: 4000}
    chi = sum((r.n - 500 * rows[r.source_no - 1][2] / 20_000) ** 2 / (500 * rows[r.source_no - 1][2] / 20_000) for r in got)
    assert abs(chi - 78) < 5 * math.sqrt(2 * 78)  # (40 - 1) * (3 - 1) degrees of freedom
    at = Counter()
    for r in sorted(got, key=lambda r: (r.source_no, r.shard)):
        assert r["first"] == at[r.source_no]
        at[r.source_no] += r.n
    other = {(r.source_no, r.shard): r.n for r in mixing.shard_counts(targets, 40, seed=99).collect()}
    assert other != {(r.source_no, r.shard): r.n for r in got}


def test_blocks_of_a_pass_are_drawn_once(spark):
    rows = [(1, 70, 100, 0, 137), (2, 30, 37, 100, 137), (3, 5, 0, 137, 137)]
    targets = spark.createDataFrame(rows, "source_no int, blocks long, draws long, first_draw long, all_draws long")
    n = Counter((r.source_no, r["pass"], r.block) for r in mixing.mix_slots(targets).collect())
    assert set(n.values()) == {1}
    assert Counter((s, p) for s, p, _ in n) == {(1, 0): 70, (1, 1): 30, (2, 0): 30, (2, 1): 7}
    assert all(0 <= b < {1: 70, 2: 30}[s] for s, _, b in n)


def test_mixed_documents_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, " a b\tc\n", "x"), (2, long, "y"), (2, long, "y"), (3, None, None), (4, "", "y"), (5, "one two three", None), (None, "p q r s", "x")]
    clash = ("runs", "times", "block", "n_words", "place", "shard", "start", "size", "target", "source_no", "run", "from_word", "n_chars", "n")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("k") for c in clash if c != "n_chars"}).withColumn("n_chars", F.lit(0).cast("long"))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got, taken = out.collect(), mixing.taken_words(mixing.sized(df), extra=["__q_h"]).collect()
    assert all(r.runs == "k" and r.n_chars == len(r.text) for r in got)
    count = lambda t: len(WORD.findall(t or ""))
    for doc in {r[0] for r in rows}:
        assert sum(count(r.text) for r in got if r.doc_id == doc) == sum(r.taken for r in taken if r.doc_id == doc)
        texts = [WORD.findall(t or "") for d, t, _ in rows if d == doc]
        for r in got:
            if r.doc_id == doc:
                w = WORD.findall(r.text)
                assert any(t[i : i + len(w)] == w for t in texts for i in range(len(t)) if t[i] == w[0])
    assert mixing.mixed_documents(df.where("1 = 0")).count() == 0
    assert mixing.taken_words(mixing.sized(df.where("1 = 0"))).count() == 0
    assert mixing.mixed_documents(df.where("doc_id in (3, 4)")).count() == 0
