"""Further operators against brute force, with nulls, ties, repeats, long texts, empty tables and clashing names."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codequarry.llm import line_dedup, packing, quality_model, quality_rules, sharding, simhash, vptree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 5003}" for i in range(30_000))
ROWS = [
    (1, "Some words, some # of them |twice|.\nSome words\n\nsome words\n" * 3),
    (2, None), (3, ""), (4, " \t\n"), (5, LONG), (5, LONG), (6, "one two three four five six seven eight nine ten " * 4), (7, "É é ß x y z & % $ *"),
    (None, "null id, " + " ".join(f"u{i}" for i in range(25))), (8, "a b c"), (9, "A  b\tc"), (10, " ".join(f"v{i}" for i in range(40))), (11, "SOME words"),
]


def frame(spark, rows, *clash):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in clash})


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_quality_rules_on_all_columns(spark, docs):
    trusted = {1, 10}
    got = quality_rules.judge(docs, spark.createDataFrame([(1,), (1,), (10,), (None,)], "doc_id long")).collect()
    words_of = {t: WORD.findall(t or "") for t in {r[1] for r in ROWS}}
    pairs = sorted({(a, b) for w in words_of.values() for a, b in zip(w, w[1:], strict=False)} | {(w, w) for own in words_of.values() for w in own})
    bucket = lambda h: F.pmod(h, F.lit(quality_rules.BUCKETS))
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", bucket(F.xxhash64("a")).alias("one"), bucket(F.xxhash64("a", "b")).alias("two")).collect()
    one, two = {r.a: r.one for r in found}, {(r.a, r.b): r.two for r in found}
    grams = {t: [one[x] for x in w] + [two[p] for p in zip(w, w[1:], strict=False)] for t, w in words_of.items()}
    corpus, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for d, t in ROWS:
        np.add.at(corpus, grams[t], 1)
        if d in trusted:
            np.add.at(target, grams[t], 1)
    raw = (corpus + 1) / (corpus.sum() + len(corpus))
    ratio = np.log((target + quality_rules.PRIOR * raw) / (target.sum() + quality_rules.PRIOR) / raw)
    assert len(got) == len(ROWS)
    for r, (d, t) in zip(sorted(got, key=key), sorted(ROWS, key=key), strict=True):
        w, text = WORD.findall(t or ""), t or ""
        lines = [x for x in text.split("\n") if WORD.search(x)]
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        llr = ratio[grams[t]].mean() if w else 0.0
        assert r.doc_id == d
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), len(covered), failed)
        assert r.llr == pytest.approx(llr, abs=1e-3)
        assert r.kept == (not failed and r.llr >= quality_rules.THRESHOLD)


def test_accepted_keeps_the_callers_columns(spark):
    df = frame(spark, ROWS, "kept", "n_words", "llr", "base_failed", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    trusted = spark.createDataFrame([(10,)], "doc_id long")
    want = [(r.doc_id, r.text) for r in quality_rules.judge(df.select("doc_id", "text"), trusted).collect() if r.kept]
    out = quality_rules.accepted(df, trusted)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want, key=key)
    assert all(set(tuple(r)[2:]) == {"mine"} for r in got)
    assert quality_rules.accepted(df.where("1 = 0"), trusted).count() == 0


def test_lines_against_brute_force(spark):
    df = frame(spark, ROWS, "unit", "d1", "first", "removed", "n_units")
    norm = lambda x: tuple(WORD.findall(x.translate(LOWER)))
    first = {}
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, x in enumerate((t or "").split("\n")):
            if norm(x):
                first.setdefault(norm(x), (d, i))
    got = line_dedup.line_dedup(df).collect()
    for r, (d, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        lines = (t or "").split("\n")
        gone = [i for i, x in enumerate(lines) if norm(x) and first[norm(x)] != (d, i)]
        assert (r.doc_id, r.n_units, r.n_removed) == (d, len(lines), len(gone))
        assert r.text == (None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
        assert [(t or "")[s.start : s.start + s.length] for s in r.removed] == [lines[i] for i in gone]


def test_no_repeated_line_is_left_and_unique_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    norm = lambda x: " ".join(WORD.findall(x.translate(LOWER)))
    before = {r.doc_id: r.text for r in docs.collect()}
    count = Counter(norm(x) for t in before.values() for x in t.split("\n"))
    out = line_dedup.line_dedup(docs).collect()
    left = Counter(norm(x) for r in out for x in r.text.split("\n") if norm(x))
    assert max(left.values()) == 1
    assert set(left) == {x for x in count if x}
    untouched = [d for d, t in before.items() if all(count[norm(x)] == 1 for x in t.split("\n") if norm(x))]
    assert all(r.text == before[r.doc_id] and r.n_removed == 0 for r in out if r.doc_id in set(untouched))
    assert len(untouched) > 100


def test_paragraphs(spark):
    rows = [(1, "a b\nc\n\nd e\n \nlast"), (2, "x\n\nA  b c\n\n\nD e"), (3, "d\ne"), (4, None)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, rows), "paragraph").collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["a b\nc\n\nd e\n \nlast", "x", "", None]
    assert [(s.start, s.length) for s in got[2].removed] == [(3, 6), (12, 3)]


def test_shards_by_the_law(spark, docs):
    out = sharding.shard_rows(docs.withColumn("h", F.xxhash64("text")), ["doc_id", "h"], 4).collect()
    n = len(ROWS)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted(r.row_no for r in out) == list(range(n))
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    again = sharding.shard_rows(docs.repartition(3).withColumn("h", F.xxhash64("text")), ["doc_id", "h"], 4).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)
    side = math.isqrt(n - 1) + 1
    assert all(0 <= r.row_no < side * side for r in out)


def test_sharding_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = sharding.op5_sharding(spark, folder).collect()
    assert {r.doc_id for r in out} == set(texts)
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in out)
    assert all(r.law == "rows" and r.grown_shard is None for r in out)
    n = Counter(r.shard for r in out)
    assert set(n) == set(range(8))
    assert max(n.values()) - min(n.values()) <= 1
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in sorted(n) for k in range(n[s])]


def test_shards_written_and_read(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "x"), ["doc_id", "text"], 3)
    back = spark.read.parquet(str(tmp_path / "x"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=key) == sorted(ROWS, key=key)
    assert sorted(int(p.name.split("=")[1]) for p in (tmp_path / "x").glob("shard=*")) == [0, 1, 2]


def test_packing_covers_every_id(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    left = Counter()
    for d, t in ROWS:
        left[d, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])] += 1
    out = packing.packing_digests(docs).collect()
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist()
        assert sum(n for _, n in parts) <= 4096
    for (d, ids), many in left.items():
        crc = lambda a, n: zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())
        mine = [r for r in out if r.doc_id == d and r.doc_tokens == len(ids) and r.ids_crc32 == crc(r.start, r.length)]
        cover = Counter(i for r in mine for i in range(r.start, r.start + r.length))
        assert cover == {i: many for i in range(len(ids))}
    total = sum(r.length for r in out)
    assert total == sum(len(ids) * many for (_, ids), many in left.items())
    assert len(sequences) <= total / 4096 + 13


def test_simhash_components_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()] + [(10_000 + i, t) for i, (_, t) in enumerate(ROWS)]
    prints = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        h = [xxhash.xxh64_intdigest(s, 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else []))]
        bits = (np.array(h, np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) if h else np.zeros((0, 64), np.uint64)
        prints.append(sum(1 << b for b in np.flatnonzero(2 * bits.sum(0) > len(h)).tolist()))
    fp = np.array(prints, np.uint64)
    root = list(range(len(rows)))
    for i, j in zip(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2), strict=True):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root] if a != b else root
    least = {}
    for r, (d, _) in zip(root, rows, strict=True):
        least[r] = min(least.get(r, d), d)
    got = {r.doc_id: (bytes(r.fp).hex(), r.component_id) for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, root, strict=True)}


def test_classifier_edge_cases(spark):
    df = frame(spark, ROWS, "score", "p", "x", "predicted")
    model, prior = quality_model.train(df, spark.createDataFrame([(1,), (10,), (99,), (None,)], "doc_id long"))
    out = quality_model.score_documents(df, model).collect()
    assert len(out) == len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id in (2, 3, 4)}) == 1
    assert 0 < prior < 1
    empty = df.where("1 = 0")
    none, _ = quality_model.train(empty, empty)
    assert {r.score for r in quality_model.score_documents(df, none).collect()} == {0.5}
    assert quality_model.score_documents(empty, model).count() == 0
    assert [quality_model.is_held_out(i) for i in (1, 2, 6)] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, 6)]


def test_hashed_words_are_those_of_the_pattern():
    import pyarrow as pa

    from codequarry.llm.word_hashes import hashed_words

    texts = [t for _, t in ROWS] + ["à\x85b  c\x1fd\r\n\x0b\x0ce"]
    h, ends = hashed_words(pa.array(texts))
    want = [[xxhash.xxh64_intdigest(w) for w in WORD.findall((t or "").translate(LOWER))] for t in texts]
    assert np.diff(ends, prepend=0).tolist() == list(map(len, want))
    assert h.tolist() == [x for w in want for x in w]


def test_every_piece_is_packed_by_the_plan():
    """Also where one length is a third or all of the pieces: whole sequences but for less than one, pieces cut only to close gaps."""
    rng = np.random.default_rng(4)
    shapes = [{3000: 900}, {1500: 700}, {3000: 300, 2500: 10}, {4095: 50}, {1: 5}, {}, {2048: 7}, {3000: 400} | {int(x): 2 for x in rng.integers(1, 900, 400)}]
    shapes += [dict(Counter(rng.integers(1, 4096, n).tolist())) for n in (3, 50, 2000)] + [{3000: 1000} | dict(Counter(rng.integers(1, 4096, 2000).tolist()))]
    for histogram in shapes:
        plan = packing.make_plan(histogram, 10)
        filled, cuts, pieces = {}, 0, sum(histogram.values())
        for x, n in histogram.items():
            for k in range(n):
                parts = plan.places(x, k)
                assert sum(t for _, _, t in parts) == x
                cuts += len(parts) - 1
                for s, at, t in parts:
                    filled.setdefault(s, []).append((at, t))
        sizes = []
        for s in sorted(filled):
            parts = sorted(filled[s])
            assert [at for at, _ in parts] == np.cumsum([0, *[t for _, t in parts]])[:-1].tolist()
            sizes.append(sum(t for _, t in parts))
        assert sorted(filled) == list(range(10, 10 + len(filled)))
        whole = [x for x in sizes if packing.CAPACITY - x <= packing.MAX_SLACK]
        small = sizes[len(whole) :]
        assert sizes[: len(whole)] == whole and sum(small) < packing.CAPACITY and all(x & (x - 1) == 0 for x in small)
        assert cuts <= len(sizes) + 12


def test_labels_follow_links(monkeypatch):
    """Against one link after another: chains, stars and repeats, with few and many links held."""
    rng = np.random.default_rng(12)
    for held in (1, 7, 1 << 20):
        monkeypatch.setattr(vptree, "HELD", held)
        for n in (1, 5, 300):
            labels, want = vptree.Labels(n), list(range(n))
            for _ in range(n):
                row, others = int(rng.integers(n)), rng.integers(max(0, n - 40), n, rng.integers(1, 4))
                labels.link(row, others)
                for o in [row, *others.tolist()]:
                    x, y = want[row], want[o]
                    want = [min(x, y) if v in (x, y) else v for v in want]
            assert labels.settle().tolist() == want


def test_gradient_of_the_risk_by_differences():
    """The risk in plain Python, on both sides of zero, and for positives against unlabelled."""
    rng = np.random.default_rng(2)
    ep, eu = rng.normal(0.5, 1, (40, 6)), rng.normal(0, 1, (60, 6))
    soft = lambda z: math.log1p(math.exp(z))
    mean = lambda rows, w, sign: sum(soft(sign * sum(a * b for a, b in zip(r, w, strict=True))) for r in rows.tolist()) / len(rows)
    rest = lambda w, prior: mean(eu, w, 1) - prior * mean(ep, w, 1)
    seen = set()
    for prior in (None, 0.3, 0.9):
        for scale in (0.1, 2.0):
            w = rng.normal(0, scale, 6)
            if prior is None:
                risk = lambda w: mean(ep, w, -1) + mean(eu, w, 1)
            elif rest(w, prior) >= 0:
                risk = lambda w, q=prior: q * mean(ep, w, -1) + rest(w, q)
            else:
                risk = lambda w, q=prior: -rest(w, q)
            seen.add(prior is not None and rest(w, prior) >= 0)
            steps = np.eye(6) * 1e-5
            want = [(risk(w + s) - risk(w - s)) / 2e-5 for s in steps]
            assert quality_model.gradient(ep, eu, w, prior) == pytest.approx(want, abs=1e-6)
    w = np.full(6, 3.0)
    assert rest(w, 0.95) < 0
    assert quality_model.gradient(ep, eu, w, 0.95) == pytest.approx([-(rest(w + s, 0.95) - rest(w - s, 0.95)) / 2e-5 for s in np.eye(6) * 1e-5], abs=1e-6)
    assert seen == {True, False}
