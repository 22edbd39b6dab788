"""Each operator against brute force or SQL, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from compare import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codequarry.llm import exact_dedup, line_dedup, mixing, packing, quality_model, quality_rules, sharding, simhash, suffix_dedup, token_files
from codequarry.llm.queries import QUERIES, SQL
from codequarry.llm.tokens import WordEncoder

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 97}x{i}" for i in range(3000))
ROWS = [
    (1, "The Cat sat\non the mat with a hat and a bat today", "a", 5),
    (2, "the cat SAT\non the mat with a hat and a bat today", "a", 6),
    (2, "the cat SAT\non the mat with a hat and a bat today", "a", 6),
    (3, None, None, None),
    (4, "", "b", 0),
    (5, LONG, "b", 1),
    (6, "new start " + LONG[4000:9000] + " é ß\tend", "b", 1),
    (None, "on the mat with a hat and a bat today", None, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, "k", 7) for r in ROWS], "doc_id long, text string, source string, n_chars long, block string, name int")
    return df.withColumnRenamed("name", "pos")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], D)


def test_exact_groups(docs, empty):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, 64).collect())
    assert got == [(False, 1, 2, 3, False), (False, 2, 2, 3, False), (False, 2, 2, 3, True), (False, 3, 4, 2, False), (False, 4, 4, 2, True), (False, 5, 5, 1, True), (False, 6, 6, 1, True), (True, 0, None, 1, True)]
    assert exact_dedup.exact_dedup(docs, 64).count() == 5
    assert exact_dedup.exact_groups(empty).count() == 0


def test_shards(docs, empty):
    out = sharding.shard_rows(docs, ["doc_id", "text"], 3).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [2, 3, 3]
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in range(3))
    assert sharding.shard_rows(empty, ["doc_id"], 3).count() == 0


def test_feistel_is_a_permutation(spark):
    from codequarry.llm.common import with_feistel

    for n in (1, 2, 3, 10, 577):
        got = with_feistel(spark.range(n), "y", F.col("id"), F.lit(n), F.lit(5)).collect()
        assert sorted(r.y for r in got) == list(range(n))


def test_mix(spark, docs, empty):
    sized = mixing.sized(docs)
    out = mixing.taken_words(sized, extra=["__q_h"]).collect()
    assert len(out) == len(ROWS)
    assert all(r.taken <= 2 * r.size for r in out)
    assert mixing.taken_words(mixing.sized(empty)).count() == 0
    big = mixing.taken_words(mixing.sized(spark.read.parquet(f"{D}/documents.parquet")), block=16, extra=["__q_h"]).collect()
    sums = {}
    for r in big:
        n, t = sums.setdefault((r.source_size, r.target), [0, 0])
        sums[r.source_size, r.target] = [n + r.size, t + r.taken]
    assert sum(t for _, t in sums.values()) == pytest.approx(1.5 * sum(n for n, _ in sums.values()), rel=0.03)


def test_mixed_documents(docs):
    taken = sum(r.taken for r in mixing.taken_words(mixing.sized(docs), extra=["__q_h"]).collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == taken


def test_quality_rules(docs, empty, spark):
    trusted = spark.createDataFrame([(1,), (None,)], "doc_id long")
    for r in quality_rules.judge(docs, trusted).collect():
        w, text = WORD.findall(r.text or ""), r.text or ""
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(empty, trusted).count() == 0
    text = "a b c d e f g h x a b c d e f g h a b c d e f g h i\n\nq\nq"
    r = quality_rules.base_measures(quality_rules._hashes(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r.n_repeat_words, r.n_dup_lines) == (24, 1)


def test_target_counts_all_trusted_documents(spark):
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
    corpus, target = quality_rules.ngram_counts(docs, docs.where("doc_id >= 100").select("doc_id"))
    assert (corpus.sum(), target.sum()) == (3 * 20_500, 3 * 20_400)  # two words and a pair


def test_word_encoder_equals_the_tokenizer():
    path = public_tokenizers.path(token_files.TOKENIZER)
    odd = ["", " \t\n", "it's don't 'Tis a'b. x'. é'S", "<|endoftext|>x y<|endoftext|>", "Σίσυφος ΟΔΟΣ İx 12ab!?", " é 가", "a\x1cb \x85 c", "foo... bar--- (baz) $5 a_b", LONG]
    coder, tokenizer = WordEncoder(path), Tokenizer.from_file(path)
    assert [np.frombuffer(x, np.uint16).tolist() for x in coder.encode(odd)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in odd]


def test_rank_coding_round_trip():
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 3], np.uint32)
    for n in range(len(ranks) + 1):
        assert token_files.unpack_ranks(*token_files.pack_ranks(ranks[:n]), n).tolist() == ranks[:n].tolist()


def test_token_file(docs, empty):
    path = public_tokenizers.path(token_files.TOKENIZER)
    got = sorted(token_files.read_token_file(*token_files.write_token_file(docs, path)).collect(), key=lambda r: r.start)
    tokenizer, at = Tokenizer.from_file(path), 0
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 4, 5, 6]
    texts = {r[0]: r[1] or "" for r in ROWS}
    for r in got:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, np.frombuffer(r.ids, "<u4").tolist()) == (at, ids)
        at += len(ids)
    assert token_files.read_token_file(*token_files.write_token_file(empty, path)).count() == 0


def test_packing(docs, empty):
    out = packing.packing_digests(docs).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert packing.packing_digests(empty).count() == 0


def test_best_fill_is_the_best_subset_sum():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = {int(x): int(k) for x, k in zip(rng.choice(range(3, 30), 4, replace=False), rng.integers(1, 4, 4), strict=True)}
        room = int(rng.integers(5, 60))
        got = packing.best_fill(counts, sorted(counts, reverse=True), room)
        sums = [sum(a * b for a, b in zip(counts, c, strict=True)) for c in product(*[range(k + 1) for k in counts.values()])]
        assert all(k <= counts[x] for x, k in got.items())
        assert sum(x * k for x, k in got.items()) == max(s for s in sums if s <= room)


def test_substring_dedup(docs, empty):
    texts = [(r[0], (r[1] or "").encode()) for r in ROWS]
    count = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = []
    for doc, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want.append((str(doc), bytes(np.frombuffer(t, np.uint8)[~gone])))
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs).collect()) == sorted(want)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_line_dedup(docs, empty):
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert out[None].text == ROWS[-1][1]  # a null doc_id ranks first
    assert (out[1].text, out[1].n_removed, out[1].removed[0].start) == ("The Cat sat", 1, 12)
    assert line_dedup.line_dedup(empty).count() == 0
    clash = line_dedup.line_dedup(docs.withColumn("removed", F.lit("x")).withColumn("unit", F.lit(1)))
    assert clash.columns == [*docs.columns, "unit", "n_units", "n_removed", "removed"]
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in clash.collect()) == sorted((str(r.doc_id), r.text, len(r.text or "")) for r in line_dedup.line_dedup(docs).collect())


def test_quality_model_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in quality_model.op8_quality_classifier(spark, folder).collect() if r.held_out and r.doc_id in label]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == label[r.doc_id] for r in rows]) >= 0.95


def test_simhash(docs, empty):
    def fingerprint(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(s, 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else []))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = {r.doc_id: (int(bytes(r.fp).hex(), 16), r.component_id) for r in simhash.near_components(docs).collect()}
    assert all(got[r[0]][0] == fingerprint(r[1]) for r in ROWS)
    assert got[2][1] == 1
    assert got[4][1] == 3
    assert simhash.near_components(empty).count() == 0


def test_tree_finds_all_links():
    rng = np.random.default_rng(1)
    from codequarry.llm.vptree import build, link_near, route

    base = rng.integers(0, 2**63, (400, 1), np.uint64)
    rows = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 63, (400, 1), np.uint64)), base[:50] ^ np.uint64(3)])
    near = np.bitwise_count(rows ^ rows.T) <= 2
    root, leaves = build(rows[::3], 8)
    at, leaf, home = route(root, rows, np.ones(len(rows), bool), 2)
    assert leaves > 10
    met = np.zeros_like(near)
    for k in range(leaves):
        mine, all_ = at[(leaf == k) & home], at[leaf == k]
        met[np.ix_(mine, all_)] = True
    assert (met | met.T)[near].all()
    label = link_near(rows, np.ones(len(rows), bool), 2)
    assert (label[:, None] == label[None, :])[near].all()


def test_digest_is_of_kept_bytes():
    assert hashlib.sha256(suffix_dedup.cut(b"abc", [])[0]).hexdigest() == hashlib.sha256(b"abc").hexdigest()


def test_another_tokenizer_gets_whole_texts():
    """One that keeps case and white space is not taken word by word."""
    own, other = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.by_words and not other.by_words
    texts = ["Hello  World, it's\n12", "", "é ß"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, np.uint16).tolist() for x in other.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_copies_of_one_row(spark, monkeypatch):
    """As many rows come out as went in, one of them kept."""
    monkeypatch.setattr(exact_dedup, "COPIES", 7)
    rows = [(1, "Same")] * 50 + [(1, "same")] * 3 + [(2, "other")] * 7 + [(3, "x")]
    out = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.group_size) for r in out) == [(1, 53)] * 53 + [(2, 7)] * 7 + [(3, 1)]
    assert sum(r.kept for r in out) == 3
