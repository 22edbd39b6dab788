"""Top-k search, source divergence and token alignment against brute force, with nulls, ties, repeats, long texts, empty tables and clashing names."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codequarry.llm import alignment, divergence, knn
from compare import same

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", [knn, divergence])
def test_queries_equal_their_sql(spark, module):
    for name, sql in module.SQL.items():
        same(spark, module.QUERIES[name], sql, D)


def ranked(rows, k, scale, every):
    """By all pairs, in plain Python."""
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(good):
        if q is None or q % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i is None, i or 0, i) for b, (i, w) in enumerate(good) if b != a and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


def search(spark, rows, k, every, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumns({"score": F.lit("mine"), "name": F.lit("mine"), "dim": F.lit("mine")})
    return sorted((tuple(r) for r in knn.top_k_by_product(df, df.where(F.col("vec_id") % every == 0), k, 4, **sizes).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_top_k_with_edge_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 2, 5)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0, 1.0]) for i in range(60)] + [(20, [1.0] * 5), (20, [1.0] * 5), (40, [0.0] * 5), (40, [0.1] * 5)]
    rows += [(None, [1.0] * 5), (None, [9.0] * 5), (60, None), (80, [1.0, None, 1.0, 1.0, 1.0]), (100, [math.nan] * 5), (120, [math.inf] + [0.0] * 4), (140, [1.0, 2.0]), (160, [2.0, 2.0]), (180, []), (200, [])]
    rows += [(5000, [300.0, -2e6, 5.0, 1e5, 0.0])]
    assert search(spark, rows, 7, 20, group_queries=5, block_rows=64, max_pivots=12) == ranked(rows, 7, 4, 20)
    assert search(spark, rows, 7, 20) == ranked(rows, 7, 4, 20)
    assert search(spark, [], 7, 20) == []
    assert search(spark, [(20, [1.0])], 7, 20) == []
    assert search(spark, [(7, [1.0])], 7, 20) == []


def test_rows_go_only_where_they_may_matter(spark):
    """Tight clusters far apart: each group of queries gets the rows of its own cluster, not all."""
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 1, (8, 16))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    v = np.floor(1000 * (middles[rng.integers(0, 8, 4000)] + rng.normal(0, 0.001, (4000, 16)))).astype(np.int64)
    most = int((v * v).sum(1).max())
    cells = knn.Cells(knn.choose_pivots(knn.lifted(v[:500], most, False), 60), most, 16)
    d, dq = knn.distances(knn.lifted(v, most, False), cells.pivots), knn.distances(knn.lifted(v, most, True), cells.pivots)
    own, ask = d.argmin(1), dq.argmin(1)
    queries = {int(c): (int((ask == c).sum()), float(dq[ask == c].min(1).max())) for c in set(ask.tolist())}
    nearest = [(int(c), float(x)) for c in set(own.tolist()) for x in np.sort(d[own == c, c])[:11]]
    cells.summarize(queries, nearest, 10, 50)
    row, group = cells.groups_of_rows(v)
    assert len(row) < 0.5 * len(v) * len(set(group.tolist()))
    assert set(row.tolist()) <= set(range(len(v)))


def audit(rows, least):
    """(lang, source, part, item, value, rank) with Python's whole numbers."""
    docs = [(lang or "", source or "", [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        among = Counter(w for d in own for w in set(d[2]))
        kept = {w for w, n in among.items() if n >= least}
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2] if w in kept) for s in {d[1] for d in own}}
        every = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        for s, c in counts.items():
            pairs = sorted((-sum(f(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in counts if t != s)
            terms = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if c[w] > 0 and p[s][w] > q[w])[:10]
            out += [(lang, s, part, item, -v, r + 1) for part, found in (("pair", pairs), ("term", terms)) for r, (v, _, item) in enumerate(found)]
    return sorted(out)


def test_divergence_with_edge_cases(spark, monkeypatch):
    rng = np.random.default_rng(1)
    word = lambda: rng.choice(["Über", "ÜBER", "the", "The", "a1b", "x-y", "zoo", "naïve", "日本", "K"])  # noqa: E731  the last is the Kelvin sign
    rows = [(rng.choice(["en", "de"]), rng.choice(["s1", "s2", "é", "z"]), " ".join(word() for _ in range(rng.integers(0, 30)))) for _ in range(80)]
    rows += [(None, None, "the the"), ("", "s", "the"), ("xx", "only", ""), ("xx", "other", None), ("yy", "one", "the"), ("en", "empty", "12 34\x00\x7f"), ("en", None, "the " * 5000)] * 2
    frame = lambda rows: spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("mine") for c in ("term", "g", "value", "rank", "n")})
    got = lambda rows, **sizes: sorted(tuple(r) for r in divergence.source_divergence(frame(rows), 3, **sizes).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got(rows) == audit(rows, 3)
    assert got([]) == []
    rows += [("en", f"s{k}", "the zoo the naïve über") for k in range(5)]
    assert got(rows, block_terms=2, run_size=2) == audit(rows, 3)
    # What a task holds, in this process: small steps add up to the same.
    batch = pa.RecordBatch.from_pylist([{"lang": lang or "", "source": source or "", "text": (text or "").encode()} for lang, source, text in rows])
    sums = []
    for held, at_once, cells in ((divergence.HELD, divergence.AT_ONCE, divergence.CELLS), (3, 16, 8)):
        for name, x in (("HELD", held), ("AT_ONCE", at_once), ("CELLS", cells)):
            monkeypatch.setattr(divergence, name, x)
        found = defaultdict(lambda: np.zeros(2, np.int64))
        for b in divergence._count([batch]):
            for r in b.to_pylist():
                found[r["lang"], r["source"], r["term"]] += (r["n"], r["docs"])
        p = divergence.shares(np.arange(60).reshape(4, 15) ** 2, np.full((4, 1), 90_000), 15)
        sums.append(({k: tuple(x.tolist()) for k, x in found.items()}, divergence.pair_sums(p, p).tolist()))
    assert sums[0] == sums[1]


def test_shares_are_exact_for_huge_counts():
    count, total, v = np.array([0, 10**12, 123456789012345]), np.array([4 * 10**15]), 77_777
    assert divergence.shares(count, total, v).tolist() == [1 + 10**9 * (int(c) + 2) // (4 * 10**15 + 2 * v) for c in count]


PATHS = public_tokenizers.path(alignment.TOKENIZER_A), public_tokenizers.path(alignment.TOKENIZER_B)


def aligned(texts):
    """Rows of all texts from whole encodings and byte ranges, without units or arrays."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    of = alignment.byte_level()
    docs, counts = [], Counter()
    for text in texts:
        links, groups, n = [], [], (0, 0)
        if text:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids
            ids_b = b.encode(text)
            raw_a = [bytes(of[c] for c in a.id_to_token(k)) for k in ids_a]
            raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b.id_to_piece(k)) for k in ids_b)]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                n = len(ids_a), len(ids_b)
                i = j = at_a = at_b = 0
                group = ([], [])
                while i < len(ids_a) or j < len(ids_b):
                    if at_a <= at_b:
                        group[0].append(ids_a[i])
                        at_a, i = at_a + len(raw_a[i]), i + 1
                    else:
                        group[1].append(ids_b[j])
                        at_b, j = at_b + len(raw_b[j]), j + 1
                    if at_a == at_b:
                        groups.append(group)
                        group = ([], [])
                ends_a, ends_b = np.cumsum([0, *map(len, raw_a)]), np.cumsum([0, *map(len, raw_b)])
                j = 0
                for i in range(len(ids_a)):
                    while ends_b[j + 1] <= ends_a[i]:
                        j += 1
                    k = j
                    while k < len(ids_b) and ends_b[k] < ends_a[i + 1]:
                        links.append((ids_a[i], ids_b[k]))
                        k += 1
        counts.update(links)
        docs.append((n, groups, links))
    most = defaultdict(int)
    for (_, b_id), n in counts.items():
        most[b_id] = max(most[b_id], n)
    say = lambda groups: ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    return [(*n, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(say(groups).encode()).hexdigest() if groups else "") for n, groups, links in docs]


ODD = [
    "Hello world, it's 12 o'clock.", None, "", " ", "  two  spaces ", " lead", "trail ", "tab\tand\nline\r\n end", "a▁b c", "x y z", "é ü ß 日本語 \U0001f600 ok", "<|endoftext|> a <s> b </s> <unk> <0x41>", "\x00 nul \x00a",
    " em space　wide b", "a ́b c", "﻿mark x", "'s 's don't  's", "a \x1c b \x85 c", "same same same", "same same same", "x" * 3000, "word " * 4000 + "end", "\n\n a \n b", "1 2 3 4,5 ,6 . 7", "▁", "a ​ b",
]
KEYS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_byte_ranges(spark, monkeypatch):
    def got(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("part", "codes", "n_a", "groups")})
        out = alignment.score_links(alignment.save(alignment.align(docs, *PATHS, keep_groups=True), "t")).orderBy("doc_id").collect()
        for r in out:
            assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") and bool(r.groups) == bool(r.n_a)
        return [tuple(r[c] for c in KEYS) for r in out]

    texts = ODD + [r.text for r in spark.read.parquet(f"{D}/documents.parquet").orderBy("doc_id").collect()]
    want = aligned(texts)
    assert got(texts) == want
    assert got([]) == []
    monkeypatch.setattr(alignment, "PART_CHARS", 300)
    assert got(texts[:60]) == aligned(texts[:60])
    # What a worker holds, in this process: texts in small pieces, few units kept.
    for name, small in (("AT_ONCE", 50), ("UNITS", 40), ("PER_CALL", 3)):
        monkeypatch.setattr(alignment, name, small)
    own = alignment.Aligner(*PATHS)
    for text, row in zip(texts, want, strict=True):
        document = alignment.Document(False)
        for piece in alignment.split_units(text) if text else ():
            alignment._add_all(own, [(document, piece)])
        assert document.row()[:5] == (*row[:4], row[6])


def test_alignment_query_keeps_all_rows(spark):
    assert alignment.op13_token_alignment(spark, D).count() == spark.read.parquet(f"{D}/documents.parquet").count()
