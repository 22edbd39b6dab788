"""Substring removal against brute force, on all columns."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import suffix_dedup


def brute_force(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    out = []
    for doc, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[1:-1]])
        out.append((str(doc), len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def by_operator(df):
    out = suffix_dedup.suffix_dedup(df).mapInArrow(suffix_dedup.digest_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return sorted((str(r.doc_id), *tuple(r)[1:]) for r in out.collect())


def words(rng, n):
    return " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(n))


@pytest.mark.parametrize(("small", "many"), [(False, 0), (True, 1 << 20), (True, 60), (True, 1)])
def test_equals_brute_force(spark, monkeypatch, small, many):
    """Passages across and within documents, cut at every length around 200, copies, near copies, runs of one character."""
    rng, rows = np.random.default_rng(5), []
    passage = words(rng, 120)
    for k in range(40):
        a, b = sorted(rng.integers(0, len(passage), 2))
        rows.append((k, words(rng, 20) + passage[a:b] + words(rng, 30)))
    for k in range(195, 206):
        rows.append((k, words(rng, 15) + passage[7 : 7 + k] + words(rng, 5)))
    twice = words(rng, 60)
    rows += [(300, twice + "  " + twice), (301, "a" * 450), (302, "b" * 199), (303, "c" * 200), (304, "ab" * 300), (305, None), (306, ""), (None, twice[:230])]
    rows += [(307, words(rng, 50))] * 2 + [(308, rows[3][1]), (309, words(rng, 40) + " é ß ☃ " * 30), (310, "☃" * 70 + words(rng, 3)), (311, "x" + "☃" * 70)]
    base = words(rng, 150)
    for k in range(12):
        at = rng.integers(0, len(base))
        rows.append((400 + k, base[:at] + "ZZ" + base[at + 1 :]))
    rows.append((500, words(rng, 3000) + twice + words(rng, 3000)))
    if small:
        for name, value in (("TOGETHER", 7), ("HELD", 60), ("TASK_ROWS", 50), ("AT_ONCE", 300), ("MOST_ROWS", many)):
            monkeypatch.setattr(suffix_dedup, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("spans", "h", "t", "doc", "rows", "removed")})
    assert by_operator(df) == brute_force(rows)
    assert suffix_dedup.suffix_dedup(df.where("1 = 0")).count() == 0


def test_a_folder_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert by_operator(docs) == brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_a_passage_in_many_surroundings_is_dealt_out(spark, monkeypatch):
    """A passage that stands between different texts each time: its phrases' rows go to many tasks, and windows within it are found."""
    rng = np.random.default_rng(6)
    passage = words(rng, 60)[:260]
    other = [words(rng, 30) for _ in range(3000)]
    rows = [(k, other[k] + (passage if k % 2 else passage[40:190]) + other[-k - 1]) for k in range(3000)]
    for name, value in (("TASK_ROWS", 500), ("MOST_ROWS", 1000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    sizes, tables, save = [], {}, suffix_dedup.save

    def seen(df, label, *more):
        tables[label] = save(df, label, *more)
        return tables[label]

    monkeypatch.setattr(suffix_dedup, "save", seen)
    monkeypatch.setattr(suffix_dedup, "discard", lambda df: None)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert by_operator(df) == brute_force(rows)
    large = {r["bucket"]: r["k"] for r in tables["large-buckets"].collect()}
    assert large
    for r in tables["triggers"].where("bucket is not null").select("bucket", "rows").collect():
        if r["bucket"] in large:
            one = np.frombuffer(r["rows"], suffix_dedup._ROW)
            sizes += (suffix_dedup.mix64(one["ctx"] ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(large[r["bucket"]])).tolist()
    assert max(Counter(sizes).values()) < 0.5 * len(sizes)
    assert tables["windows"].count() > 1500
