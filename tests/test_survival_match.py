"""The survival match against all pairs."""

import random

import pandas as pd
from pyspark.sql import functions as F

from codequarry.operators import matching
from codequarry.plans.history_queries import QUERIES

D = "/root/testdata/sf0.001"
FIELDS = ("id", "rule_name", "file", "text", "message", "line", "print")


def by_all_pairs(before, after):
    """Each one before, in order, takes the first of the best that are free."""
    free, out = sorted(after, key=lambda r: r["id"]), []
    for a in sorted(before, key=lambda r: r["id"]):
        best = (0.0, None, "no-match")
        for b in free:
            if (a["rule_name"], a["file"]) == (b["rule_name"], b["file"]):
                score, reason = matching.survival_score(a, b)
                if score > best[0]:
                    best = (score, b, reason)
        if best[1] is not None:
            free.remove(best[1])
        out.append((a["id"], best[1] and best[1]["id"], best[0], best[2]))
    return sorted(out)


def test_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "x", "return", "value", "é", "日本"]
    for trial in range(3):
        some = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9 - 2 * trial)))
        rows = [{"id": i, "rule_name": rng.choice(["r", "q"]), "file": rng.choice([1, 2]), "text": some(), "message": rng.choice(["", "m", "n", "o"]), "line": rng.randrange(0, 60), "print": rng.choice(["p", "q", "s", str(i)])} for i in range(260)]
        df = spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in rows], "id long, rule_name string, file int, text string, message string, line int, print string")
        got = sorted(tuple(r) for r in matching.match_survival(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["file"]).collect())
        want = by_all_pairs([r for r in rows if r["id"] % 2 == 0], [r for r in rows if r["id"] % 2])
        assert got == want
        assert len({r[3] for r in got}) == 6  # every rung of the ladder, and none
    empty = df.where("1 = 0")
    assert matching.match_survival(empty, empty, ["file"]).collect() == []


def test_query_over_all_lines(spark):
    """The query against the score of all pairs of a file's lines."""
    rows, call = [], matching.match_survival

    def seen(before, after, scope):
        rows.extend([[r.asDict() for r in side.collect()] for side in (before, after)])
        return call(before, after, scope)

    matching.match_survival = seen
    try:
        got = sorted(tuple(r) for r in QUERIES["h09_survival_match"](spark, D).collect())
    finally:
        matching.match_survival = call
    lines = spark.read.parquet(f"{D}/documents.parquet").where("doc_id % 2 = 0").select(F.sum(F.size(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\n$", ""), "\n")))).first()[0]
    assert lines - 20 < len(got) <= lines  # empty texts have no line
    some = [[r for r in side if r["file"] in (0, 4)] for side in rows]
    ids = {r["id"] for r in some[0]}
    assert [r for r in got if r[0] in ids] == by_all_pairs(*some)


def test_bound_is_the_longest_common_subsequence():
    """Of many pairs at once, of texts of no, one, many and very many words of bits, against the plain table."""

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            above = row[:]
            for j, d in enumerate(y):
                row[j + 1] = above[j] + 1 if c == d else max(above[j + 1], row[j])
        return row[-1]

    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    sizes = [(0, 5), (5, 0), (64, 64), (65, 3), (1, 200), (64 * matching.WIDE + 9, 50), (64 * matching.WIDE, 300), *((rng.randrange(1, 400), rng.randrange(1, 400)) for _ in range(60))]
    pairs = [(some(m), some(n)) for m, n in sizes] + [("x" * 130, "x" * 129), ("日本é" * 30, "é日x" * 40)]
    left, right = zip(*pairs, strict=True)
    got = matching.common_subsequence(matching._classes(left), matching._classes(right))
    assert got.tolist() == [plain(x, y) for x, y in pairs]


def test_difflib_runs_on_few_pairs_alone(spark):
    """Of texts that have as many of each letter, only those go to difflib that have enough of them in order, and the low limit holds for common messages alone."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(60)]
    texts = [" ".join(rng.sample(words, 60)) for _ in range(60)]
    texts[59] = texts[0][:-4] + "zzzz"
    df = spark.createDataFrame([(1, t, "m" if i % 4 < 2 else "n") for i, t in enumerate(texts)], "k int, text string, message string").withColumn("i", F.monotonically_increasing_id())
    sides = [df.where(F.col("text").isin(texts[k::2])) for k in (0, 1)]
    calls = []
    call = matching.similarity
    matching.similarity = lambda x, y: calls.append(1) or call(x, y)
    try:
        rated = list(matching.ratio_from.func(iter([tuple(pd.Series(c) for c in ([x for x in texts[::2] for _ in texts[1::2]], [y for _ in texts[::2] for y in texts[1::2]], [matching.ALIKE_ENOUGH] * 900))])))[0]
    finally:
        matching.similarity = call
    assert len(calls) <= 5 and rated[rated > 0].tolist() == [call(texts[0], texts[59])]
    found = [tuple(r) for r in matching.alike_texts(*sides, ["k"]).select("text", "other", "strong").collect()]
    assert found == [(texts[0], texts[59], True)]
