"""Parsers of captured text and manifests, on rows with odd cases."""

import json

from pyspark.sql import functions as F

from codequarry.functions import issues
from codequarry.sources import commits, git_text

A, B = "a" * 40, "b" * 40


def one(spark, text, column="output"):
    return spark.createDataFrame([(1, text), (2, None), (3, "")], f"k int, {column} string")


def test_log_entries(spark):
    rows = git_text.log_entries(one(spark, "h1|n|e|12|a | b\nbad|line\nh2|n|e|x|s"), ["k"]).orderBy("line_no").collect()
    assert [(r.commit_hash, r.timestamp, r.subject) for r in rows] == [("h1", 12, "a | b"), ("h2", 0, "s")]


def test_name_status_and_numstat(spark):
    rows = git_text.name_status(one(spark, "M\ta.py\nR100\told.py\tnew/b.py\n\nA\tsrc/{x => y}/z.py\nD\n"), ["k"]).orderBy("line_no").collect()
    assert [(r.status, r.path) for r in rows] == [("M", "a.py"), ("R100", "new/b.py"), ("A", "src/y/z.py")]
    rows = git_text.numstat(one(spark, "3\t1\ta => b\n-\t-\timg.png\n5\t0\td/{ => e}/f\nx"), ["k"]).orderBy("line_no").collect()
    assert [(r.path, r.added, r.deleted) for r in rows] == [("b", 3, 1), ("img.png", None, None), ("d/e/f", 5, 0)]


def test_hunks(spark):
    patch = "@@ -1,2 +10,3 @@ def f\n+x\n@@ -5 +20 @@\n@@ -9,2 +30,0 @@\n@@ -1 +11,2 @@"
    assert sorted(r.line for r in git_text.changed_lines(one(spark, patch, "patch"), ["k"]).collect()) == [10, 11, 12, 20]


def test_file_patches(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n++c\ndiff --git a/gone b/gone\n--- a/gone\n+++ /dev/null\n-z"
    rows = git_text.file_patches(one(spark, diff, "diff"), ["k"]).orderBy("part_no").collect()
    assert [(r.path, r.added) for r in rows] == [("x.py", ["b", "+c"]), ("gone", [])]
    bare = spark.createDataFrame([(1, "+q\n r", "p.py")], "k int, diff string, path string")
    assert [(r.path, r.added) for r in git_text.file_patches(bare.withColumnRenamed("path", "fb"), ["k"], fallback="fb").collect()] == [("p.py", ["q"])]


def test_blame(spark):
    text = f"{A} 1 1 2\nauthor x\n\tcode {B} 1 1\n{A} 2 2\n\tmore\n{B} 1 3 1\n\tend"
    assert {r.sha: r.n_lines for r in git_text.blame_counts(one(spark, text), ["k"]).collect()} == {A: 2, B: 1}


def test_ranges_of_many_files(spark):
    diff = "@@ -1 +1 @@\n--- a/x\n+++ b/x.py\n@@ -1,2 +10,3 @@ f\n+a\n@@ -5 +20 @@\n@@ -9,2 +30,0 @@\n--- a/y\n+++ b/d e.py\n@@ -0,0 +1,2 @@"
    got = git_text.added_ranges(one(spark, diff, "diff"), ["k"]).collect()
    assert sorted((r.path, r.start, r.stop) for r in got) == [("d e.py", 1, 2), ("x.py", 10, 12), ("x.py", 20, 20)]


def test_blame_totals(spark):
    text = f"\tbefore\n{A} 1 1\n\tcode\n\tmore\n{B} 2 2\nauthor y\n\tend"
    assert {r.sha: r.n_lines for r in git_text.blame_counts(one(spark, text), ["k"]).collect()} == {A: 2, B: 1}
    assert git_text.blame_totals(one(spark, text), ["k"]).first().total_lines == 4


def test_manifests(spark, tmp_path):
    url = "https://host/o/r/commit/s1"
    docs = {
        "a.json": {"repo": "o/r", "ai_commits": [{"sha": "s1", "url": url, "ai_tool": "t"}, {"sha": "s2", "repo": ""}]},
        "b.json": {"repo": "p/q", "repo_source": "src", "ai_commit_shas": ["s3"], "ai_tools": ["t1", "t2"]},
        "c.json": [{"sha": "s4", "tool": "x"}],
    }
    for name, d in docs.items():
        (tmp_path / name).write_text(json.dumps(d, indent=1))
    (tmp_path / "d.json").write_text("{broken")
    got = {r.sha: (r.full_name, r.repo_url, r.tool) for r in commits.load_commits(spark, f"{tmp_path}/*.json").collect()}
    assert got == {"s1": ("o/r", "https://host/o/r", "t"), "s2": ("o/r", "o/r", "unknown"), "s3": ("p/q", "src", "unknown"), "s4": (None, None, "x")}
    (tmp_path / "e.jsonl").write_text('{"sha": "s5"}\n\nnot json\n{"sha": "s6", "repo": "a/b"}\n')
    assert sorted(r.sha for r in commits.load_commits(spark, f"{tmp_path}/e.jsonl").collect()) == ["s5", "s6"]


def test_manifests_of_a_mixed_folder(spark, tmp_path):
    (tmp_path / "a.JSON").write_text("\n\t" + json.dumps({"repo": "p/q", "ai_commit_shas": ["s1"], "ai_tools": ["t"]}))
    (tmp_path / "b.jsonl").write_text('{"sha": "s2"}\n')
    got = {r.sha: (r.tool, r.possible_tools) for r in commits.load_commits(spark, str(tmp_path)).collect()}
    assert got == {"s1": ("t", ["t"]), "s2": (None, None)}


def test_repo_metadata(spark):
    csv = spark.createDataFrame([("a/b", "7", "Go", 1), ("a/b", "9", "C", 2), ("c/d", "many", None, 3), ("", "1", "x", 4)], "repo_name string, stars string, language string, ord int")
    more = spark.createDataFrame([("a/b", 1, "no"), ("e/f", 2, "yes")], "repo_name string, stars long, language string")
    assert sorted(commits.repo_metadata(csv, more).collect()) == [("a/b", 7, "Go"), ("c/d", 0, None), ("e/f", 2, "yes")]


def test_issue_expressions(spark):
    rows = [("pylint", None, "error", None, "unreachable"), (None, "bandit", "LOW", None, "B101"), ("eslint", None, "warning", None, "B12"), ("x", None, None, "Bug", None), ("", "", "convention", "", "B1x4")]
    df = spark.createDataFrame(rows, "type string, by string, sev string, cat string, rule string")
    c = [F.col(x) for x in ("type", "by", "cat", "rule")]
    got = df.select(issues.severity_level(c[0], c[1], F.col("sev")), issues.issue_family(*c)).collect()
    assert [tuple(r) for r in got] == [("high", "bug"), ("low", "security"), ("medium", "security"), ("medium", "bug"), ("low", "code_smell")]
    taint = spark.createDataFrame([(201, ["A", "A"]), (201, ["A", "M"]), (200, ["A"]), (300, []), (None, None)], "n int, s array<string>")
    assert [r[0] for r in taint.select(issues.is_tainted(F.col("n"), F.col("s"))).collect()] == [True, False, False, False, False]
