"""Entries that get their rule and their tool: each side is read, sent and sorted once."""

from codequarry.plans import capture_queries
from codequarry.reports import survival

D = "/root/testdata/sf0.001"
ADDED = "repo string, commit_hash string, file_path string, file_no int, ord int, line int, type string, message string, severity string, rule string, symbol string, rule_id string, detected_by string, category string, context string"
ENTRIES = "repo string, commit_sha string, file_path string, n int, line int, type string, message string, severity string, rule string, symbol string, rule_id string, detected_by string, category string, filter_context string"


def test_documents_are_read_once(spark):
    """Findings and commits come from one exchange of the documents; the other scan is that of the entries."""
    got = capture_queries.QUERIES["c09_hydrated_survival"](spark, D)
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 2


def test_first_of_equal_findings_counts(spark):
    place = ("f", "t", "m", "s")
    known = lambda repo, sha, no, k, rule: (repo, sha, place[0], no, k, 1, *place[1:], rule, None, None, None, None, "x")
    asked = lambda repo, sha, n, rule_id, line=1: (repo, sha, place[0], n, line, *place[1:], None, None, rule_id, None, None, None)
    added = spark.createDataFrame([known("r", "a", 1, 0, "late"), known("r", "a", 0, 2, "later"), known("r", "a", 0, 1, "first"), known(None, "a", 0, 0, "none"), known("r", None, 0, 0, "bare")], ADDED)
    entries = spark.createDataFrame([asked("r", "a", 1, None), asked("r", "a", 2, "t"), asked("r", "a", 3, "own"), asked(None, "a", 4, "t"), asked("r", "a", 5, None, 2), asked("r", None, 6, None), asked("r", "", 7, None)], ENTRIES)
    out = survival.hydrated(entries, added)
    assert out.columns == entries.columns
    assert {r.n: (r.rule, r.rule_id, r.filter_context) for r in out.collect()} == {
        1: ("first", "first", "x"), 2: ("first", "first", "x"), 3: ("first", "own", "x"), 4: (None, "t", None), 5: (None, None, None), 6: ("bare", "bare", "x"), 7: ("bare", "bare", "x"),
    }
    out.collect()
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count(" Exchange hashpartitioning") == 1


def test_tool_by_whole_hash_or_twelve_characters(spark):
    a, b = "a" * 40, "a" * 12 + "b" * 28
    commits = spark.createDataFrame([("r", a, a[:12], "x", False), ("r", a, a[:12], "w", False), ("r", b, b[:12], "z", True), ("r", "", "", "v", False), ("s", "c" * 40, "c" * 12, "y", True)], "repo string, commit_hash string, sha12 string, tool string, is_tainted boolean")
    entries = spark.createDataFrame([("r", a), ("r", b), ("r", ""), ("r", None), ("s", "c" * 40), (None, a)], "repo string, commit_sha string")
    out = survival.with_tool(entries, commits)
    assert out.columns == ["repo", "sha12", "commit_sha", "tool"]
    assert {(r.repo, r.commit_sha): r.tool for r in out.collect()} == {("r", a): "x", ("r", b): "x", ("r", ""): "unknown", ("r", None): "unknown", ("s", "c" * 40): "unknown", (None, a): "unknown"}
