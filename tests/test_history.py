"""Histories, captured output, discovery and sinks."""

import datetime
import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from codequarry import sinks
from codequarry.plans.history_queries import QUERIES, SQL
from codequarry.reports import history
from codequarry.sources import analyzers, discovery

DAY = 86_400


def test_lifecycle(spark):
    files = spark.createDataFrame([("r", "s", p, 1000) for p in ("src/a.py", "src/b.py", "src/c.py", "README.md")], "repo string, sha string, path string, ts long")
    log = spark.createDataFrame([("r", "s", "src/a.py", 1000 + DAY, "Fixes it"), ("r", "s", "src/a.py", 1000 + 3 * DAY, "improve and revert")], "repo string, sha string, path string, ts long, subject string")
    head = spark.createDataFrame([("r", "src/a.py"), ("r", "src/b.py")], "repo string, path string")
    got = {r.path: r for r in history.lifecycle(files, log, head).collect()}
    assert {p: r.status for p, r in got.items()} == {"src/a.py": "MODIFIED", "src/b.py": "SURVIVED", "src/c.py": "DELETED"}
    a = got["src/a.py"]
    assert (a.days_to_first_change, a.was_fixed, a.was_refactored, a.was_reverted, a.num_changes, a.time_to_first_fix_days, a.time_to_first_refactor_days) == (3.0, True, True, True, 2, 1.0, 3.0)
    assert {r.path: r for r in history.lifecycle(files, log, head, corrected=True).collect()}["src/a.py"].days_to_first_change == 1.0


def test_lines_at_the_head(spark):
    ranges = spark.createDataFrame([("r", "s", "src/a.py", 2, 4), ("r", "s", "src/b.py", 1, 1), ("r", "s", "x.md", 1, 1)], "repo string, sha string, path string, start int, stop int")
    then = spark.createDataFrame([("r", "s", "src/a.py", "one\n two \n\nthree\n"), ("r", "s", "src/b.py", "z")], "repo string, sha string, path string, content string")
    head = spark.createDataFrame([("r", "src/a.py", "TWO\ntwo\n")], "repo string, path string, content string")
    lines = history.added_lines(ranges, then)
    assert sorted((r.path, r.number, r.line) for r in lines.collect()) == [("src/a.py", 2, " two "), ("src/a.py", 3, ""), ("src/a.py", 4, "three"), ("src/b.py", 1, "z")]
    status = history.line_status(lines, head, ["repo", "path"])
    assert {(r.path, r.number): r.status for r in status.collect()} == {("src/a.py", 2): "EXISTS", ("src/a.py", 3): "EXISTS", ("src/a.py", 4): "MODIFIED", ("src/b.py", 1): "DELETED"}
    later = spark.createDataFrame([("r", "src/a.py", "l1", 4, 9), ("r", "src/a.py", "l1", 2, 2), ("r", "src/a.py", "l2", 3, 3), ("r", "src/a.py", "l3", 90, 99)], "repo string, path string, later_sha string, start int, stop int")
    n = history.line_modifications(ranges, later)
    assert {(r.path, r.start): r.n for r in n.collect()} == {("src/a.py", 2): 2, ("src/b.py", 1): 0, ("x.md", 1): 0}
    assert {r.n for r in history.line_modifications(ranges, later, most=1).collect()} == {0}
    units = spark.createDataFrame([("r", "s", True, 4, 2, 1, 1), ("r", "s", False, 9, 9, 9, 9)], "repo string, sha string, supported boolean, original_units int, surviving_units int, modified_units int, deleted_units int")
    d = history.destiny(status, n, units).first()
    assert (d.files_analyzed, d.total_lines_added, d.lines_still_exist, d.lines_modified, d.lines_deleted, d.total_modifications) == (2, 4, 2, 1, 1, 2)
    assert (d.survival_rate, d.semantic_survival_rate, d.exact_semantic_survival_rate, d.semantic_vs_syntactic_delta, d.developer_valuation) == (0.5, 0.75, 0.5, 0.25, "MEDIUM")
    assert history.destiny(status).first().developer_valuation == "MEDIUM"


def test_renames(spark):
    wanted = spark.createDataFrame([("r", p) for p in ("a", "b", "c", "d")], "repo string, path string")
    head = spark.createDataFrame([("r", "a"), ("r", "b2"), ("r", "b3"), ("r", "c2")], "repo string, path string")
    renames = spark.createDataFrame([("r", "a", "b2", 1, True), ("r", "b", "b3", 9, False), ("r", "b", "b2", 1, True), ("r", "c", "gone", 5, True), ("r", "c", "c2", 1, False), ("r", "d", "gone", 1, True)], "repo string, old string, new string, ord int, followed boolean")
    assert {r.path: r.head_path for r in history.head_paths(wanted, head, renames).collect()} == {"a": "a", "b": "b2", "c": "c2", "d": None}


def test_checkpoints_and_blame(spark):
    commits = spark.createDataFrame([("r", "s", 0)], "repo string, sha string, ts long")
    log = spark.createDataFrame([("r", "x", 7 * DAY - 1), ("r", "y", 8 * DAY), ("r", "z", 40 * DAY)], "repo string, sha string, ts long")
    points = history.checkpoints(commits, log)
    assert {r.days: r.checkpoint_sha for r in points.collect()} == {7: "y", 30: "z", 60: None, 90: None}
    blame = spark.createDataFrame([("r", "y", "f", "s", 3), ("r", "y", "f", "o", 1), ("r", "z", "f", "o", 5), ("r", "y", "other", "s", 9)], "repo string, checkpoint_sha string, path string, sha string, n_lines int")
    files = spark.createDataFrame([("r", "s", "f")], "repo string, sha string, path string")
    got = history.survival_by_days(history.blame_survival(points, blame, files)).first()
    assert (got.survival_7d, got.survival_30d, got.survival_60d, got.blamed_lines_total_7d, got.blamed_lines_from_target_30d, got.checkpoint_sha_7d) == (0.75, 0.0, None, 4, 0, "y")
    edits = spark.createDataFrame([("r", "s", "f", 2 * DAY, 0), ("r", "s", "f", DAY, 1), ("r", "s", "g", 0, 0)], "repo string, sha string, path string, ts long, ord int")
    of = spark.createDataFrame([("r", "s", p, 0) for p in "fgh"], "repo string, sha string, path string, ts long")
    assert {r.path: r.days for r in history.time_to_first_edit(of, edits).collect()} == {"f": 2.0, "g": None, "h": None}


def test_patches_and_deltas(spark):
    changed = spark.createDataFrame([("r", "s", p) for p in ("src/a.py", "dist/b.js", "README.md", "tests/c.py", "")], "repo string, sha string, path string")
    stat = spark.createDataFrame([("r", "s", "src/a.py", 0, 1, 1), ("r", "s", "src/a.py", 1, 5, 2), ("r", "s", "dist/b.js", 2, None, None), ("r", "s", "README.md", 3, 7, 0)], "repo string, sha string, path string, ord int, added int, deleted int")
    p = history.patch_summary(changed, stat).first()
    assert (p.files_changed_total, p.files_changed_code, p.files_changed_docs, p.files_changed_tests, p.additions_code, p.deletions_code, p.additions_total, p.noise_file_ratio, p.touches_noise_only) == (5, 1, 1, 1, 5, 2, 12, 0.2, False)
    cc = spark.createDataFrame([("s", 4, 2, 9, 3), ("s", None, None, 1, 1)], "sha string, cc_before int, functions_before int, cc_after int, functions_after int")
    assert tuple(history.complexity_delta(cc, ["sha"]).first()) == ("s", 4, 10, 6, 2.0, 2.5)
    keys = [*history.DELTAS, "issues_total", "duplicates"]
    shape = "struct<" + ",".join(f"{k}:int" for k in keys) + ">"
    rows = [(1, None, tuple(range(1, 10))), (2, tuple([2] * 9), tuple([1] * 8 + [None]))]
    got = {r.k: r.delta for r in history.quality_delta(spark.createDataFrame(rows, f"k int, before {shape}, after {shape}")).collect()}
    assert (got[1].is_new_file, got[1].issues_introduced, got[1].net_change, got[1].linter_errors_delta, got[1].quality_improved) == (True, 8, 8, 1, None)
    assert (got[2].issues_introduced, got[2].issues_fixed, got[2].net_change, got[2].duplicates_delta, got[2].quality_improved) == (0, 1, -1, -2, True)
    assert history.quality_measures(spark.createDataFrame([(1, 2, 3)], "k int, todos int, other int"), ["k"]).columns == ["k", "todos"]
    commits = spark.createDataFrame([("r", "a"), ("r", "b")], "repo string, sha string")
    parents = spark.createDataFrame([(r.repo, "b", "x", 0) for r in commits.where("sha = 'b'").collect()], "repo string, sha string, parent string, ord int")
    assert [r.sha for r in history.reachable(commits, parents, commits.where("sha = 'b'")).collect()] == ["b"]
    assert history.in_changed_files(changed, changed.where("path = 'src/a.py'"), ["path"]).count() == 1


def out(spark, *docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "k int, output string")


def test_analyzer_output(spark):
    df = out(spark, {"messages": [{"type": "error", "symbol": "x", "message": "m", "line": 1, "column": 2}, {"type": "error", "symbol": "import-error"}, {"type": "warning", "symbol": "y"}], "statistics": {"score": 7.5}}, "no json")
    assert [(r.k, r.type, r.severity, r.line, r.symbol) for r in analyzers.pylint(df, ["k"]).collect()] == [(0, "pylint", "error", 1, "x"), (0, "pylint", "warning", None, "y")]
    assert [tuple(r) for r in analyzers.pylint_counts(df, ["k"]).where("score is not null").collect()] == [(0, 7.5, 1, 1)]
    df = out(spark, [{"messages": [{"ruleId": "eqeqeq", "severity": 2, "message": "m", "line": 3}, {"ruleId": None, "severity": 2, "message": "Parsing error"}, {"ruleId": "no-console", "severity": 1, "message": "n"}]}, {"messages": [{"ruleId": "other"}]}])
    assert [(r.rule, r.severity, r.line) for r in analyzers.eslint(df, ["k"], blocked=["no-console"]).collect()] == [("eqeqeq", "error", 3)]
    df = out(spark, {"results": [{"check_id": "c", "path": "p", "start": {"line": 4}, "extra": {"severity": "ERROR", "message": "m", "metadata": {"cwe": ["CWE-1", "CWE-2"]}}}, {"check_id": "d", "extra": {"metadata": {"cwe": "CWE-1"}}}]}, {"results": []})
    assert [(r.symbol, r.severity, r.line, r.detected_by) for r in analyzers.semgrep(df, ["k"]).collect()] == [("c", "error", 4, "semgrep"), ("d", "info", None, "semgrep")]
    s = {r.k: r for r in analyzers.semgrep_summary(df, ["k"]).collect()}
    assert (s[0].vulnerability_count, s[0].error_count, s[0].info_count, s[0].cwe_count, s[0].cwe_ids) == (2, 1, 1, 2, ["CWE-1", "CWE-2"])
    assert (s[1].vulnerability_count, s[1].info_count, s[1].cwe_count) == (0, 0, 0)
    df = out(spark, {"results": [{"test_id": "B404", "issue_severity": "HIGH", "issue_text": "t", "line_number": 2}, {"test_id": "B1", "issue_severity": "MEDIUM"}]})
    assert [(r.rule, r.severity, r.line) for r in analyzers.bandit(df, ["k"]).collect()] == [("B404", "low", 2), ("B1", "medium", None)]
    df = out(spark, "log {0} line\n".replace("{0}", "") + json.dumps({"nodejs": {"r1": {"metadata": {"severity": "ERROR", "description": "d"}, "files": [{"match_lines": [5, 6]}, {}]}, "insecure_random": {"metadata": {}, "files": [{"match_lines": [1]}]}}}))
    assert sorted((r.rule, r.severity, r.line, r.message) for r in analyzers.njsscan(df, ["k"]).collect()) == [("insecure_random", "low", 1, "Security issue detected"), ("r1", "error", 0, "d"), ("r1", "error", 5, "d")]
    df = out(spark, {"duplicates": [{"lines": 6, "tokens": 60, "firstFile": {"name": "a", "start": 1, "end": 6}, "secondFile": {"name": "b", "start": 9, "end": 14}, "fragment": "x" * 300}]})
    r = analyzers.jscpd(df, ["k"]).first()
    assert (r.lines, r.first_file, r.second_start, len(r.fragment)) == (6, "a", 9, 200)
    df = spark.createDataFrame([(1, json.dumps({"f": [{"complexity": 3}, {"complexity": 2}]}), json.dumps({"f": {"mi": 61.5}})), (2, "{}", "{}"), (3, "", "")], "k int, cc string, mi string")
    assert [tuple(r) for r in analyzers.radon(df, ["k"]).orderBy("k").collect()] == [(1, 5.0, 61.5), (2, 0.0, None), (3, None, None)]


def test_deep_scans(spark):
    rules = [{"id": "q", "properties": {"tags": ["security", "cwe-79"]}}, {"id": "n"}]
    place = [{"physicalLocation": {"artifactLocation": {"uri": "f.py"}, "region": {"startLine": 3, "startColumn": 1}}}]
    df = out(spark, {"runs": [{"tool": {"driver": {"rules": rules}}, "results": [{"ruleId": "q", "level": "error", "message": {"text": "m"}, "locations": place}, {"ruleId": "n", "message": {}}, {"ruleId": "unlisted"}]}]})
    found = analyzers.sarif(df, ["k"])
    assert [(r.rule, r.severity, r.file, r.line, r.cwe, r.type) for r in found.collect()] == [("q", "error", "f.py", 3, ["cwe-79"], "security"), ("n", "warning", "", 0, [], "quality"), ("unlisted", "warning", "", 0, [], "quality")]
    assert [tuple(r) for r in analyzers.cwe_counts(found, "k").collect()] == [(0, "CWE-79", 1)]
    df = out(spark, {"issues": [{"rule": "r", "severity": "MAJOR", "type": "SECURITY_HOTSPOT", "component": "p:src/a.py", "line": 2}, {}]})
    sonar = analyzers.sonar_issues(df, ["k"])
    assert [(r.rule, r.severity, r.type, r.file, r.line) for r in sonar.collect()] == [("r", "major", "security hotspot", "src/a.py", 2), ("", "info", "code smell", "", 0)]
    both = analyzers.combined(found, sonar)
    assert tuple(analyzers.combined_counts(both).first()) == (5, 2, 3)
    df = out(spark, {"component": {"measures": [{"metric": "bugs", "value": "3.0"}, {"metric": "duplicated_lines_density", "value": "1.5"}, {"metric": "security_rating", "value": "A"}, {"metric": "sqale_index", "value": "42"}]}})
    m = analyzers.sonar_measures(df, ["k"]).first()
    assert (m.bugs, m.duplicated_lines_density, m.security_rating, m.tech_debt_minutes, m.complexity) == (3, 1.5, "A", 42, None)
    new = spark.createDataFrame([("r", "a", "high", "bug"), ("r", "a", None, None)], "repo string, sha string, severity string, type string")
    d = analyzers.deep_summary(new, new.limit(1).withColumn("sha", F.lit("b")))
    assert sorted((r.sha, r.introduced, r.fixed, r.net_change) for r in d["commits"].collect()) == [("a", 2, 0, 2), ("b", 0, 1, -1)]
    assert {r.severity: r.n for r in d["by_severity"].collect()} == {"HIGH": 1, "UNKNOWN": 1}


def test_discovery(spark, tmp_path):
    commit = lambda sha, name, mail, msg: {"sha": sha, "message": msg, "author": {"name": name, "email": mail}}
    rows = [
        ("o/r", "Copilot", "2025-01-02", {"head": "h1", "commits": [commit("h1", "Jo", "jo@x.y", "m")]}, "20250102", "PushEvent"),
        ("o/r", "jo", "2025-01-03", {"head": "h3", "commits": [commit("c1", "Jo", "jo@x.y", "m\nCo-authored-by: Copilot <x@y.z>"), commit("c2", "aider", "a@b.c", "m"), commit("c2", "Aider", "a@b.c", "m")]}, "20250103", "PushEvent"),
        ("o/r", "jo", "2025-02-03", {"commits": [commit("c9", "aider", "a@b.c", "m")]}, "20250203", "PushEvent"),
        ("p/q", "jo", "2025-01-03", {}, "20250103", "PushEvent"), ("p/q", "jo", "2025-01-03", {"commits": [commit("w", "aider", "a@b.c", "m")]}, "20250103", "WatchEvent"),
    ]
    df = spark.createDataFrame([(a, b, c, json.dumps(d), e, f) for a, b, c, d, e, f in rows], "repo_name string, actor_login string, created_at string, payload string, day string, type string")
    df.write.partitionBy("day").parquet(str(tmp_path / "ev"))
    events = discovery.scan_events(spark, str(tmp_path / "ev"), "2025-01-01", "2025-01-31")
    assert "PartitionFilters: [isnotnull(day" in events._jdf.queryExecution().toString()
    found = discovery.discovered(events)
    got = [(r.repo_name, r.ai_tool, r.detection_method, r.commit_count, r.sample_shas, r.first_commit, r.last_commit) for r in found.collect()]
    assert got == [("o/r", "copilot", "coauthor", 2, ["c1", "h1"], "2025-01-02", "2025-01-03"), ("o/r", "aider", "author", 1, ["c2"], "2025-01-03", "2025-01-03")]
    both = discovery.merged(found, discovery.discovered(discovery.scan_events(spark, str(tmp_path / "ev"), "2025-02-01", "2025-02-28")))
    assert {(r.ai_tool, r.commit_count, tuple(r.shas)) for r in both.collect()} == {("copilot", 2, ("c1", "h1")), ("aider", 2, ("c2", "c9"))}
    assert [(r.ai_tool, r.name, r.commits, r.repos) for r in discovery.tool_summary(both).collect()] == [("aider", "Aider", 2, 1), ("copilot", "GitHub Copilot", 2, 1)]
    assert discovery.months_between("2024-11-15", "2025-02-03") == [("2024-11-15", "2024-11-30"), ("2024-12-01", "2024-12-31"), ("2025-01-01", "2025-01-31"), ("2025-02-01", "2025-02-03")]
    assert [(r.month, str(r.month_start), str(r.month_end)) for r in discovery.month_table(spark, "2024-11-15", "2025-01-03").collect()] == [("2024-11", "2024-11-15", "2024-11-30"), ("2024-12", "2024-12-01", "2024-12-31"), ("2025-01", "2025-01-01", "2025-01-03")]
    assert discovery.bytes_and_cost(1024**4) == (1024.0, 5.0)


def test_repositories(spark):
    repos = spark.createDataFrame([("A/b", 10, {"aider": 3, "v0": 1}, False), ("a/B", 90, {"aider": 9}, True), ("c/d", 500, None, True), ("e/f", None, {"v0": 7}, None)], "full_name string, stars long, commit_counts map<string,long>, is_fork boolean")
    assert [r.full_name for r in discovery.batch(repos, tool="aider").collect()] == ["a/B", "A/b"]
    assert [r.full_name for r in discovery.batch(repos, 50, limit=1).collect()] == ["a/B"]
    assert sorted(r.full_name for r in discovery.without_forks(repos, 100).collect()) == ["A/b", "c/d", "e/f"]
    assert tuple(discovery.fork_counts(repos, 100, 5).first()) == (4, 1, 1, 2)
    one = discovery.first_of_each(repos.withColumn("ord", F.col("stars")), "full_name", "ord")
    assert sorted(r.full_name for r in one.collect()) == ["A/b", "c/d", "e/f"]
    assert sorted(r.full_name for r in discovery.not_yet(repos, spark.createDataFrame([("a/b",)], "full_name string"), "full_name").collect()) == ["c/d", "e/f"]
    scans = spark.createDataFrame([("a/b", 3, 10), ("c/d", 1, 100), ("x/y", 2, 0), ("e/f", 0, 5)], "repo string, ai_commits long, total_commits long")
    full = discovery.with_metadata(scans, spark.createDataFrame([("A/B", 60, "Go"), ("c/d", 70, "Rust"), ("x/y", 80, "go")], "full_name string, stars long, language string"))
    assert [(r.repo, r.ai_percentage) for r in discovery.filter_repos(full).collect()] == [("c/d", 1.0), ("x/y", 0.0), ("a/b", 30.0)]
    assert [r.repo for r in discovery.filter_repos(full, languages=["GO"], max_commits=5).collect()] == ["x/y"]
    earlier = spark.createDataFrame([("a/b", {"aider": 2}, {"aider": ["s1"]}, {"aider": "author"})], "full_name string, commit_counts map<string,long>, commit_shas map<string,array<string>>, detection_methods map<string,string>")
    assert [tuple(r) for r in discovery.from_repos(earlier).collect()] == [("a/b", "aider", 2, ["s1"], "author")]
    assert [tuple(r)[:3] for r in sinks.repo_tool_rows(earlier.withColumns({"stars": F.lit(4), "language": F.lit(None).cast("string"), "url": F.lit("u")})).collect()] == [("a/b", "aider", 2)]


def test_logs_and_answers(spark):
    log = "s1|Jo|jo@x.y|Jo|jo@x.y|2025-01-01|subject | with bar\nbody\n---COMMIT_END---\ns2|Jo|jo@x.y|aider-chat-bot|b@c.d|2025-01-02|t\n---COMMIT_END---\nbad|line\n---COMMIT_END---\n"
    commits = discovery.log_commits(spark.createDataFrame([("o/r", log)], "repo string, output string"))
    assert [(r.sha, r.committer_name, r.message, r.url[-2:]) for r in commits.orderBy("ord").collect()] == [("s1", "Jo", "subject | with bar\nbody", "s1"), ("s2", "aider-chat-bot", "t\n", "s2")]
    found = discovery.scan_log(commits)
    assert [(r.sha, r.ai_tool, r.detection_method, r.ai_identifier_type) for r in found.collect()] == [("s2", "aider", "committer", "committer_author_name")]
    s = discovery.scan_summary(commits, found).first()
    assert (s.total_commits_scanned, s.ai_commits_count, s.tools_found) == (2, 1, {"aider": 1})
    assert tuple(discovery.commit_rows(found).first())[:5] == ("s2", "Aider", "committer", "Jo", "2025-01-02")
    pages = spark.createDataFrame([("o/r", 1, json.dumps([{"sha": "p1", "html_url": "u", "author": {"login": "Copilot"}, "commit": {"message": "m" * 600, "author": {"name": "x", "email": "y", "date": "d"}}}])), ("o/r", 2, "{}")], "repo string, page int, body string")
    got = discovery.scan_pages(discovery.page_commits(pages)).first()
    assert (got.sha, got.ai_tool, got.detection_method, len(got.message)) == ("p1", "copilot", "actor", 500)
    files = [{"filename": f"f{i}", "status": "modified", "additions": 1, "deletions": 0, "patch": "x" * 20_000} for i in range(60)]
    d = discovery.commit_details(spark.createDataFrame([("o/r", json.dumps({"sha": "s", "stats": {"additions": 5}, "files": files}))], "repo string, body string")).first()
    assert (len(d.files), len(d.files[0].patch), d.additions, d.deletions) == (50, 10_000, 5, 0)
    answer = {"data": {"r0": {"nameWithOwner": "a/b", "stargazerCount": 5, "primaryLanguage": {"name": "Go"}, "isFork": True, "parent": {"nameWithOwner": "c/d"}}, "r1": None}}
    g = discovery.graph_metadata(spark.createDataFrame([(json.dumps(answer),)], "body string")).collect()
    assert [(r.full_name, r.stars, r.language, r.is_fork, r.parent) for r in g] == [("a/b", 5, "Go", True, "c/d")]
    hits = discovery.search_results(spark.createDataFrame([("Go", json.dumps({"items": [{"full_name": "a/b", "stargazers_count": 9, "language": "Go"}]}))], "query string, body string"))
    assert [tuple(r) for r in hits.collect()] == [("Go", 0, "a/b", 9, "Go")]


def test_sinks(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    df = spark.createDataFrame([("o/r", "s1", 1.5), ("p/q", "s2", None)], "repo string, sha string, x double")
    sinks.write_json(spark, sinks.report_document({"rows": df, "n": 2}), at("r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"rows": [{"repo": "o/r", "sha": "s1", "x": 1.5}, {"repo": "p/q", "sha": "s2", "x": None}], "n": 2}
    with pytest.raises(ValueError, match="no report"):
        sinks.report_document({"rows": df}, most=1)
    sinks.write_csv(df, at("c"), ["sha", "missing"])
    assert sorted(map(tuple, spark.read.option("header", True).csv(at("c")).collect())) == [("s1", None), ("s2", None)]
    sinks.write_lines(df, at("l"))
    assert spark.read.json(at("l")).count() == 2
    sinks.write_details(df, at("d"))
    sinks.write_details(df.where("repo = 'o/r'").withColumn("sha", F.lit("new")), at("d"))
    assert sorted((r.repo_folder, r.sha) for r in spark.read.json(at("d")).collect()) == [("o_r", "new"), ("p_q", "s2")]
    assert sinks.append_if_absent(spark, at("index.json"), ["b", "a", "b"]) == ["b", "a"]
    assert sinks.append_if_absent(spark, at("index.json"), ["a", "c"]) == ["b", "a", "c"]
    sinks.complete(spark, at("done.json"), ["x"])
    sinks.complete(spark, at("done.json"), ["w", "x"])
    assert sinks.completed(spark, at("done.json")) == ["w", "x"]
    assert sinks.completed(spark, at("none.json")) == []
    assert [r.sha for r in sinks.still_to_do(df, df.limit(1), ["sha"]).collect()] == ["s2"]
    calls = []
    build = lambda: calls.append(1) or {"n": len(calls)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("1")
    assert [sinks.cached(spark, at("cache.json"), [at("in")], build)["n"] for _ in range(2)] == [1, 1]
    import os

    os.utime(tmp_path / "in" / "a.json", (4e9, 4e9))
    assert sinks.cached(spark, at("cache.json"), [at("in")], build)["n"] == 2
    assert sinks.remove(spark, at("d"), ["repo_folder=o_r".replace("=", "-")]) == []
    with pytest.raises(ValueError, match="name"):
        sinks.remove(spark, at("d"), ["../x"])
    assert sinks.remove(spark, at("in")) == ["a.json"]
    tex = sinks.latex_table(df, ["repo", "x"], "A & B", "t")
    assert "o/r & 1.50" in tex and r"\caption{A \& B}" in tex and "{lr}" in tex
    assert set(sinks.environment(spark)) >= {"python", "spark"}


def test_refresh_server(spark):
    def rebuild(name):
        if name == "bad":
            raise ValueError("broken")
        return {"name": name}

    server = sinks.refresh_server(rebuild)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        def ask(path):
            try:
                with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", timeout=10) as r:
                    return r.status, json.loads(r.read())
            except urllib.error.HTTPError as e:
                return e.code, json.loads(e.read())

        assert ask("/refresh?dataset=x1") == (200, {"ok": True, "result": {"name": "x1"}})
        assert ask("/refresh?dataset=../x")[0] == 400
        assert ask("/other")[0] == 404
        assert ask("/refresh?dataset=bad") == (500, {"ok": False, "error": "broken"})
    finally:
        server.shutdown()
        server.server_close()


def test_checkpoints_of_times_between_seconds(spark, tmp_path):
    """Times are the nearest second, as the SQL has them: 0.4 is before, 0.6 behind, of halves the even one."""
    from compare import same

    at = lambda text: datetime.datetime.fromisoformat(text)
    rows = [(1, 1, "signup", at("2024-01-01 00:00:00.600000")), (2, 1, "purchase", at("2024-01-08 00:00:00.400000")), (3, 1, "purchase", at("2024-01-08 00:00:00.700000"))]
    rows += [(4, 2, "signup", at("2024-01-01 00:00:00.100000")), (5, 2, "purchase", at("2024-01-07 23:59:59.500000")), (6, 3, "signup", at("2024-01-01 00:00:01.500000")), (7, 3, "purchase", at("2024-01-08 00:00:02.500000"))]
    rows = [(e, u, k, ts, 1.0, "") for e, u, k, ts in rows]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double, props string").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("part-*")).rename(tmp_path / "events.parquet")
    same(spark, QUERIES["h01_checkpoints"], SQL["h01_checkpoints"], str(tmp_path))
    got = {r.repo: r.checkpoint_sha for r in QUERIES["h01_checkpoints"](spark, str(tmp_path)).where("days = 7").collect()}
    assert got == {"1": "3", "2": "5", "3": "7"}


def test_lines_of_a_path_meet_before_they_are_counted(spark):
    """A task holds the paths of its lines, so lines are dealt out to many tasks first, not counted where they are read."""
    rows = [("a", "s", "p", "EXISTS"), ("b", "s", "p", "DELETED"), ("a", "s", "p", "EXISTS"), ("a", "s", "q", "MODIFIED"), ("a", "s", None, "EXISTS"), ("a", "t", None, None)]
    out = history.destiny(spark.createDataFrame(rows, "repo string, sha string, path string, status string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    by_path = [line for line in plan.splitlines() if "hashpartitioning(" in line and "path" in line]
    assert len(by_path) == 1 and "REPARTITION_BY_NUM" in by_path[0]
    assert "Aggregate" not in plan[plan.index(by_path[0]) :]
    got = {(r.repo, r.sha): (r.files_analyzed, r.total_lines_added, r.lines_still_exist, r.lines_modified, r.lines_deleted) for r in out.collect()}
    assert got == {("a", "s"): (2, 4, 3, 1, 0), ("b", "s"): (1, 1, 0, 0, 1), ("a", "t"): (0, 1, 0, 0, 0)}
