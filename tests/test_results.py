"""From documents to facts and reports, on small documents whose results are known."""

import json

import pytest
from pyspark.sql import functions as F

from codequarry import facts
from codequarry.reports import debt, display, survival
from codequarry.sources import results

A, B, C = "a" * 40, "b" * 40, "c" * 40


def issue(name, **kw):
    return {"type": "pylint", "severity": "error", "line": 3, "symbol": name, "message": "m", **kw}


DEBT = [
    {
        "commit_hash": A, "ai_tool": "claude", "code_files_analyzed": 2, "analysis_counters": {"files_total": 2},
        "files": [
            {"file_path": "src/a.py", "status": "M", "issues_added": [issue("undefined-variable"), issue("line-too-long", severity="convention"), issue("import-error")], "issues_resolved": [issue("eqeqeq", type="eslint", symbol=None, rule="eqeqeq", line="7")]},
            {"file_path": "node_modules/b.js", "status": "M", "issues_added": [issue("eqeqeq")], "issues_resolved": []},
            {"file_path": "src/t.py", "status": "M", "issue_filter_context_after": {"is_test": True, "is_simulation": False, "is_dev": False}, "issues_added": [issue("jwt_exposed", line=None)], "issues_resolved": None},
        ],
    },
    {"commit_hash": B, "ai_tool": None, "author_role": "coauthor", "files": []},
    {"commit_hash": C, "ai_tool": "cursor", "analysis_counters": {"files_total": 300}, "files": [{"file_path": "src/c.py", "status": "A", "issues_added": [issue("unreachable")]}]},
]
SURVIVAL = {
    "total_issues": 3,
    "issues": [
        {"survived": True, "original": {"commit_sha": A, "file_path": "src/a.py", "line": 3, "type": "pylint", "severity": "error", "message": "m", "rule_id": "pylint"}},
        {"survived": False, "original": {"commit_sha": A, "file_path": "src/x.py", "line": 1, "type": "eslint", "severity": "warning", "message": "n", "rule_id": "eqeqeq"}},
        {"survived": True, "original": {"commit_sha": A, "file_path": "src/x.py", "line": 1, "type": "eslint", "severity": None, "message": "n", "rule_id": "sort-keys"}},
    ],
}
LIFE = [{"commit_hash": A, "ai_tool": None, "files": [{"filepath": "p", "status": "MODIFIED", "was_fixed": True, "num_changes": 2, "days_to_first_change": 4.0}, {"filepath": "q", "status": "DELETED"}]}, {"commit_hash": B, "ai_tool": "gemini", "files": [{"filepath": "p", "status": "SURVIVED", "days_to_first_change": 2.0}]}]
DESTINY = [{"commit": A[:12], "total_lines_added": 10, "survival_rate": 0.5, "semantic_units_original": 0, "developer_valuation": "MEDIUM", "file_details": [{"file": "f", "lines_added": 10, "lines_exist": 9, "modification_count": 2}, {"file": "g", "lines_added": 5, "lines_exist": 0}]}]
DETAIL = {"commit_hash": A, "repo": "o/r_x", "ai_tool": "claude", "timestamp": "2026-02-01T00:30:00+09:00", "debt_debug": {"src/a.py": {"issues_added": [issue("undefined-variable")], "issues_resolved": []}}}
MANIFEST = {"repo": "o/r_x", "ai_commits_count": 2, "total_commits_scanned": 50, "ai_commits": [{"sha": A, "author_role": "sole_author", "date": "2025-12-31T23:00:00-05:00"}, {"sha": B, "date": "bad"}, {"sha": "", "date": "2025-01-01"}]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("out")
    repo = root / "res" / "o_r_x"
    (repo / "debug").mkdir(parents=True)
    (root / "res" / "empty").mkdir()
    (root / "man").mkdir()
    for name, doc in (("debt_metrics", DEBT), ("issue_survival", SURVIVAL), ("lifecycle_metrics", LIFE), ("destiny_metrics", DESTINY)):
        (repo / f"{name}.json").write_text("\n " + json.dumps(doc, indent=1))
    (repo / "debug" / "aaaaaaaa_claude.json").write_text(json.dumps(DETAIL))
    (repo / "debug" / "broken.json").write_text("{")
    (root / "man" / "o_r_x_commits.json").write_text(json.dumps(MANIFEST, indent=2))
    (root / "man" / "p_q_commits.json").write_text(json.dumps([1]))
    return root


@pytest.fixture(scope="module")
def read(spark, folder):
    class Read:
        debt = results.read_results(spark, f"{folder}/res", "debt_metrics").cache()
        details = results.read_details(spark, f"{folder}/res")
        manifests = results.read_manifests(spark, f"{folder}/man")
        dates = results.commit_dates(manifests, details)
        commits = facts.commit_facts(debt, dates, results.detail_months(details)).cache()
        rows = facts.issue_rows(debt).cache()
        classified = facts.classified(rows).cache()
        measures = facts.commit_measures(commits, classified)
        events = facts.of_commits(classified, commits)
        entries = survival.survival_entries(results.read_results(spark, f"{folder}/res", "issue_survival"))
        tracked = survival.tracked(survival.hydrated(entries, rows.where("phase = 'added'")))

    return Read


def test_commits_and_dates(read):
    got = {r.commit_hash: r for r in read.commits.collect()}
    assert {(r.repo, r.tool, r.role, r.n_files, r.is_tainted, r.month, r.cohort) for r in got.values()} == {
        ("o/r_x", "claude", "sole_author", 2, False, "2026-02", "2025-12"), ("o/r_x", "unknown", "coauthor", 0, False, None, None), ("o/r_x", "cursor", "unknown", 1, True, None, None),
    }
    assert [(r.repo, r.source, r.ord, r.sha) for r in read.manifests.orderBy("ord").collect()] == [("o/r_x", "o_r_x_commits.json", i, s) for i, s in enumerate((A, B, ""))]


def test_classified_findings(read):
    rows = read.classified.collect()
    assert {(r.commit_hash[0], r.phase, r.rule_name, r.sev, r.family, r.is_actionable) for r in rows} == {
        ("a", "added", "undefined-variable", "high", "bug", True), ("a", "added", "line-too-long", "low", "code_smell", False), ("a", "resolved", "eqeqeq", "high", "code_smell", True), ("c", "added", "unreachable", "high", "bug", True),
    }
    m = {r.commit_hash[0]: (r.issues, r.fixed, r.high, r.security) for r in read.measures.collect()}
    assert m == {"a": (2, 1, 1, 0), "b": (0, 0, 0, 0)}
    total = debt.global_totals(read.commits, read.measures, read.events).first()
    assert (total.repos, total.commits, total.issues_introduced, total.issues_fixed, total.actionable_introduced, total.actionable_fixed, total.files_analyzed) == (1, 2, 2, 1, 1, 1, 2)
    repo = debt.repo_rows(read.commits, read.measures).first()
    assert (repo.commits, repo.issues_per_commit, repo.tool, repo.issues_sole_author) == (3, pytest.approx(2 / 3), "claude", 2)


def test_survival(read):
    got = {(r.rule_name, r.sev, r.family, r.survived) for r in read.tracked.collect()}
    assert got == {("undefined-variable", "ERROR", "bug", True), ("eqeqeq", "WARNING", "code_smell", False)}
    assert {r.tool for r in survival.with_tool(read.tracked, read.commits).collect()} == {"claude"}
    cohort = survival.with_cohort(read.tracked, read.dates)
    over = survival.over_time(cohort).first()
    assert (over.month, over.total, over.surviving, over.cum_rate) == ("2025-12", 2, 1, 0.5)
    ages = {r.label: r.total for r in survival.by_age(cohort, reference="2026-04").collect()}
    assert ages == {"> 9 months": 0, "6–9 months": 0, "3–6 months": 2, "< 3 months": 0}
    family = survival.by_age(cohort, family=True)
    assert family.count() == 12
    assert "2/3" in survival.text_summary(3, 2, [("HIGH", 2, 3)], [("r", 1, 2)])


def test_lifecycle_and_destiny(spark, read, folder):
    files = survival.lifecycle_files(results.read_results(spark, f"{folder}/res", "lifecycle_metrics"), read.commits)
    assert sorted((r.filepath, r.tool) for r in files.collect()) == [("p", "claude"), ("p", "gemini"), ("q", "claude")]
    one = survival.file_lifecycle(files).first()
    assert tuple(one) == (3, 1, 1, 1, 1, 0)
    merged = {r.path: (r.status, r.num_changes, r.commit_count, r.was_fixed, r.days_to_first_change) for r in display.file_map(files).collect()}
    assert merged == {"p": ("MODIFIED", 2, 2, True, 2.0), "q": ("DELETED", 0, 1, False, None)}
    assert tuple(display.file_map_summary(display.file_map(files)).first()) == (2, 0, 1, 1, 1, 0)
    docs = results.read_results(spark, f"{folder}/res", "destiny_metrics")
    commits = survival.destiny_commits(docs, read.commits)
    assert [(r.tool, r.rate) for r in survival.line_rates(commits).collect()] == [("claude", 0.5)]
    assert survival.unit_rates(commits).count() == 0
    assert {r.valuation: r.n for r in display.valuation_histogram(commits).collect()} == {"HIGH": 0, "MEDIUM": 1, "LOW": 0}
    assert tuple(display.mean_survival(commits).first()) == (0.5, 1, 0.0, 0)
    table = display.file_table(docs.select("repo", F.col("c.commit").alias("commit_sha"), F.explode("c.file_details").alias("f")))
    assert {r.file: (r.label, r.is_deleted) for r in table.collect()} == {"f": ("stable", False), "g": ("deleted", True)}
    assert [r.file for r in display.file_page(table, "deleted-first").collect()] == ["g", "f"]
    assert [r.file for r in display.file_page(table, "lowest-survival", 0, 1).collect()] == ["g"]
    assert display.file_table_summary(table).first().mean_survival == pytest.approx(0.45)
    stats = survival.list_stats(survival.line_rates(commits), "rate").first()
    assert (stats.n, stats.median, stats.mean) == (1, 0.5, 0.5)
    counts = display.commit_counts(display.visible(read.rows.drop("tool")), read.commits)
    rows = {r.commit_sha[0]: r for r in display.export_rows(counts, files, commits).collect()}
    assert (rows["a"].issues_introduced, rows["a"].issues_fixed, rows["a"].survival_rate, rows["a"].files_modified) == (2, 1, 0.5, 1)
    assert (rows["b"].issues_introduced, rows["b"].survival_rate, rows["b"].files_survived) == (0, None, 1)


def test_details_as_results(spark, read):
    rows = facts.issue_rows(results.detail_commits(read.details))
    assert [(r.repo, r.file_path, r.symbol, r.phase) for r in rows.collect()] == [("o/r_x", "src/a.py", "undefined-variable", "added")]
    wanted = spark.createDataFrame([(A, "claude"), (A, "other"), (B, "claude")], "sha string, tool string")
    assert sorted((r.sha[0], r.tool, r.found is not None) for r in results.find_detail(read.details, wanted).collect()) == [("a", "claude", True), ("a", "other", True), ("b", "claude", False)]
    start = results.survival_input(read.debt)
    assert sorted((r.file_path, r.line, r.rule_id) for r in start.where(F.col("commit_sha") == A).collect())[:2] == [("node_modules/b.js", 3, "eqeqeq"), ("src/a.py", 3, "import-error")]


def test_manifest_summaries_and_lists(spark, folder, tmp_path):
    assert [(r.repo, r.ai_commits, r.total_commits) for r in results.manifest_summaries(spark, f"{folder}/man").collect()] == [("o/r_x", 2, 50)]
    for name, doc in (("a", ["x/y", "z/w"]), ("b", {"repos": [{"repo": "x/y", "stars": 4}]}), ("c", [{"repo": "q/r", "file": "f"}]), ("d", {"repos": ["m/n"]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    got = {n: [(r.repo, r.file, r.stars) for r in results.read_repo_list(spark, str(tmp_path / f"{n}.json")).orderBy("ord").collect()] for n in "abcd"}
    assert got == {"a": [("x/y", None, None), ("z/w", None, None)], "b": [("x/y", None, 4)], "c": [("q/r", "f", None)], "d": [("m/n", None, None)]}


def test_display(spark, read):
    shown = display.visible(read.rows, show_low=True)
    assert {(r.commit_hash[0], r.shown_rule) for r in shown.collect()} == {("a", "undefined-variable"), ("a", "line-too-long"), ("a", "eqeqeq"), ("c", "unreachable")}
    hot = display.hotspots(display.visible(read.rows))
    assert [(r.commit_hash[0], r["count"], r.rule) for r in hot["commits"].collect()] == [("a", 2, "undefined-variable"), ("c", 1, "unreachable")]
    assert {r.rule_name: r.severity for r in display.rule_severities(read.entries).where("rule_name in ('eqeqeq', 'pylint', 'sort-keys', 'strict')").collect()} == {"eqeqeq": "warning", "pylint": "error", "sort-keys": "low", "strict": "low"}
    s = display.survival_summary(survival.hydrated(read.entries, read.rows.where("phase = 'added'")))
    assert tuple(s["totals"].first()) == (2, 1, 1, 0.5)
    assert {(r.sev, r.total) for r in s["by_severity"].collect()} == {("ERROR", 1), ("WARNING", 1)}
    found = display.severity_commits(display.visible(read.rows), read.entries.withColumn("commit_sha", F.lit(C)), "Warning").collect()
    assert [(r.commit_hash[0], r["count"]) for r in found] == [("c", 1)]
    assert [r.severity for r in display.issue_list(read.rows.where(F.col("file_path") == "src/a.py")).collect()] == ["error", "error", "error", "convention"]
    names = spark.createDataFrame([(x,) for x in ("no-var", "a/b.c.c", "@x/y_z-q", "", None, "python.lang.rule-id", "...")], "r string").select(display.humanized(F.col("r")))
    assert [r[0] for r in names.collect()] == ["No var", "C", "Y z q", "Unknown rule", "Unknown rule", "Rule id", "..."]
    rows = spark.createDataFrame([("no-undef", 3, 1, "bug"), ("undefined-variable", 2, 2, "bug"), ("strict", 9, 0, "code_smell"), ("B1", 1, 1, "security")], "rule_name string, count long, high long, family string")
    assert [(r.key, r["count"], r.high) for r in display.merged_rules(rows).collect()] == [("strict", 9, 0), ("undefined-reference", 5, 3), ("B1", 1, 1)]
    assert [r.raw for r in display.merged_notes(rows).collect()] == [["no-undef", "undefined-variable"]]
    assert tuple(display.rule_counts(rows).first()) == (4, 3, 1)
    assert [(r.rule_name, r["count"]) for r in display.of_severity(rows, "high").collect()] == [("undefined-variable", 2), ("B1", 1), ("no-undef", 1)]
    assert [r.key for r in display.rankings(rows.withColumn("medium", F.lit(1)))["high"].collect()][0] == "undefined-reference"
    months = spark.createDataFrame([("2025-01",), ("2025-02",), ("2025-05",)], "month string")
    assert [r.month for r in display.latest_months(months, 3, F.lit("2025-05-20").cast("date")).collect()] == ["2025-02", "2025-05"]
    low = spark.createDataFrame([(5, 7), (9, 2)], "t int, l int").select(display.without_low(F.col("t"), F.col("l"))).collect()
    assert [r[0] for r in low] == [0, 7]
    mini = display.severity_mini(read.rows.where("phase = 'added'"), "commit_hash").where(F.col("commit_hash") == A).first()
    assert (mini.high, mini.medium, mini.low) == (4, 0, 1)
    cat = display.examples(spark, [("bug", "t", "r", "s", "f", 1, "c"), ("bug", "u", "r", "s", "f", 1, "c"), ("smell", "v", "r", "s", "f", 1, "c")])
    assert {r.category: r.n for r in display.example_counts(cat).collect()} == {"bug": 2, "smell": 1, "all": 3}
    assert display.scope({"all": {"x": 1}, "focused": {}}) == {"x": 1}
    changed = spark.createDataFrame([("a", 0, "SURVIVED", 3), ("b", 0, "SURVIVED", 5)], "path string, num_changes int, status string, commit_count int")
    assert [r.path for r in display.most_changed(changed, 30, 1).collect()] == ["b"]
    assert [r.sha[0] for r in display.first_commits(read.manifests, 1).collect()] == ["a"]


def test_layouts(spark, folder, tmp_path):
    assert results.layout(spark, f"{folder}/res", "o/r_x").endswith("/res/o_r_x")
    assert results.layout(spark, f"{folder}/res/o_r_x", "any").endswith("/o_r_x")
    assert results.layout(spark, f"{folder}/res", "no/such") is None
    tables = results.repo_tables(spark, f"{folder}/res", "o/r_x")
    assert set(tables) == {"debt_metrics", "issue_survival", "lifecycle_metrics", "destiny_metrics", "details"}
    assert tables["issue_survival"].first().doc.total_issues == 3
    assert tables["details"].count() == 1
    (tmp_path / "bad.json").write_text("[1]")
    (tmp_path / "good.json").write_text(json.dumps({"status": "completed", "total_issues_introduced": 5}))
    got = results.first_document(spark, [str(tmp_path / n) for n in ("none.json", "bad.json", "good.json")], results.SUMMARY)
    assert got.first().doc.total_issues_introduced == 5
    assert results.first_document(spark, [str(tmp_path / "none.json")], results.SUMMARY) is None
