"""What a reader of the reports sees: filters, merged rules, rankings, pages, and totals.

``rows`` are findings as of facts.issue_rows(), without what the analyses leave out: the display has
lists of its own for that. ``visible()`` applies them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.functions import issues, rules
from codequarry.functions.paths import any_of, falsy
from codequarry.operators.ordered import top_k
from codequarry.reports.debt import count_if, ratio

PAGE = 50
# Rules that are one to a reader, with what they are called.
RULE_GROUPS = [
    ("unused-vars", "Unused variables or parameters", ["no-unused-vars", "@typescript-eslint/no-unused-vars"]),
    ("undefined-reference", "Undefined variable or reference", ["undefined-variable", "no-undef"]),
    ("unreachable-code", "Unreachable code", ["unreachable", "no-unreachable"]),
    ("shadowed-variable", "Shadowed outer variable", ["redefined-outer-name", "no-shadow", "@typescript-eslint/no-shadow"]),
    ("too-many-params", "Too many parameters", ["too-many-arguments", "max-params", "@typescript-eslint/max-params"]),
    ("redeclared-symbol", "Redeclared symbol", ["function-redefined", "no-redeclare"]),
    ("magic-numbers", "Magic numbers", ["no-magic-numbers", "@typescript-eslint/no-magic-numbers"]),
]
# Severities of low rank, their order, and what a survival severity counts as.
LOW = ["low", "info", "style", "convention", "refactor", "minor"]
SEVERITY_ORDER = {
    "fatal": 5, "critical": 5, "blocker": 5, "error": 4, "high": 4, "warning": 3, "medium": 3, "major": 3, "convention": 2, "refactor": 2, "low": 2, "minor": 2, "info": 1, "style": 1,
}
SURVIVAL_SEVERITIES = {"ERROR": "high", "FATAL": "high", "HIGH": "high", "WARNING": "medium", "MEDIUM": "medium", "CONVENTION": "low", "REFACTOR": "low", "LOW": "low", "INFO": "low"}
TEST_PATH = r"(^|/)(tests?|__tests__|spec|fixtures?|mocks?|testdata|testing)(/|$)|\.test\.[jt]sx?$|\.spec\.[jt]sx?$|(^|/)conftest\.py$"
TOOL_PATH = r"(^|/)(scripts?|tools?|cli|bin)(/|$)|(^|/)__main__\.py$|(^|/)serve\.[jt]s$|dev[-_]?server\.[jt]sx?$"
#: Orders of the table of files; deleted ones first, most changed, least surviving, most lines.
FILE_ORDERS = {
    "most-changed": [F.desc, ("modification_count", "lines_added")],
    "lowest-survival": [F.asc, ("line_survival",)],
    "most-lines": [F.desc, ("lines_added",)],
    "deleted-first": [F.desc, ("is_deleted", "modification_count")],
}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def display_context(path: Column) -> Column:
    """The context of a path as the display infers it where none was stored."""
    p = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    words = "|".join(rules.SIMULATION_WORDS)
    return F.struct(p.rlike(TEST_PATH).alias("is_test"), p.rlike(rf"\b({words})\b").alias("is_simulation"), p.rlike(TOOL_PATH).alias("is_dev"))


def display_rule(rule: Column, symbol: Column, rule_id: Column, kind: Column) -> Column:
    return F.coalesce(falsy(rule_id, rule, symbol, kind), F.lit(""))


def is_display_blocked(rule: Column, context: Column) -> Column:
    yes = lambda k: F.coalesce(context[k], F.lit(False))
    return any_of(
        rule.isin(rules.DISPLAY_BLOCKED_RULES), yes("is_test") & rule.isin(rules.DISPLAY_TEST_RULES), yes("is_simulation") & rule.isin(rules.SIMULATION_RULES), yes("is_dev") & rule.isin(rules.DISPLAY_DEV_TOOL_RULES)
    )


def is_display_low(severity: Column, rule: Column, message: Column, path: Column, marked: Column | None = None) -> Column:
    low = F.lower(F.coalesce(severity, F.lit(""))).isin(LOW) | rules.is_low_signal(rule, message, path, rules.DISPLAY_LOW_SIGNAL_RULES)
    return low if marked is None else F.coalesce(marked, F.lit(False)) | low


def with_visibility(rows: DataFrame, context: str = "context") -> DataFrame:
    """Rows with shown_rule, is_blocked_here and is_low_here."""
    c = F.col
    rule = display_rule(c("rule"), c("symbol"), c("rule_id"), c("type"))
    out = rows.withColumn("shown_rule", rule).withColumn("is_blocked_here", is_display_blocked(c("shown_rule"), F.coalesce(c(context), display_context(c("file_path")))))
    return out.withColumn("is_low_here", is_display_low(c("severity"), rules.signal_rule(c("rule"), c("symbol"), c("rule_id")), c("message"), c("file_path")))


def visible(rows: DataFrame, show_low: bool = False, role: str = "all", context: str = "context") -> DataFrame:
    """Rows that are not blocked and, but with ``show_low``, not of low severity; of one role, or all."""
    out = with_visibility(rows, context).where("NOT is_blocked_here")
    if not show_low:
        out = out.where("NOT is_low_here")
    return out if role == "all" else out.where(F.coalesce("role", F.lit("unknown")) == role)


def commit_counts(shown: DataFrame, commits: DataFrame, only_changes: bool = False) -> DataFrame:
    """repo, commit_hash, introduced, fixed of what is visible; with ``only_changes``, commits with any."""
    keys = ["repo", "commit_hash"]
    n = shown.groupBy(*keys).agg(count_if(F.col("phase") == "added", "introduced"), count_if(F.col("phase") == "resolved", "fixed"))
    out = commits.join(n, keys, "left").na.fill(0, ["introduced", "fixed"])
    return out.where("introduced > 0 OR fixed > 0") if only_changes else out


def net_debt(counts: DataFrame, order: list[str]) -> DataFrame:
    """Counts with net and cumulative: the sum of net over a repository's commits up to each, in ``order``."""
    w = Window.partitionBy("repo").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("net", F.col("introduced") - F.col("fixed"))
    return out.withColumn("cumulative", F.sum("net").over(w))


def debt_peaks(running: DataFrame, order: list[str]) -> DataFrame:
    """repo, introduced, fixed, peak, final."""
    return running.groupBy("repo").agg(F.sum("introduced").alias("introduced"), F.sum("fixed").alias("fixed"), F.max("cumulative").alias("peak"), F.max_by("cumulative", F.struct(*order)).alias("final"))


def humanized(rule: Column) -> Column:
    """A rule's name in words: what stands behind the last slash and dot, dashes as blanks, with a capital."""
    raw = F.trim(F.coalesce(rule, F.lit("")))
    base = F.substring_index(raw, "/", -1)
    parts = F.filter(F.split(base, r"\."), lambda p: p != "")
    n = F.size(parts)
    twice = (n >= 2) & (F.element_at(parts, -1) == F.get(parts, n - 2))
    last = F.when(twice, F.get(parts, n - 2)).otherwise(F.get(parts, n - 1))
    base = F.when(base.contains("."), F.coalesce(last, raw)).otherwise(base)
    clean = F.trim(F.regexp_replace(base, "[_-]+", " "))
    named = F.when(clean == "", raw).otherwise(F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 30)))
    return F.when(raw == "", "Unknown rule").otherwise(named)


def rule_key(rule: Column) -> Column:
    """The group that a rule belongs to, else the rule itself."""
    raw = F.trim(F.coalesce(rule, F.lit("")))
    return F.coalesce(_lookup({r: key for key, _, listed in RULE_GROUPS for r in listed}, raw), F.nullif(raw, F.lit("")), F.lit("?"))


def rule_label(rule: Column, description: Column | None = None) -> Column:
    raw = F.trim(F.coalesce(rule, F.lit("")))
    grouped = _lookup({r: label for _, label, listed in RULE_GROUPS for r in listed}, raw)
    return F.coalesce(grouped, *([falsy(description)] if description is not None else []), humanized(raw))


def merged_rules(rows: DataFrame, sort: str = "count", limit: int | None = 10) -> DataFrame:
    """key, label, raw_rules, count, high, medium, low, surviving, total, rate: rows (rule_name and any of the numbers) by group, most of ``sort`` first."""
    have = set(rows.columns)
    number = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c) if c in have else F.lit(0).cast("long").alias(c)
    out = rows.groupBy(rule_key(F.col("rule_name")).alias("key")).agg(
        F.min(rule_label(F.col("rule_name"))).alias("label"), F.count_distinct("rule_name").alias("raw_rules"), *[number(c) for c in ("count", "high", "medium", "low", "surviving", "total")]
    )
    out = out.withColumn("rate", ratio("surviving", "total"))
    return out if limit is None else out.orderBy(F.desc(sort), "key").limit(limit)


def rankings(rows: DataFrame, limit: int = 10) -> dict[str, DataFrame]:
    """Merged rules by all findings, by those of high severity, and by those of medium."""
    return {sort: merged_rules(rows, sort, limit) for sort in ("count", "high", "medium")}


def of_severity(rows: DataFrame, severity: str) -> DataFrame:
    """Rules with any finding of one severity, counted by those alone."""
    return rows.where(F.col(severity) > 0).withColumn("count", F.col(severity)).orderBy(F.desc("count"), "rule_name")


def merged_notes(rows: DataFrame) -> DataFrame:
    """label, raw: groups in which more than one rule occurs."""
    out = rows.groupBy(rule_key(F.col("rule_name")).alias("key"), rule_label(F.col("rule_name")).alias("label")).agg(F.array_sort(F.collect_set("rule_name")).alias("raw"))  # a group's rules: a few
    return out.where(F.size("raw") > 1).select("label", "raw")


def rule_counts(rows: DataFrame) -> DataFrame:
    """One row: raw_rules, concepts (after merging), and rules of security."""
    return rows.agg(F.count_distinct("rule_name").alias("raw_rules"), F.count_distinct(rule_key(F.col("rule_name"))).alias("concepts"), F.count_distinct(F.when(F.col("family") == "security", F.col("rule_name"))).alias("security_rules"))


def survival_buckets(by_severity: DataFrame) -> DataFrame:
    """sev (high, medium, low), total, surviving, fixed, rate of survival by the analyzers' own severities (sev, total, surviving)."""
    bucket = F.coalesce(_lookup(SURVIVAL_SEVERITIES, F.upper("sev")), F.lit("low"))
    out = by_severity.groupBy(bucket.alias("sev")).agg(F.sum("total").alias("total"), F.sum("surviving").alias("surviving"))
    grid = by_severity.sparkSession.createDataFrame([("high",), ("medium",), ("low",)], "sev string")
    out = grid.join(out, "sev", "left").na.fill(0)
    return out.withColumns({"fixed": F.col("total") - F.col("surviving"), "rate": ratio("surviving", "total")})


def mean_survival(destiny: DataFrame) -> DataFrame:
    """One row: the plain means of the commits' line and unit survival, and how many commits each is of."""
    lines, units = F.col("total_lines_added") > 0, F.col("semantic_units_original") > 0
    return destiny.agg(
        F.coalesce(F.avg(F.when(lines, F.col("survival_rate"))), F.lit(0.0)).alias("line_survival"), count_if(lines, "commits_with_lines"),
        F.coalesce(F.avg(F.when(units, F.col("semantic_survival_rate"))), F.lit(0.0)).alias("unit_survival"), count_if(units, "commits_with_units"),
    )


def file_map(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """[by,] path, status (the worst), num_changes, commit_count, was_fixed, was_refactored, days_to_first_change (the least above 0)."""
    by = by or []
    worst = F.max(F.when(F.col("status") == "DELETED", 3).when(F.col("status") == "MODIFIED", 2).otherwise(1))
    days = F.min(F.when(F.col("days_to_first_change") > 0, F.col("days_to_first_change")))
    out = files.where(F.coalesce("filepath", F.lit("")) != "").groupBy(*by, F.col("filepath").alias("path")).agg(
        worst.alias("_w"), F.coalesce(F.sum("num_changes"), F.lit(0)).alias("num_changes"), F.count("*").alias("commit_count"),
        F.bool_or(F.coalesce("was_fixed", F.lit(False))).alias("was_fixed"), F.bool_or(F.coalesce("was_refactored", F.lit(False))).alias("was_refactored"), days.alias("days_to_first_change"),
    )
    return out.withColumn("status", F.when(F.col("_w") == 3, "DELETED").when(F.col("_w") == 2, "MODIFIED").otherwise("SURVIVED")).drop("_w")


def file_map_summary(files: DataFrame) -> DataFrame:
    s = F.col("status")
    return files.agg(F.count("*").alias("files"), count_if(s == "SURVIVED", "survived"), count_if(s == "MODIFIED", "modified"), count_if(s == "DELETED", "deleted"), count_if(F.col("was_fixed"), "had_fixes"), count_if(F.col("was_refactored"), "refactored"))


def most_changed(files: DataFrame, n: int = 30, else_n: int = 15) -> DataFrame:
    """The ``n`` files with most changes, of those with any or deleted; where there are none, the ``else_n`` with most commits."""
    touched = (F.col("num_changes") > 0) | (F.col("status") == "DELETED")
    first = files.where(touched).orderBy(F.desc("num_changes"), "path").limit(n)
    none = files.agg(F.count_if(touched).alias("t")).where("t = 0")  # one row or none
    other = files.orderBy(F.desc("commit_count"), "path").limit(else_n).crossJoin(none).drop("t")
    return first.unionByName(other)


def file_table(details: DataFrame) -> DataFrame:
    """repo, commit_sha, file, line_survival, semantic_rate, modification_count, lines_added, is_deleted, label. ``details``: repo, commit_sha, f (a file of destiny)."""
    from codequarry.functions.paths import stability

    f = F.col("f")
    added, exist = F.coalesce(f["lines_added"], F.lit(0)), F.coalesce(f["lines_exist"], F.lit(0))
    return details.select(
        "repo", "commit_sha", f["file"].alias("file"), ratio(exist, added).alias("line_survival"), f["semantic"]["semantic_survival_rate"].alias("semantic_rate"),
        F.coalesce(f["modification_count"], F.lit(0)).alias("modification_count"), added.alias("lines_added"), ((added > 0) & (exist == 0)).alias("is_deleted"), stability(added, exist, f["semantic"]["semantic_survival_rate"]).alias("label"),
    )


def file_table_summary(files: DataFrame) -> DataFrame:
    x = F.col("label")
    return files.agg(F.count("*").alias("files"), count_if(x == "stable", "stable"), count_if(x == "modified", "modified"), count_if(x == "deleted", "deleted"), F.coalesce(F.avg("line_survival"), F.lit(0.0)).alias("mean_survival"))


def page(rows: DataFrame, number: int = 0, size: int = PAGE) -> DataFrame:
    return rows.offset(number * size).limit(size)


def file_page(files: DataFrame, order: str = "most-changed", number: int = 0, size: int = PAGE) -> DataFrame:
    way, columns = FILE_ORDERS[order]
    return page(files.orderBy(*[way(c) for c in columns], "file", "commit_sha"), number, size)


def repo_page(repos: DataFrame, category: str = "all", min_stars: int = 0, role: str = "all", search: str = "", sort: str = "issues_introduced", ascending: bool = False, number: int = 0, size: int = PAGE) -> DataFrame:
    """Repositories with findings: of a category (security, high, high-rate, all), with stars, with findings of a role, by a part of the name; one page."""
    out = repos.where("issues_introduced > 0")
    tests = {"security": F.col("issues_security") > 0, "high": F.col("issues_high") > 0, "high-rate": F.col("issues_per_commit") > 5}
    if category in tests:
        out = out.where(tests[category])
    if min_stars:
        out = out.where(F.coalesce("stars", F.lit(0)) >= min_stars)
    if role in ("sole_author", "coauthor"):
        out = out.where(F.col(f"issues_{role}") > 0)
    if search:
        out = out.where(name_contains(F.col("repo"), search))
    return page(out.orderBy(F.asc(sort) if ascending else F.desc(sort), "repo"), number, size)


def name_contains(name: Column, search: str) -> Column:
    return F.lower(name).contains(search.strip().lower())


def latest_months(rows: DataFrame, months: int, today: Column | None = None) -> DataFrame:
    """Rows of the last ``months`` months, and of the one that runs."""
    return rows.where(F.col("month") >= F.date_format(F.add_months(F.trunc(today if today is not None else F.current_date(), "MM"), -months), "yyyy-MM"))


def cumulative_issues(months: DataFrame) -> DataFrame:
    """month, issues, cumulative."""
    return months.withColumn("cumulative", F.sum("issues").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each month


def hotspots(shown: DataFrame, n: int = 8) -> dict[str, DataFrame]:
    """Commits and files with most visible findings of high severity: commits (repo, commit_hash, tool, count, file, rule of the first one), files (repo, file_path, count)."""
    high = shown.where("phase = 'added'").where(issues.severity_level(F.col("type"), F.col("detected_by"), F.trim("severity")) == "high")
    rule = F.coalesce(falsy(F.col("symbol"), F.col("rule"), F.col("rule_id")), F.lit("unknown"))
    first = F.min_by(F.struct("file_path", rule.alias("rule")), F.struct("file_no", "ord"))
    commits = high.groupBy("repo", "commit_hash", "tool").agg(F.count("*").alias("count"), first.alias("e")).select("repo", "commit_hash", "tool", "count", F.col("e.file_path").alias("file"), F.col("e.rule").alias("rule"))
    files = high.groupBy("repo", "file_path").agg(F.count("*").alias("count"))
    return {"commits": commits.orderBy(F.desc("count"), "repo", "commit_hash").limit(n), "files": files.orderBy(F.desc("count"), "repo", "file_path").limit(n)}


def tool_role_counts(counts: DataFrame) -> DataFrame:
    """tool, commits, introduced, sole, other: issues of commits by one author, and of all others."""
    sole = F.col("role") == "sole_author"
    return counts.groupBy("tool").agg(F.count("*").alias("commits"), F.sum("introduced").alias("introduced"), F.sum(F.when(sole, F.col("introduced")).otherwise(0)).alias("sole"), F.sum(F.when(sole, 0).otherwise(F.col("introduced"))).alias("other"))


def valuation_histogram(destiny: DataFrame) -> DataFrame:
    grid = destiny.sparkSession.createDataFrame([("HIGH",), ("MEDIUM",), ("LOW",)], "valuation string")
    n = destiny.groupBy(F.coalesce(falsy(F.col("developer_valuation")), F.lit("LOW")).alias("valuation")).agg(F.count("*").alias("n"))
    return grid.join(n, "valuation", "left").na.fill(0)


def with_totals(rows: DataFrame, by: str, numbers: list[str], label: str = "Total") -> DataFrame:
    """Sums by ``by``, and a last row with those over all of them."""
    out = rows.rollup(by).agg(*[F.sum(c).alias(c) for c in numbers], F.grouping(by).alias("_all"))
    return out.withColumn(by, F.when(F.col("_all") == 1, label).otherwise(F.col(by))).drop("_all")


def coverage(tools: DataFrame) -> DataFrame:
    """tool, commits, repos, repos_with_code, coverage_pct, commit_share_pct, and a total row. ``tools``: tool, commits, repos, repos_with_code."""
    out = with_totals(tools, "tool", ["commits", "repos", "repos_with_code"])
    every = F.max(F.when(F.col("tool") == "Total", F.col("commits"))).over(Window.partitionBy())  # a row for each tool
    return out.withColumns({"coverage_pct": ratio("repos_with_code", "repos", 100), "commit_share_pct": ratio(F.col("commits"), every, 100)})


def extremes(rows: DataFrame, column: str) -> DataFrame:
    """Rows with is_best (the least of the column) and is_worst (the most)."""
    all_ = Window.partitionBy()  # of a report's few rows
    return rows.withColumns({"is_best": F.col(column) == F.min(column).over(all_), "is_worst": F.col(column) == F.max(column).over(all_)})


def without_low(total: Column, low: Column) -> Column:
    """A headline without those of low severity, never below 0."""
    return F.greatest(F.lit(0), total - low)


def survival_summary(entries: DataFrame, show_low: bool = False, n: int = 10) -> dict[str, DataFrame]:
    """Of visible survival entries (as of survival.hydrated()): totals, by_severity (upper case), by_rule (the ``n`` most frequent)."""
    shown = visible(entries, show_low, context="filter_context").withColumn("sev", F.upper(F.coalesce("severity", F.lit("UNKNOWN")))).withColumn("rule_name", F.coalesce(F.nullif("shown_rule", F.lit("")), F.lit("unknown")))
    rate = lambda df: df.agg(F.count("*").alias("total"), count_if(F.col("survived"), "surviving")).withColumns({"fixed": F.col("total") - F.col("surviving"), "rate": ratio("surviving", "total")})
    return {"totals": rate(shown.groupBy()), "by_severity": rate(shown.groupBy("sev")), "by_rule": rate(shown.groupBy("rule_name")).orderBy(F.desc("total"), "rule_name").limit(n)}


def rule_severities(entries: DataFrame) -> DataFrame:
    """rule_name, severity: low if any visible entry of the rule is, else that of its first entry, medium if that says none; rules of low signal without an entry are low."""
    shown = visible(entries, True, context="filter_context").where("shown_rule <> ''")
    low = F.col("is_low_here") | F.lower(F.coalesce("severity", F.lit(""))).isin(LOW)
    found = shown.groupBy(F.col("shown_rule").alias("rule_name")).agg(F.bool_or(low).alias("_low"), F.min_by(F.lower(F.coalesce("severity", F.lit(""))), F.struct("repo", "ord")).alias("_first"))
    found = found.select("rule_name", F.when(F.col("_low"), "low").otherwise(F.coalesce(F.nullif("_first", F.lit("")), F.lit("medium"))).alias("severity"))
    known = entries.sparkSession.createDataFrame([(r,) for r in rules.DISPLAY_LOW_SIGNAL_RULES], "rule_name string").withColumn("severity", F.lit("low"))
    return found.unionByName(known.join(found, "rule_name", "left_anti"))


def severity_commits(shown: DataFrame, entries: DataFrame, severity: str) -> DataFrame:
    """repo, commit_hash, tool, count: commits with visible added findings of a severity, and those that only survival entries tell of, which count one."""
    keys = ["repo", "sha8"]
    short = F.substring("commit_hash", 1, 8)
    direct = shown.where("phase = 'added'").where(F.lower("severity") == severity.lower()).withColumn("sha8", short)
    direct = direct.groupBy(*keys).agg(F.min("commit_hash").alias("commit_hash"), F.min("tool").alias("tool"), F.count("*").alias("count"))
    commits = shown.withColumn("sha8", short).groupBy(*keys).agg(F.min("commit_hash").alias("commit_hash"), F.min("tool").alias("tool"))
    told = visible(entries, context="filter_context").where(F.lower("severity") == severity.lower()).select("repo", F.substring("commit_sha", 1, 8).alias("sha8")).where("sha8 <> ''").distinct()
    more = told.join(direct, keys, "left_anti").join(commits, keys).withColumn("count", F.lit(1).cast("long"))
    return direct.unionByName(more.select(direct.columns)).select("repo", "commit_hash", "tool", "count").orderBy(F.desc("count"), "repo", "commit_hash")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(_lookup(SEVERITY_ORDER, F.lower(F.coalesce(severity, F.lit("")))), F.lit(0))


def issue_list(rows: DataFrame) -> DataFrame:
    """Findings of a commit, most severe first, of those the security ones, then by file."""
    secure = F.lower(F.coalesce("type", F.lit(""))).isin("security", "bandit")
    return rows.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc(secure), "file_path", "file_no", "ord")


def severity_mini(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, high, medium, low of findings."""
    level = issues.severity_level(F.col("type"), F.col("detected_by"), F.col("severity"))
    return rows.groupBy(*keys).agg(*[count_if(level == s, s) for s in ("high", "medium", "low")])


def top_tools(months: DataFrame, n: int = 6) -> DataFrame:
    """tool, total: the ``n`` largest sums of the tool_<name> columns of a wide table of months."""
    names = [c for c in months.columns if c.startswith("tool_")]
    long = months.unpivot("month", names, "tool", "n").groupBy(F.substring("tool", 6, 100).alias("tool")).agg(F.sum("n").alias("total"))
    return long.orderBy(F.desc("total"), "tool").limit(n)


def notable(rows: DataFrame, column: str, n: int = 12) -> DataFrame:
    """Repositories or commits ranked by one column, such as the issues of a role; those with none are left out."""
    return rows.where(F.col(column) > 0).orderBy(F.desc(column), *[c for c in ("repo", "commit_hash") if c in rows.columns]).limit(n)


def deep_detail(commits: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` commits of a deep scan, in their order, that introduced anything."""
    return commits.where("introduced > 0").orderBy("ord").limit(n)


def export_rows(counts: DataFrame, lifecycle: DataFrame, destiny: DataFrame) -> DataFrame:
    """A row for each commit with its findings, files and lines: what the CSV holds. ``counts``: commit_counts() of commits with tool and n_files;
    ``lifecycle``: repo, sha12, status of files; ``destiny``: repo, commit_sha, survival_rate. Joined by the commit's hash, never by place."""
    life = lifecycle.groupBy("repo", "sha12").agg(count_if(F.col("status") == "SURVIVED", "files_survived"), count_if(F.col("status") == "MODIFIED", "files_modified"))
    lines = destiny.groupBy("repo", F.substring("commit_sha", 1, 8).alias("sha8")).agg(F.min("survival_rate").alias("survival_rate"))
    out = counts.withColumns({"sha12": F.substring("commit_hash", 1, 12), "sha8": F.substring("commit_hash", 1, 8)}).join(life, ["repo", "sha12"], "left").join(lines, ["repo", "sha8"], "left")
    out = out.na.fill(0, ["files_survived", "files_modified"])
    return out.select(
        F.col("sha12").alias("commit_sha"), "repo", F.col("tool").alias("ai_tool"), F.col("n_files").alias("files_analyzed"), F.col("introduced").alias("issues_introduced"), F.col("fixed").alias("issues_fixed"),
        (F.col("introduced") - F.col("fixed")).alias("net_change"), "survival_rate", "files_survived", "files_modified",
    )


def scope(blocks: dict[str, dict], focused_first: bool = True) -> dict:
    """The block of the tools in focus if there is one, else that of all."""
    return (blocks.get("focused") or blocks["all"]) if focused_first else blocks["all"]


def examples(spark, rows: list[tuple], category: str = "all") -> DataFrame:
    """A catalogue of examples (category, title, repo, sha, file, line, code) as rows, of one category or all."""
    out = spark.createDataFrame(rows, "category string, title string, repo string, sha string, file string, line int, code string")
    return out if category == "all" else out.where(F.col("category") == category)


def example_counts(catalogue: DataFrame) -> DataFrame:
    return with_totals(catalogue.withColumn("n", F.lit(1).cast("long")), "category", ["n"], "all")


def first_commits(commits: DataFrame, n: int) -> DataFrame:
    """The first ``n`` commits in the order of their manifest; all for 0."""
    return commits.orderBy("source", "ord").limit(n) if n else commits


def ranked(rows: DataFrame, by: list[str], column: str, n: int) -> DataFrame:
    return top_k(rows, by, [F.desc(column), F.col("rule_name")], n)
