"""Reports over commits and their findings.

``commits``: facts.commit_facts(); ``measures``: facts.commit_measures(); ``events``: facts.of_commits(facts.classified()).
Counts are whole and ratios not rounded; a ratio to nothing is 0. Ties go by name, so results
don't depend on the order of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.functions.rules import FOCUSED_TOOLS
from codequarry.operators.ordered import floor_quantiles, top_k
from codequarry.tables import written

SEVERITIES = ("high", "medium", "low")
FAMILIES = ("bug", "code_smell", "security")
# Ranges of stars, and the languages that reports name.
STAR_RANGES = [("100-500", 100, 500), ("500-1K", 500, 1000), ("1K-5K", 1000, 5000), ("5K-10K", 5000, 10_000), ("10K-50K", 10_000, 50_000), ("50K+", 50_000, 10**9)]
NAMED_LANGUAGES = ["Python", "TypeScript", "JavaScript", "Go", "Rust", "Java", "C++", "C#", "C", "Ruby", "PHP", "Kotlin"]
# What the patterns of likely false positives are called.
PATTERN_LABELS = {
    "embedded_env": "Embedded Environment / Installed Package Code",
    "vendored_dependency": "Vendored / Third-Party Dependency Code",
    "dev_tool_context": "Developer Tool / CLI Context Warning",
}


def ratio(a: Column | str, b: Column | str, times: float = 1.0) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a.cast("double") * times / b).otherwise(0.0)


def count_if(test: Column, name: str) -> Column:
    return F.count_if(test).alias(name)


def added(events: DataFrame) -> DataFrame:
    return events.where("phase = 'added'")


def actionable(events: DataFrame) -> DataFrame:
    return events.where("phase = 'added' AND is_actionable")


def focused(df: DataFrame, tools: list[str] = FOCUSED_TOOLS) -> DataFrame:
    """Only the rows of the tools in focus; every report can be made of these instead of all."""
    return df.where(F.col("tool").isin(tools))


def global_totals(commits: DataFrame, measures: DataFrame, events: DataFrame) -> DataFrame:
    """One row. Repositories count with any commit, tainted or not; everything else leaves tainted commits out."""
    repos = commits.agg(F.count_distinct("repo").alias("repos"))
    m = measures.agg(
        F.count_distinct(F.when(F.col("n_files") > 0, F.col("repo"))).alias("repos_with_code"), F.count("*").alias("commits"), F.coalesce(F.sum("issues"), F.lit(0)).alias("issues_introduced"),
        F.coalesce(F.sum("fixed"), F.lit(0)).alias("issues_fixed"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("files_analyzed"), F.coalesce(F.sum("security"), F.lit(0)).alias("security_total"),
    )
    is_added = F.col("phase") == "added"
    e = events.agg(count_if(is_added & F.col("is_actionable"), "actionable_introduced"), count_if(~is_added & F.col("is_actionable"), "actionable_fixed"))
    # One row each.
    out = repos.crossJoin(m).crossJoin(e)
    return out.withColumns({
        "net_debt": F.col("issues_introduced") - F.col("issues_fixed"), "actionable_net_debt": F.col("actionable_introduced") - F.col("actionable_fixed"),
        "files_per_commit": ratio("files_analyzed", "commits"), "issues_per_file": ratio("issues_introduced", "files_analyzed"),
        "fix_rate": ratio("issues_fixed", "issues_introduced", 100), "security_pct": ratio("security_total", "issues_introduced", 100),
    })


def count_by(events: DataFrame, *keys: str) -> DataFrame:
    """The keys and n."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def fixed_by_severity(events: DataFrame) -> DataFrame:
    """sev, n of resolved findings that are no noise."""
    return count_by(events.where("phase = 'resolved' AND is_actionable"), "sev")


def measures_by(measures: DataFrame, *keys: str) -> DataFrame:
    """The keys, and what their commits add up to, with the ratios of those sums."""
    out = measures.groupBy(*keys).agg(
        F.count("*").alias("commits"), F.sum("issues").alias("issues"), F.sum("fixed").alias("fixed"), F.sum("high").alias("high"), F.sum("security").alias("security"),
        F.sum("n_files").alias("files"), count_if(F.col("issues") == 0, "zero_commits"),
    )
    return out.withColumns({
        "net_debt": F.col("issues") - F.col("fixed"), "issues_per_commit": ratio("issues", "commits"), "files_per_commit": ratio("files", "commits"), "issues_per_file": ratio("issues", "files"),
        "high_per_file": ratio("high", "files"), "security_per_file": ratio("security", "files"), "zero_pct": ratio("zero_commits", "commits", 100), "fix_rate": ratio("fixed", "issues", 100),
        "high_pct": ratio("high", "issues", 100), "security_pct": ratio("security", "issues", 100),
    })


def monthly(measures: DataFrame, *keys: str) -> DataFrame:
    """month, the keys, and commits, issues, high of each; commits whose month is unknown are left out."""
    out = measures.where("month is not null").groupBy("month", *keys).agg(F.count("*").alias("commits"), F.sum("issues").alias("issues"), F.sum("high").alias("high"))
    return out.withColumn("rate", ratio("issues", "commits"))


def monthly_wide(measures: DataFrame, tools: list[str]) -> DataFrame:
    """A row for each month, with columns tool_<t>, issues_<t>, high_<t>, rate_<t> for each tool."""
    one = lambda t, c: F.coalesce(F.sum(F.when(F.col("tool") == t, c)), F.lit(0))
    sums = [e for t in tools for e in (one(t, F.lit(1)).alias(f"tool_{t}"), one(t, F.col("issues")).alias(f"issues_{t}"), one(t, F.col("high")).alias(f"high_{t}"))]
    out = measures.where("month is not null").groupBy("month").agg(F.count("*").alias("commits"), F.sum("issues").alias("issues"), F.sum("high").alias("high_issues"), *sums)
    return out.withColumns({f"rate_{t}": ratio(f"issues_{t}", f"tool_{t}") for t in tools})


def focused_monthly(measures: DataFrame, events: DataFrame, tools: list[str] = FOCUSED_TOOLS, first: str = "2024-01") -> DataFrame:
    """month (of the cohort), tool, commits, and actionable issues, from ``first`` on."""
    n = focused(measures, tools).where(F.col("cohort") >= first).groupBy(F.col("cohort").alias("month"), "tool").agg(F.count("*").alias("commits"))
    i = actionable(focused(events, tools)).where(F.col("cohort") >= first).groupBy(F.col("cohort").alias("month"), "tool").agg(F.count("*").alias("issues"))
    return n.join(i, ["month", "tool"], "full_outer").na.fill(0, ["commits", "issues"]).withColumn("rate", ratio("issues", "commits"))


def dominant(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by``, the value that most of their rows have, and n; of equals the first by name."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return top_k(n, by, [F.desc("n"), F.col(value)], 1).drop("rank")


def repo_rows(commits: DataFrame, measures: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """A row for each repository. Its rate divides by all commits, tainted ones too."""
    measures = written(measures, "measures")
    all_ = commits.groupBy("repo").agg(F.count("*").alias("commits"))
    of = lambda role, c: F.coalesce(F.sum(F.when(F.col("role") == role, F.col(c))), F.lit(0))
    sums = measures.groupBy("repo").agg(
        F.bool_or(F.col("n_files") > 0).alias("has_code"), F.sum("issues").alias("issues_introduced"), F.sum("fixed").alias("issues_fixed"), F.sum("high").alias("issues_high"), F.sum("security").alias("issues_security"),
        of("sole_author", "issues").alias("issues_sole_author"), of("coauthor", "issues").alias("issues_coauthor"), of("sole_author", "fixed").alias("fixed_sole_author"), of("coauthor", "fixed").alias("fixed_coauthor"),
    )
    numbers = [c for c in sums.columns if c not in ("repo", "has_code")]
    out = all_.join(sums, "repo", "left").join(dominant(measures, ["repo"], "tool").select("repo", "tool"), "repo", "left")
    out = out.na.fill(0, numbers).na.fill(False, ["has_code"]).na.fill("unknown", ["tool"])
    out = out.withColumn("issues_per_commit", ratio("issues_introduced", "commits"))
    out = out.withColumn("pct_sole", 100 * F.col("issues_sole_author").cast("double") / F.greatest(F.lit(1), F.col("issues_introduced")))
    if metadata is None:
        return out
    known = metadata.select(F.col("repo_name").alias("repo"), "stars", "language")
    return out.join(known, "repo", "left").withColumn("stars", F.coalesce("stars", F.lit(0).cast("long"))).withColumn("language", F.coalesce("language", F.lit("")))


def repo_counts(repos: DataFrame) -> DataFrame:
    """One row: how many repositories there are, without a finding, with high or security ones, with more than 5 a commit."""
    return repos.agg(
        F.count("*").alias("repos"), count_if(F.col("issues_introduced") == 0, "zero_issues"), count_if(F.col("issues_high") > 0, "with_high"),
        count_if(F.col("issues_security") > 0, "with_security"), count_if(F.col("issues_per_commit") > 5, "over_5"),
    )


def top_repos(repos: DataFrame, n: int | None = 15) -> DataFrame:
    """Repositories with any finding (``n`` None) or the first n, most findings first."""
    out = repos.orderBy(F.desc("issues_introduced"), "repo")
    return out.where("issues_introduced > 0") if n is None else out.limit(n)


def high_debt_commits(measures: DataFrame, least: int = 5, n: int = 20) -> DataFrame:
    rows = measures.where(F.col("issues") >= least).select("repo", "sha12", "tool", "role", "issues", "high", "security", "month")
    return rows.orderBy(F.desc("high"), F.desc("issues"), "repo", "sha12").limit(n)


def rules_by_severity(events: DataFrame, by: list[str] | None = None, n: int | None = 25) -> DataFrame:
    """``by``, rule_name, n, high, medium, low of actionable findings; the ``n`` most frequent of each."""
    by = by or []
    out = actionable(events).groupBy(*by, "rule_name").agg(F.count("*").alias("n"), *[count_if(F.col("sev") == s, s) for s in SEVERITIES])
    if n is None:
        return out
    order = [F.desc("n"), F.col("rule_name")]
    return top_k(out, by, order, n).drop("rank") if by else out.orderBy(*order).limit(n)


def tool_ranking(measures: DataFrame) -> DataFrame:
    """tool, rate: issues a commit, most first."""
    return measures_by(measures, "tool").select("tool", F.col("issues_per_commit").alias("rate")).orderBy(F.desc("rate"), "tool")


def tool_stats(commits: DataFrame, measures: DataFrame) -> DataFrame:
    """A row for each tool: sums, ratios, medians, its repositories, and the same by role.

    ``measures``, a row for each commit, is gone over many times, so it is written once.
    """
    measures = written(measures, "measures")
    base = measures_by(measures, "tool")
    mid = lambda rows, name: floor_quantiles(rows, ["tool"], "issues", {name: (1, 2)}).select("tool", name)
    repos = repo_rows(commits, measures).groupBy("tool").agg(F.count("*").alias("repos"))
    out = base.join(mid(measures, "issues_per_commit_median"), "tool").join(repos, "tool", "left").na.fill(0, ["repos"])
    for short, role in (("sole", "sole_author"), ("co", "coauthor")):
        mine = measures.where(F.col("role") == role)
        sums = measures_by(mine, "tool").select("tool", *[F.col(c).alias(f"{short}_{c}") for c in ("commits", "issues", "files", "issues_per_commit", "issues_per_file", "files_per_commit")])
        out = out.join(sums, "tool", "left").join(mid(mine, f"{short}_issues_per_commit_median"), "tool", "left")
    out = out.na.fill(0)
    return out.withColumn("pct_sole_author", ratio("sole_commits", "commits", 100))


def focused_tool_stats(measures: DataFrame, events: DataFrame, files: DataFrame, tools: list[str] = FOCUSED_TOOLS) -> DataFrame:
    """tool, commits, actionable findings by family, files (``files``: a row for each file that is no noise, with repo, commit_hash, tool), and ratios."""
    m = focused(measures, tools).groupBy("tool").agg(F.count("*").alias("commits"), F.count_distinct(F.when(F.col("n_files") > 0, F.col("repo"))).alias("repos_with_code"))
    f = focused(files, tools).groupBy("tool").agg(F.count("*").alias("actionable_files"))
    e = actionable(focused(events, tools)).groupBy("tool").agg(F.count("*").alias("actionable_issues"), *[count_if(F.col("family") == x, x) for x in FAMILIES])
    out = m.join(f, "tool", "left").join(e, "tool", "left").na.fill(0)
    per = {f"{x}_per_{unit}": ratio(x, of) for x in FAMILIES for unit, of in (("commit", "commits"), ("file", "actionable_files"))}
    return out.withColumns(per | {"actionable_per_commit": ratio("actionable_issues", "commits"), "actionable_per_file": ratio("actionable_issues", "actionable_files")})


def role_detail(measures: DataFrame, events: DataFrame, role: str) -> dict[str, DataFrame]:
    """All that is told of one role: totals, by_severity, by_type, by_language, top_rules, by_tool, time_series."""
    m, e = measures.where(F.col("role") == role), events.where(F.col("role") == role)
    by_tool = measures_by(m, "tool").join(floor_quantiles(m, ["tool"], "issues", {"issues_per_commit_median": (1, 2)}).select("tool", "issues_per_commit_median"), "tool")
    return {
        "totals": measures_by(m, "role"), "by_severity": count_by(added(e), "sev"), "by_type": count_by(added(e), "kind").orderBy(F.desc("n"), "kind").limit(20),
        "by_language": count_by(added(e), "lang"), "top_rules": rules_by_severity(e), "by_tool": by_tool, "time_series": monthly(m).orderBy("month"),
    }


def distinct_counts(commits: DataFrame, measures: DataFrame, events: DataFrame) -> DataFrame:
    """One row: repositories (all, with code, with actionable findings) and commits with such findings, by sha alone."""
    all_ = commits.where(~F.col("is_tainted")).agg(F.count_distinct("repo").alias("repos_all"))
    m = measures.agg(F.count_distinct(F.when(F.col("n_files") > 0, F.col("repo"))).alias("repos_with_code"))
    e = actionable(events).agg(F.count_distinct("repo").alias("repos_with_issues"), F.count_distinct("sha12").alias("commits_with_issues"))
    return all_.crossJoin(m).crossJoin(e)  # one row each


def families(events: DataFrame) -> DataFrame:
    """family, issues, fixed, net, repos, commits of actionable findings."""
    is_added, resolved = F.col("phase") == "added", F.col("phase") == "resolved"
    # One pass over the findings, down to a row for each commit of a family; only those are told apart.
    per = events.where(F.col("is_actionable")).groupBy("family", "repo", "sha12").agg(count_if(is_added, "issues"), count_if(resolved, "fixed")).where("issues > 0 OR fixed > 0")
    of_added = lambda c: F.count_distinct(F.when(F.col("issues") > 0, F.col(c)))
    out = per.groupBy("family").agg(F.sum("issues").alias("issues"), F.sum("fixed").alias("fixed"), of_added("repo").alias("repos"), of_added("sha12").alias("commits"))
    return out.withColumn("net", F.col("issues") - F.col("fixed")).select("family", "issues", "fixed", "net", "repos", "commits")


def script_language(lang: Column) -> Column:
    """JavaScript and TypeScript are one language in the tables of rules."""
    return F.when(lang == "typescript", "javascript").otherwise(lang)


def family_rules(events: DataFrame, n: int | None = 10) -> DataFrame:
    """family, rule_name, n: the first ``n`` or all rules of each family."""
    out = count_by(actionable(events), "family", "rule_name")
    return out if n is None else top_k(out, ["family"], [F.desc("n"), F.col("rule_name")], n).drop("rank")


def language_rules(events: DataFrame, n: int = 10) -> DataFrame:
    rows = actionable(events).withColumn("lang", script_language(F.col("lang"))).where(F.col("lang").isin("python", "javascript"))
    return top_k(count_by(rows, "lang", "rule_name"), ["lang"], [F.desc("n"), F.col("rule_name")], n).drop("rank")


def family_by_language(events: DataFrame) -> DataFrame:
    rows = actionable(events).withColumn("lang", script_language(F.col("lang"))).where(F.col("lang").isin("python", "javascript"))
    return count_by(rows, "lang", "family")


def _filtered(events: DataFrame) -> DataFrame:
    """Findings with ``why``: a pattern, low_signal, or null where they are visible by default."""
    low = (F.col("sev") == "low") | F.col("is_low_signal")
    return added(events).withColumn("why", F.coalesce("fp_pattern", F.when(low, F.lit("low_signal"))))


def filter_summary(events: DataFrame) -> DataFrame:
    """One row: total, likely_false_positive, low_signal, filtered_total, visible, and shares in percent."""
    out = _filtered(events).agg(F.count("*").alias("total"), count_if(F.col("fp_pattern").isNotNull(), "likely_false_positive"), count_if(F.col("why") == "low_signal", "low_signal"))
    out = out.withColumn("filtered_total", F.col("likely_false_positive") + F.col("low_signal"))
    out = out.withColumn("visible", F.greatest(F.lit(0), F.col("total") - F.col("filtered_total")))
    return out.withColumns({"filtered_rate": ratio("filtered_total", "total", 100), "visible_rate": ratio("visible", "total", 100)})


def first_samples(rows: DataFrame, by: list[str], value: str, k: int = 5) -> DataFrame:
    """``by``, samples: the first ``k`` different values by name, which are ranked, never gathered."""
    one = rows.where(F.coalesce(F.col(value), F.lit("")) != "").select(*by, value).distinct()
    return top_k(one, by, [F.col(value)], k).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("samples"))  # k at most


def filter_patterns(events: DataFrame) -> DataFrame:
    """pattern, label, n, share_pct, top_rules (five at most), samples (five paths at most)."""
    rows = _filtered(events).where("fp_pattern is not null").withColumnRenamed("fp_pattern", "pattern")
    total = added(events).agg(F.count("*").alias("total"))  # one row
    n = count_by(rows, "pattern")
    best = top_k(count_by(rows, "pattern", "rule_name"), ["pattern"], [F.desc("n"), F.col("rule_name")], 5)
    best = best.groupBy("pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rule_name", "n"))), lambda r: F.concat_ws(":", r["rule_name"], r["n"].cast("string"))).alias("top_rules"))
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in PATTERN_LABELS.items() for x in kv]), F.col("pattern"))
    out = n.join(best, "pattern").join(first_samples(rows, ["pattern"], "file_path"), "pattern", "left").crossJoin(total)
    return out.select("pattern", label.alias("label"), "n", ratio("n", "total", 100).alias("share_pct"), "top_rules", "samples")


def low_signal_rules(events: DataFrame, n: int = 15) -> DataFrame:
    """rule_name, n, share_pct (of all), filtered_share_pct (of those filtered), samples: rules that are hidden as of low signal."""
    rows = _filtered(events)
    total = rows.agg(F.count("*").alias("total"), count_if(F.col("why").isNotNull(), "filtered"))  # one row
    low = rows.where("why = 'low_signal'")
    top = count_by(low, "rule_name").orderBy(F.desc("n"), "rule_name").limit(n)
    out = top.join(first_samples(low, ["rule_name"], "file_path"), "rule_name", "left").crossJoin(total)
    return out.select("rule_name", "n", ratio("n", "total", 100).alias("share_pct"), ratio("n", "filtered", 100).alias("filtered_share_pct"), "samples")


def _repo_families(measures: DataFrame, events: DataFrame) -> DataFrame:
    """repo, commits and actionable findings by family of repositories with code."""
    m = measures.groupBy("repo").agg(F.count("*").alias("commits"), F.bool_or(F.col("n_files") > 0).alias("has_code")).where("has_code").drop("has_code")
    e = actionable(events).groupBy("repo").agg(*[count_if(F.col("family") == x, x) for x in FAMILIES])
    return m.join(e, "repo", "left").na.fill(0)


def _rates(rows: DataFrame, by: str) -> DataFrame:
    out = rows.groupBy(by).agg(F.count("*").alias("repos"), *[F.sum(c).alias(c) for c in ("commits", *FAMILIES)])
    out = out.withColumns({f"{x}_per_commit": ratio(x, "commits") for x in FAMILIES})
    return out.withColumn("total_per_commit", ratio(F.col("bug") + F.col("code_smell") + F.col("security"), F.col("commits")))


def star_ranges(measures: DataFrame, events: DataFrame, metadata: DataFrame) -> DataFrame:
    """label, repos, commits, bug, code_smell, security, and each a commit; ranges without a repository are left out."""
    rows = _repo_families(measures, events).join(metadata.select(F.col("repo_name").alias("repo"), "stars"), "repo", "left")
    label = F.coalesce(*[F.when((F.col("stars") >= low) & (F.col("stars") < high), name) for name, low, high in STAR_RANGES])
    return _rates(rows.withColumn("label", label).where("label is not null"), "label")


def language_rollup(measures: DataFrame, events: DataFrame, metadata: DataFrame, least: int = 5) -> DataFrame:
    """language (those not named are Other), repos, ... as star_ranges(); languages of ``least`` repositories or more."""
    rows = _repo_families(measures, events).join(metadata.select(F.col("repo_name").alias("repo"), "language"), "repo", "left")
    rows = rows.withColumn("language", F.when(F.col("language").isin(NAMED_LANGUAGES), F.col("language")).otherwise("Other"))
    return _rates(rows, "language").where(F.col("repos") >= least)


def skip_counts(files: DataFrame) -> DataFrame:
    """repo, commit_hash, files_total, and a column for each reason why files (path, status) were left out."""
    from codequarry.functions.paths import skip_reason

    why = F.when(F.col("status").startswith("D"), "deleted").otherwise(skip_reason(F.col("path")))
    reasons = ("deleted", "noise", "non_code", "unsupported_language", "generated", "vendored", "example")
    out = files.withColumn("why", why).groupBy("repo", "commit_hash").agg(F.count("*").alias("files_total"), *[count_if(F.col("why") == r, r) for r in reasons], count_if(F.col("why").isNull(), "left_to_analyze"))
    return out.withColumn("skipped_total", sum((F.col(r) for r in reasons), F.lit(0)))


def commit_summary(events: DataFrame) -> DataFrame:
    """repo, commit_hash, introduced, fixed, net_change, quality_improved, by_type and by_severity (maps of raw names)."""
    one = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    keys = ["repo", "commit_hash"]
    # One pass over the findings: they are counted by what they are, and the few counts of a commit then make all columns.
    per = events.groupBy(*keys, "phase", one("type").alias("by_type"), one("severity").alias("by_severity")).agg(F.count("*").alias("n"))
    sum_of = lambda phase: F.coalesce(F.sum(F.when(F.col("phase") == phase, F.col("n"))), F.lit(0).cast("long"))
    of = [F.struct(F.lit(name).alias("of"), F.col(name).alias("k")) for name in ("by_type", "by_severity")]
    names = per.withColumn("x", F.explode(F.array(*of))).groupBy(*keys, "x").agg(
        F.sum(F.when(F.col("phase") == "added", F.col("n"))).alias("n"), sum_of("added").alias("introduced"), sum_of("resolved").alias("fixed")
    )
    is_type = F.col("x.of") == "by_type"  # each finding has one type
    listed = lambda name: F.collect_list(F.when((F.col("x.of") == name) & F.col("n").isNotNull(), F.struct(F.col("x.k").alias("k"), "n")))
    all_of = lambda c: F.coalesce(F.sum(F.when(is_type, F.col(c))), F.lit(0).cast("long")).alias(c)
    n = names.groupBy(*keys).agg(all_of("introduced"), all_of("fixed"), *[listed(name).alias(name) for name in ("by_type", "by_severity")])
    n = n.withColumns({name: F.when(F.size(name) > 0, F.map_from_entries(F.array_sort(name))) for name in ("by_type", "by_severity")})
    return n.withColumns({"net_change": F.col("introduced") - F.col("fixed"), "quality_improved": F.col("fixed") > F.col("introduced")})


def running(rows: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """Adds cum_<value> for each value: the sum up to each row. Rows are already grouped: a few for each of ``by``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"cum_{v}": F.sum(v).over(w) for v in values})
