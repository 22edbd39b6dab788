"""Facts that the reports are made of: commits, files, and classified findings.

All reports group a few wide tables, so classification happens once, as Column
expressions that stay in one stage with the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import issues, paths, rules
from codequarry.functions.paths import falsy


def commit_facts(results: DataFrame, dates: DataFrame | None = None, months: DataFrame | None = None) -> DataFrame:
    """repo, commit_hash, sha12, tool, role, files_total, n_files, is_tainted, month, cohort of each commit.

    ``results``: as of read_results(..., 'debt_metrics'). ``dates`` (sha12, role, month) fill in a role that the commit does
    not name, and give the cohort's month; ``months`` (sha12, month) are those of the detail files, which time series go by.
    """
    c = F.col("c")
    statuses = F.transform(c["files"], lambda f: f["status"])
    n_files = F.coalesce(F.nullif(c["code_files_analyzed"], F.lit(0)), F.greatest(F.size(c["files"]), F.lit(0)))
    out = results.select(
        "repo", F.coalesce(c["commit_hash"], F.lit("")).alias("commit_hash"), F.substring(F.coalesce(c["commit_hash"], F.lit("")), 1, 12).alias("sha12"),
        F.coalesce(falsy(c["ai_tool"]), F.lit("unknown")).alias("tool"), falsy(c["author_role"]).alias("own_role"),
        F.coalesce(c["analysis_counters"]["files_total"], F.lit(0)).alias("files_total"), n_files.cast("long").alias("n_files"),
        issues.is_tainted(c["analysis_counters"]["files_total"], statuses).alias("is_tainted"),
    )
    if dates is not None:
        out = out.join(dates.select("sha12", F.col("role").alias("known_role"), F.col("month").alias("cohort")), "sha12", "left")
    else:
        out = out.withColumn("known_role", F.lit(None).cast("string")).withColumn("cohort", F.lit(None).cast("string"))
    out = out.join(months.select("sha12", "month"), "sha12", "left") if months is not None else out.withColumn("month", F.lit(None).cast("string"))
    role = F.coalesce("own_role", falsy(F.col("known_role")), F.lit("unknown"))
    return out.select("repo", "commit_hash", "sha12", "tool", role.alias("role"), "files_total", "n_files", "is_tainted", "month", "cohort")


def issue_rows(results: DataFrame) -> DataFrame:
    """A row for each finding: repo, commit_hash, tool, file_path, phase (added, resolved), ord, context, and its own fields."""
    f = results.select("repo", F.coalesce("c.commit_hash", F.lit("")).alias("commit_hash"), F.coalesce(falsy(F.col("c.ai_tool")), F.lit("unknown")).alias("tool"), F.posexplode("c.files").alias("file_no", "f"))
    sides = []
    for phase, listed, context in (("added", "f.issues_added", "f.issue_filter_context_after"), ("resolved", "f.issues_resolved", "f.issue_filter_context_before")):
        one = f.select("repo", "commit_hash", "tool", "file_no", F.coalesce("f.file_path", F.lit("")).alias("file_path"), F.lit(phase).alias("phase"), F.col(context).alias("context"), F.posexplode(listed).alias("ord", "i"))
        sides.append(one)
    both = sides[0].unionByName(sides[1])
    fields = ("type", "severity", "symbol", "rule", "rule_id", "message", "category", "detected_by")
    return both.select("repo", "commit_hash", "tool", "file_no", "file_path", "phase", "context", "ord", *[f"i.{x}" for x in fields], F.coalesce(F.expr("try_cast(i.line AS int)"), F.lit(0)).alias("line"))


def classified(rows: DataFrame) -> DataFrame:
    """Findings that count (not in noise paths, not blocked), with rule_name, sev, kind, lang, family, is_security, is_low_signal,
    fp_pattern, is_actionable. ``rows``: as of issue_rows()."""
    c = F.col
    context = rules.filter_context(c("file_path"), given=c("context"))
    kept = rows.where(~paths.is_noise_path(c("file_path"))).where(~rules.is_blocked(rules.block_rule(c("rule"), c("symbol")), context))
    name = rules.counted_rule(c("rule"), c("symbol"), c("rule_id"))
    of_family = (c("type"), c("detected_by"), c("category"), rules.family_rule(c("rule"), c("symbol"), c("rule_id")))
    out = kept.withColumns({
        "rule_name": name, "sev": issues.severity_level(c("type"), c("detected_by"), c("severity")), "kind": F.lower(F.coalesce(falsy(c("type"), c("detected_by")), F.lit("unknown"))),
        "lang": paths.report_language(c("file_path")), "family": issues.issue_family(*of_family), "is_security": issues.is_security(*of_family),
        "is_low_signal": rules.is_low_signal(rules.signal_rule(c("rule"), c("symbol"), c("rule_id")), c("message"), c("file_path")),
        "fp_pattern": rules.false_positive_pattern(c("file_path"), name),
    })
    fixed_rule = falsy(c("symbol"), c("rule"), c("rule_id"))
    # A resolved finding is judged without its path's pattern, and one without any name is never noise.
    resolved = ~F.coalesce(fixed_rule, F.lit("")).isin(rules.NOISE_RULES) & ~c("is_low_signal")
    return out.withColumn("is_actionable", F.when(c("phase") == "added", rules.is_actionable(c("rule_name"), c("fp_pattern"), c("is_low_signal"))).otherwise(resolved))


def commit_measures(commits: DataFrame, events: DataFrame) -> DataFrame:
    """Untainted commits with issues, fixed, high, security: what the reports add up."""
    n = events.groupBy("repo", "commit_hash").agg(
        F.count_if(F.col("phase") == "added").alias("issues"), F.count_if(F.col("phase") == "resolved").alias("fixed"),
        F.count_if((F.col("phase") == "added") & (F.col("sev") == "high")).alias("high"), F.count_if((F.col("phase") == "added") & F.col("is_security")).alias("security"),
    )
    return commits.where(~F.col("is_tainted")).join(n, ["repo", "commit_hash"], "left").na.fill(0, ["issues", "fixed", "high", "security"])


def of_commits(events: DataFrame, commits: DataFrame) -> DataFrame:
    """Events of untainted commits, with role, month, cohort and sha12 of the commit."""
    keys = ["repo", "commit_hash"]
    return events.join(commits.where(~F.col("is_tainted")).select(*keys, "role", "month", "cohort", "sha12").dropDuplicates(keys), keys)
