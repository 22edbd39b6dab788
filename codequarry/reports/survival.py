"""Reports over findings, lines and files that survive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.functions import issues, rules
from codequarry.functions.paths import falsy
from codequarry.operators.ordered import floor_quantiles
from codequarry.reports.debt import FAMILIES, count_if, dominant, ratio, running

# Age cohorts in months, half open.
AGES = [("> 9 months", 9, 999), ("6–9 months", 6, 9), ("3–6 months", 3, 6), ("< 3 months", 0, 3)]
PLACE = ["repo", "k_sha", "k_path", "k_line", "k_type", "k_message", "k_severity"]
#: What findings are brought together by: their hash first, so that sorting rarely compares the texts.
KEY = ["k_hash", *PLACE]


def _keyed(df: DataFrame, sha: str, path: str) -> DataFrame:
    """With the columns that tell a finding from any other, none of them null but the repository, and their hash."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.withColumns({
        "k_sha": text(sha), "k_path": text(path), "k_line": F.coalesce(F.col("line"), F.lit(0)), "k_type": F.coalesce(falsy(F.col("type"), F.col("detected_by")), F.lit("")),
        "k_message": text("message"), "k_severity": text("severity"),
    }).withColumn("k_hash", F.xxhash64(*PLACE))


def survival_entries(documents: DataFrame) -> DataFrame:
    """repo, ord, survived, and the fields of the original finding. ``documents``: read_results(..., 'issue_survival')."""
    e = documents.where("doc.total_issues > 0").select("repo", F.posexplode("doc.issues").alias("ord", "e"))
    o = F.col("e.original")
    fields = ("commit_sha", "file_path", "type", "severity", "symbol", "rule", "rule_id", "message", "category", "detected_by", "filter_context")
    return e.select("repo", "ord", F.coalesce("e.survived", F.lit(False)).alias("survived"), *[o[f].alias(f) for f in fields], F.coalesce(F.expr("try_cast(e.original.line AS int)"), F.lit(0)).alias("line"))


def hydrated(entries: DataFrame, added: DataFrame) -> DataFrame:
    """Entries with what the finding said when it was introduced: rule, symbol, context, detected_by, category, and a rule_id
    where the entry's own is none or merely the type. ``added``: the added rows of facts.issue_rows(); of equal ones the first counts."""
    more = ("rule", "symbol", "rule_id", "detected_by", "category")
    said = F.struct(*more, F.col("context").alias("filter_context"))
    first = _keyed(added, "commit_hash", "file_path").where("repo IS NOT NULL").select(*KEY, F.col("file_no").alias("k_file"), F.col("ord").alias("k_ord"), said.alias("said"), F.lit(False).alias("k_entry"))
    # One exchange and one sort for both sides: what was introduced first heads its key, and is what the entries behind it read.
    both = _keyed(entries, "commit_sha", "file_path").withColumn("k_entry", F.lit(True)).unionByName(first, allowMissingColumns=True)
    heads = Window.partitionBy(*KEY).orderBy("k_entry", "k_file", "k_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("said", F.first_value("said").over(heads)).where("k_entry")
    known = falsy(F.col("said.rule"), F.col("said.symbol"), F.col("said.rule_id"))
    generic = (F.coalesce("rule_id", F.lit("")) == "") | F.col("rule_id").eqNullSafe(F.col("type"))
    filled = {f: F.coalesce(F.col(f"said.{f}"), F.col(f)) for f in ("rule", "symbol", "detected_by", "category", "filter_context")}
    return out.withColumns(filled | {"rule_id": F.when(generic & known.isNotNull(), known).otherwise(F.col("rule_id"))}).drop("said", "k_entry", "k_file", "k_ord", "k_hash", *PLACE[1:])


def tracked(entries: DataFrame) -> DataFrame:
    """Entries that count: not blocked, no noise, not of low signal; with rule_name, sev (upper case) and family."""
    c = F.col
    context = rules.filter_context(c("file_path"), given=c("filter_context"))
    kept = entries.where(~rules.is_blocked(rules.block_rule(c("rule_id"), c("symbol")), context))
    named = F.coalesce(falsy(c("rule_id"), c("symbol"), c("rule")), F.lit(""))
    low = rules.is_low_signal(rules.signal_rule(c("rule"), c("symbol"), c("rule_id")), c("message"), c("file_path"))
    kept = kept.where(~named.isin(rules.NOISE_RULES) & ~low)
    return kept.withColumns({
        "rule_name": F.coalesce(falsy(c("rule_id"), c("rule"), c("symbol"), c("type")), F.lit("unknown")), "sev": F.upper(F.coalesce(c("severity"), F.lit("UNKNOWN"))),
        "family": issues.issue_family(c("type"), c("detected_by"), c("category"), rules.family_rule(c("rule"), c("symbol"), c("rule_id"))),
    })


def with_tool(entries: DataFrame, commits: DataFrame) -> DataFrame:
    """Entries with the tool of their commit: by its whole hash, else by its first twelve characters, else unknown."""
    # A commit's tool is found once and read twice; hashes stand before the texts, so that sorting rarely compares them.
    key = lambda c: F.xxhash64("repo", c).alias("k_commit")
    full = commits.where("NOT is_tainted").groupBy(key("commit_hash"), "repo", F.col("commit_hash").alias("commit_sha")).agg(F.max(F.when(F.col("commit_hash") != "", F.col("tool"))).alias("by_sha"))
    short = full.groupBy("repo", F.substring("commit_sha", 1, 12).alias("sha12")).agg(F.max("by_sha").alias("by_sha12"))
    out = entries.withColumns({"sha12": F.substring(F.coalesce("commit_sha", F.lit("")), 1, 12), "k_commit": key("commit_sha")})
    out = out.join(full, ["k_commit", "repo", "commit_sha"], "left").join(short, ["repo", "sha12"], "left")
    return out.withColumn("tool", F.coalesce("by_sha", "by_sha12", F.lit("unknown"))).drop("by_sha", "by_sha12", "k_commit")


def with_cohort(entries: DataFrame, dates: DataFrame) -> DataFrame:
    """Entries whose commit has a month, with that month; the others go."""
    sha12 = F.substring(F.coalesce("commit_sha", F.lit("")), 1, 12)
    return entries.drop("sha12").withColumn("sha12", sha12).join(dates.where("month is not null").select("sha12", "month"), "sha12")


def summary(entries: DataFrame, *keys: str) -> DataFrame:
    """The keys, total, surviving, fixed, rate; of none, one row."""
    out = entries.groupBy(*keys).agg(F.count("*").alias("total"), count_if(F.col("survived"), "surviving"))
    return out.withColumns({"fixed": F.col("total") - F.col("surviving"), "rate": ratio("surviving", "total")})


def top_surviving_rules(entries: DataFrame, n: int = 15) -> DataFrame:
    return summary(entries, "rule_name").orderBy(F.desc("surviving"), "rule_name").limit(n)


def by_dominant_tool(entries: DataFrame, measures: DataFrame, least: int = 10) -> DataFrame:
    """tool, total, surviving, rate: all entries of a repository go to the tool that most of its commits are by."""
    tool = dominant(measures, ["repo"], "tool").select("repo", F.col("tool").alias("repo_tool"))
    per = summary(entries, "repo").join(tool, "repo", "left").groupBy(F.coalesce("repo_tool", F.lit("unknown")).alias("tool"))
    out = per.agg(F.sum("total").alias("total"), F.sum("surviving").alias("surviving")).where(F.col("total") >= least)
    return out.withColumn("rate", ratio("surviving", "total"))


def by_month(cohorts: DataFrame, family: bool = False) -> DataFrame:
    return summary(cohorts, "month", *(["family"] if family else [])).drop("fixed").withColumnRenamed("rate", "monthly_rate")


def over_time(cohorts: DataFrame, family: bool = False) -> DataFrame:
    """As by_month(), with running sums and their rate. By family, each month has a row for every family."""
    rows = by_month(cohorts, family).drop("monthly_rate")
    if family:  # a month's few rows are put beside each other, so that the entries are read once
        of = lambda c, name: F.coalesce(F.sum(F.when(F.col("family") == name, F.col(c))), F.lit(0).cast("long")).alias(c)
        cells = [F.struct(F.lit(x).alias("family"), of("total", x), of("surviving", x)) for x in FAMILIES]
        rows = rows.groupBy("month").agg(F.array(*cells).alias("cells")).select("month", F.inline("cells"))
    out = running(rows, ["family"] if family else [], "month", ["total", "surviving"])
    return out.withColumns({"monthly_rate": ratio("surviving", "total"), "cum_rate": ratio("cum_surviving", "cum_total")})


def month_number(month: Column) -> Column:
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def by_age(cohorts: DataFrame, commits_by_month: DataFrame | None = None, reference: str | None = None, family: bool = False) -> DataFrame:
    """label, [family,] total, surviving, fixed, commits, rate, per_100_commits: by age at ``reference``, the latest month if not given.
    ``commits_by_month``: month, commits. Every cohort has a row, also without any entry; months after the reference are left out."""
    rows = by_month(cohorts, family)
    n = rows.select("month").distinct()
    n = n.join(commits_by_month, "month", "left").na.fill(0, ["commits"]) if commits_by_month is not None else n.withColumn("commits", F.lit(0).cast("long"))
    last = rows.agg(F.max("month").alias("last"))  # one row
    age = month_number(F.lit(reference) if reference else F.col("last")) - month_number(F.col("month"))
    label = F.coalesce(*[F.when((age >= low) & (age < high), name) for name, low, high in AGES])
    aged = lambda df: df.crossJoin(last).withColumn("label", label).where("label is not null")
    keys = ["label", "family"] if family else ["label"]
    sums = aged(rows).groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("surviving").alias("surviving"))
    commits = aged(n).groupBy("label").agg(F.sum("commits").alias("commits"))
    grid = rows.sparkSession.createDataFrame([(name,) for name, _, _ in AGES], "label string")
    if family:
        grid = grid.select("label", F.explode(F.array(*[F.lit(x) for x in FAMILIES])).alias("family"))
    out = grid.join(sums, keys, "left").join(commits, "label", "left").na.fill(0)
    return out.withColumns({"fixed": F.col("total") - F.col("surviving"), "rate": ratio("surviving", "total"), "per_100_commits": ratio("surviving", "commits", 100)})


def per_repo_rates(entries: DataFrame) -> DataFrame:
    return summary(entries, "repo")


def file_lifecycle(files: DataFrame, *keys: str) -> DataFrame:
    """total_files, survived, modified, deleted, had_fixes, refactored of lifecycle files (status, was_fixed, was_refactored)."""
    s = F.col("status")
    known = F.coalesce(s.isin("SURVIVED", "MODIFIED", "DELETED"), F.lit(False))
    return files.groupBy(*keys).agg(
        count_if(known, "total_files"), count_if(s == "SURVIVED", "survived"), count_if(s == "MODIFIED", "modified"), count_if(s == "DELETED", "deleted"),
        count_if(F.coalesce("was_fixed", F.lit(False)), "had_fixes"), count_if(F.coalesce("was_refactored", F.lit(False)), "refactored"),
    )


def lifecycle_files(results: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """repo, sha12, tool, and the fields of each file; a commit without a tool has that of ``commits``."""
    rows = results.select("repo", F.substring(F.coalesce("c.commit_hash", F.lit("")), 1, 12).alias("sha12"), falsy(F.col("c.ai_tool")).alias("own"), F.explode("c.files").alias("f")).select("repo", "sha12", "own", "f.*")
    if commits is None:
        return rows.withColumn("tool", F.coalesce("own", F.lit("unknown"))).drop("own")
    tool = commits.where("NOT is_tainted").groupBy("repo", "sha12").agg(F.max("tool").alias("tool"))
    return rows.join(tool, ["repo", "sha12"], "left").withColumn("tool", F.coalesce("own", "tool", F.lit("unknown"))).drop("own")


def destiny_commits(results: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """repo, commit_sha, tool, and the measures of each commit's lines and units."""
    rows = results.select("repo", "c.*").drop("file_details").withColumnRenamed("commit", "commit_sha")
    return rows.withColumn("tool", F.lit("unknown")) if commits is None else with_tool(rows, commits)


def line_rates(destiny: DataFrame) -> DataFrame:
    return destiny.where("total_lines_added > 0").select("tool", F.coalesce("survival_rate", F.lit(0.0)).alias("rate"))


def unit_rates(destiny: DataFrame) -> DataFrame:
    return destiny.where("semantic_units_original > 0").select("tool", F.coalesce("semantic_survival_rate", F.lit(0.0)).alias("rate"))


def list_stats(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The keys, n, mean, least, most, median, p25, p75: elements n/2, n/4 and 3n/4 (rounded down) of the sorted values."""
    ends = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    mid = floor_quantiles(rows, list(keys), value, {"median": (1, 2), "p25": (1, 4), "p75": (3, 4)}).drop("n")
    return ends.join(mid, list(keys)) if keys else ends.crossJoin(mid)  # one row each


def text_summary(total: int, surviving: int, by_severity: list[tuple], by_rule: list[tuple]) -> str:
    """A plain text of a survival summary; both lists hold (name, surviving, total), and five rules are told, most surviving first."""
    part = lambda a, b: f"{100 * a / b if b else 0.0:.1f}%"
    lines = [f"introduced {total}", f"still there {surviving} ({part(surviving, total)})", f"fixed {total - surviving} ({part(total - surviving, total)})", "", "by severity"]
    lines += [f"  {name}: {s}/{n} ({part(s, n)})" for name, s, n in by_severity]
    lines += ["", "rules that survive most"] + [f"  {name}: {s}/{n} ({part(s, n)})" for name, s, n in sorted(by_rule, key=lambda r: (-r[1], r[0]))[:5]]
    return "\n".join(lines)
