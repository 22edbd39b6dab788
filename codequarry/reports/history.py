"""What became of a commit's files, lines and findings, from tables taken out of repositories.

Tables: log (repo, path, sha, ts, subject, ..), blobs (repo, path, content: the head's files),
renames (repo, old, new, ord), blame (repo, checkpoint_sha, path, sha, n_lines), ranges (repo, sha, path, start, stop).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import code, paths
from codequarry.operators.graph import ancestors
from codequarry.operators.ordered import forward_asof
from codequarry.reports.debt import count_if, ratio

DAY = 86_400
#: Tasks for each core, at least, where memory goes with the rows of a task.
TASKS_A_CORE = 16
# Words of a later commit's subject that tell of a fix, of work on the form, of a revert.
FIX_WORDS = [r"\bfix(?:es|ed|ing)?\b", r"\bbug(?:fix)?\b", r"\bpatch(?:ed|ing)?\b", r"\bhotfix\b", r"\bissue\b", r"\bcleanup\b"]
REFACTOR_WORDS = [r"\brefactor(?:ed|ing)?\b", r"\bclean(?:up)?\b", r"\brewrite\b", r"\brework\b", r"\bimprove(?:ment|d|s)?\b"]
REVERT_WORDS = [r"\brevert(?:ed|ing)?\b"]
# Measures of a file's quality that reports keep.
QUALITY_KEYS = [
    "lines", "linter_errors", "linter_warnings", "issues_total", "security_high", "security_medium", "security_low", "security_total", "cognitive_complexity", "cyclomatic_complexity",
    "maintainability_index", "pylint_score", "console_logs", "ts_any", "ts_ignore", "todos", "fixmes", "duplicates", "skipped", "reason",
]


def _says(subject: Column, words: list[str]) -> Column:
    return F.coalesce(subject, F.lit("")).rlike("(?i)" + "|".join(words))


def is_fix(subject: Column) -> Column:
    return _says(subject, FIX_WORDS)


def is_refactor(subject: Column) -> Column:
    return _says(subject, REFACTOR_WORDS)


def is_revert(subject: Column) -> Column:
    return _says(subject, REVERT_WORDS)


def classify_changes(log: DataFrame, keys: list[str], corrected: bool = False) -> DataFrame:
    """keys, num_changes, was_/num_ of fixes, refactorings and reverts, and the times of the "first" change, fix and refactoring.

    A log begins with the newest entry, and what counts as the first is its first entry: the newest one.
    ``corrected`` takes the oldest.
    """
    s, pick = F.col("subject"), F.min if corrected else F.max
    out = log.groupBy(*keys).agg(
        F.count("*").alias("num_changes"), count_if(is_fix(s), "num_fix_commits"), count_if(is_refactor(s), "num_refactor_commits"), count_if(is_revert(s), "num_revert_commits"),
        pick("ts").alias("first_change"), pick(F.when(is_fix(s), F.col("ts"))).alias("first_fix"), pick(F.when(is_refactor(s), F.col("ts"))).alias("first_refactor"),
    )
    return out.withColumns({f"was_{x}": F.col(f"num_{n}_commits") > 0 for x, n in (("fixed", "fix"), ("refactored", "refactor"), ("reverted", "revert"))})


def lifecycle(files: DataFrame, log: DataFrame, head: DataFrame, corrected: bool = False) -> DataFrame:
    """A row for each file of a commit that is followed: status (SURVIVED, MODIFIED, DELETED), days to its first change, fix and refactoring, and counts.

    ``files``: repo, sha, path, ts (of the commit). ``log``: repo, sha, path, ts, subject of later commits. ``head``: repo, path of files that are there.
    """
    keys = ["repo", "sha", "path"]
    kept = files.where(paths.in_lifecycle(F.col("path")))
    there = head.select("repo", "path", F.lit(True).alias("at_head")).distinct()
    rows = kept.join(classify_changes(log, keys, corrected), keys, "left").join(there, ["repo", "path"], "left")
    changed = F.coalesce("num_changes", F.lit(0)) > 0
    status = F.when(changed, "MODIFIED").when(F.col("at_head").isNull(), "DELETED").otherwise("SURVIVED")
    known = F.coalesce("ts", F.lit(0)) != 0
    days = lambda c: F.when(known & F.col(c).isNotNull() & (F.col(c) != 0), (F.col(c) - F.col("ts")) / float(DAY))
    numbers = ("num_changes", "num_fix_commits", "num_refactor_commits", "num_revert_commits")
    flags = ("was_fixed", "was_refactored", "was_reverted")
    return rows.select(
        *keys, status.alias("status"), F.when(F.col("first_change") > F.col("ts"), days("first_change")).alias("days_to_first_change"), *[F.coalesce(f, F.lit(False)).alias(f) for f in flags],
        (status == "DELETED").alias("was_deleted"), *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], days("first_fix").alias("time_to_first_fix_days"), days("first_refactor").alias("time_to_first_refactor_days"),
    )


def head_paths(wanted: DataFrame, head: DataFrame, renames: DataFrame) -> DataFrame:
    """repo, path, head_path of each path wanted: itself if it is there, else where its latest rename to a file that is there went, else null.

    ``renames``: repo, old, new, ord (higher: later), followed (whether it is of the file's own history); those come first.
    """
    there = head.select("repo", F.col("path").alias("at")).distinct()
    live = renames.join(there.withColumnRenamed("at", "new"), ["repo", "new"], "left_semi")
    best = live.groupBy("repo", F.col("old").alias("path")).agg(F.max_by("new", F.struct("followed", "ord", "new")).alias("moved"))
    rows = wanted.select("repo", "path").distinct()
    rows = rows.join(there.select("repo", F.col("at").alias("path"), F.lit(True).alias("here")), ["repo", "path"], "left").join(best, ["repo", "path"], "left")
    return rows.select("repo", "path", F.when(F.col("here"), F.col("path")).otherwise(F.col("moved")).alias("head_path"))


def line_status(lines: DataFrame, blobs: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` (keys, path, line text as ``line``) with status: EXISTS where the file at the head has such a line, bare at its ends,
    anywhere; MODIFIED where the file is there without it; DELETED where there is no file, or an empty one. A blank line always exists."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")
    files = blobs.where(F.coalesce("content", F.lit("")) != "").select(*keys, F.lit(True).alias("_file")).distinct()
    have = blobs.select(*keys, F.explode(code.lines_of(F.col("content"))).alias("_l")).select(*keys, bare(F.col("_l")).alias("_bare"), F.lit(True).alias("_line")).distinct()
    rows = lines.withColumn("_bare", bare(F.col("line"))).join(files, keys, "left").join(have, [*keys, "_bare"], "left")
    status = F.when((F.col("_bare") == "") | F.col("_line"), "EXISTS").when(F.col("_file"), "MODIFIED").otherwise("DELETED")
    return rows.withColumn("status", status).drop("_bare", "_file", "_line")


def added_lines(ranges: DataFrame, blobs: DataFrame) -> DataFrame:
    """repo, sha, path, number, line: the text of each line that a commit added. ``ranges``: repo, sha, path, start, stop; ``blobs``: repo, sha,
    path, content of the files as the commit left them. Lines past the end of a file are left out; other files than code are, too."""
    rows = ranges.where(paths.in_destiny(F.col("path"))).join(blobs.where(F.coalesce("content", F.lit("")) != ""), ["repo", "sha", "path"])
    rows = rows.withColumn("_lines", code.lines_of(F.col("content"))).withColumn("number", F.explode(F.sequence("start", "stop"))).where(F.col("number") <= F.size("_lines"))
    return rows.select("repo", "sha", "path", "number", F.when(F.col("number") > 0, F.get("_lines", F.col("number") - 1)).otherwise("").alias("line"))


def line_modifications(ranges: DataFrame, history: DataFrame, most: int = 500) -> DataFrame:
    """repo, sha, path, start, stop, n: different later commits whose own ranges of a file (``history``: repo, path, sha as later_sha, start, stop)
    meet each range. Ranges of more than ``most`` lines count none."""
    from codequarry.operators.ordered import overlap_pairs

    small = ranges.where(F.col("stop") - F.col("start") <= most)
    pairs = overlap_pairs(
        small.select("repo", "path", "sha", F.col("start").alias("s"), F.col("stop").alias("e")), history.select("repo", "path", "later_sha", F.col("start").alias("rs"), F.col("stop").alias("re")), ["repo", "path"]
    )
    n = pairs.groupBy("repo", "path", "sha", F.col("s").alias("start"), F.col("e").alias("stop")).agg(F.count_distinct("later_sha").alias("n"))
    keys = ["repo", "sha", "path", "start", "stop"]
    return ranges.select(*keys).join(n, keys, "left").na.fill(0, ["n"])


def destiny(statuses: DataFrame, modifications: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """repo, sha, lines and units of each commit that are still there, with rates and developer_valuation.

    ``statuses``: repo, sha, path, status of each added line. ``units``: repo, sha, and the counts of semantic_survival() of each file.
    """
    keys = ["repo", "sha"]
    # Lines of a path meet before they are counted, in many small tasks: a task tells the paths of all its lines apart at once.
    spark = statuses.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    out = statuses.repartition(parts, "sha", "path").groupBy(*keys).agg(
        F.count_distinct("path").alias("files_analyzed"), F.count("*").alias("total_lines_added"), *[count_if(F.col("status") == s, c) for s, c in (("EXISTS", "lines_still_exist"), ("MODIFIED", "lines_modified"), ("DELETED", "lines_deleted"))]
    )
    if modifications is not None:
        out = out.join(modifications.groupBy(*keys).agg(F.sum("n").alias("total_modifications")), keys, "left").na.fill(0, ["total_modifications"])
    counts = ("original_units", "surviving_units", "modified_units", "deleted_units")
    if units is not None:
        out = out.join(units.where("supported").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts]), keys, "left").na.fill(0, counts)
    else:
        out = out.withColumns({c: F.lit(0).cast("long") for c in counts})
    out = out.withColumns({
        "survival_rate": ratio("lines_still_exist", "total_lines_added"), "modification_rate": ratio("lines_modified", "total_lines_added"), "deletion_rate": ratio("lines_deleted", "total_lines_added"),
        "semantic_survival_rate": ratio(F.col("surviving_units") + F.col("modified_units"), F.col("original_units")), "exact_semantic_survival_rate": ratio("surviving_units", "original_units"),
    })
    has_units = F.col("original_units") > 0
    out = out.withColumn("semantic_vs_syntactic_delta", F.when(has_units, F.col("semantic_survival_rate") - F.col("survival_rate")).otherwise(0.0))
    return out.withColumn("developer_valuation", valuation(F.when(has_units, F.col("semantic_survival_rate")).otherwise(F.col("survival_rate"))))


def valuation(rate: Column) -> Column:
    return F.when(rate >= 0.8, "HIGH").when(rate >= 0.5, "MEDIUM").otherwise("LOW")


def checkpoints(commits: DataFrame, log: DataFrame, days: tuple[int, ...] = (7, 30, 60, 90)) -> DataFrame:
    """repo, sha, days, checkpoint_sha: the first commit, in the order of the log (repo, sha, ts, ord; ord 0 is the oldest),
    so many days after each commit (repo, sha, ts) or later; null where there is none."""
    due = commits.select("repo", "sha", "ts", F.explode(F.array(*[F.lit(d) for d in days])).alias("days"))
    due = due.withColumn("due", F.col("ts") + F.col("days") * DAY)
    out = forward_asof(due, log.select("repo", F.col("sha").alias("checkpoint_sha"), "ts"), ["repo"], "due", "ts", "checkpoint_sha")
    return out.select("repo", "sha", "days", F.col("next_checkpoint_sha").alias("checkpoint_sha"))


def blame_survival(points: DataFrame, blame: DataFrame, files: DataFrame) -> DataFrame:
    """repo, sha, days, checkpoint_sha, total_lines, own_lines, survival (null without a checkpoint): of the lines of a commit's files
    (``files``: repo, sha, path) at each checkpoint, those that are still the commit's own."""
    at = points.where("checkpoint_sha is not null").join(files.select("repo", "sha", "path"), ["repo", "sha"])
    rows = at.join(blame.select("repo", "checkpoint_sha", "path", F.col("sha").alias("line_sha"), "n_lines"), ["repo", "checkpoint_sha", "path"])
    sums = rows.groupBy("repo", "sha", "days").agg(F.sum("n_lines").alias("total_lines"), F.sum(F.when(F.col("line_sha") == F.col("sha"), F.col("n_lines")).otherwise(0)).alias("own_lines"))
    out = points.join(sums, ["repo", "sha", "days"], "left").na.fill(0, ["total_lines", "own_lines"])
    return out.withColumn("survival", F.when(F.col("checkpoint_sha").isNotNull(), ratio("own_lines", "total_lines")))


def survival_by_days(survival: DataFrame, days: tuple[int, ...] = (7, 30, 60, 90)) -> DataFrame:
    """repo, sha, and survival_<n>d, blamed_lines_total_<n>d, blamed_lines_from_target_<n>d for each number of days."""
    one = lambda d, c: F.max(F.when(F.col("days") == d, F.col(c)))
    names = (("survival", "survival"), ("total_lines", "blamed_lines_total"), ("own_lines", "blamed_lines_from_target"), ("checkpoint_sha", "checkpoint_sha"))
    return survival.groupBy("repo", "sha").agg(*[one(d, c).alias(f"{name}_{d}d") for d in days for c, name in names])


def time_to_first_edit(files: DataFrame, log: DataFrame) -> DataFrame:
    """repo, sha, path, days: from a commit to the oldest later commit (in the order of the log, ord 0 first) of a file; null where there is none,
    or where its time is no later."""
    keys = ["repo", "sha", "path"]
    first = log.groupBy(*keys).agg(F.min_by("ts", "ord").alias("edit"))
    out = files.join(first, keys, "left")
    return out.select(*keys, F.when(F.col("edit") > F.col("ts"), (F.col("edit") - F.col("ts")) / float(DAY)).alias("days"))


def patch_summary(changed: DataFrame, numstat: DataFrame) -> DataFrame:
    """repo, sha, and files and lines of a commit by category, with the share of noise. ``changed``: repo, sha, path; ``numstat``: repo, sha, path,
    ord, added, deleted, of which the last for a path counts."""
    keys = ["repo", "sha"]
    stat = numstat.groupBy(*keys, "path").agg(F.max_by(F.struct("added", "deleted"), "ord").alias("n"))
    noise = paths.is_noise_path(F.col("path"))
    named = F.coalesce("path", F.lit("")) != ""
    rows = changed.join(stat, [*keys, "path"], "left").withColumns({"_noise": noise & named, "_kind": F.when(named & ~noise, paths.path_category(F.col("path"))).when(named, "other")})
    is_code = F.col("_kind") == "code"
    total = lambda c, test: F.coalesce(F.sum(F.when(test, F.col(f"n.{c}"))), F.lit(0))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("files_changed_total"), count_if(is_code, "files_changed_code"), count_if(F.col("_kind") == "docs", "files_changed_docs"), count_if(F.col("_kind") == "test", "files_changed_tests"),
        total("added", is_code).alias("additions_code"), total("deleted", is_code).alias("deletions_code"), total("added", named).alias("additions_total"), total("deleted", named).alias("deletions_total"), count_if(F.col("_noise"), "noise_files"),
    )
    return out.withColumns({"touches_noise_only": F.col("noise_files") == F.col("files_changed_total"), "noise_file_ratio": ratio("noise_files", "files_changed_total")})


def complexity_delta(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sums and means of cyclomatic complexity before and after. ``files``: keys, cc_before, functions_before, cc_after, functions_after (null: no such file)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = files.groupBy(*keys).agg(total("cc_before").alias("total_cc_parent"), total("functions_before").alias("_fb"), total("cc_after").alias("total_cc_sha"), total("functions_after").alias("_fa"))
    out = out.withColumns({"delta_total_cc": F.col("total_cc_sha") - F.col("total_cc_parent"), "avg_cc_parent": ratio("total_cc_parent", "_fb"), "avg_cc_sha": ratio("total_cc_sha", "_fa")})
    return out.drop("_fb", "_fa")


DELTAS = ("linter_errors", "linter_warnings", "security_high", "security_medium", "security_low", "security_total", "cognitive_complexity")


def quality_delta(files: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """``files`` with delta: how a file's measures (structs ``before``, null for a new file, and ``after``) changed. Introduced and fixed are the least that the net change tells."""
    n = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0))
    new = F.col(before).isNull()
    net = n(after, "issues_total") - F.when(new, 0).otherwise(n(before, "issues_total"))
    deltas = [(n(after, c) - F.when(new, 0).otherwise(n(before, c))).alias(f"{c}_delta") for c in DELTAS]
    return files.withColumn("delta", F.struct(
        new.alias("is_new_file"), net.alias("net_change"), F.when(new, net).otherwise(F.greatest(net, F.lit(0))).alias("issues_introduced"), F.when(new, 0).otherwise(F.greatest(-net, F.lit(0))).alias("issues_fixed"), *deltas,
        F.when(~new, n(after, "duplicates") - n(before, "duplicates")).alias("duplicates_delta"), F.when(~new, net < 0).alias("quality_improved"), F.when(~new, net > 0).alias("quality_degraded"),
    ))


def quality_measures(quality: DataFrame, keys: list[str]) -> DataFrame:
    """Of a table of measures, the keys and those columns that reports keep."""
    return quality.select(*keys, *[c for c in QUALITY_KEYS if c in quality.columns])


def reachable(commits: DataFrame, parents: DataFrame, heads: DataFrame) -> DataFrame:
    """Commits (repo, sha) that the default branch has: those at or before its head. ``parents``: repo, sha, parent, ord (from 0); ``heads``: repo, sha."""
    return commits.join(ancestors(parents, heads), ["repo", "sha"], "left_semi")


def in_changed_files(rows: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(files.select(*keys).distinct(), keys, "left_semi")
