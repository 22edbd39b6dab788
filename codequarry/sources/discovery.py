"""From push events and repository logs to the list of repositories and the commits that tools made."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import detection
from codequarry.functions.paths import falsy

RECORD = "---COMMIT_END---"
#: Files of a commit that are kept, and the most characters of a patch and of a message.
MOST_FILES, MOST_PATCH, MOST_MESSAGE = 50, 10_000, 500


def months_between(first: str, last: str) -> list[tuple[str, str]]:
    """(first day, last day) of each month that the range meets, cut off at its ends."""
    start, end = date.fromisoformat(first), date.fromisoformat(last)
    out, month = [], start.replace(day=1)
    while month <= end:
        following = (month + timedelta(days=31)).replace(day=1)
        out.append((max(month, start).isoformat(), min(following - timedelta(days=1), end).isoformat()))
        month = following
    return out


def month_table(spark: SparkSession, first: str, last: str) -> DataFrame:
    """month, month_start, month_end: months_between() as rows."""
    months = spark.sql(f"SELECT explode(sequence(trunc(DATE'{first}', 'MM'), trunc(DATE'{last}', 'MM'), INTERVAL 1 MONTH)) AS m")
    return months.select(F.date_format("m", "yyyy-MM").alias("month"), F.greatest("m", F.lit(first).cast("date")).alias("month_start"), F.least(F.last_day("m"), F.lit(last).cast("date")).alias("month_end"))


def scan_events(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Push events of days first..last. The table at ``path`` is partitioned by ``day`` (yyyyMMdd as text), so other days are never listed or read."""
    day = lambda d: d.replace("-", "")
    return spark.read.parquet(path).where(F.col("day").cast("string").between(day(first), day(last)) & (F.col("type") == "PushEvent"))


def discovered(events: DataFrame) -> DataFrame:
    """repo_name, ai_tool, detection_method, commit_count, sample_shas (five), first_commit, last_commit, the most commits first.

    ``events`` has repo_name, actor_login, created_at and payload (JSON). A push by a tool's account counts for its head commit,
    any push for each commit in it by the author, else the co-author; the same commit may be found either way, and counts once.
    """
    push = events.select("repo_name", "actor_login", "created_at", "payload")
    by_actor = push.where(F.expr(detection.actor_filter_sql())).select(
        "repo_name", F.get_json_object("payload", "$.head").alias("sha"), "created_at", F.expr(detection.actor_case_sql()).alias("ai_tool"), F.lit("actor").alias("detection_method")
    )
    commit = "array<struct<sha:string,message:string,author:struct<name:string,email:string>>>"
    listed = push.select("repo_name", "created_at", F.explode(F.from_json(F.get_json_object("payload", "$.commits"), commit)).alias("c"))
    listed = listed.select("repo_name", "created_at", "c.sha", F.col("c.author.name").alias("author_name"), F.col("c.author.email").alias("author_email"), F.col("c.message").alias("commit_message"))
    named = listed.where("author_email is not null").select("repo_name", "sha", "created_at", F.expr(detection.author_case_sql()).alias("a"), F.expr(detection.coauthor_case_sql()).alias("c"))
    method = F.when(F.col("a").isNotNull(), "author").when(F.col("c").isNotNull(), "coauthor")
    by_author = named.select("repo_name", "sha", "created_at", F.coalesce("a", "c").alias("ai_tool"), method.alias("detection_method"))
    return discovery_summary(by_actor.unionByName(by_author).where("ai_tool is not null"))


def discovery_summary(found: DataFrame) -> DataFrame:
    """As discovered(), of rows with repo_name, sha, created_at, ai_tool, detection_method."""
    keys = ["repo_name", "ai_tool"]
    # One row for each commit first, so that it counts without a list of a repository's commits; the five least are its samples.
    one = found.groupBy(*keys, "sha").agg(F.max("detection_method").alias("m"), F.min("created_at").alias("f"), F.max("created_at").alias("l"))
    sums = one.groupBy(*keys).agg(F.max("m").alias("detection_method"), F.count("sha").alias("commit_count"), F.min("f").alias("first_commit"), F.max("l").alias("last_commit"))
    from codequarry.operators.ordered import top_k

    some = top_k(one.where("sha is not null"), keys, [F.col("sha")], 5).groupBy(*keys).agg(F.array_sort(F.collect_list("sha")).alias("sample_shas"))
    out = sums.join(some, keys, "left").withColumn("sample_shas", F.coalesce("sample_shas", F.array().cast("array<string>")))
    return out.select("repo_name", "ai_tool", "detection_method", "commit_count", "sample_shas", "first_commit", "last_commit").orderBy(F.desc("commit_count"), "repo_name", "ai_tool")


def merged(*months: DataFrame) -> DataFrame:
    """Discoveries of several months as one: repo_name, ai_tool, commit_count (their sum), shas (each once, ordered), detection_method (of the latest).
    An earlier result with these columns may be one of them."""
    rows = None
    for i, m in enumerate(months):
        shas = F.col("sample_shas") if "sample_shas" in m.columns else F.col("shas")
        part = m.select("repo_name", "ai_tool", "commit_count", "detection_method", shas.alias("s"), F.lit(i).alias("i"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("repo_name", "ai_tool").agg(
        F.sum("commit_count").alias("commit_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("shas"), F.max_by("detection_method", "i").alias("detection_method")
    )  # at most five shas a month


def from_repos(repos: DataFrame) -> DataFrame:
    """An earlier discovery (read_repos()) in the shape that merged() takes."""
    rows = repos.select(F.col("full_name").alias("repo_name"), F.explode("commit_counts").alias("ai_tool", "commit_count"), "commit_shas", "detection_methods")
    none = F.array().cast("array<string>")
    return rows.select("repo_name", "ai_tool", "commit_count", F.coalesce(F.try_element_at("commit_shas", "ai_tool"), none).alias("shas"), F.try_element_at("detection_methods", F.col("ai_tool")).alias("detection_method"))


def tool_summary(found: DataFrame) -> DataFrame:
    """ai_tool, name, commits, repos, the most commits first."""
    out = found.groupBy("ai_tool").agg(F.sum("commit_count").alias("commits"), F.count_distinct("repo_name").alias("repos"))
    return out.withColumn("name", detection.tool_name(F.col("ai_tool"))).orderBy(F.desc("commits"), "ai_tool")


def with_metadata(found: DataFrame, metadata: DataFrame) -> DataFrame:
    """Repositories with the stars and language that ``metadata`` (full_name, stars, language) knows, whatever the case of names."""
    known = metadata.where(F.coalesce("full_name", F.lit("")) != "").groupBy(F.lower("full_name").alias("_key")).agg(F.max_by("stars", "full_name").alias("stars"), F.max_by("language", "full_name").alias("language"))
    out = found.drop("stars", "language").withColumn("_key", F.lower("repo")).join(known, "_key", "left").drop("_key")
    return out.withColumns({"stars": F.coalesce("stars", F.lit(0).cast("long")), "language": F.coalesce("language", F.lit(""))})


def filter_repos(repos: DataFrame, min_stars: int = 50, languages: list[str] | None = None, max_commits: int = 0, min_ai_commits: int = 1) -> DataFrame:
    """Repositories (repo, stars, language, ai_commits, total_commits) within the limits, few commits first, then many stars."""
    out = repos.where((F.col("stars") >= min_stars) & (F.col("ai_commits") >= min_ai_commits))
    if languages:
        out = out.where(F.lower("language").isin([x.lower() for x in languages]))
    if max_commits:
        out = out.where(F.col("total_commits") <= max_commits)
    share = F.when(F.col("total_commits") > 0, 100.0 * F.col("ai_commits") / F.col("total_commits")).otherwise(0.0)
    return out.withColumn("ai_percentage", share).orderBy("ai_commits", F.desc("stars"), "repo")


def without_forks(repos: DataFrame, min_fork_stars: int, min_stars: int = 0) -> DataFrame:
    """Originals, and forks with stars of their own; then those with ``min_stars``."""
    stars = F.coalesce("stars", F.lit(0))
    return repos.where(~F.coalesce("is_fork", F.lit(False)) | (stars >= min_fork_stars)).where(stars >= min_stars)


def fork_counts(repos: DataFrame, min_fork_stars: int, min_stars: int = 0) -> DataFrame:
    """One row: total, forks_removed, low_star_removed, kept."""
    stars = F.coalesce("stars", F.lit(0))
    fork = F.coalesce("is_fork", F.lit(False)) & (stars < min_fork_stars)
    return repos.agg(F.count("*").alias("total"), F.count_if(fork).alias("forks_removed"), F.count_if(~fork & (stars < min_stars)).alias("low_star_removed"), F.count_if(~fork & (stars >= min_stars)).alias("kept"))


def batch(repos: DataFrame, min_stars: int = 0, tool: str | None = None, limit: int | None = None) -> DataFrame:
    """Repositories (full_name, stars, commit_counts) to scan, the most commits of all tools first."""
    out = repos.where(F.coalesce("stars", F.lit(0)) >= min_stars) if min_stars > 0 else repos
    if tool:
        out = out.where(F.coalesce(F.map_contains_key("commit_counts", tool), F.lit(False)))
    total = F.aggregate(F.coalesce(F.map_values("commit_counts"), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, b: a + b)
    out = out.withColumn("total_commits", total).orderBy(F.desc("total_commits"), "full_name")
    return out.limit(limit) if limit else out


def first_of_each(repos: DataFrame, name: str, ord: str) -> DataFrame:
    """Of names that differ in case alone, the row that comes first."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(F.lower(name)).orderBy(ord)
    return repos.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def not_yet(wanted: DataFrame, done: DataFrame, name: str) -> DataFrame:
    """Rows whose name, whatever its case, is not among those done."""
    seen = done.select(F.lower(name).alias("_key")).distinct()
    return wanted.withColumn("_key", F.lower(name)).join(seen, "_key", "left_anti").drop("_key")


def log_commits(logs: DataFrame, text: str = "output") -> DataFrame:
    """repo, ord, sha, author_name, author_email, committer_name, committer_email, date, message, url of captured logs: records end with RECORD,
    and their first line is sha|author|address|committer|address|date|subject. Records with fewer fields are left out."""
    records = logs.select("repo", F.posexplode(F.split(text, RECORD)).alias("ord", "r"))
    bare = F.regexp_replace("r", r"^\s+|\s+$", "")
    head = F.split(F.split(bare, "\n", 2)[0], r"\|", 7)
    rows = records.where(bare != "").select("repo", "ord", head.alias("f"), F.coalesce(F.get(F.split(bare, "\n", 2), 1), F.lit("")).alias("body")).where(F.size("f") == 7)
    names = ("sha", "author_name", "author_email", "committer_name", "committer_email", "date", "subject")
    rows = rows.select("repo", "ord", "body", *[F.get("f", i).alias(n) for i, n in enumerate(names)])
    return rows.withColumns({"message": F.concat_ws("\n", "subject", "body"), "url": F.concat(F.lit("https://github.com/"), "repo", F.lit("/commit/"), "sha")}).drop("subject", "body")


def scan_log(commits: DataFrame) -> DataFrame:
    """The commits (as of log_commits()) that a tool made, with what told so; messages are cut at MOST_MESSAGE characters."""
    c = F.col
    found = detection.detect_with_committer(c("author_name"), c("author_email"), c("message"), c("committer_name"), c("committer_email"))
    return _found(commits, found)


def scan_pages(commits: DataFrame) -> DataFrame:
    """As scan_log(), of commits with the login of their author, as a server's pages list them."""
    c = F.col
    return _found(commits, detection.detect(c("author_name"), c("author_email"), c("message"), c("login")))


def _found(commits: DataFrame, found: Column) -> DataFrame:
    rows = commits.withColumn("_d", found).where("_d is not null")
    rows = rows.withColumn("message", F.substring("message", 1, MOST_MESSAGE))
    return rows.select("*", F.col("_d.tool_key").alias("ai_tool"), "_d.detection_method", "_d.author_role", "_d.ai_identifier", "_d.ai_identifier_type").drop("_d")


def scan_summary(commits: DataFrame, found: DataFrame) -> DataFrame:
    """repo, total_commits_scanned, ai_commits_count, tools_found (a map)."""
    per = found.groupBy("repo", "ai_tool").agg(F.count("*").alias("n")).groupBy("repo").agg(F.sum("n").alias("ai_commits_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ai_tool", "n")))).alias("tools_found"))
    out = commits.groupBy("repo").agg(F.count("*").alias("total_commits_scanned")).join(per, "repo", "left")
    return out.na.fill(0, ["ai_commits_count"])


def commit_rows(found: DataFrame) -> DataFrame:
    """The columns of a scan's CSV: short sha, tool's name, day, and one line of the message."""
    return found.select(
        F.substring("sha", 1, 12).alias("sha"), detection.tool_name(F.col("ai_tool")).alias("ai_tool"), "detection_method", F.col("author_name").alias("author"), F.substring(F.coalesce("date", F.lit("")), 1, 10).alias("date"), "url",
        F.replace(F.substring(F.coalesce("message", F.lit("")), 1, 100), F.lit("\n"), F.lit(" ")).alias("message"),
    )


def page_commits(pages: DataFrame, text: str = "body") -> DataFrame:
    """repo, page, sha, author_name, author_email, login, date, message, url of captured pages of a server's list of commits. A page that is no list gives none."""
    shape = "array<struct<sha:string,html_url:string,author:struct<login:string>,commit:struct<message:string,author:struct<name:string,email:string,date:string>>>>"
    c = F.col("c")
    rows = pages.select("repo", "page", F.explode(F.from_json(text, shape)).alias("c"))
    a = c["commit"]["author"]
    return rows.select("repo", "page", c["sha"].alias("sha"), a["name"].alias("author_name"), a["email"].alias("author_email"), c["author"]["login"].alias("login"), a["date"].alias("date"), c["commit"]["message"].alias("message"), c["html_url"].alias("url"))


def commit_details(bodies: DataFrame, text: str = "body") -> DataFrame:
    """repo, sha, files (the first MOST_FILES), additions, deletions of captured answers for single commits; a patch longer than MOST_PATCH is cut there."""
    file = "filename:string,status:string,additions:int,deletions:int,patch:string"
    d = bodies.select("repo", F.from_json(text, f"sha string, stats struct<additions:int,deletions:int>, files array<struct<{file}>>").alias("d")).where("d.sha is not null")
    cut = F.transform(F.slice("d.files", 1, MOST_FILES), lambda f: F.struct(f["filename"], f["status"], f["additions"], f["deletions"], F.substring(f["patch"], 1, MOST_PATCH).alias("patch")))
    return d.select("repo", "d.sha", cut.alias("files"), F.coalesce("d.stats.additions", F.lit(0)).alias("additions"), F.coalesce("d.stats.deletions", F.lit(0)).alias("deletions"))


def graph_metadata(answers: DataFrame, text: str = "body") -> DataFrame:
    """full_name, stars, language, is_fork, parent, fork_count, description, created_at, pushed_at of captured answers to batched look-ups (up to 100 aliases each).
    Aliases without an answer (a repository that is gone) are left out."""
    repo = "nameWithOwner:string,stargazerCount:long,primaryLanguage:struct<name:string>,isFork:boolean,parent:struct<nameWithOwner:string>,forkCount:long,description:string,createdAt:string,pushedAt:string"
    r = F.col("r")
    rows = answers.select(F.explode(F.map_values(F.from_json(F.get_json_object(text, "$.data"), f"map<string,struct<{repo}>>"))).alias("r")).where(falsy(r["nameWithOwner"]).isNotNull())
    return rows.select(
        r["nameWithOwner"].alias("full_name"), F.coalesce(r["stargazerCount"], F.lit(0).cast("long")).alias("stars"), r["primaryLanguage"]["name"].alias("language"), F.coalesce(r["isFork"], F.lit(False)).alias("is_fork"),
        r["parent"]["nameWithOwner"].alias("parent"), F.coalesce(r["forkCount"], F.lit(0).cast("long")).alias("fork_count"), r["description"].alias("description"), r["createdAt"].alias("created_at"), r["pushedAt"].alias("pushed_at"),
    )


def search_results(answers: DataFrame, text: str = "body") -> DataFrame:
    """query, full_name, stars, language, ord of captured answers to searches; a search gives a thousand rows at most, so they are split by language."""
    d = answers.select("query", F.posexplode(F.from_json(text, "items array<struct<full_name:string,stargazers_count:long,language:string>>")["items"]).alias("ord", "i"))
    return d.select("query", "ord", "i.full_name", F.col("i.stargazers_count").alias("stars"), "i.language")


def bytes_and_cost(scanned: int, per_terabyte: float = 5.0) -> tuple[float, float]:
    """Gigabytes, and what a warehouse that bills by bytes would ask for them."""
    return scanned / 1024**3, scanned / 1024**4 * per_terabyte


def partition_filters(df: DataFrame) -> list[str]:
    """Of each scan of files in the plan, the filters that choose partitions; '[]' for a scan of all."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    scans = [leaves.apply(k) for k in range(leaves.size()) if leaves.apply(k).nodeName().startswith("Scan ")]
    return [x.metadata().get("PartitionFilters").getOrElse(None) or "[]" for x in scans]


def scan_cost(df: DataFrame, per_terabyte: float = 5.0) -> dict:
    """Run ``df``, keep nothing of it, and tell what its scans read: bytes_processed (by the executors' own count, so
    only of columns and partitions that were read), gb_processed, cost_estimate_usd, partition_filters."""
    spark = df.sparkSession
    context, group = spark.sparkContext, f"scan-{uuid.uuid4().hex}"
    context.setJobGroup(group, "what a scan reads")
    # Reads on threads of their own are not in a task's count.
    vectored, before = "parquet.hadoop.vectored.io.enabled", spark.conf.get("parquet.hadoop.vectored.io.enabled", None)
    spark.conf.set(vectored, "false")
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset(vectored) if before is None else spark.conf.set(vectored, before)
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    store = context._jsc.sc()
    store.listenerBus().waitUntilEmpty()
    tracker, status, seen, read = context.statusTracker(), store.statusStore(), set(), 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            if stage not in seen:  # a stage that several jobs share is read once
                seen.add(stage)
                try:
                    read += status.lastStageAttempt(stage).inputBytes()
                except Py4JJavaError:  # skipped, so it read nothing
                    continue
    gb, cost = bytes_and_cost(read, per_terabyte)
    return {"bytes_processed": read, "gb_processed": round(gb, 2), "cost_estimate_usd": round(cost, 2), "partition_filters": partition_filters(df)}
