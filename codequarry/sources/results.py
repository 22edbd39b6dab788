"""Analysis results as tables: findings of commits, survival, lifecycle, destiny, detail files.

Each kind is a folder of JSON documents, read with an explicit schema: a document that
is not JSON, or of another shape, gives no row. Where a document does not say which repository
it is about, its folder's name does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.paths import falsy, repo_from_folder, repo_name, stem

ISSUE = (
    "struct<type:string,severity:string,line:string,symbol:string,rule:string,rule_id:string,message:string,category:string,detected_by:string,_is_low_severity:boolean,"
    "filter_context:struct<is_test:boolean,is_simulation:boolean,is_dev:boolean>,file_path:string,commit_sha:string>"
)
CONTEXT = "struct<is_test:boolean,is_simulation:boolean,is_dev:boolean>"
FILE = f"struct<file_path:string,language:string,status:string,issue_filter_context_before:{CONTEXT},issue_filter_context_after:{CONTEXT},issues_added:array<{ISSUE}>,issues_resolved:array<{ISSUE}>>"
DEBT = f"struct<commit_hash:string,ai_tool:string,repo:string,author_role:string,code_files_analyzed:int,analysis_counters:struct<files_total:int>,files:array<{FILE}>>"
SURVIVAL = f"struct<total_issues:long,issues:array<struct<survived:boolean,match_score:double,match_reason:string,resolved_path:string,original:{ISSUE}>>>"
LIFECYCLE = (
    "struct<commit_hash:string,ai_tool:string,repo:string,files:array<struct<filepath:string,status:string,days_to_first_change:double,was_fixed:boolean,was_refactored:boolean,"
    "was_reverted:boolean,was_deleted:boolean,num_changes:int,num_fix_commits:int,num_refactor_commits:int,num_revert_commits:int,time_to_first_fix_days:double,time_to_first_refactor_days:double>>>"
)
DESTINY = (
    "struct<commit:string,files_analyzed:int,total_lines_added:long,lines_still_exist:long,lines_modified:long,lines_deleted:long,total_modifications:long,survival_rate:double,"
    "semantic_units_original:long,semantic_units_surviving:long,semantic_units_modified:long,semantic_units_deleted:long,semantic_survival_rate:double,developer_valuation:string,"
    "file_details:array<struct<file:string,lines_added:long,lines_exist:long,lines_modified:long,lines_deleted:long,modification_count:long,semantic:struct<semantic_survival_rate:double>>>>"
)
DETAIL = (
    f"struct<commit_hash:string,repo:string,ai_tool:string,url:string,author:string,message:string,timestamp:string,debt_debug:map<string,struct<issues_added:array<{ISSUE}>,issues_resolved:array<{ISSUE}>>>,"
    "lifecycle_debug:map<string,struct<subsequent_commits:array<struct<sha:string,author:string,email:string,timestamp:long,message:string,is_fix:boolean,is_refactor:boolean,is_revert:boolean>>>>,"
    "analysis_summary:struct<debt:struct<issues_introduced:int,issues_fixed:int>,destiny:struct<survival_rate:double,semantic_survival_rate:double,developer_valuation:string,lines_added:long,lines_still_exist:long>>>"
)
MANIFEST = "struct<repo:string,total_commits_scanned:long,ai_commits_count:long,tools_found:map<string,long>,stars:long,language:string,ai_commits:array<struct<sha:string,ai_tool:string,author_role:string,date:string,author_name:string,author_email:string,message:string,url:string>>>"
REPOS = (
    "struct<last_updated:string,repos:array<struct<full_name:string,url:string,stars:long,language:string,description:string,is_fork:boolean,parent:string,fork_count:long,created_at:string,pushed_at:string,"
    "topics:array<string>,commit_counts:map<string,long>,commit_shas:map<string,array<string>>,detection_methods:map<string,string>>>>"
)
DDL = {"debt_metrics": f"array<{DEBT}>", "issue_survival": SURVIVAL, "lifecycle_metrics": f"array<{LIFECYCLE}>", "destiny_metrics": f"array<{DESTINY}>"}


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """file, doc: a row for each JSON document under ``path`` that has the shape of ``kind``; others are left out."""
    raw = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(path, wholetext=True)
    text = F.regexp_replace("value", r"^[\s\x{feff}]+", "")
    shaped = text.startswith("[" if kind.startswith("array") else "{")
    shaped = shaped & F.try_parse_json(text).isNotNull()  # half a document would give a row of nulls
    return raw.where(shaped).select(F.col("_metadata.file_path").alias("file"), F.from_json(text, kind).alias("doc")).where("doc is not null")


def folder_of(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -2)


def read_results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """repo, c (or doc, for survival): the documents called ``name``.json in each folder below ``folder``, an item a row.
    Folders without that document are no repositories."""
    docs = read_documents(spark, f"{folder}/*/{name}.json", DDL[name])
    of = repo_from_folder(folder_of(F.col("file"))).alias("repo")
    if not DDL[name].startswith("array"):
        return docs.select(of, "doc")
    return docs.select(of, F.posexplode("doc").alias("ord", "c"))


def read_details(spark: SparkSession, folder: str) -> DataFrame:
    """The detail files of commits (folder/<repo>/debug/<name>.json): repo, detail (file's name), and their fields."""
    docs = read_documents(spark, f"{folder}/*/debug/*.json", DETAIL)
    of = F.element_at(F.split("file", "/"), -3)
    return docs.select(repo_from_folder(of).alias("repo_folder"), stem(F.element_at(F.split("file", "/"), -1)).alias("detail"), "doc.*")


def read_manifests(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """repo, source (file name), ord, and the fields of each commit that the manifests list; at most ``most`` of a file."""
    docs = read_documents(spark, f"{folder}/*_commits.json", MANIFEST)
    listed = F.slice("doc.ai_commits", 1, most) if most else F.col("doc.ai_commits")
    of = docs.select(repo_name(F.col("doc.repo"), F.col("file")).alias("repo"), F.element_at(F.split("file", "/"), -1).alias("source"), F.posexplode(listed).alias("ord", "c"))
    return of.select("repo", "source", "ord", "c.*")


def manifest_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """repo, file, ai_commits, total_commits, stars, language of each manifest."""
    docs = read_documents(spark, f"{folder}/*_commits.json", MANIFEST)
    d = F.col("doc")
    n = F.coalesce(d["ai_commits_count"], F.size(d["ai_commits"]).cast("long"), F.lit(0).cast("long"))
    return docs.select(repo_name(d["repo"], F.col("file")).alias("repo"), "file", n.alias("ai_commits"), F.coalesce(d["total_commits_scanned"], F.lit(0).cast("long")).alias("total_commits"), d["stars"].alias("stars"), d["language"].alias("language"))


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    """A row for each repository of an earlier discovery."""
    return read_documents(spark, path, REPOS).select(F.explode("doc.repos").alias("r")).select("r.*").where(F.coalesce("full_name", F.lit("")) != "")


def read_repo_list(spark: SparkSession, path: str) -> DataFrame:
    """repo, file: a batch's input, a list of repositories or an object that holds one; items are names or objects."""
    item = "array<struct<repo:string,file:string,stars:long,language:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^\s+", "").alias("t"))
    bare = F.when(F.col("t").startswith("{"), F.from_json("t", f"struct<repos:{item}>")["repos"]).otherwise(F.from_json("t", item))
    names = F.when(F.col("t").startswith("{"), F.from_json("t", "struct<repos:array<string>>")["repos"]).otherwise(F.from_json("t", "array<string>"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    both = F.arrays_zip(none(bare, item).alias("item"), none(names, "array<string>").alias("text"))
    rows = raw.select(F.posexplode(both).alias("ord", "x"))
    repo = F.coalesce(F.col("x.item.repo"), F.when(~F.col("x.text").startswith("{"), F.col("x.text")))
    return rows.select("ord", repo.alias("repo"), F.col("x.item.file").alias("file"), F.col("x.item.stars").alias("stars"), F.col("x.item.language").alias("language")).where("repo is not null")


def month_of(ts: Column) -> Column:
    """The month of an ISO text, as its author saw it; null where it does not begin with a year."""
    return F.when((F.length(ts) >= 7) & ts.rlike("^[0-9]{4}"), F.substring(ts, 1, 7))


def commit_dates(manifests: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """sha12, role, month: what manifests say of a commit, the last of them where several do; a commit's
    detail file gives the month where no manifest does."""
    place = F.struct("source", "ord")
    listed = manifests.where(F.coalesce("sha", F.lit("")) != "").withColumn("sha12", F.substring("sha", 1, 12)).groupBy("sha12").agg(
        F.max_by("author_role", F.when(falsy(F.col("author_role")).isNotNull(), place)).alias("role"), F.max_by(month_of(F.col("date")), F.when(month_of(F.col("date")).isNotNull(), place)).alias("month")
    )
    if details is None:
        return listed
    seen = detail_months(details)
    both = listed.join(seen.withColumnRenamed("month", "seen"), "sha12", "full_outer")
    return both.select("sha12", "role", F.coalesce("month", "seen").alias("month"))


def detail_months(details: DataFrame) -> DataFrame:
    """sha12, month of each commit with a detail file that has a time."""
    rows = details.where((F.coalesce("commit_hash", F.lit("")) != "") & (F.coalesce("timestamp", F.lit("")) != ""))
    return rows.groupBy(F.substring("commit_hash", 1, 12).alias("sha12")).agg(F.max_by(month_of(F.col("timestamp")), "detail").alias("month"))


def find_detail(details: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of each (sha, tool) wanted, its detail file: by the eight first characters and the tool, else by those alone."""
    files = details.select(F.substring("commit_hash", 1, 8).alias("sha8"), F.col("ai_tool").alias("of_tool"), F.struct(*details.columns).alias("found"))
    asked = wanted.select("*", F.substring("sha", 1, 8).alias("sha8")).join(files, "sha8", "left")
    best = F.max_by("found", F.struct(F.col("of_tool").eqNullSafe(F.col("tool")), F.col("found")["detail"]))
    return asked.groupBy(*wanted.columns).agg(best.alias("found"))


def detail_commits(details: DataFrame) -> DataFrame:
    """Detail files in the shape of read_results(..., 'debt_metrics'): the findings of a commit by file."""
    files = F.transform(
        F.map_entries(F.coalesce("debt_debug", F.create_map().cast(f"map<string,struct<issues_added:array<{ISSUE}>,issues_resolved:array<{ISSUE}>>>"))),
        lambda e: F.struct(
            e["key"].alias("file_path"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("status"), F.lit(None).cast(CONTEXT).alias("issue_filter_context_before"),
            F.lit(None).cast(CONTEXT).alias("issue_filter_context_after"), e["value"]["issues_added"].alias("issues_added"), e["value"]["issues_resolved"].alias("issues_resolved"),
        ),
    )
    c = F.struct(
        "commit_hash", "ai_tool", "repo", F.lit(None).cast("string").alias("author_role"), F.lit(None).cast("int").alias("code_files_analyzed"),
        F.lit(None).cast("struct<files_total:int>").alias("analysis_counters"), files.alias("files"),
    )
    return details.select(F.coalesce("repo_folder", "repo").alias("repo"), F.monotonically_increasing_id().alias("ord"), c.alias("c"))


def survival_input(results: DataFrame) -> DataFrame:
    """What a survival match starts from: a row for each finding that a commit introduced (commit_sha, file_path,
    filter_context, line, rule_id, type, severity, message). ``results``: as of read_results(..., 'debt_metrics')."""
    f = results.select("repo", F.col("c.commit_hash").alias("commit_sha"), F.explode("c.files").alias("f"))
    i = f.select("repo", "commit_sha", F.col("f.file_path").alias("file_path"), F.col("f.issue_filter_context_after").alias("filter_context"), F.explode("f.issues_added").alias("i"))
    rule = F.coalesce(falsy(F.col("i.symbol"), F.col("i.rule"), F.col("i.type")), F.lit("unknown"))
    return i.select("repo", "commit_sha", "file_path", "filter_context", F.coalesce(F.expr("try_cast(i.line AS int)"), F.lit(0)).alias("line"), rule.alias("rule_id"), "i.type", "i.severity", "i.message")


SUMMARY = "struct<status:string,repo:string,commits_analyzed:long,errors:long,total_issues_introduced:long,total_issues_fixed:long,net_debt_change:long,issue_survival:struct<total_issues:long,surviving_issues:long,fixed_issues:long,survival_rate:double>>"
PARTS = {**{name: kind for name, kind in DDL.items()}, "summary": SUMMARY, "checkpoint": "struct<completed:array<string>>"}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def layout(spark: SparkSession, folder: str, repo: str) -> str | None:
    """Where a repository's results lie: in a folder of its own, in one of a data set, or in ``folder`` itself; null where none has findings."""
    named = repo.replace("/", "_")
    places = (f"{folder}/{named}", f"{folder}/results/{named}", f"{folder}/out/{named}", folder)
    return next((p for p in places if _exists(spark, f"{p}/debt_metrics.json")), None)


def repo_tables(spark: SparkSession, folder: str, repo: str) -> dict[str, DataFrame]:
    """The documents of one repository by name (findings, survival, lifecycle, destiny, summary, checkpoint, details): each is read only when it is used.
    Documents that are not there are left out."""
    place = layout(spark, folder, repo)
    if place is None:
        return {}
    found = {name: read_documents(spark, f"{place}/{name}.json", kind) for name, kind in PARTS.items() if _exists(spark, f"{place}/{name}.json")}
    if _exists(spark, f"{place}/debug"):
        found["details"] = read_documents(spark, f"{place}/debug", DETAIL)
    return found


def first_document(spark: SparkSession, paths: list[str], kind: str) -> DataFrame | None:
    """The first of several documents that is there and has the shape of ``kind``."""
    for path in paths:
        if _exists(spark, path):
            found = read_documents(spark, path, kind)
            if not found.isEmpty():
                return found
    return None


def batch_summary(results: DataFrame) -> DataFrame:
    """One row over the summaries of all repositories of a batch (status, commits_analyzed, total_issues_introduced, total_issues_fixed): how many
    went well and how many did not, sums, and the difference. What a summary lacks counts as 0; no rows give zeros."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    out = results.agg(F.count_if(ok).alias("repos_analyzed"), F.count_if(~ok).alias("repos_failed"), total("commits_analyzed", "total_commits_analyzed"), total("total_issues_introduced", "total_issues_introduced"), total("total_issues_fixed", "total_issues_fixed"))
    return out.withColumn("net_debt_change", F.col("total_issues_introduced") - F.col("total_issues_fixed"))


def matching_files(spark: SparkSession, folder: str, patterns: list[str]) -> list[str]:
    """Files of a folder that match any of the patterns, each once, by name; as many as the folder lists."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = {str(x.getPath()) for p in patterns for x in (system.globStatus(path(f"{folder}/{p}")) or []) if x.isFile()}
    return sorted(found)
