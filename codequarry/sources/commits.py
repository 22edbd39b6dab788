"""Commit manifests in four layouts as one table.

A document is an object with ``ai_commits``, an object with ``ai_commit_shas``, or an array
of commits; other files have a commit a line. All are read with an explicit
schema, so no pass over the data infers one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = (
    "sha string, repo string, full_name string, repo_url string, ai_tool string, tool string, detection_method string, author_name string, author_email string, "
    "message string, date string, url string, author_role string, ai_identifier string, ai_identifier_type string"
)
DOCUMENT = f"repo string, repo_url string, repo_source string, stars long, language string, ai_commits array<struct<{COMMIT.replace(' string', ': string')}>>, ai_commit_shas array<string>, ai_tools array<string>"
NAMES = [c.split()[0] for c in COMMIT.split(", ")]


def repo_url(commit_url: Column) -> Column:
    """What stands before the last ``/commit/`` of a commit's address; null without one."""
    return F.when(commit_url.contains("/commit/"), F.regexp_extract(commit_url, r"^(?s)(.*)/commit/", 1))


def _or(*cols: Column) -> Column:
    """The first value that is neither null nor empty, else the last."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], cols[-1])


def commits_of_documents(texts: DataFrame, column: str = "value") -> DataFrame:
    """Commits of whole JSON documents, one in each row of ``column``; text that is no JSON gives none."""
    text = F.regexp_replace(F.col(column), r"^[\s\x{feff}]+", "")
    objects = texts.where(text.startswith("{")).select(F.from_json(text, DOCUMENT).alias("d")).select("d.*")
    c = F.col("c")
    listed = objects.where("ai_commits is not null").select(F.coalesce("repo", F.lit("")).alias("of"), F.explode("ai_commits").alias("c"))
    repo, tool = _or(c["repo"], F.col("of")), F.coalesce(c["ai_tool"], F.lit("unknown"))
    made = {"repo": repo, "full_name": repo, "ai_tool": tool, "tool": tool, "repo_url": _or(repo_url(c["url"]), repo)}
    out = listed.select(*[made.get(n, c[n]).alias(n) for n in NAMES])
    old = objects.where("ai_commits is null").withColumn("sha", F.explode("ai_commit_shas"))
    only = F.when(F.size("ai_tools") == 1, F.get("ai_tools", 0)).otherwise("unknown")
    old = old.select("sha", F.col("repo").alias("full_name"), _or(F.col("repo_url"), F.col("repo_source")).alias("repo_url"), only.alias("tool"), F.coalesce("ai_tools", F.array().cast("array<string>")).alias("possible_tools"))
    arrays = texts.where(text.startswith("[")).select(F.explode(F.from_json(text, f"array<struct<{COMMIT.replace(' string', ': string')}>>")).alias("c")).select("c.*")
    return out.unionByName(old, allowMissingColumns=True).unionByName(arrays, allowMissingColumns=True)


def load_commits(spark: SparkSession, path: str) -> DataFrame:
    """All commits of the manifests at ``path`` (a file, a folder, or a pattern): .json files are documents, others have a commit a line.
    ``possible_tools`` lists a whole repository's tools where the layout does not say which made a commit.

    Lines that are no JSON object are left out.
    """
    is_document = F.lower(F.col("_metadata.file_path")).endswith(".json")
    documents = commits_of_documents(spark.read.option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(path, wholetext=True))
    value = F.regexp_replace("value", r"^[\s\x{feff}]+", "")
    lines = spark.read.text(path).where(~is_document).where(value.startswith("{"))
    return documents.unionByName(lines.select(F.from_json(value, COMMIT).alias("c")).where("c is not null").select("c.*"), allowMissingColumns=True)


def repo_metadata(csv: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """repo_name, stars, language: of each name the first row in ``ord``; stars that are no number are 0.
    ``fallback`` fills in only names that are missing."""
    first = csv.where(F.trim("repo_name") != "").groupBy(F.trim("repo_name").alias("repo_name")).agg(F.min_by(F.struct("stars", "language"), "ord").alias("m"))
    out = first.select("repo_name", F.coalesce(F.expr("try_cast(m.stars AS bigint)"), F.lit(0).cast("long")).alias("stars"), "m.language")
    return out if fallback is None else out.unionByName(fallback.join(out, "repo_name", "left_anti").select(*out.columns))
