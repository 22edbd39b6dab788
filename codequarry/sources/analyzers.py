"""Captured output of analyzers as one table of findings.

Each function takes rows with the output as text, and keeps the caller's ``keys``. Findings have
type, severity, line, col, symbol, rule, message, category, detected_by; no tool is ever started here. Output that is
not JSON gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.rules import is_eslint_artefact, overridden_severity

FIELDS = ("type", "severity", "line", "col", "symbol", "rule", "message", "category", "detected_by")
# Rules of Pylint that depend on what is installed around the code.
INSTALLATION_RULES = ["import-error", "no-name-in-module"]
_INT = ("line", "col")


def _findings(df: DataFrame, keys: list[str], **cols: Column) -> DataFrame:
    return df.select(*keys, *[cols.get(c, F.lit(None)).cast("int" if c in _INT else "string").alias(c) for c in FIELDS])


def _parsed(df: DataFrame, keys: list[str], text: str, shape: str, from_brace: bool = False) -> DataFrame:
    raw = F.col(text)
    if from_brace:  # there may be a log before it
        raw = F.when(F.instr(raw, "{") > 0, F.substring(raw, F.instr(raw, "{"), F.length(raw)))
    return df.select(*keys, F.from_json(raw, shape).alias("d")).where("d is not null")


def pylint(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    d = _parsed(df, keys, text, "messages array<struct<type:string,symbol:string,message:string,line:int,column:int>>").select(*keys, F.explode("d.messages").alias("m"))
    m = F.col("m")
    kept = d.where(~F.coalesce(m["symbol"], F.lit("")).isin(INSTALLATION_RULES))
    return _findings(kept, keys, type=F.lit("pylint"), severity=F.coalesce(m["type"], F.lit("warning")), line=m["line"], col=m["column"], symbol=m["symbol"], message=m["message"], category=F.lit("maintainability"))


def pylint_counts(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """keys, score, errors, warnings."""
    d = _parsed(df, keys, text, "messages array<struct<type:string,symbol:string>>, statistics struct<score:double>")
    kept = F.filter(F.coalesce("d.messages", F.array().cast("array<struct<type:string,symbol:string>>")), lambda m: ~F.coalesce(m["symbol"], F.lit("")).isin(INSTALLATION_RULES))
    n = lambda *kinds: F.size(F.filter(kept, lambda m: m["type"].isin(*kinds)))
    return d.select(*keys, F.col("d.statistics.score").alias("score"), n("error", "fatal").alias("errors"), n("warning").alias("warnings"))


def eslint(df: DataFrame, keys: list[str], text: str = "output", blocked: list[str] | None = None) -> DataFrame:
    """Of the first file in the output, without messages about its surroundings."""
    shape = "array<struct<messages:array<struct<ruleId:string,severity:int,message:string,line:int,column:int>>>>"
    d = _parsed(df, keys, text, shape).select(*keys, F.explode(F.get("d", 0)["messages"]).alias("m"))
    m = F.col("m")
    kept = d.where(~is_eslint_artefact(m["ruleId"], m["message"]) & ~m["ruleId"].isin(blocked or []))
    return _findings(
        kept, keys, type=F.lit("eslint"), severity=F.when(m["severity"] == 2, "error").otherwise("warning"), line=m["line"], col=m["column"], rule=m["ruleId"], message=m["message"],
        category=F.lit("maintainability"), detected_by=F.lit("eslint"),
    )


_SEMGREP = "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<severity:string,message:string,metadata:struct<cwe:string>>>>"


def semgrep(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    d = _parsed(df, keys, text, _SEMGREP).select(*keys, F.explode("d.results").alias("r"))
    r = F.col("r")
    return _findings(
        d, keys, type=F.lit("security"), severity=F.lower(F.coalesce(r["extra"]["severity"], F.lit("INFO"))), line=r["start"]["line"], symbol=r["check_id"],
        message=F.coalesce(r["extra"]["message"], F.lit("")), category=F.lit("vulnerability"), detected_by=F.lit("semgrep"),
    )


def semgrep_summary(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """keys, vulnerability_count, error_count, warning_count, info_count (all other severities), cwe_count, cwe_ids. A finding's CWEs are a text or a list of texts."""
    d = _parsed(df, keys, text, _SEMGREP).select(*keys, F.explode_outer("d.results").alias("r"))
    severity, cwe = F.upper(F.coalesce("r.extra.severity", F.lit("INFO"))), F.col("r.extra.metadata.cwe")
    listed = F.when(cwe.startswith("["), F.from_json(cwe, "array<string>")).when(cwe.isNotNull(), F.array(cwe)).otherwise(F.array().cast("array<string>"))
    rows = d.select(*keys, F.col("r").isNotNull().alias("found"), severity.alias("s"), listed.alias("cwe"))
    known = F.col("s").isin("ERROR", "WARNING")
    n = rows.groupBy(*keys).agg(*[F.count_if(F.col("found") & t).alias(c) for t, c in ((F.lit(True), "vulnerability_count"), (F.col("s") == "ERROR", "error_count"), (F.col("s") == "WARNING", "warning_count"), (~known, "info_count"))])
    ids = rows.select(*keys, F.explode("cwe").alias("cwe")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("cwe")).alias("cwe_ids"))
    return n.join(ids, keys, "left").withColumn("cwe_ids", F.coalesce("cwe_ids", F.array().cast("array<string>"))).withColumn("cwe_count", F.size("cwe_ids"))


def bandit(df: DataFrame, keys: list[str], text: str = "output", blocked: list[str] | None = None) -> DataFrame:
    shape = "results array<struct<test_id:string,issue_severity:string,issue_confidence:string,issue_text:string,line_number:int>>"
    d = _parsed(df, keys, text, shape).select(*keys, F.explode("d.results").alias("r"))
    r = F.col("r")
    severity = F.lower(overridden_severity(r["test_id"], F.upper(F.coalesce(r["issue_severity"], F.lit("UNKNOWN")))))
    kept = d.where(~F.coalesce(r["test_id"], F.lit("")).isin(blocked or []))
    return _findings(kept, keys, type=F.lit("security"), severity=severity, line=r["line_number"], rule=r["test_id"], message=r["issue_text"])


def njsscan(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """A finding for each file and rule, at the first line it names."""
    shape = "nodejs map<string,struct<metadata:struct<severity:string,description:string>,files:array<struct<match_lines:array<int>>>>>"
    d = _parsed(df, keys, text, shape, from_brace=True).select(*keys, F.explode("d.nodejs").alias("rule", "f")).select(*keys, "rule", "f.metadata", F.explode("f.files").alias("file"))
    m = F.col("metadata")
    severity = F.lower(overridden_severity(F.col("rule"), F.upper(F.coalesce(m["severity"], F.lit("WARNING")))))
    return _findings(
        d, keys, type=F.lit("security"), severity=severity, line=F.coalesce(F.get("file.match_lines", 0), F.lit(0)), symbol=F.col("rule"), rule=F.col("rule"), message=F.coalesce(m["description"], F.lit("Security issue detected")),
        category=F.lit("vulnerability"), detected_by=F.lit("njsscan"),
    )


def jscpd(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """keys, lines, tokens, first_file, first_start, first_end, second_file, second_start, second_end, fragment (200 characters) of each copied block."""
    side = "struct<name:string,start:int,end:int>"
    d = _parsed(df, keys, text, f"duplicates array<struct<lines:int,tokens:int,firstFile:{side},secondFile:{side},fragment:string>>").select(*keys, F.explode("d.duplicates").alias("d"))
    ends = [F.col(f"d.{s}File.{c}").alias(f"{s}_{name}") for s in ("first", "second") for c, name in (("name", "file"), ("start", "start"), ("end", "end"))]
    return d.select(*keys, F.coalesce("d.lines", F.lit(0)).alias("lines"), F.coalesce("d.tokens", F.lit(0)).alias("tokens"), *ends, F.substring(F.coalesce("d.fragment", F.lit("")), 1, 200).alias("fragment"))


def radon(df: DataFrame, keys: list[str], cc: str = "cc", mi: str = "mi") -> DataFrame:
    """keys, cyclomatic_complexity (the sum over a file's blocks), maintainability_index, of the output for one file each."""
    blocks = F.get(F.map_values(F.from_json(cc, "map<string,array<struct<complexity:double>>>")), 0)
    index = F.get(F.map_values(F.from_json(mi, "map<string,struct<mi:double>>")), 0)["mi"]
    total = F.aggregate(blocks, F.lit(0.0), lambda a, b: a + F.coalesce(b["complexity"], F.lit(0.0)))
    return df.select(*keys, F.coalesce(total, F.when(F.from_json(cc, "map<string,string>").isNotNull(), 0.0)).alias("cyclomatic_complexity"), index.alias("maintainability_index"))


_SARIF = (
    "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,properties:struct<tags:array<string>>>>>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>>>>>"
)


def sarif(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """keys, rule, severity, message, file, line, col, cwe (tags that begin so), type (security or quality), detected_by: a rule's tags are looked up in its run."""
    d = _parsed(df, keys, text, _SARIF).select(*keys, F.explode_outer("d.runs").alias("run")).where("run IS NOT NULL")  # not explode(), whose filter on empty lists parses all texts once more
    ids = F.transform("run.tool.driver.rules", lambda r: F.struct(r["id"].alias("id"), F.coalesce(r["properties"]["tags"], F.array().cast("array<string>")).alias("tags")))
    pair = "array<struct<id:string,tags:array<string>>>"
    # Of rules of one name the last counts, as in a dictionary that is filled in their order.
    last = F.filter(ids, lambda r, i: ~F.exists(F.slice(ids, i + 2, F.size(ids)), lambda o: o["id"] == r["id"]))
    tagged = d.select(*keys, F.map_from_entries(F.coalesce(last.cast(pair), F.array().cast(pair))).alias("tags"), F.col("run.results").alias("results"))
    rows = tagged.select(*keys, "tags", F.explode("results").alias("r"))  # apart, so that no row of a result holds its whole run
    r, place = F.col("r"), F.get("r.locations", 0)["physicalLocation"]
    tags = F.coalesce(F.try_element_at("tags", r["ruleId"]), F.array().cast("array<string>"))
    return rows.select(
        *keys, F.coalesce(r["ruleId"], F.lit("unknown")).alias("rule"), F.coalesce(r["level"], F.lit("warning")).alias("severity"), F.coalesce(r["message"]["text"], F.lit("")).alias("message"),
        F.coalesce(place["artifactLocation"]["uri"], F.lit("")).alias("file"), F.coalesce(place["region"]["startLine"], F.lit(0)).alias("line"), F.coalesce(place["region"]["startColumn"], F.lit(0)).alias("col"),
        F.filter(tags, lambda t: t.startswith("cwe")).alias("cwe"), F.when(F.array_contains(tags, "security"), "security").otherwise("quality").alias("type"), F.lit("codeql").alias("detected_by"),
    )


def cwe_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """keys, cwe (upper case), n."""
    return findings.select(*keys, F.explode("cwe").alias("cwe")).groupBy(*keys, F.upper("cwe").alias("cwe")).agg(F.count("*").alias("n"))


def sonar_issues(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    shape = "issues array<struct<rule:string,severity:string,type:string,message:string,component:string,line:int,effort:string,tags:array<string>>>"
    i = F.col("i")
    d = _parsed(df, keys, text, shape).select(*keys, F.explode("d.issues").alias("i"))
    kind = F.replace(F.lower(F.coalesce(i["type"], F.lit("CODE_SMELL"))), F.lit("_"), F.lit(" "))
    return d.select(
        *keys, F.coalesce(i["rule"], F.lit("")).alias("rule"), F.lower(F.coalesce(i["severity"], F.lit("INFO"))).alias("severity"), kind.alias("type"), F.coalesce(i["message"], F.lit("")).alias("message"),
        F.substring_index(F.coalesce(i["component"], F.lit("")), ":", -1).alias("file"), F.coalesce(i["line"], F.lit(0)).alias("line"), F.coalesce(i["effort"], F.lit("")).alias("effort"), F.lit("sonarqube").alias("detected_by"),
    )


# Measures of SonarQube that are whole numbers.
SONAR_COUNTS = ["bugs", "vulnerabilities", "code_smells", "security_hotspots", "cognitive_complexity", "complexity", "sqale_index"]


def sonar_measures(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """keys, and a column for each measure; whole numbers are cut, duplicated_lines_density stays a fraction, ratings stay texts."""
    d = _parsed(df, keys, text, "component struct<measures:array<struct<metric:string,value:string>>>")
    value = lambda m: F.get(F.filter("d.component.measures", lambda x: x["metric"] == m), 0)["value"]
    return d.select(
        *keys, *[value(m).cast("double").cast("long").alias(m) for m in SONAR_COUNTS], value("duplicated_lines_density").cast("double").alias("duplicated_lines_density"),
        *[value(m).alias(m) for m in ("reliability_rating", "security_rating")], F.coalesce(value("sqale_index").cast("double").cast("long"), F.lit(0).cast("long")).alias("tech_debt_minutes"),
    )


def combined(codeql: DataFrame | None, sonar: DataFrame | None) -> DataFrame:
    """Findings of deep scans together, with source and is_security."""
    sides = []
    if codeql is not None:
        sides.append(codeql.withColumn("source", F.lit("codeql")).withColumn("is_security", F.col("type") == "security"))
    if sonar is not None:
        sides.append(sonar.withColumn("source", F.lit("sonarqube")).withColumn("is_security", F.col("type").isin("vulnerability", "security hotspot")))
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1], allowMissingColumns=True)


def combined_counts(findings: DataFrame, *keys: str) -> DataFrame:
    out = findings.groupBy(*keys).agg(F.count("*").alias("total_issues"), F.count_if("is_security").alias("security_issues"))
    return out.withColumn("quality_issues", F.col("total_issues") - F.col("security_issues"))


def deep_summary(introduced: DataFrame, fixed: DataFrame) -> dict[str, DataFrame]:
    """Of many commits' deep scans (repo, sha and findings): commits (introduced, fixed, net_change), by_severity (upper case), by_type."""
    keys = ["repo", "sha"]
    n = introduced.groupBy(*keys).agg(F.count("*").alias("introduced")).join(fixed.groupBy(*keys).agg(F.count("*").alias("fixed")), keys, "full_outer").na.fill(0)
    return {
        "commits": n.withColumn("net_change", F.col("introduced") - F.col("fixed")),
        "by_severity": introduced.groupBy(F.upper(F.coalesce("severity", F.lit("unknown"))).alias("severity")).agg(F.count("*").alias("n")),
        "by_type": introduced.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n")),
    }
