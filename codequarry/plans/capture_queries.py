"""Queries that read captured output of tools: logs, diffs, blame, analyzers, servers and result documents.

The driver's tables hold no such text, so it is written from their rows, one text for each order or customer, and
then read by the functions of ``sources`` alone. The SQL works on the rows the text was written from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry import facts
from codequarry.functions import code, paths
from codequarry.operators import matching
from codequarry.plans.catalog import catalog
from codequarry.reports import history, survival
from codequarry.sources import analyzers, commits, discovery, git_text, results

QUERIES, SQL, query = catalog()


def _text(rows: DataFrame, keys: list[str], order: str, line: Column, end: str = "\n", name: str = "output") -> DataFrame:
    """keys and one text of all its lines, in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order), line.alias("line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["line"]), end).alias(name))


def _s(*parts) -> Column:
    """Columns and texts as one text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _c(name: str) -> Column:
    return F.col(name)


def _json(rows: DataFrame, keys: list[str], order: str, item: Column, name: str) -> DataFrame:
    """keys and the JSON list of all items, in order, as column ``name``."""
    items = F.sort_array(F.collect_list(F.struct(F.col(order), item.alias("item"))))
    return rows.groupBy(*keys).agg(F.to_json(F.transform(items, lambda x: x["item"])).alias(name))


@query("""SELECT o_custkey AS repo, count(*) AS n, CAST(sum(epoch(o_orderdate)) AS BIGINT) AS seconds, count(*) FILTER (o_orderkey % 5 <> 0) AS named, min('fix | ' || o_orderpriority || '|' || o_orderkey) AS first_subject, min(CAST(o_orderkey AS VARCHAR)) AS first_hash
  FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1""")
def c01_log_entries(t):
    """A log a customer; every eleventh line lacks a field and goes, subjects hold bars."""
    o = t("orders")
    line = F.when(_c("o_orderkey") % 11 == 0, _s(_c("o_orderkey"), "|broken")).otherwise(
        _s(_c("o_orderkey"), "|", F.when(_c("o_orderkey") % 5 == 0, "").otherwise("n m"), "|e@x|", F.unix_timestamp(_c("o_orderdate").cast("timestamp")), "|fix | ", _c("o_orderpriority"), "|", _c("o_orderkey")))
    log = git_text.log_entries(_text(o, ["o_custkey"], "o_orderkey", line), ["o_custkey"])
    return log.groupBy(_c("o_custkey").alias("repo")).agg(F.count("*").alias("n"), F.sum("timestamp").alias("seconds"), F.count_if(_c("author_name") != "").alias("named"), F.min("subject").alias("first_subject"), F.min("commit_hash").alias("first_hash"))


@query("""WITH s AS (SELECT l_orderkey, ['M', 'A', 'R100', 'D', 'C75'][l_suppkey % 5 + 1] AS status, CASE WHEN l_suppkey % 5 IN (2, 4) THEN 'new/f' || l_partkey WHEN l_suppkey % 5 = 0 THEN 'a/y/f' || l_partkey ELSE 'src/f' || l_partkey END AS path FROM lineitem),
  n AS (SELECT l_orderkey, CASE WHEN l_suppkey % 5 = 0 THEN 'a/y/f' || l_partkey ELSE 'src/f' || l_partkey END AS path, CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_quantity AS INTEGER) END AS added FROM lineitem)
  SELECT s.l_orderkey AS sha, count(*) AS files, count(*) FILTER (status = 'R100') AS renamed, min(path) AS first_path, (SELECT sum(added) FROM n WHERE n.l_orderkey = s.l_orderkey)::BIGINT AS added, (SELECT count(*) FROM n WHERE n.l_orderkey = s.l_orderkey AND added IS NULL) AS binaries,
  (SELECT max(path) FROM n WHERE n.l_orderkey = s.l_orderkey) AS last_path FROM s GROUP BY 1""")
def c02_name_status_and_numstat(t):
    """What an order's lines changed, as two commands tell it: with renames in braces, copies and binary files."""
    l = t("lineitem").withColumn("k", _c("l_suppkey") % 5)
    status = F.when(_c("k") == 0, _s("M\ta/{x => y}/f", _c("l_partkey"))).when(_c("k") == 1, _s("A\tsrc/f", _c("l_partkey"))).when(_c("k") == 2, _s("R100\told/f\tnew/f", _c("l_partkey"))).when(_c("k") == 3, _s("D\tsrc/f", _c("l_partkey"))).otherwise(_s("C75\told/g\tnew/f", _c("l_partkey")))
    path = F.when(_c("k") == 0, _s("a/{x => y}/f", _c("l_partkey"))).otherwise(_s("src/f", _c("l_partkey")))
    stat = _s(F.when(_c("l_linenumber") % 4 == 0, "-").otherwise(_c("l_quantity").cast("int").cast("string")), "\t", F.when(_c("l_linenumber") % 4 == 0, "-").otherwise("1"), "\t", path)
    key, order = ["l_orderkey"], "l_linenumber"
    changed = git_text.name_status(_text(l, key, order, status), key).groupBy(*key).agg(F.count("*").alias("files"), F.count_if(_c("status") == "R100").alias("renamed"), F.min("path").alias("first_path"))
    lines = git_text.numstat(_text(l, key, order, stat), key).groupBy(*key).agg(F.sum("added").alias("added"), F.count_if(_c("added").isNull()).alias("binaries"), F.max("path").alias("last_path"))
    return changed.join(lines, key).withColumnRenamed("l_orderkey", "sha")


def _diffs(t):
    """A diff for each order: a file for each line item, whose hunks cover l_quantity lines from l_partkey on, and one more line."""
    n = _c("l_quantity").cast("int")
    file = _s(
        "diff --git a/f", _c("l_linenumber"), ".py b/f", _c("l_linenumber"), ".py\n--- a/f", _c("l_linenumber"), ".py\n+++ ", F.when(_c("l_suppkey") % 7 == 0, "/dev/null").otherwise(_s("b/f", _c("l_linenumber"), ".py")), "\n@@ -1,2 +", _c("l_partkey"), ",", n, " @@ def f():\n-gone\n+",
        F.repeat(F.lit("x"), _c("l_linenumber")), "\n same\n+", _c("l_partkey"), "\n@@ -9 +", _c("l_partkey") + 100, " @@\n+last",
    )
    return _text(t("lineitem"), ["l_orderkey"], "l_linenumber", file, name="diff")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS n, l_suppkey % 7 = 0 AS gone FROM lineitem),
  r AS (SELECT l_orderkey, l_partkey AS a, l_partkey + n - 1 AS b, gone FROM f WHERE n > 0 UNION ALL SELECT l_orderkey, l_partkey + 100, l_partkey + 100, gone FROM f),
  u AS (SELECT l_orderkey, count(DISTINCT line) AS lines FROM (SELECT l_orderkey, unnest(generate_series(a, b)) AS line FROM r) GROUP BY 1),
  p AS (SELECT l_orderkey, count(*) AS files, CAST(sum(l_linenumber + length(CAST(l_partkey AS VARCHAR)) + 4) AS BIGINT) AS added_chars FROM f GROUP BY 1)
  SELECT r.l_orderkey AS sha, count(*) AS hunks, CAST(min(a) AS INTEGER) AS first_line, CAST(max(b) AS INTEGER) AS last_line, max(u.lines) AS lines, max(p.files) AS files, max(p.added_chars) AS added_chars FROM r JOIN u USING (l_orderkey) JOIN p USING (l_orderkey) GROUP BY 1""")
def c03_hunks_and_patches(t):
    """Changed ranges, changed lines, and added text of each file of a diff."""
    d, key = _diffs(t), ["l_orderkey"]
    ranges = git_text.changed_ranges(d, key, "diff").groupBy(*key).agg(F.count("*").alias("hunks"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))
    lines = git_text.changed_lines(d, key, "diff").groupBy(*key).agg(F.count("*").alias("lines"))
    chars = F.aggregate("added", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    patches = git_text.file_patches(d, key, "diff").groupBy(*key).agg(F.count("*").alias("files"), F.sum(chars).alias("added_chars"))
    return ranges.join(lines, key).join(patches, key).withColumnRenamed("l_orderkey", "sha")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey AS a, CAST(l_quantity AS INTEGER) AS n, max(CASE WHEN l_suppkey % 7 <> 0 THEN l_linenumber END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey % 7 <> 0) AS header FROM lineitem)
  SELECT l_orderkey AS sha, 'f' || header || '.py' AS path, count(*) FILTER (n > 0) + count(*) AS ranges, CAST(sum(a + n - 1) FILTER (n > 0) + sum(a + 100) AS BIGINT) AS stops FROM f WHERE header IS NOT NULL GROUP BY 1, 2""")
def c04_ranges_by_file(t):
    """Hunks under the header above them, which a file that is gone does not have."""
    return git_text.added_ranges(_diffs(t), ["l_orderkey"], "diff").groupBy(_c("l_orderkey").alias("sha"), "path").agg(F.count("*").alias("ranges"), F.sum("stop").alias("stops"))


_HASHES = ["a" * 40, "b" * 40, "0123456789" * 4]


@query(f"""WITH l AS (SELECT l_suppkey AS f, {_HASHES}[l_partkey % 3 + 1] AS sha FROM lineitem) SELECT CAST(f AS VARCHAR) AS path, sha, count(*) AS n_lines, CAST(sum(count(*)) OVER (PARTITION BY f) AS BIGINT) AS total_lines FROM l GROUP BY 1, 2, f""")
def c05_blame(t):
    """Blame of a file for each supplier: each line under the header of its commit, with the fields that porcelain output has between them."""
    sha = F.element_at(F.array(*[F.lit(h) for h in _HASHES]), (_c("l_partkey") % 3 + 1).cast("int"))
    line = _s(sha, " 1 ", _c("l_linenumber"), " 1\nauthor x\nsummary ", F.repeat(F.lit("c"), 41), "\n\t", _c("l_orderkey"))
    text = _text(t("lineitem").select(_c("l_suppkey").cast("string").alias("path"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("at"), "l_partkey", "l_linenumber", "l_orderkey"), ["path"], "at", line)
    return git_text.blame_counts(text, ["path"]).join(git_text.blame_totals(text, ["path"]), "path")


@query("""WITH l AS (SELECT l_suppkey, l_partkey % 3 AS k, l_linenumber FROM lineitem) SELECT l_suppkey AS repo, ['r0', 'r1', 'unknown'][k + 1] AS rule, CASE WHEN l_linenumber % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, CASE k WHEN 0 THEN 'security' ELSE 'quality' END AS type, count(*) AS n,
  count(*) FILTER (k = 0) * 2 + count(*) FILTER (k = 1) AS cwes, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM l GROUP BY ALL""")
def c06_sarif(t):
    """A run of results for each supplier; tags of rules are looked up, a result without a rule or level has the usual ones."""
    none = F.lit(None).cast("string")
    rule = F.when(_c("l_partkey") % 3 < 2, _s("r", _c("l_partkey") % 3)).otherwise(none)
    place = F.array(F.struct(F.struct(F.struct(F.lit("src/a.py").alias("uri")).alias("artifactLocation"), F.struct(_c("l_linenumber").alias("startLine")).alias("region")).alias("physicalLocation")))
    item = F.struct(rule.alias("ruleId"), F.when(_c("l_linenumber") % 2 == 0, "error").otherwise(none).alias("level"), F.struct(F.lit("m").alias("text")).alias("message"), place.alias("locations"))
    listed = _json(t("lineitem").withColumn("at", F.struct("l_orderkey", "l_linenumber")), ["l_suppkey"], "at", item, "r")
    rules = '[{"id":"r0","properties":{"tags":["security","cwe-79","cwe-20"]}},{"id":"r1","properties":{"tags":["cwe-1"]}}]'
    text = listed.select("l_suppkey", _s('{"runs":[{"tool":{"driver":{"rules":', rules, '}},"results":', _c("r"), "}]}").alias("output"))
    found = analyzers.sarif(text, ["l_suppkey"])
    return found.groupBy(_c("l_suppkey").alias("repo"), "rule", "severity", "type").agg(F.count("*").alias("n"), F.sum(F.size("cwe")).alias("cwes"), F.sum("line").alias("lines"))


@query("""SELECT 'r' || o_custkey AS repo, count(*) AS n, count(*) FILTER (o_orderkey % 3 <> 0) AS logins, min(CAST(o_orderdate AS VARCHAR)) AS first_date, CAST(count(DISTINCT o_orderkey % 4) AS BIGINT) AS pages, max('m ' || o_orderpriority) AS last_message FROM orders GROUP BY 1""")
def c07_commit_pages(t):
    """Pages of a server's list of commits; one in three commits has no account."""
    c, none = F.col, F.lit(None).cast("string")
    author = F.struct(F.lit("n").alias("name"), F.lit("e").alias("email"), c("o_orderdate").cast("string").alias("date"))
    item = F.struct(c("o_orderkey").cast("string").alias("sha"), F.struct(F.when(c("o_orderkey") % 3 != 0, "l").otherwise(none).alias("login")).alias("author"), F.struct(_s("m ", c("o_orderpriority")).alias("message"), author.alias("author")).alias("commit"))
    pages = _json(t("orders").select("*", _s("r", c("o_custkey")).alias("repo"), (c("o_orderkey") % 4).cast("int").alias("page")), ["repo", "page"], "o_orderkey", item, "body")
    got = discovery.page_commits(pages)
    return got.groupBy("repo").agg(F.count("*").alias("n"), F.count("login").alias("logins"), F.min("date").alias("first_date"), F.count_distinct("page").alias("pages"), F.max("message").alias("last_message"))


@query("""SELECT CASE WHEN o_custkey % 3 = 0 THEN 'r' || o_custkey END AS repo, CASE o_custkey % 3 WHEN 0 THEN ['claude', 'unknown'][o_orderkey % 2 + 1] WHEN 1 THEN 'aider' END AS tool, count(*) AS n,
  count(*) FILTER (o_custkey % 3 = 1) AS listed, min(CAST(o_orderkey AS VARCHAR)) AS first_sha FROM orders GROUP BY 1, 2""")
def c08_commit_manifests(t):
    """Manifests in three layouts, a document for each customer, some behind a byte-order mark: an object with commits, one with hashes, a bare list."""
    c = F.col
    o = t("orders").withColumn("kind", c("o_custkey") % 3)
    item = F.struct(c("o_orderkey").cast("string").alias("sha"), F.when(c("o_orderkey") % 2 == 0, "claude").alias("ai_tool"))
    rows = _json(o, ["o_custkey", "kind"], "o_orderkey", item, "items").join(_json(o, ["o_custkey", "kind"], "o_orderkey", c("o_orderkey").cast("string"), "hashes"), ["o_custkey", "kind"])
    text = F.when(c("kind") == 0, _s('{"repo":"r', c("o_custkey"), '","ai_commits":', c("items"), "}")).when(c("kind") == 1, _s('{"ai_tools":["aider"],"ai_commit_shas":', c("hashes"), "}")).otherwise(F.regexp_replace("items", '"ai_tool":"claude"', '"x":1'))
    marked = F.concat(F.when(c("o_custkey") % 2 == 0, "﻿\n ").otherwise(""), text)
    got = commits.commits_of_documents(rows.select(marked.alias("value")))
    return got.groupBy("repo", F.coalesce("tool", "ai_tool").alias("tool")).agg(F.count("*").alias("n"), F.count("possible_tools").alias("listed"), F.min("sha").alias("first_sha"))


def _documents(t):
    """Findings of commits as saved documents have them, in the shape that read_results() gives: a commit for each order, a file for each supplier of it."""
    c = F.col

    def issue(x):
        return F.struct(
            F.lit("pylint").alias("type"), F.when(x["n"] % 2 == 0, "error").otherwise("warning").alias("severity"), _s("rule", x["part"] % 9).alias("symbol"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_id"), _s("m", x["part"] % 4).alias("message"),
            F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("detected_by"), x["quantity"].cast("int").cast("string").alias("line"),
        )

    context = F.lit(None).cast("struct<is_test:boolean,is_simulation:boolean,is_dev:boolean>")

    def files_of(lines):
        """The files of a commit's lines, by path; what each says is made of its own lines."""
        file = lambda x: F.struct(x["file_path"].alias("file_path"), F.lit(None).cast("string").alias("language"), F.lit("M").alias("status"), context.alias("issue_filter_context_before"), context.alias("issue_filter_context_after"), F.transform(F.filter(lines, lambda i: i["of"].eqNullSafe(x["of"])), issue).alias("issues_added"), F.transform(F.slice(lines, 1, 0), issue).alias("issues_resolved"))
        named = F.transform(F.array_distinct(F.transform(lines, lambda i: i["of"])), lambda of: F.struct(_s("src/f", of, ".py").alias("file_path"), of.alias("of")))
        return F.transform(F.sort_array(named), file)

    # An order's lines are brought together once, as numbers. They stand in a list of one, so that they have a name and are sorted once.
    line = F.struct((c("l_suppkey") % 3).alias("of"), c("l_linenumber").alias("n"), c("l_partkey").alias("part"), c("l_quantity").alias("quantity"))
    files = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.array(F.sort_array(F.collect_list(line))), files_of)[0].alias("files"))
    sha = F.lpad(c("l_orderkey").cast("string"), 40, "0")
    commit = F.struct(sha.alias("commit_hash"), F.when(c("l_orderkey") % 5 != 0, "cursor").alias("ai_tool"), F.lit(None).cast("string").alias("author_role"), F.lit(3).alias("code_files_analyzed"), F.struct(F.lit(3).alias("files_total")).alias("analysis_counters"), c("files").alias("files"))
    return files.select(_s("org/r", c("l_orderkey") % 20).alias("repo"), commit.alias("c"))


_FOUND = "f AS (SELECT 'org/r' || l_orderkey % 20 AS repo, lpad(CAST(l_orderkey AS VARCHAR), 40, '0') AS sha, 'src/f' || l_suppkey % 3 || '.py' AS path, 'rule' || l_partkey % 9 AS rule, 'm' || l_partkey % 4 AS message, CASE WHEN l_linenumber % 2 = 0 THEN 'error' ELSE 'warning' END AS sev, CAST(l_quantity AS INTEGER) AS line, l_linenumber AS n, l_partkey AS p, l_orderkey AS k FROM lineitem)"


@query(f"""WITH {_FOUND}, h AS (SELECT repo, sha, path, line, message, sev, min_by(rule, (n, p)) AS rule FROM f GROUP BY ALL), e AS (SELECT *, n % 3 = 0 AS survived FROM f)
  SELECT h.rule AS rule_name, CASE WHEN e.k % 5 <> 0 THEN 'cursor' ELSE 'unknown' END AS tool, count(*) AS total, count(*) FILTER (survived) AS surviving FROM e JOIN h ON h.repo = e.repo AND h.sha = e.sha AND h.path = e.path AND h.line = e.line AND h.message = e.message AND h.sev = e.sev GROUP BY 1, 2""")
def c09_hydrated_survival(t):
    """Survival entries that know only a finding's place, type and message get its rule from where it was introduced, and the tool from their commit (by its whole hash, or twelve characters)."""
    documents = _documents(t)
    added, made = facts.issue_rows(documents).where("phase = 'added'"), facts.commit_facts(documents)
    c, none = F.col, F.lit(None).cast("string")
    known = F.lpad(c("l_orderkey").cast("string"), 40, "0")
    entries = t("lineitem").select(
        _s("org/r", c("l_orderkey") % 20).alias("repo"), c("l_linenumber").alias("ord"), (c("l_linenumber") % 3 == 0).alias("survived"), known.alias("commit_sha"), _s("src/f", c("l_suppkey") % 3, ".py").alias("file_path"), F.lit("pylint").alias("type"),
        F.when(c("l_linenumber") % 2 == 0, "error").otherwise("warning").alias("severity"), none.alias("symbol"), none.alias("rule"), F.when(c("l_linenumber") % 4 == 1, "pylint").alias("rule_id"), _s("m", c("l_partkey") % 4).alias("message"), none.alias("category"), none.alias("detected_by"),
        F.lit(None).cast("struct<is_test:boolean,is_simulation:boolean,is_dev:boolean>").alias("filter_context"), c("l_quantity").cast("int").alias("line"),
    )
    rows = survival.with_tool(survival.hydrated(entries, added), made)
    return rows.groupBy(F.coalesce("rule_id", "symbol").alias("rule_name"), "tool").agg(F.count("*").alias("total"), F.count_if("survived").alias("surviving"))


@query(f"WITH {_FOUND} SELECT repo, path AS file_path, rule AS rule_id, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM f GROUP BY 1, 2, 3")
def c10_survival_input(t):
    """The introduced findings of all documents as rows that a survival match starts from."""
    return results.survival_input(_documents(t)).groupBy("repo", "file_path", "rule_id").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


@query("""WITH i AS (SELECT l_suppkey AS scope, 'r' || l_partkey % 6 AS rule, l_linenumber AS line, 'msg ' || l_partkey % 2 AS message FROM lineitem WHERE l_returnflag <> 'R'), m AS (SELECT DISTINCT l_suppkey AS scope, 'r' || l_partkey % 6 AS rule, l_linenumber AS line, 'msg ' || l_partkey % 2 AS message FROM lineitem WHERE l_returnflag = 'R')
  SELECT scope, (SELECT count(*) FROM i WHERE i.scope = s.scope) AS own, (SELECT count(*) FROM m ANTI JOIN i USING (scope, rule, line, message) WHERE m.scope = s.scope) AS more FROM (SELECT DISTINCT scope FROM i UNION SELECT scope FROM m) s""")
def c11_augmented(t):
    """Findings of a second tool that the first has not, by rule, line and message, whatever their case and blanks."""
    c, none = F.col, F.lit(None).cast("string")
    l = t("lineitem").select(c("l_suppkey").alias("scope"), none.alias("rule_id"), _s("r", c("l_partkey") % 6).alias("rule"), none.alias("symbol"), F.lit("t").alias("type"), c("l_linenumber").alias("line"), c("l_returnflag").alias("flag"), _s("MSG   ", c("l_partkey") % 2).alias("message"))
    first = l.where("flag <> 'R'").withColumns({"message": F.lower(F.regexp_replace("message", " +", " ")), "mine": F.lit(True)}).drop("flag")
    more = l.where("flag = 'R'").withColumn("mine", F.lit(False)).drop("flag")
    return matching.augmented(first, more, ["scope"]).groupBy("scope").agg(F.count_if("mine").alias("own"), F.count_if(~c("mine")).alias("more"))


@query("""WITH s AS (SELECT l_orderkey, 'f' || l_suppkey AS path, ['EXISTS', 'EXISTS', 'MODIFIED', 'DELETED'][l_partkey % 4 + 1] AS status FROM lineitem)
  SELECT CAST(l_orderkey AS VARCHAR) AS sha, count(DISTINCT path) AS files_analyzed, count(*) AS total_lines_added, count(*) FILTER (status = 'EXISTS') AS lines_still_exist, count(*) FILTER (status = 'EXISTS') * 1.0::DOUBLE / count(*) AS survival_rate,
  CASE WHEN count(*) FILTER (status = 'EXISTS') * 10 >= 8 * count(*) THEN 'HIGH' WHEN count(*) FILTER (status = 'EXISTS') * 2 >= count(*) THEN 'MEDIUM' ELSE 'LOW' END AS developer_valuation FROM s GROUP BY 1""")
def c12_destiny(t):
    """Lines of commits that are still there, and how they are valued."""
    rows = t("lineitem").select(F.lit("r").alias("repo"), F.col("l_orderkey").cast("string").alias("sha"), _s("f", F.col("l_suppkey")).alias("path"), F.element_at(F.array(*[F.lit(s) for s in ("EXISTS", "EXISTS", "MODIFIED", "DELETED")]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("status"))
    return history.destiny(rows).select("sha", "files_analyzed", "total_lines_added", "lines_still_exist", "survival_rate", "developer_valuation")


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS repos_analyzed, count(*) FILTER (o_orderstatus <> 'F') AS repos_failed, CAST(sum(CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END) AS BIGINT) AS total_commits_analyzed, CAST(sum(o_orderkey % 7) AS BIGINT) AS total_issues_introduced, CAST(sum(o_orderkey % 3) AS BIGINT) AS total_issues_fixed,
  CAST(sum(o_orderkey % 7 - o_orderkey % 3) AS BIGINT) AS net_debt_change FROM orders""")
def c13_batch_summary(t):
    """Totals over the saved summaries of all repositories, read from their JSON."""
    c = F.col
    body = F.to_json(F.struct(F.when(c("o_orderstatus") == "F", "success").otherwise("error").alias("status"), F.when(c("o_orderkey") % 5 != 0, c("o_custkey")).alias("commits_analyzed"), (c("o_orderkey") % 7).alias("total_issues_introduced"), (c("o_orderkey") % 3).alias("total_issues_fixed")))
    return results.batch_summary(t("orders").select(F.from_json(body, results.SUMMARY).alias("s")).select("s.*"))


@query("""WITH RECURSIVE l AS (SELECT doc_id AS d, x.i, x.h FROM (SELECT doc_id, list_transform(generate_series(0, len(s) - 5), lambda k: {'i': k, 'h': (length(s[k + 1]) % 3) || ',' || (length(s[k + 2]) % 3) || ',' || (length(s[k + 3]) % 3) || ',' || (length(s[k + 4]) % 3) || ',' || (length(s[k + 5]) % 3)}) AS b
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) WHERE len(s) >= 5), LATERAL (SELECT unnest(b) AS x) u),
  n AS (SELECT d, h, i, row_number() OVER (PARTITION BY d, h ORDER BY i) AS k FROM l),
  s AS (SELECT d, h, i AS at, 1::BIGINT AS k, 0::BIGINT AS n FROM n WHERE k = 1 UNION ALL SELECT n.d, n.h, CASE WHEN n.i - s.at >= 5 THEN n.i ELSE s.at END, n.k, s.n + CASE WHEN n.i - s.at >= 5 THEN 1 ELSE 0 END FROM s JOIN n ON n.d = s.d AND n.h = s.h AND n.k = s.k + 1)
  SELECT doc_id, coalesce((SELECT sum(x) FROM (SELECT max(n) AS x FROM s WHERE s.d = doc_id GROUP BY h)), 0)::BIGINT AS duplicates FROM documents""")
def c14_duplicate_blocks(t):
    """Blocks of five lines that come again at least five lines later, over lines of three kinds made of every line's length."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("k"), (F.length(x) % 3).cast("string")))
    return t("documents").select("doc_id", code.duplicate_chunks(lines).alias("duplicates"))


@query("""WITH f AS (SELECT l_orderkey AS sha, CAST(l_quantity AS INTEGER) AS a, l_linenumber AS b, l_partkey % 3 AS na, l_suppkey % 3 AS nb FROM lineitem)
  SELECT sha, CAST(sum(b) AS BIGINT) AS total_cc_parent, CAST(sum(a) AS BIGINT) AS total_cc_sha, CAST(sum(a) - sum(b) AS BIGINT) AS delta_total_cc, CASE WHEN sum(nb) > 0 THEN sum(b)::DOUBLE / sum(nb) ELSE 0.0 END AS avg_cc_parent, CASE WHEN sum(na) > 0 THEN sum(a)::DOUBLE / sum(na) ELSE 0.0 END AS avg_cc_sha FROM f GROUP BY 1""")
def c15_complexity_delta(t):
    """Complexity of a commit's files before and after."""
    c = F.col
    return history.complexity_delta(t("lineitem").select(c("l_orderkey").alias("sha"), c("l_linenumber").alias("cc_before"), c("l_quantity").cast("int").alias("cc_after"), (c("l_suppkey") % 3).alias("functions_before"), (c("l_partkey") % 3).alias("functions_after")), ["sha"])


@query("""SELECT DISTINCT CAST(o_orderkey % 1000 AS VARCHAR) AS path FROM orders WHERE o_orderkey % 4 <> 0""")
def c16_commit_files(t):
    """Paths that a commit lists, without the hashes that stand among them."""
    line = F.when(F.col("o_orderkey") % 4 == 0, F.sha1(F.col("o_orderkey").cast("string"))).otherwise((F.col("o_orderkey") % 1000).cast("string"))
    rows = git_text.output_lines(_text(t("orders"), ["o_custkey"], "o_orderkey", line), ["o_custkey"], "output")
    return rows.where(paths.is_listed_path(F.col("line"))).select(F.col("line").alias("path")).distinct()
