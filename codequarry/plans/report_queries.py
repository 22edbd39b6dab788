"""Queries that make the reports over the driver's tables, and SQL for each.

An order stands for a commit and a line item for a finding; what a finding is about is made of its
keys. The SQL holds the classes of those few paths and rules as a table, so
it shares nothing with the expressions that find them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry import facts
from codequarry.reports import debt, display, survival

QUERIES: dict = {}
SQL: dict = {}
PATHS = ["src/app.py", "web/ui.ts", "lib/core.jsx", "node_modules/x.js", "scripts/run.py", "a/dist-packages/m.py", "tests/test_a.py", "pkg/main.go"]
RULES = ["undefined-variable", "no-member", "line-too-long", "eqeqeq", "B602", "no-console", "unspecified-encoding", "jwt_exposed", "no-undef"]
TOOLS = {"1-URGENT": "claude", "2-HIGH": "copilot", "3-MEDIUM": "cursor", "4-NOT SPECIFIED": "gemini", "5-LOW": "codex"}
LANGS = ["Python", "Go", "Zig", "Rust", "TypeScript", "Elm"]


def _pick(index, values):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _map(column, table):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(column))


def driver_commits(t) -> DataFrame:
    o = t("orders")
    month = F.substring(F.col("o_orderdate").cast("string"), 1, 7)
    sha = F.lpad(F.col("o_orderkey").cast("string"), 16, "0")
    return o.select(
        F.concat(F.lit("org/r"), (F.col("o_custkey") % 40).cast("string")).alias("repo"), sha.alias("commit_hash"), F.substring(sha, 1, 12).alias("sha12"), _map("o_orderpriority", TOOLS).alias("tool"),
        _map("o_orderstatus", {"F": "sole_author", "O": "coauthor", "P": "unknown"}).alias("role"), F.lit(1).alias("files_total"), (F.col("o_orderkey") % 4).alias("n_files"), (F.col("o_orderkey") % 97 == 0).alias("is_tainted"),
        month.alias("month"), month.alias("cohort"),
    )


def driver_issues(t) -> DataFrame:
    """In the shape of facts.issue_rows()."""
    c = F.col
    rows = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), c("l_orderkey") == c("o_orderkey"))
    none = F.lit(None).cast("string")
    rule = _pick(c("l_partkey") % 9, RULES)
    return rows.select(
        F.concat(F.lit("org/r"), (c("o_custkey") % 40).cast("string")).alias("repo"), F.lpad(c("o_orderkey").cast("string"), 16, "0").alias("commit_hash"), _map("o_orderpriority", TOOLS).alias("tool"), c("l_linenumber").alias("file_no"),
        _pick(c("l_suppkey") % 8, PATHS).alias("file_path"), F.when(c("l_linestatus") == "F", "added").otherwise("resolved").alias("phase"), F.lit(None).cast("struct<is_test:boolean,is_simulation:boolean,is_dev:boolean>").alias("context"),
        F.lit(0).alias("ord"), _map("l_returnflag", {"A": "pylint", "N": "eslint", "R": "security"}).alias("type"), _pick(c("l_linenumber") % 3, ["error", "warning", "convention"]).alias("severity"),
        F.when(c("l_returnflag") == "A", rule).alias("symbol"), F.when(c("l_returnflag") == "N", rule).alias("rule"), F.when(c("l_returnflag") == "R", rule).alias("rule_id"),
        F.when(c("l_partkey") % 9 == 8, "'alert' is not defined.").otherwise("m").alias("message"), none.alias("category"), none.alias("detected_by"), c("l_quantity").cast("int").alias("line"),
    )


def driver_metadata(t) -> DataFrame:
    """repo_name, stars, language of 36 of the 40 repositories."""
    c = t("customer").where("c_custkey < 36")
    return c.select(F.concat(F.lit("org/r"), F.col("c_custkey").cast("string")).alias("repo_name"), ((F.col("c_custkey") * F.col("c_custkey") * 71) % 90_000).alias("stars"), _pick(F.col("c_custkey") % 6, LANGS).alias("language"))


def _case(index: str, values: list[str]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _names(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


C = f"""c AS (SELECT 'org/r' || (o_custkey % 40) AS repo, lpad(CAST(o_orderkey AS VARCHAR), 16, '0') AS commit_hash, {_names('o_orderpriority', TOOLS)} AS tool,
  {_names('o_orderstatus', {'F': 'sole_author', 'O': 'coauthor', 'P': 'unknown'})} AS role, o_orderkey % 4 AS n_files, o_orderkey % 97 = 0 AS is_tainted, substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS month, o_orderkey FROM orders)"""
# Classes of the paths (by place in PATHS) and rules (by place in RULES). Blocking does not look at a rule_id, which is all that security findings have.
E = f"""{C}, x AS (SELECT c.*, l_suppkey % 8 AS p, l_partkey % 9 AS r, l_linestatus = 'F' AS is_added, l_returnflag AS fl, l_linenumber % 3 AS s, l_linenumber FROM lineitem JOIN c ON l_orderkey = o_orderkey WHERE NOT is_tainted),
e AS (SELECT *, {_case('p', PATHS)} AS file_path, {_case('r', RULES)} AS rule_name, CASE fl WHEN 'A' THEN 'pylint' WHEN 'N' THEN 'eslint' ELSE 'security' END AS kind,
  CASE WHEN s = 0 THEN 'high' WHEN s = 1 OR fl = 'N' THEN 'medium' ELSE 'low' END AS sev, CASE WHEN p IN (0, 4, 5, 6) THEN 'python' WHEN p = 1 THEN 'typescript' WHEN p = 2 THEN 'javascript' ELSE 'other' END AS lang,
  fl = 'R' OR r = 4 AS is_security, CASE WHEN fl = 'R' OR r = 4 THEN 'security' WHEN r = 0 THEN 'bug' ELSE 'code_smell' END AS family, r IN (2, 5) OR (r = 8 AND p IN (1, 2)) AS is_low_signal,
  CASE WHEN p = 5 THEN 'embedded_env' WHEN r = 6 AND p = 4 THEN 'dev_tool_context' END AS fp_pattern,
  r NOT IN (1, 2, 5, 8) AND (NOT is_added OR (p <> 5 AND NOT (r = 6 AND p = 4))) AS is_actionable FROM x WHERE p <> 3 AND NOT (fl <> 'R' AND (r = 5 OR (r = 7 AND p = 6))))"""
M = f"""{E}, m AS (SELECT c.*, coalesce(i.issues, 0) AS issues, coalesce(i.fixed, 0) AS fixed, coalesce(i.high, 0) AS high, coalesce(i.security, 0) AS security FROM c LEFT JOIN
  (SELECT o_orderkey, count(*) FILTER (is_added) AS issues, count(*) FILTER (NOT is_added) AS fixed, count(*) FILTER (is_added AND sev = 'high') AS high, count(*) FILTER (is_added AND is_security) AS security FROM e GROUP BY 1) i
  ON c.o_orderkey = i.o_orderkey WHERE NOT is_tainted)"""
META = f"meta AS (SELECT 'org/r' || c_custkey AS repo, (c_custkey * c_custkey * 71) % 90000 AS stars, {_case('c_custkey % 6', LANGS)} AS language FROM customer WHERE c_custkey < 36)"
FOCUS = "('claude', 'copilot', 'cursor', 'devin', 'gemini')"


def big(e: str, name: str) -> str:
    return f"CAST({e} AS BIGINT) AS {name}"


def part(a: str, b: str, name: str, times: int = 1) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) * {times}.0::DOUBLE / {b} ELSE 0.0::DOUBLE END AS {name}"


class Facts:
    """What a report is made of, from one folder of tables."""

    def __init__(self, t):
        self.t = t

    @cached_property
    def commits(self) -> DataFrame:
        return driver_commits(self.t)

    @cached_property
    def rows(self) -> DataFrame:
        return driver_issues(self.t)

    @cached_property
    def classified(self) -> DataFrame:
        return facts.classified(self.rows)

    @cached_property
    def events(self) -> DataFrame:
        return facts.of_commits(self.classified, self.commits)

    @cached_property
    def metadata(self) -> DataFrame:
        return driver_metadata(self.t)

    @cached_property
    def measures(self) -> DataFrame:
        return facts.commit_measures(self.commits, self.classified)


def query(sql: str):
    def add(f):
        def run(spark, sf_dir):
            return f(Facts(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")))

        QUERIES[f.__name__] = run
        SQL[f.__name__] = sql
        return f

    return add


SUMS = ", ".join([
    "count(*) AS commits", big("sum(issues)", "issues"), big("sum(fixed)", "fixed"), big("sum(high)", "high"), big("sum(security)", "security"), big("sum(n_files)", "files"), "count(*) FILTER (issues = 0) AS zero_commits",
])
RATES = ", ".join([
    "issues - fixed AS net_debt", part("issues", "commits", "issues_per_commit"), part("files", "commits", "files_per_commit"), part("issues", "files", "issues_per_file"), part("high", "files", "high_per_file"),
    part("security", "files", "security_per_file"), part("zero_commits", "commits", "zero_pct", 100), part("fixed", "issues", "fix_rate", 100), part("high", "issues", "high_pct", 100), part("security", "issues", "security_pct", 100),
])


def by(*keys: str, where: str = "") -> str:
    k = ", ".join(keys)
    return f"WITH {M}, g AS (SELECT {k}, {SUMS} FROM m {where} GROUP BY {k}) SELECT *, {RATES} FROM g"


def counts(*keys: str, where: str = "is_added") -> str:
    k = ", ".join(keys)
    return f"WITH {E} SELECT {k}, count(*) AS n FROM e WHERE {where} GROUP BY {k}"


SEV = ", ".join(f"count(*) FILTER (sev = '{s}') AS {s}" for s in ("high", "medium", "low"))


@query(f"""WITH {M}, a AS (SELECT (SELECT count(DISTINCT repo) FROM c) AS repos, count(DISTINCT CASE WHEN n_files > 0 THEN repo END) AS repos_with_code, count(*) AS commits, {big('sum(issues)', 'issues_introduced')}, {big('sum(fixed)', 'issues_fixed')},
  {big('sum(n_files)', 'files_analyzed')}, {big('sum(security)', 'security_total')}, (SELECT count(*) FROM e WHERE is_added AND is_actionable) AS actionable_introduced, (SELECT count(*) FROM e WHERE NOT is_added AND is_actionable) AS actionable_fixed FROM m)
  SELECT *, issues_introduced - issues_fixed AS net_debt, actionable_introduced - actionable_fixed AS actionable_net_debt, {part('files_analyzed', 'commits', 'files_per_commit')}, {part('issues_introduced', 'files_analyzed', 'issues_per_file')},
  {part('issues_fixed', 'issues_introduced', 'fix_rate', 100)}, {part('security_total', 'issues_introduced', 'security_pct', 100)} FROM a""")
def r01_global_totals(f):
    return debt.global_totals(f.commits, f.measures, f.events)


@query(f"""WITH {E} SELECT 'sev' AS of, sev AS name, count(*) AS n FROM e WHERE is_added GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM e WHERE is_added GROUP BY 2
  UNION ALL SELECT 'lang', lang, count(*) FROM e WHERE is_added GROUP BY 2 UNION ALL SELECT 'family', family, count(*) FROM e WHERE is_added AND is_actionable GROUP BY 2""")
def r02_counts(f):
    a = debt.added(f.events)
    parts = [debt.count_by(a, c) for c in ("sev", "kind", "lang")] + [debt.count_by(debt.actionable(f.events), "family")]
    out = [p.select(F.lit(p.columns[0]).alias("of"), F.col(p.columns[0]).alias("name"), "n") for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(by("tool"))
def r03_by_tool(f):
    return debt.measures_by(f.measures, "tool")


@query(by("role"))
def r04_by_role(f):
    return debt.measures_by(f.measures, "role")


@query(by("tool", "role"))
def r05_by_tool_and_role(f):
    return debt.measures_by(f.measures, "tool", "role")


@query(counts("role", "sev", "kind", "lang"))
def r06_role_breakdown(f):
    return debt.count_by(debt.added(f.events), "role", "sev", "kind", "lang")


@query(f"""WITH {E}, g AS (SELECT role, rule_name, count(*) AS n, {SEV} FROM e WHERE is_added AND is_actionable GROUP BY 1, 2)
  SELECT role, rule_name, n, high, medium, low FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, rule_name) AS k FROM g) WHERE k <= 4""")
def r07_role_rules(f):
    return debt.rules_by_severity(f.events, ["role"], 4)


@query(f"WITH {M}, g AS (SELECT month, tool, count(*) AS commits, {big('sum(issues)', 'issues')}, {big('sum(high)', 'high')} FROM m GROUP BY 1, 2) SELECT *, {part('issues', 'commits', 'rate')} FROM g")
def r08_monthly_by_tool(f):
    return debt.monthly(f.measures, "tool")


@query(f"""WITH {M}, g AS (SELECT month, count(*) AS commits, {big('sum(issues)', 'issues')}, {big('sum(high)', 'high_issues')}, {', '.join(f"count(*) FILTER (tool = '{t}') AS tool_{t}, {big(f"coalesce(sum(issues) FILTER (tool = '{t}'), 0)", f'issues_{t}')}, {big(f"coalesce(sum(high) FILTER (tool = '{t}'), 0)", f'high_{t}')}" for t in ('claude', 'cursor'))} FROM m GROUP BY 1)
  SELECT *, {part('issues_claude', 'tool_claude', 'rate_claude')}, {part('issues_cursor', 'tool_cursor', 'rate_cursor')} FROM g""")
def r09_monthly_wide(f):
    return debt.monthly_wide(f.measures, ["claude", "cursor"])


@query(f"""WITH {M}, n AS (SELECT month, tool, count(*) AS commits FROM m WHERE tool IN {FOCUS} AND month >= '1996-06' GROUP BY 1, 2), i AS (SELECT month, tool, count(*) AS issues FROM e WHERE is_added AND is_actionable AND tool IN {FOCUS} AND month >= '1996-06' GROUP BY 1, 2)
  SELECT month, tool, coalesce(commits, 0) AS commits, coalesce(issues, 0) AS issues, {part('coalesce(issues, 0)', 'coalesce(commits, 0)', 'rate')} FROM n FULL JOIN i USING (month, tool)""")
def r10_focused_monthly(f):
    return debt.focused_monthly(f.measures, f.events, first="1996-06")


REPOS = f"""a AS (SELECT repo, count(*) AS commits FROM c GROUP BY 1), s AS (SELECT repo, bool_or(n_files > 0) AS has_code, {big('sum(issues)', 'issues_introduced')}, {big('sum(fixed)', 'issues_fixed')}, {big('sum(high)', 'issues_high')}, {big('sum(security)', 'issues_security')},
  {', '.join(big(f"coalesce(sum({c}) FILTER (role = '{r}'), 0)", f'{n}_{r}') for c, n in (('issues', 'issues'), ('fixed', 'fixed')) for r in ('sole_author', 'coauthor'))} FROM m GROUP BY 1),
  d AS (SELECT repo, tool FROM (SELECT repo, tool, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, tool) AS k FROM m GROUP BY 1, 2) WHERE k = 1),
  repos AS (SELECT a.repo, commits, has_code, issues_introduced, issues_fixed, issues_high, issues_security, issues_sole_author, issues_coauthor, fixed_sole_author, fixed_coauthor, tool, {part('issues_introduced', 'commits', 'issues_per_commit')},
  100 * CAST(issues_sole_author AS DOUBLE) / greatest(1, issues_introduced) AS pct_sole FROM a JOIN s USING (repo) JOIN d USING (repo))"""


@query(f"WITH {M}, {META}, {REPOS} SELECT repos.*, coalesce(stars, 0) AS stars, coalesce(language, '') AS language FROM repos LEFT JOIN meta USING (repo)")
def r11_repositories(f):
    return debt.repo_rows(f.commits, f.measures, f.metadata)


@query(f"""WITH {M}, {REPOS} SELECT count(*) AS repos, count(*) FILTER (issues_introduced = 0) AS zero_issues, count(*) FILTER (issues_high > 0) AS with_high, count(*) FILTER (issues_security > 0) AS with_security, count(*) FILTER (issues_per_commit > 5) AS over_5 FROM repos""")
def r12_repo_counts(f):
    return debt.repo_counts(debt.repo_rows(f.commits, f.measures))


@query(f"WITH {M}, {REPOS} SELECT repo, issues_introduced FROM repos ORDER BY issues_introduced DESC, repo LIMIT 15")
def r13_top_repos(f):
    return debt.top_repos(debt.repo_rows(f.commits, f.measures)).select("repo", "issues_introduced")


@query(f"WITH {M} SELECT repo, substr(commit_hash, 1, 12) AS sha12, tool, role, issues, high, security, month FROM m WHERE issues >= 3 ORDER BY high DESC, issues DESC, repo, commit_hash LIMIT 20")
def r14_high_debt_commits(f):
    rows = debt.high_debt_commits(f.measures.withColumn("sha12", F.col("commit_hash")), least=3)
    return rows.withColumn("sha12", F.substring("sha12", 1, 12))


@query(f"WITH {E} SELECT rule_name, count(*) AS n, {SEV} FROM e WHERE is_added AND is_actionable GROUP BY 1 ORDER BY n DESC, rule_name LIMIT 25")
def r15_top_rules(f):
    return debt.rules_by_severity(f.events)


MEDIAN = "max(issues) FILTER (k = n // 2)"


@query(f"""WITH {M}, o AS (SELECT tool, issues, row_number() OVER (PARTITION BY tool ORDER BY issues) - 1 AS k, count(*) OVER (PARTITION BY tool) AS n FROM m), r AS (SELECT tool, role, issues, row_number() OVER (PARTITION BY tool, role ORDER BY issues) - 1 AS k, count(*) OVER (PARTITION BY tool, role) AS n FROM m)
  SELECT tool, {MEDIAN} AS issues_per_commit_median, (SELECT {MEDIAN} FROM r WHERE r.tool = o.tool AND role = 'sole_author') AS sole_median, (SELECT {MEDIAN} FROM r WHERE r.tool = o.tool AND role = 'coauthor') AS co_median,
  (SELECT count(*) FROM m WHERE m.tool = o.tool AND role = 'coauthor') AS co_commits, (SELECT CAST(count(*) FILTER (role = 'sole_author') AS DOUBLE) * 100.0::DOUBLE / count(*) FROM m WHERE m.tool = o.tool) AS pct_sole_author FROM o GROUP BY tool""")
def r16_tool_stats(f):
    s = debt.tool_stats(f.commits, f.measures)
    return s.select("tool", "issues_per_commit_median", F.col("sole_issues_per_commit_median").alias("sole_median"), F.col("co_issues_per_commit_median").alias("co_median"), "co_commits", "pct_sole_author")


@query(by("tool", where="WHERE role = 'coauthor'"))
def r17_role_detail_by_tool(f):
    return debt.role_detail(f.measures, f.events, "coauthor")["by_tool"].drop("issues_per_commit_median")


@query(f"""WITH {M} SELECT (SELECT count(DISTINCT repo) FROM c WHERE NOT is_tainted) AS repos_all, count(DISTINCT CASE WHEN n_files > 0 THEN repo END) AS repos_with_code, (SELECT count(DISTINCT repo) FROM e WHERE is_added AND is_actionable) AS repos_with_issues,
  (SELECT count(DISTINCT substr(commit_hash, 1, 12)) FROM e WHERE is_added AND is_actionable) AS commits_with_issues FROM m""")
def r18_distinct_counts(f):
    return debt.distinct_counts(f.commits, f.measures, f.events)


@query(f"""WITH {E} SELECT family, count(*) FILTER (is_added) AS issues, count(*) FILTER (NOT is_added) AS fixed, count(*) FILTER (is_added) - count(*) FILTER (NOT is_added) AS net, count(DISTINCT CASE WHEN is_added THEN repo END) AS repos,
  count(DISTINCT CASE WHEN is_added THEN substr(commit_hash, 1, 12) END) AS commits FROM e WHERE is_actionable GROUP BY 1""")
def r19_families(f):
    return debt.families(f.events)


@query(f"WITH {E}, g AS (SELECT family, rule_name, count(*) AS n FROM e WHERE is_added AND is_actionable GROUP BY 1, 2) SELECT family, rule_name, n FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, rule_name) AS k FROM g) WHERE k <= 3")
def r20_family_rules(f):
    return debt.family_rules(f.events, 3)


JS = "CASE WHEN lang = 'typescript' THEN 'javascript' ELSE lang END"


@query(f"WITH {E}, g AS (SELECT {JS} AS lang, rule_name, count(*) AS n FROM e WHERE is_added AND is_actionable AND lang <> 'other' GROUP BY 1, 2) SELECT lang, rule_name, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, rule_name) AS k FROM g) WHERE k <= 3")
def r21_language_rules(f):
    return debt.language_rules(f.events, 3)


@query(f"WITH {E} SELECT {JS} AS lang, family, count(*) AS n FROM e WHERE is_added AND is_actionable AND lang <> 'other' GROUP BY 1, 2")
def r22_family_by_language(f):
    return debt.family_by_language(f.events)


WHY = "why AS (SELECT *, coalesce(fp_pattern, CASE WHEN sev = 'low' OR is_low_signal THEN 'low_signal' END) AS why FROM e WHERE is_added)"


@query(f"""WITH {E}, {WHY}, a AS (SELECT count(*) AS total, count(*) FILTER (fp_pattern IS NOT NULL) AS likely_false_positive, count(*) FILTER (why = 'low_signal') AS low_signal FROM why), b AS (SELECT *, likely_false_positive + low_signal AS filtered_total FROM a),
  d AS (SELECT *, greatest(0, total - filtered_total) AS visible FROM b) SELECT *, {part('filtered_total', 'total', 'filtered_rate', 100)}, {part('visible', 'total', 'visible_rate', 100)} FROM d""")
def r23_filter_summary(f):
    return debt.filter_summary(f.events)


@query(f"""WITH {E}, {WHY}, g AS (SELECT fp_pattern AS pattern, rule_name, count(*) AS n FROM why WHERE fp_pattern IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, rule_name) AS k FROM g)
  SELECT pattern, {big('sum(n)', 'n')}, CAST(sum(n) AS DOUBLE) * 100.0::DOUBLE / (SELECT count(*) FROM why) AS share_pct, string_agg(rule_name || ':' || n, ',' ORDER BY k) FILTER (k <= 5) AS top_rules,
  CASE pattern WHEN 'embedded_env' THEN 'a/dist-packages/m.py' ELSE 'scripts/run.py' END AS samples FROM k GROUP BY 1""")
def r24_filter_patterns(f):
    return debt.filter_patterns(f.events).select("pattern", "n", "share_pct", F.array_join("top_rules", ",").alias("top_rules"), F.array_join("samples", ",").alias("samples"))


@query(f"""WITH {E}, {WHY}, g AS (SELECT rule_name, count(*) AS n, array_to_string(list_sort(list_distinct(list(file_path)))[1:5], ',') AS samples FROM why WHERE why = 'low_signal' GROUP BY 1 ORDER BY n DESC, rule_name LIMIT 15)
  SELECT rule_name, n, CAST(n AS DOUBLE) * 100.0::DOUBLE / (SELECT count(*) FROM why) AS share_pct, CAST(n AS DOUBLE) * 100.0::DOUBLE / (SELECT count(*) FROM why WHERE why IS NOT NULL) AS filtered_share_pct, samples FROM g""")
def r25_low_signal_rules(f):
    return debt.low_signal_rules(f.events).withColumn("samples", F.array_join("samples", ","))


FAM = ", ".join(f"count(*) FILTER (family = '{x}') AS {x}" for x in ("bug", "code_smell", "security"))
RF = f"""rf AS (SELECT repo, commits, coalesce(bug, 0) AS bug, coalesce(code_smell, 0) AS code_smell, coalesce(security, 0) AS security FROM (SELECT repo, count(*) AS commits FROM m GROUP BY 1 HAVING bool_or(n_files > 0)) LEFT JOIN
  (SELECT repo, {FAM} FROM e WHERE is_added AND is_actionable GROUP BY 1) USING (repo)), j AS (SELECT rf.*, stars, language FROM rf LEFT JOIN meta USING (repo))"""
RFS = f"count(*) AS repos, {', '.join(big(f'sum({c})', c) for c in ('commits', 'bug', 'code_smell', 'security'))}"
RFR = f"{', '.join(part(x, 'commits', f'{x}_per_commit') for x in ('bug', 'code_smell', 'security'))}, {part('bug + code_smell + security', 'commits', 'total_per_commit')}".replace("CAST(bug + code_smell + security AS DOUBLE)", "CAST((bug + code_smell + security) AS DOUBLE)")


@query(f"""WITH {M}, {META}, {RF}, g AS (SELECT CASE {' '.join(f"WHEN stars >= {a} AND stars < {b} THEN '{n}'" for n, a, b in debt.STAR_RANGES)} END AS label, {RFS} FROM j GROUP BY 1) SELECT *, {RFR} FROM g WHERE label IS NOT NULL""")
def r26_star_ranges(f):
    return debt.star_ranges(f.measures, f.events, f.metadata)


@query(f"WITH {M}, {META}, {RF}, g AS (SELECT CASE WHEN language IN ('Python', 'Go', 'Rust', 'TypeScript') THEN language ELSE 'Other' END AS language, {RFS} FROM j GROUP BY 1) SELECT *, {RFR} FROM g WHERE repos >= 6")
def r27_language_rollup(f):
    return debt.language_rollup(f.measures, f.events, f.metadata, 6)


@query("""WITH f AS (SELECT o_orderkey % 50 AS g, o_orderkey % 8 AS p, o_orderkey % 11 = 0 AS d FROM orders)
  SELECT CAST(g AS VARCHAR) AS commit_hash, count(*) AS files_total, count(*) FILTER (d) AS deleted, count(*) FILTER (NOT d AND p = 3) AS noise, count(*) FILTER (NOT d AND p = 6) AS non_code, count(*) FILTER (NOT d AND p = 7) AS unsupported_language,
  count(*) FILTER (NOT d AND p IN (0, 1, 2, 4, 5)) AS left_to_analyze FROM f GROUP BY 1""")
def r28_skip_counts(f):
    o = f.t("orders")
    files = o.select(F.lit("r").alias("repo"), (F.col("o_orderkey") % 50).cast("string").alias("commit_hash"), _pick(F.col("o_orderkey") % 8, PATHS).alias("path"), F.when(F.col("o_orderkey") % 11 == 0, "D").otherwise("M").alias("status"))
    return debt.skip_counts(files).select("commit_hash", "files_total", "deleted", "noise", "non_code", "unsupported_language", "left_to_analyze")


@query(f"""WITH {E} SELECT commit_hash, count(*) FILTER (is_added) AS introduced, count(*) FILTER (NOT is_added) AS fixed, count(*) FILTER (is_added) - count(*) FILTER (NOT is_added) AS net_change, count(*) FILTER (NOT is_added) > count(*) FILTER (is_added) AS quality_improved,
  count(*) FILTER (is_added AND kind = 'pylint') AS pylint, count(*) FILTER (is_added AND s = 0) AS errors FROM e GROUP BY 1""")
def r29_commit_summary(f):
    s = debt.commit_summary(f.events)
    at = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0).cast("long"))
    return s.select("commit_hash", "introduced", "fixed", "net_change", "quality_improved", at("by_type", "pylint").alias("pylint"), at("by_severity", "error").alias("errors"))


def _line():
    """A number that a commit's finding shares only with one of the same rule."""
    return F.hash("line", "file_no", F.coalesce("symbol", "rule", "rule_id"))


def entries(f) -> DataFrame:
    """Each added finding of a commit with an even number is tracked; it survives if its own number is even. What it says of its rule is merely the type."""
    rows = f.rows.where("phase = 'added'").where((F.col("commit_hash").cast("long") % 2 == 0) & ~(F.col("commit_hash").cast("long") % 97 == 0))
    none = F.lit(None).cast("string")
    return rows.select(
        "repo", F.lit(0).alias("ord"), (F.col("file_no") % 2 == 0).alias("survived"), F.col("commit_hash").alias("commit_sha"), "file_path", "type", "severity", none.alias("symbol"), none.alias("rule"), F.col("type").alias("rule_id"), "message",
        none.alias("category"), none.alias("detected_by"), F.lit(None).cast("struct<is_test:boolean,is_simulation:boolean,is_dev:boolean>").alias("filter_context"), _line().alias("line"),
    )


def tracked(f) -> DataFrame:
    added = f.rows.where("phase = 'added'").withColumn("line", _line())
    return survival.tracked(survival.hydrated(entries(f), added))


# Tracked: as the actionable ones, but paths (noise or likely false positives) play no part.
S = f"""{C}, y AS (SELECT c.*, l_suppkey % 8 AS p, l_partkey % 9 AS r, l_returnflag AS fl, CASE l_linenumber % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'CONVENTION' END AS sev, l_linenumber % 2 = 0 AS survived FROM lineitem JOIN c ON l_orderkey = o_orderkey
  WHERE l_linestatus = 'F' AND o_orderkey % 2 = 0 AND NOT is_tainted), s AS (SELECT *, {_case('r', RULES)} AS rule_name, CASE WHEN fl = 'R' OR r = 4 THEN 'security' WHEN r = 0 THEN 'bug' ELSE 'code_smell' END AS family FROM y WHERE r NOT IN (1, 2, 5, 8) AND NOT (r = 7 AND p = 6))"""
SURV = f"count(*) AS total, count(*) FILTER (survived) AS surviving, count(*) - count(*) FILTER (survived) AS fixed, {part('count(*) FILTER (survived)', 'count(*)', 'rate')}"


@query(f"WITH {S} SELECT sev, family, rule_name, {SURV} FROM s GROUP BY 1, 2, 3")
def r30_survival(f):
    return survival.summary(tracked(f), "sev", "family", "rule_name")


@query(f"WITH {S} SELECT rule_name, {SURV} FROM s GROUP BY 1 ORDER BY surviving DESC, rule_name LIMIT 3")
def r31_top_surviving_rules(f):
    return survival.top_surviving_rules(tracked(f), 3)


@query(f"""WITH {S}, d AS (SELECT repo, tool FROM (SELECT repo, tool, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, tool) AS k FROM c WHERE NOT is_tainted GROUP BY 1, 2) WHERE k = 1)
  SELECT d.tool, count(*) AS total, count(*) FILTER (survived) AS surviving, {part('count(*) FILTER (survived)', 'count(*)', 'rate')} FROM s JOIN d USING (repo) GROUP BY 1 HAVING count(*) >= 10""")
def r32_survival_by_dominant_tool(f):
    return survival.by_dominant_tool(tracked(f), f.measures)


def dates(f) -> DataFrame:
    # The hash's first twelve characters say too little here, so the join is by the whole of it.
    return f.commits.select(F.col("commit_hash").alias("sha12"), "month")


def cohorts(f) -> DataFrame:
    rows = tracked(f).withColumn("sha12", F.col("commit_sha"))
    return rows.join(dates(f), "sha12")


@query(f"""WITH {S}, g AS (SELECT month, family, count(*) AS total, count(*) FILTER (survived) AS surviving FROM s GROUP BY 1, 2), grid AS (SELECT DISTINCT month, f AS family FROM s, (SELECT unnest(['bug', 'code_smell', 'security']) AS f)),
  h AS (SELECT month, family, coalesce(total, 0) AS total, coalesce(surviving, 0) AS surviving FROM grid LEFT JOIN g USING (month, family)),
  k AS (SELECT *, {big('sum(total) OVER w', 'cum_total')}, {big('sum(surviving) OVER w', 'cum_surviving')} FROM h WINDOW w AS (PARTITION BY family ORDER BY month)) SELECT *, {part('surviving', 'total', 'monthly_rate')}, {part('cum_surviving', 'cum_total', 'cum_rate')} FROM k""")
def r33_survival_over_time(f):
    return survival.over_time(cohorts(f), family=True)


@query(f"""WITH {S}, g AS (SELECT month, count(*) AS total, count(*) FILTER (survived) AS surviving FROM s GROUP BY 1), n AS (SELECT month, count(*) AS commits FROM c GROUP BY 1),
  a AS (SELECT (1998 * 12 + 8) - (CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 6, 2) AS INTEGER)) AS age, total, surviving, commits FROM g JOIN n USING (month)),
  b AS (SELECT CASE {' '.join(f"WHEN age >= {x} AND age < {y} THEN '{n}'" for n, x, y in survival.AGES)} END AS label, * FROM a), l AS (SELECT unnest(['{"', '".join(n for n, _, _ in survival.AGES)}']) AS label)
  SELECT label, {big('coalesce(sum(total), 0)', 'total')}, {big('coalesce(sum(surviving), 0)', 'surviving')}, {big('coalesce(sum(commits), 0)', 'commits')}, {big('coalesce(sum(total) - sum(surviving), 0)', 'fixed')}, {part('sum(surviving)', 'sum(total)', 'rate')}, {part('sum(surviving)', 'sum(commits)', 'per_100_commits', 100)} FROM l LEFT JOIN b USING (label) GROUP BY 1""")
def r34_survival_by_age(f):
    per = f.commits.groupBy("month").agg(F.count("*").alias("commits"))
    return survival.by_age(cohorts(f), per, "1998-08")


@query(f"""WITH {S}, g AS (SELECT repo, CAST(count(*) FILTER (survived) AS DOUBLE) / count(*) AS rate FROM s GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY rate) - 1 AS k, count(*) OVER () AS n FROM g)
  SELECT max(n) AS n, min(rate) AS least, max(rate) AS most, max(rate) FILTER (k = n // 2) AS median, max(rate) FILTER (k = n // 4) AS p25, max(rate) FILTER (k = 3 * n // 4) AS p75 FROM k""")
def r35_survival_distribution(f):
    return survival.list_stats(survival.per_repo_rates(tracked(f)), "rate").drop("mean")


@query(f"WITH {S} SELECT CASE sev WHEN 'ERROR' THEN 'high' WHEN 'WARNING' THEN 'medium' ELSE 'low' END AS sev, {SURV} FROM s GROUP BY 1")
def r36_survival_buckets(f):
    return display.survival_buckets(survival.summary(tracked(f), "sev"))


def lifecycle_files(f) -> DataFrame:
    o = f.t("orders")
    return o.select(
        F.concat(F.lit("f"), (F.col("o_custkey") % 200).cast("string")).alias("filepath"), _map("o_orderstatus", {"F": "MODIFIED", "O": "SURVIVED", "P": "DELETED"}).alias("status"), (F.col("o_orderkey") % 5).cast("int").alias("num_changes"),
        (F.col("o_orderkey") % 7 == 0).alias("was_fixed"), (F.col("o_orderkey") % 1000 == 0).alias("was_refactored"), (F.col("o_orderkey") % 30).cast("double").alias("days_to_first_change"),
    )


LIFE = """l AS (SELECT 'f' || (o_custkey % 200) AS path, o_orderstatus AS s, o_orderkey % 5 AS n, o_orderkey % 7 = 0 AS fixed, o_orderkey % 1000 = 0 AS refactored, CAST(o_orderkey % 30 AS DOUBLE) AS d FROM orders),
  fm AS (SELECT path, CAST(sum(n) AS BIGINT) AS num_changes, count(*) AS commit_count, bool_or(fixed) AS was_fixed, bool_or(refactored) AS was_refactored, min(d) FILTER (d > 0) AS days_to_first_change,
  CASE WHEN bool_or(s = 'P') THEN 'DELETED' WHEN bool_or(s = 'F') THEN 'MODIFIED' ELSE 'SURVIVED' END AS status FROM l GROUP BY 1)"""


@query(f"WITH {LIFE} SELECT * FROM fm")
def r37_file_map(f):
    return display.file_map(lifecycle_files(f))


@query(f"WITH {LIFE} SELECT path, num_changes FROM fm WHERE num_changes > 0 OR status = 'DELETED' ORDER BY num_changes DESC, path LIMIT 30")
def r38_most_changed_files(f):
    return display.most_changed(display.file_map(lifecycle_files(f))).select("path", "num_changes")


@query("SELECT count(*) AS total_files, count(*) FILTER (o_orderstatus = 'O') AS survived, count(*) FILTER (o_orderstatus = 'F') AS modified, count(*) FILTER (o_orderstatus = 'P') AS deleted, count(*) FILTER (o_orderkey % 7 = 0) AS had_fixes, count(*) FILTER (o_orderkey % 1000 = 0) AS refactored FROM orders")
def r39_file_lifecycle(f):
    return survival.file_lifecycle(lifecycle_files(f))


@query(f"WITH {E}, g AS (SELECT CASE r WHEN 0 THEN 'undefined-reference' WHEN 8 THEN 'undefined-reference' ELSE rule_name END AS key, rule_name, sev FROM e WHERE is_added) SELECT key, count(DISTINCT rule_name) AS raw_rules, count(*) AS count, {SEV} FROM g GROUP BY 1 ORDER BY count DESC, key LIMIT 10")
def r40_merged_rules(f):
    rows = debt.added(f.events).groupBy("rule_name").agg(F.count("*").alias("count"), *[F.count_if(F.col("sev") == s).alias(s) for s in ("high", "medium", "low")])
    return display.merged_rules(rows).select("key", "raw_rules", "count", "high", "medium", "low")


@query(f"""WITH {M}, g AS (SELECT tool, count(*) AS commits, count(DISTINCT repo) AS repos, count(DISTINCT CASE WHEN n_files > 2 THEN repo END) AS repos_with_code FROM m GROUP BY 1), u AS (SELECT * FROM g UNION ALL SELECT 'Total', CAST(sum(commits) AS BIGINT), CAST(sum(repos) AS BIGINT), CAST(sum(repos_with_code) AS BIGINT) FROM g)
  SELECT *, {part('repos_with_code', 'repos', 'coverage_pct', 100)}, CAST(commits AS DOUBLE) * 100.0::DOUBLE / (SELECT commits FROM u WHERE tool = 'Total') AS commit_share_pct FROM u""")
def r41_coverage_with_total(f):
    g = f.measures.groupBy("tool").agg(F.count("*").alias("commits"), F.count_distinct("repo").alias("repos"), F.count_distinct(F.when(F.col("n_files") > 2, F.col("repo"))).alias("repos_with_code"))
    return display.coverage(g)


@query(f"WITH {M}, g AS (SELECT tool, {part('sum(issues)', 'count(*)', 'rate')} FROM m GROUP BY 1) SELECT *, rate = (SELECT min(rate) FROM g) AS is_best, rate = (SELECT max(rate) FROM g) AS is_worst FROM g")
def r42_best_and_worst_tool(f):
    return display.extremes(debt.tool_ranking(f.measures), "rate")


@query(f"WITH {M} SELECT tool, count(*) AS total FROM m GROUP BY 1 ORDER BY total DESC, tool LIMIT 3")
def r43_top_tools_of_wide_months(f):
    return display.top_tools(debt.monthly_wide(f.measures, sorted(TOOLS.values())), 3)


VISIBLE = f"""{C}, v AS (SELECT c.*, l_suppkey % 8 AS p, l_partkey % 9 AS r, l_returnflag AS fl, l_linenumber % 3 AS s, l_linestatus = 'F' AS is_added, l_linenumber FROM lineitem JOIN c ON l_orderkey = o_orderkey
  WHERE NOT (l_partkey % 9 IN (2, 5)) AND l_linenumber % 3 <> 2 AND NOT (l_partkey % 9 = 7 AND l_suppkey % 8 = 6) AND NOT (l_partkey % 9 = 8 AND l_suppkey % 8 IN (1, 2, 3)))"""


@query(f"WITH {VISIBLE} SELECT c.commit_hash, count(v.p) FILTER (v.is_added) AS introduced, count(v.p) FILTER (NOT v.is_added) AS fixed FROM c LEFT JOIN v USING (commit_hash) GROUP BY 1")
def r44_visible_counts(f):
    return display.commit_counts(display.visible(f.rows.drop("tool")), f.commits).select("commit_hash", "introduced", "fixed")


@query(f"""WITH {VISIBLE}, k AS (SELECT c.repo, c.commit_hash, count(v.p) FILTER (v.is_added) - count(v.p) FILTER (NOT v.is_added) AS net, count(v.p) FILTER (v.is_added) AS introduced, count(v.p) FILTER (NOT v.is_added) AS fixed FROM c LEFT JOIN v USING (commit_hash) GROUP BY 1, 2),
  q AS (SELECT *, sum(net) OVER (PARTITION BY repo ORDER BY commit_hash) AS cum FROM k) SELECT repo, {big('sum(introduced)', 'introduced')}, {big('sum(fixed)', 'fixed')}, {big('max(cum)', 'peak')}, {big('max_by(cum, commit_hash)', 'final')} FROM q GROUP BY 1""")
def r45_net_debt(f):
    counts_ = display.commit_counts(display.visible(f.rows.drop("tool")), f.commits)
    return display.debt_peaks(display.net_debt(counts_, ["commit_hash"]), ["commit_hash"])


@query(f"WITH {VISIBLE} SELECT commit_hash, count(*) AS count FROM v WHERE is_added AND s = 0 GROUP BY 1 ORDER BY count DESC, min(repo), commit_hash LIMIT 8")
def r46_hotspots(f):
    return display.hotspots(display.visible(f.rows))["commits"].select("commit_hash", "count")


@query(f"""WITH {M}, {META}, {REPOS} SELECT repo, issues_introduced FROM repos JOIN meta USING (repo) WHERE issues_high > 0 AND stars >= 1000 AND issues_coauthor > 0 AND repo LIKE '%r2%' ORDER BY issues_introduced DESC, repo LIMIT 5 OFFSET 5""")
def r47_repo_page(f):
    rows = debt.repo_rows(f.commits, f.measures, f.metadata)
    return display.repo_page(rows, "high", 1000, "coauthor", " R2", number=1, size=5).select("repo", "issues_introduced")


@query(f"WITH {M}, g AS (SELECT month, {big('sum(issues)', 'issues')} FROM m GROUP BY 1) SELECT month, issues, {big('sum(issues) OVER (ORDER BY month)', 'cumulative')} FROM g")
def r48_cumulative_issues(f):
    return display.cumulative_issues(debt.monthly(f.measures).select("month", "issues"))


@query(f"""WITH {VISIBLE}, k AS (SELECT c.commit_hash, c.tool, c.role, count(v.p) FILTER (v.is_added) AS introduced FROM c LEFT JOIN v USING (commit_hash) GROUP BY 1, 2, 3)
  SELECT tool, count(*) AS commits, {big('sum(introduced)', 'introduced')}, {big("coalesce(sum(introduced) FILTER (role = 'sole_author'), 0)", 'sole')}, {big("coalesce(sum(introduced) FILTER (role <> 'sole_author'), 0)", 'other')} FROM k GROUP BY 1""")
def r49_tool_role_counts(f):
    return display.tool_role_counts(display.commit_counts(display.visible(f.rows.drop("tool")), f.commits))


def destiny_rows(f) -> DataFrame:
    """Orders as commits whose lines and units were looked up later on."""
    k = F.col("o_orderkey")
    return f.t("orders").select(
        _map("o_orderstatus", {"F": "HIGH", "O": "MEDIUM"}).alias("developer_valuation"), (k % 4).alias("total_lines_added"), ((k % 5) / 4.0).alias("survival_rate"), (k % 3).alias("semantic_units_original"), ((k % 3) / 2.0).alias("semantic_survival_rate"), _map("o_orderpriority", TOOLS).alias("tool"),
    )


@query("SELECT v AS valuation, count(o_orderkey) AS n FROM (SELECT unnest(['HIGH', 'MEDIUM', 'LOW']) AS v) LEFT JOIN orders ON v = CASE o_orderstatus WHEN 'F' THEN 'HIGH' WHEN 'O' THEN 'MEDIUM' ELSE 'LOW' END GROUP BY 1")
def r50_valuation_histogram(f):
    return display.valuation_histogram(destiny_rows(f))


@query("""SELECT avg((o_orderkey % 5) / 4.0::DOUBLE) FILTER (o_orderkey % 4 > 0) AS line_survival, count(*) FILTER (o_orderkey % 4 > 0) AS commits_with_lines, avg((o_orderkey % 3) / 2.0::DOUBLE) FILTER (o_orderkey % 3 > 0) AS unit_survival, count(*) FILTER (o_orderkey % 3 > 0) AS commits_with_units FROM orders""")
def r51_mean_survival(f):
    return display.mean_survival(destiny_rows(f))


def _by_rule(f) -> DataFrame:
    return debt.added(f.events).groupBy("rule_name").agg(F.count("*").alias("count"), *[F.count_if(F.col("sev") == s).alias(s) for s in ("high", "medium", "low")], F.min("family").alias("family"))


@query(f"WITH {E} SELECT array_to_string(list_sort(list(DISTINCT rule_name)), ',') AS raw FROM e WHERE is_added AND r IN (0, 8) HAVING count(DISTINCT rule_name) > 1")
def r52_merged_notes(f):
    return display.merged_notes(_by_rule(f)).select(F.array_join("raw", ",").alias("raw"))


@query(f"WITH {E} SELECT count(DISTINCT r) AS raw_rules, count(DISTINCT CASE r WHEN 8 THEN 0 ELSE r END) AS concepts, count(DISTINCT CASE WHEN is_security THEN r END) AS security_rules FROM e WHERE is_added AND family = CASE WHEN is_security THEN 'security' ELSE family END")
def r53_rule_counts(f):
    rows = debt.added(f.events).select("rule_name", F.when(F.col("is_security"), "security").otherwise("other").alias("family"))
    return display.rule_counts(rows)


@query(f"WITH {E}, g AS (SELECT CASE r WHEN 0 THEN 'undefined-reference' WHEN 8 THEN 'undefined-reference' ELSE rule_name END AS key, sev FROM e WHERE is_added) SELECT key, count(*) AS count, {SEV} FROM g GROUP BY 1 ORDER BY medium DESC, key LIMIT 5")
def r54_rules_by_medium(f):
    return display.rankings(_by_rule(f), 5)["medium"].select("key", "count", "high", "medium", "low")


@query(f"WITH {E}, g AS (SELECT rule_name, count(*) FILTER (sev = 'high') AS count FROM e WHERE is_added GROUP BY 1) SELECT rule_name, count FROM g WHERE count > 0")
def r55_rules_of_high_severity(f):
    return display.of_severity(_by_rule(f), "high").select("rule_name", "count")


@query(f"WITH {M}, {REPOS} SELECT repo, issues_coauthor FROM repos WHERE issues_coauthor > 0 ORDER BY issues_coauthor DESC, repo LIMIT 12")
def r56_notable_repos_of_a_role(f):
    return display.notable(debt.repo_rows(f.commits, f.measures), "issues_coauthor").select("repo", "issues_coauthor")


@query("""WITH x AS (SELECT 'org/r' || (o_custkey % 40) AS repo, l_linenumber % 3 = 0 AS high, l_linenumber % 3 = 1 OR (l_linenumber % 3 = 2 AND l_returnflag = 'N') AS medium FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT repo, count(*) FILTER (high) AS high, count(*) FILTER (medium) AS medium, count(*) FILTER (NOT high AND NOT medium) AS low FROM x GROUP BY 1""")
def r57_severity_mini(f):
    return display.severity_mini(f.rows, "repo")


# Of the survival entries, what the display shows: no low severity, nothing that is blocked or of low signal there.
SHOWN = f"""{C}, y AS (SELECT c.*, l_suppkey % 8 AS p, l_partkey % 9 AS r, CASE l_linenumber % 3 WHEN 0 THEN 'ERROR' ELSE 'WARNING' END AS sev, l_linenumber % 2 = 0 AS survived FROM lineitem JOIN c ON l_orderkey = o_orderkey
  WHERE l_linestatus = 'F' AND o_orderkey % 2 = 0 AND NOT is_tainted AND l_linenumber % 3 <> 2 AND NOT (l_partkey % 9 IN (2, 5)) AND NOT (l_partkey % 9 = 7 AND l_suppkey % 8 = 6) AND NOT (l_partkey % 9 = 8 AND l_suppkey % 8 IN (1, 2, 3))),
  w AS (SELECT *, {_case('r', RULES)} AS rule_name FROM y)"""


def hydrated(f) -> DataFrame:
    return survival.hydrated(entries(f), f.rows.where("phase = 'added'").withColumn("line", _line()))


@query(f"WITH {SHOWN} SELECT rule_name, {SURV} FROM w GROUP BY 1 ORDER BY total DESC, rule_name LIMIT 10")
def r58_shown_survival_by_rule(f):
    return display.survival_summary(hydrated(f))["by_rule"]


@query(f"WITH {SHOWN} SELECT sev, {SURV} FROM w GROUP BY 1")
def r59_shown_survival_by_severity(f):
    return display.survival_summary(hydrated(f))["by_severity"]


@query(f"""WITH {M}, l AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 16, '0') AS commit_hash, o_orderkey % 3 AS s FROM orders)
  SELECT m.commit_hash AS commit_sha, repo, tool AS ai_tool, n_files AS files_analyzed, issues AS issues_introduced, fixed AS issues_fixed, issues - fixed AS net_change, CASE WHEN l.s = 0 THEN 1 ELSE 0 END AS files_survived, CASE WHEN l.s = 1 THEN 1 ELSE 0 END AS files_modified FROM m JOIN l USING (commit_hash)""")
def r60_export_rows(f):
    """What the CSV holds; the hash's first twelve characters say too little here, so its last ones come first."""
    turn = lambda c: F.reverse(F.col(c))
    counts_ = f.measures.withColumn("commit_hash", turn("commit_hash")).withColumn("introduced", F.col("issues"))
    life = f.commits.select("repo", F.substring(turn("commit_hash"), 1, 12).alias("sha12"), _pick(F.col("commit_hash").cast("long") % 3, ["SURVIVED", "MODIFIED", "DELETED"]).alias("status"))
    none = f.commits.select("repo", turn("commit_hash").alias("commit_sha"), F.lit(None).cast("double").alias("survival_rate")).where("1 = 0")
    out = display.export_rows(counts_, life, none)
    return out.withColumn("commit_sha", F.lpad(F.reverse("commit_sha"), 16, "0")).drop("survival_rate").withColumns({c: F.col(c).cast("int") for c in ("files_survived", "files_modified")})


@query(f"""WITH p AS (SELECT l_suppkey % 8 AS i, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT {_case('i', PATHS)} AS path, n, i IN (0, 1, 2, 4, 5, 7) AS in_lifecycle, i IN (0, 1, 2, 4, 5, 7) AS in_destiny, i = 6 AS is_test, i = 4 AS is_dev FROM p""")
def r61_path_filters(f):
    """Which files are followed, which are tests and which tools of developers."""
    from codequarry.functions import paths, rules

    p = F.col("path")
    rows = f.t("lineitem").groupBy(_pick(F.col("l_suppkey") % 8, PATHS).alias("path")).agg(F.count("*").alias("n"))
    return rows.select("path", "n", paths.in_lifecycle(p).alias("in_lifecycle"), paths.in_destiny(p).alias("in_destiny"), rules.is_test_file(p).alias("is_test"), rules.is_dev_tool(F.concat(F.lit("pkg/"), p)).alias("is_dev"))


@query("SELECT o_orderkey AS k, o_custkey % 400 > 200 AND o_custkey % 400 > 0 AND o_orderpriority = '1-URGENT' AS is_tainted FROM orders")
def r62_tainted_commits(f):
    """A commit of over 200 files, all of them new."""
    from codequarry.functions import issues

    n = F.col("o_custkey") % 400
    status = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("A"), F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("M")))
    return f.t("orders").select(F.col("o_orderkey").alias("k"), issues.is_tainted(n, status).alias("is_tainted"))
