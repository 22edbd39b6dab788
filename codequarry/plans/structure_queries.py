"""Queries on the structure of sources and histories: units, nesting, complexity, reachability, and captured text of tools; with SQL for each.

The driver's tables hold no source code, so sources are written from them, line by line of every document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import code
from codequarry.operators import graph, units
from codequarry.plans.catalog import catalog
from codequarry.tables import written

QUERIES, SQL, query = catalog()
_LINES = "l AS (SELECT doc_id AS d, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents)"


def _lines(t):
    """doc_id, i (from 0), x: every line of every document."""
    return t("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "x"))


def _joined(rows, line, name: str):
    """doc_id and the text of its lines, in order; null lines are left out."""
    parts = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("i", line.alias("line")))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias(name))


def _versions(t):
    """doc_id, path, original, current: a function for each line with a word; the later version lacks some, and has others with another body, name or parameter."""
    word, i = F.regexp_extract("x", "([a-z]+)", 1), F.col("i")
    rows = _lines(t).withColumn("w", word).where("w <> ''")
    define = lambda prefix, params, body: F.concat(F.lit("def "), prefix, F.lit("_"), F.col("w"), F.lit("("), params, F.lit("):\n    return "), body.cast("string"))
    size = F.length("x") % 3
    old = define(F.lit("f"), F.lit("a"), size)
    new = F.when(i % 5 != 1, define(F.when(i % 7 == 3, "g").otherwise("f"), F.when(i % 6 == 4, "a,b").otherwise("a"), F.when(i % 4 == 2, 9).otherwise(size)))
    both = _joined(rows, old, "original").join(_joined(rows, new, "current"), "doc_id")
    return both.select("doc_id", F.lit("d.py").alias("path"), "original", "current")


_VERSIONS = f"""{_LINES}, w AS (SELECT d, i, length(x) % 3 AS body, regexp_extract(x, '[a-z]+') AS w FROM l WHERE regexp_extract(x, '[a-z]+') <> ''),
  b AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY i) - 1 AS ord, 'f_' || w AS name, 'a' AS sig, body FROM w),
  a AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY i) - 1 AS ord, CASE WHEN i % 7 = 3 THEN 'g_' ELSE 'f_' END || w AS name, CASE WHEN i % 6 = 4 THEN 'a,b' ELSE 'a' END AS sig, CASE WHEN i % 4 = 2 THEN 9 ELSE body END AS body FROM w WHERE i % 5 <> 1)"""


@query(f"""WITH RECURSIVE {_VERSIONS},
  names AS (SELECT DISTINCT d, name FROM a), last AS (SELECT d, name, sig, max_by(body, ord) AS body FROM a GROUP BY ALL), since AS (SELECT d, name, min(ord) AS since FROM b SEMI JOIN names USING (d, name) GROUP BY ALL),
  kept AS (SELECT b.d, b.ord, CASE WHEN last.body = b.body THEN 'survived' ELSE 'modified' END AS fate, b.name AS new_name FROM b SEMI JOIN names USING (d, name) LEFT JOIN last ON last.d = b.d AND last.name = b.name AND last.sig = b.sig),
  g AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ord) AS k FROM b ANTI JOIN names USING (d, name)),
  have AS (SELECT a.d, list({{'name': a.name, 'body': a.body, 'since': since.since}} ORDER BY a.ord) AS have FROM a LEFT JOIN since ON since.d = a.d AND since.name = a.name GROUP BY a.d),
  s AS (SELECT DISTINCT d, 0::BIGINT AS k, []::VARCHAR[] AS taken, NULL::BIGINT AS ord, NULL::VARCHAR AS new_name FROM b
    UNION ALL SELECT d, k, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p) END, ord, p FROM (SELECT s.d, g.k, s.taken, g.ord, list_filter(have.have, lambda c: c.body = g.body AND NOT coalesce(c.since < g.ord, false) AND NOT list_contains(s.taken, c.name))[1].name AS p
      FROM s JOIN g ON g.d = s.d AND g.k = s.k + 1 LEFT JOIN have ON have.d = s.d)),
  fates AS (SELECT d, ord, fate, new_name FROM kept UNION ALL SELECT d, ord, CASE WHEN new_name IS NULL THEN 'deleted' ELSE 'renamed' END, new_name FROM s WHERE k > 0),
  new AS (SELECT a.d, count(*) AS n FROM a WHERE (a.d, a.name) NOT IN (SELECT d, new_name FROM fates WHERE new_name IS NOT NULL) GROUP BY 1)
  SELECT f.d AS doc_id, count(*)::INTEGER AS original_units, count(*) FILTER (fate IN ('survived', 'renamed'))::INTEGER AS surviving_units, count(*) FILTER (fate = 'modified')::INTEGER AS modified_units, count(*) FILTER (fate = 'deleted')::INTEGER AS deleted_units,
  coalesce(max(new.n), 0)::INTEGER AS new_units, array_to_string(list(f.new_name ORDER BY f.ord) FILTER (fate = 'renamed'), ',') AS heirs FROM fates f LEFT JOIN new ON new.d = f.d GROUP BY f.d""")
def s01_unit_survival(t):
    """How the functions of two versions of a source fare, by joins of units."""
    files = _versions(t)
    found = lambda c: units.extract_units(files.withColumn("language", F.lit("python")), ["doc_id"], c)
    # Sources are parsed once, and compared once.
    before, after = written(found("original"), "units-before"), written(found("current"), "units-after")
    fates = written(units.unit_changes(before, after, ["doc_id"]), "unit-fates")
    heirs = fates.where("fate = 'renamed'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "new_name"))), lambda x: x["new_name"]), ",").alias("heirs"))
    return units.unit_survival(before, after, ["doc_id"], fates).join(heirs, "doc_id", "left").select("doc_id", "original_units", "surviving_units", "modified_units", "deleted_units", "new_units", "heirs")


@query(f"WITH {_VERSIONS} SELECT d AS doc_id, count(*) AS n, max(ord)::INTEGER AS last_ord, max(2 * ord + 2)::INTEGER AS last_line, count(DISTINCT name) AS names, count(*) FILTER (sig = 'a,b') AS pairs FROM a GROUP BY 1")
def s02_units_by_lateral_sql(t):
    """Units of a table function in SQL."""
    files = _versions(t).select("doc_id", F.col("current").alias("content"))
    spark = files.sparkSession
    units.register(spark)
    return spark.sql(
        "SELECT doc_id, count(*) AS n, max(ord) AS last_ord, max(line_end) AS last_line, count(DISTINCT name) AS names, count_if(signature = 'a,b') AS pairs FROM {files}, LATERAL source_units(content, 'python') GROUP BY doc_id", files=files
    )


#: Lines of a made-up source, by a number from 0.
_KINDS = ("for x in y:", "while x:", "if a&&b:", "else:", "break", "def f():", "f(1)", "# if x", "", "foreach (z) { [q for q in r] }")


def _sources(t):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.length("x") % len(_KINDS) + 1).cast("int"))
    return _joined(_lines(t), F.concat(F.repeat(F.lit(" "), F.length("x") % 5), kind), "source")


# What each kind of line adds: (loop, flat, deep, opens) and, in Python, (head, flat, defines, calls itself); null lines are skipped.
_NESTING = f"""WITH RECURSIVE {_LINES}, f AS (SELECT *, length(x) % {len(_KINDS)} AS k, length(x) % 5 AS depth FROM l),
  s AS (SELECT DISTINCT d, -1::BIGINT AS i, []::BIGINT[] AS loops, 0::BIGINT AS nested, []::BIGINT[] AS open, 0::BIGINT AS cc, 0::BIGINT AS heads, false AS named, 0::BIGINT AS script FROM f
    UNION ALL SELECT f.d, f.i,
      CASE WHEN k IN (0, 1, 9) THEN list_append(list_filter(s.loops, lambda y: y < depth), depth) ELSE s.loops END,
      s.nested + CASE WHEN k IN (0, 1, 9) AND len(list_filter(s.loops, lambda y: y < depth)) > 0 THEN 1 ELSE 0 END,
      CASE WHEN k IN (7, 8) THEN s.open WHEN k IN (0, 1, 2, 5, 9) THEN list_append(list_filter(s.open, lambda y: y < depth), depth) ELSE list_filter(s.open, lambda y: y < depth) END,
      s.cc + CASE WHEN k IN (0, 1, 9) THEN 1 + len(list_filter(s.open, lambda y: y < depth)) WHEN k = 2 THEN 2 + len(list_filter(s.open, lambda y: y < depth)) WHEN k IN (3, 4) THEN 1 ELSE 0 END,
      CASE WHEN k = 5 THEN 0 WHEN k IN (0, 1, 2, 3) THEN s.heads + 1 ELSE s.heads END,
      s.named OR k = 5,
      s.script + CASE WHEN k IN (0, 1, 2, 3) THEN 1 + s.heads WHEN k = 4 THEN 1 WHEN k = 6 AND s.named THEN 3 WHEN k = 9 THEN 2 ELSE 0 END
    FROM s JOIN f ON f.d = s.d AND f.i = s.i + 1)"""


@query(f"{_NESTING} SELECT d AS doc_id, max(nested) AS nested_loops, max(cc) AS cognitive, max(script) AS cognitive_python FROM s GROUP BY 1")
def s03_nesting_and_cognitive(t):
    """The stack machines over sources made of every line of every document."""
    c = F.col("source")
    return _sources(t).select("doc_id", code.nested_loops(c).alias("nested_loops"), code.cognitive_complexity(c).alias("cognitive"), code.cognitive_complexity_python(c).alias("cognitive_python"))


_PATHS = f"""WITH RECURSIVE {_LINES}, f AS (SELECT *, length(x) % {len(_KINDS)} AS k, length(x) % 5 AS depth, row_number() OVER (PARTITION BY d ORDER BY i) AS n FROM l WHERE length(x) % {len(_KINDS)} NOT IN (7, 8)),
  s AS (SELECT DISTINCT d, 0::BIGINT AS n, []::BIGINT[] AS open, 0::BIGINT AS functions, 0::BIGINT AS paths FROM l
    UNION ALL SELECT d, n, now, functions + CASE WHEN k = 5 THEN 1 ELSE 0 END, paths + CASE WHEN k = 5 THEN 1 WHEN len(now) = 0 THEN 0 WHEN k IN (0, 1, 2, 9) THEN 1 ELSE 0 END
    FROM (SELECT f.d, f.n, f.k, s.functions, s.paths, CASE WHEN f.k = 5 THEN list_append(list_filter(s.open, lambda y: y < f.depth), f.depth) ELSE list_filter(s.open, lambda y: y < f.depth) END AS now FROM s JOIN f ON f.d = s.d AND f.n = s.n + 1))
  SELECT d AS doc_id, max(functions) AS n_functions, max(paths) AS paths,
  (SELECT count(*) FROM l WHERE l.d = s.d) AS script_functions, (SELECT sum([2, 3, 1, 4][length(x) % 4 + 1])::BIGINT FROM l WHERE l.d = s.d) AS script_paths FROM s GROUP BY d"""
_SCRIPTS = ("function f(a) { if (a) { g('while') } } if (z) { }", "const h = (p, q) => { return p && q ? 1 : 2 }", "class K { m(a) { /* for */ return `if ${a}` } }", "async function r() { for (;;) { try { } catch (e) { if (e) { } } } } // if")


@query(_PATHS)
def s04_cyclomatic(t):
    """Functions and paths of the made-up sources, read as Python, and of a script with a function a line."""
    script = F.element_at(F.array(*[F.lit(k) for k in _SCRIPTS]), (F.length("x") % 4 + 1).cast("int"))
    both = _sources(t).join(_joined(_lines(t), script, "script"), "doc_id")
    p, q = code.cyclomatic(F.col("source"), F.lit("python")), code.cyclomatic(F.col("script"), F.lit("javascript"))
    return both.select("doc_id", p.alias("p"), q.alias("q")).select("doc_id", "p.n_functions", F.col("p.cyclomatic_complexity").alias("paths"), F.col("q.n_functions").alias("script_functions"), F.col("q.cyclomatic_complexity").alias("script_paths"))


@query("""WITH RECURSIVE n AS (SELECT o_custkey % 20 AS repo, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS i FROM orders),
  p AS (SELECT repo, i AS sha, i - 1 - i * 7 % 3 AS parent FROM n WHERE i - 1 - i * 7 % 3 >= 1 UNION ALL SELECT repo, i, i - 5 - i % 13 FROM n WHERE i % 7 = 0 AND i - 5 - i % 13 >= 1),
  r AS (SELECT repo, max(i) - 3 AS sha FROM n GROUP BY 1 UNION SELECT p.repo, p.parent FROM r JOIN p ON p.repo = r.repo AND p.sha = r.sha)
  SELECT CAST(repo AS VARCHAR) AS repo, CAST(sha AS VARCHAR) AS sha FROM r WHERE sha >= 1""")
def s05_reachable_commits(t):
    """Orders as commits: each has a first parent one to three before it, every seventh is a merge; which does the head reach?"""
    from codequarry.operators.ordered import numbered

    n = numbered(t("orders").select((F.col("o_custkey") % 20).alias("repo"), "o_orderkey"), ["repo"], "o_orderkey", "i")
    i, text = F.col("i"), lambda c: c.cast("string")
    first, second = i - 1 - i * 7 % 3, i - 5 - i % 13
    parents = n.select(text(F.col("repo")).alias("repo"), text(i).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("ord"), first.alias("p")), F.struct(F.lit(1).alias("ord"), F.when(i % 7 == 0, second).alias("p")))).alias("e")).where("e.p >= 1")
    heads = n.groupBy(text(F.col("repo")).alias("repo")).agg(text(F.max("i") - 3).alias("sha"))
    return graph.ancestors(parents.select("repo", "sha", text(F.col("e.p")).alias("parent"), "e.ord"), heads)
