"""Texts are taken apart once a row, and what lies in one text is not ordered over texts."""

from pyspark.sql import functions as F

from codequarry.functions import code, paths, rules
from codequarry.plans import report_queries, structure_queries
from codequarry.sources import analyzers, git_text


D = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_measures_split_a_text_once(spark):
    d = spark.range(3).select(F.concat(F.lit("def f(x):\n a\n"), F.col("id").cast("string")).alias("t"))
    for measure in (code.line_fingerprints(F.col("t")), code.duplicate_chunks(code.lines_of(F.col("t"))), code.long_functions(F.col("t"))):
        assert plan(d.select(measure.alias("m"))).count("split(") == 1


def test_duplicates_of_short_and_wide_texts(spark):
    block = "a\nb\nc\nd\ne\n"
    texts = ["", "a\nb", block, block * 2, block * 3, "\n" * 12, " \n\x1c\n" * 9, None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", code.duplicate_chunks(code.lines_of(F.col("t"))).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [0, 0, 0, 1, 6, 0, 0, 0]


DIFF = "noise\n@@ -1 +1,9 @@\n+++ b/x y.py\r\n@@ -1,2 +3,2 @@ f\r\n+a\n@@ -9 +7 @@\n--- a/z\n+++ /dev/null\n@@ -1 +0,0 @@\n@@ -1 +4 @@\n+++ b/q.py\n@@ -1 +5,3 @@"


def test_hunks_without_an_order_over_lines(spark):
    d = spark.createDataFrame([(1, DIFF), (2, ""), (3, None)], "k int, diff string")
    ranges, lines = git_text.added_ranges(d, ["k"]), git_text.changed_lines(d, ["k"], "diff")
    assert sorted(map(tuple, ranges.collect())) == [(1, "q.py", 5, 7), (1, "x y.py", 3, 4), (1, "x y.py", 4, 4), (1, "x y.py", 7, 7)]
    assert sorted(r.line for r in lines.collect()) == list(range(1, 10))
    for df in (ranges, lines):
        assert not any(word in plan(df) for word in ("Window", "Sort", "Aggregate"))


def test_blame_without_an_order_over_lines(spark):
    a, b = "a" * 40, "b" * 40
    text = f"\tabove\n{a} 1 1 1\nauthor x\n\tone\n\t\n{b}\r\n\ttwo {a} 1\n{a} 2\n\tthree\n{b}c 1\n\tfour"
    d = spark.createDataFrame([(1, text), (2, ""), (3, "\n")], "k int, output string")
    counts = git_text.blame_counts(d, ["k"])
    assert sorted(map(tuple, counts.collect())) == [(1, a, 4), (1, b, 1)]
    assert "Window" not in plan(counts)
    assert sorted(map(tuple, git_text.blame_totals(d, ["k"]).collect())) == [(1, 6), (3, 0)]


def test_sarif_no_result_holds_its_run(spark):
    text = '{"runs":[{"tool":{"driver":{"rules":[{"id":"r","properties":{"tags":["cwe-1"]}}]}},"results":[{"ruleId":"r"},{"ruleId":"s"}]},{"results":[]}]}'
    found = analyzers.sarif(spark.createDataFrame([(1, text), (2, "{}")], "k int, output string"), ["k"])
    assert sorted((r.k, r.rule, list(r.cwe)) for r in found.collect()) == [(1, "r", ["cwe-1"]), (1, "s", [])]
    assert "explode(results" in plan(found) and "explode(run" not in plan(found)


def test_findings_are_read_once(spark):
    """Reports that tell several things of findings classify each of them in one pass."""
    for name in ("r29_commit_summary", "r19_families"):
        assert plan(report_queries.QUERIES[name](spark, D)).count("Relation [l_orderkey") == 1, name
    # Entries, and what they said when introduced.
    assert plan(report_queries.QUERIES["r33_survival_over_time"](spark, D)).count("Relation [l_orderkey") == 2


def test_a_path_is_made_bare_once(spark):
    df = spark.createDataFrame([("src/a.py",)], "p string")
    assert plan(df.where(paths.is_noise_path(F.col("p")))).count("^/+") == 1
    rule = F.col("p")
    blocked = plan(df.where(rules.is_blocked(rule, rules.filter_context(F.col("p")))))
    assert blocked.index("jwt_exposed") < blocked.index("__tests__")  # the rule goes before the patterns of its context


def test_noise_paths_as_before(spark):
    """Blanks, slashes, breaks and versions in names."""
    noise = [" /node_modules/a.js ", "a/x.egg-info/b", "lib/jquery-3.1.js", "JQUERY.MIN.JS", "a/1.chunk.js", "12.abc.js\u0085", "x/generated_a.py", "A.pb.go", "dist/", "//build/x.py", "Angular.prod.js", "a/yarn.lock\n"]
    fine = ["", None, "a/jqueryx.js", "node_modulesx/a.js", "a.pb.gox", "reactor.py", "lib/a.js", " src/a b.py", "pkg/vue/x.go"]
    df = spark.createDataFrame([(p, True) for p in noise] + [(p, False) for p in fine], "p string, want boolean")
    assert [r.p for r in df.where(paths.is_noise_path(F.col("p")) != F.col("want")).collect()] == []


def test_sources_are_parsed_once(spark):
    """Units of a version are extracted once and kept, however many joins they go into."""
    assert "MapInArrow" not in plan(structure_queries.QUERIES["s01_unit_survival"](spark, D))
