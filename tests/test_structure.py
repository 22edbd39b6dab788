"""Units, nesting, complexity, reachability, table functions, scan costs and paged sources against plain loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

from codequarry.functions import code
from codequarry.operators import graph, units
from codequarry.sources import commits, discovery, paged, results

UNIT = "k int, ord int, kind string, name string, signature string, body_hash string, line_start int, line_end int"


def fare(before, after):
    """(fate, new name) of each unit before, one after another."""
    out, gone_from = [], set()
    for u in before:
        same = [v for v in after if v[:3] == u[:3]]
        if any(v[1] == u[1] for v in after):
            out.append(("survived" if same and same[-1][3] == u[3] else "modified", u[1]))
        else:
            heir = next((v[1] for v in after if v[3] == u[3] and v[1] not in gone_from), None)
            out.append(("renamed", heir) if heir else ("deleted", None))
        gone_from.add(out[-1][1])
    return out


def test_unit_changes_and_tracking(spark):
    rng = random.Random(9)
    made = lambda n: [(rng.choice(["function", "class"]), rng.choice("abcdefgh"), rng.choice(["", "x"]), rng.choice("123")) for _ in range(n)]
    files = {k: (made(rng.randrange(0, 14)), made(rng.randrange(0, 14))) for k in [*range(40), None]}
    frame = lambda side: spark.createDataFrame([(k, i, *u, 1, 1) for k, both in files.items() for i, u in enumerate(both[side])], UNIT)
    before, after = frame(0), frame(1)
    got = {(r.k, r.ord): (r.fate, r.new_name) for r in units.unit_changes(before, after, ["k"]).collect()}
    assert got == {(k, i): x for k, (b, a) in files.items() for i, x in enumerate(fare(b, a))}
    for r in units.unit_survival(before, after, ["k"]).collect():
        b, a = files[r.k]
        fates = fare(b, a)
        names = {x for _, x in fates}
        assert (r.original_units, r.new_units) == (len(b), sum(u[1] not in names for u in a))
        assert r.survived_names == [u[1] if f == "survived" else f"{u[1]}->{x}" for u, (f, x) in zip(b, fates, strict=True) if f in ("survived", "renamed")]
        assert r.deletion_rate == pytest.approx(sum(f == "deleted" for f, _ in fates) / len(b), abs=5.1e-5)
    spans = [(k, i, "function", f"n{i}", "", "1", s := rng.randrange(1, 60), s + rng.randrange(0, 20)) for k in (1, 2, None) for i in range(12)]
    ranges = [(1, 5, 9), (1, 30, 31), (None, 10, 40)]
    got = {(r.k, r.ord) for r in units.tracked_units(spark.createDataFrame(spans, UNIT), spark.createDataFrame(ranges, "k int, rs long, re long"), ["k"]).collect()}
    want = set()
    for k in (1, 2, None):
        own, lines = [u for u in spans if u[0] == k], [r for r in ranges if r[0] == k]
        met = [u for u in own if not lines or any(u[6] <= b and u[7] >= a for _, a, b in lines)]
        want |= {(k, u[1]) for u in met if not lines or not any(u[6] <= v[6] and u[7] >= v[7] and u[6:] != v[6:] for v in met)}
    assert got == want


def test_table_function(spark):
    units.register(spark)
    files = spark.createDataFrame([("r", "a.py", "def f(x): pass\nclass A:\n  def g(self): pass", "python"), ("r", "b.js", "function h(a) {\n}\n", "javascript"), ("s", "c", None, None)], "repo string, path string, content string, language string")
    want = sorted(tuple(r) for r in units.extract_units(files, ["repo", "path"]).collect())
    lateral = spark.sql("SELECT repo, path, u.* FROM {files}, LATERAL source_units(content, language) u", files=files)
    table = spark.sql("SELECT * FROM source_units(TABLE({files}) PARTITION BY repo ORDER BY path)", files=files)
    assert sorted(map(tuple, lateral.collect())) == sorted(map(tuple, table.collect())) == want
    for bad in ("source_units(1, 'x')", "source_units('x')"):
        with pytest.raises(Exception, match="source_units|columns"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def paths_by_hand(text, python):
    """Functions and ways, character by character and line by line."""
    if python:
        out, i, quote = "", 0, None
        while i < len(text):
            if quote is None and text[i] == "#":
                i = text.find("\n", i) if "\n" in text[i:] else len(text)
                continue
            if quote is None and text[i] in "'\"":
                quote = text[i : i + 3] if text[i : i + 3] == 3 * text[i] else text[i]
                i += len(quote)
                continue
            if quote is not None:
                i, quote = (i + len(quote), None) if text.startswith(quote, i) else (i + 1 + (text[i] == "\\"), quote)
                continue
            out, i = out + text[i], i + 1
        open_, n, ways = [], 0, 0
        for line in filter(str.strip, out.splitlines()):
            depth = len(line) - len(line.lstrip())
            open_ = [d for d in open_ if d < depth]
            if re.match(r"\s*(async\s+)?def\s", line):
                open_, n, ways = [*open_, depth], n + 1, ways + 1
            if open_:
                ways += len(re.findall(r"\b(if|elif|for|while|and|or|except|finally)\b", line))
        return n, ways
    return None


def test_cyclomatic(spark):
    python = [
        "", "x = 1 if y else 2\n", "def f(a):\n    if a and b or c:\n        pass\n    elif d: pass\n    else: pass\nfor i in j: pass\n", "async def f():\n    '''if for\n    while'''\n    s = 'if' + \"or\" # and\n    def g():\n        for x in [y for y in z if y]: pass\n    try: pass\n    except E: pass\n    finally: pass\nclass A:\n    def h(self): return 1 if self else 0\n    while True: pass\n",
        "def f():\n    return 'it\\'s if'\n\n\n    if x: pass\n",
    ]
    got = spark.createDataFrame([(i, t) for i, t in enumerate([*python, None])], "i int, t string").orderBy("i").select(code.cyclomatic_python(F.col("t")).alias("c")).collect()
    assert [tuple(r.c) for r in got] == [paths_by_hand(t, True) for t in python] + [(0, 0)]
    script = {
        "function f(a) { if (a && b || c) { } else if (d) { } for (;;) { } while (x) { } }": (1, 7), "if (a) { }\nfunction g() { }": (1, 1), "const h = (a, b) => { return a ? b : c }; const k = x => x && y": (1, 2),
        "class A { m(x) { switch (x) { case 1: break; case 2: break; default: } } n() { try { } catch (e) { } } }": (2, 5), "function f() { function g() { if (a) { } } if (b) { } }": (2, 4), "function f() { /* if { */ let s = '}'; // while {\n return `if ${x}` }": (1, 1), "": (0, 0),
    }
    got = spark.createDataFrame([(i, t) for i, t in enumerate(script)], "i int, t string").orderBy("i").select(code.cyclomatic_braces(F.col("t")).alias("c")).collect()
    assert [tuple(r.c) for r in got] == list(script.values())


def test_ancestors(spark):
    rng = random.Random(3)
    edges, heads = [], []
    for repo in ("a", "b", None):
        for i in range(1, 120):
            edges += [(repo, str(i), str(rng.randrange(max(0, i - 4), i)), k) for k in range(rng.choice([1, 1, 1, 2, 3]))]
        heads += [(repo, str(rng.randrange(60, 119)))] * 2
    edges += [("a", "x", None, 0), ("a", None, "1", 0), ("c", "1", "2", 0)]
    heads += [("d", "lone"), ("a", None)]
    got = sorted(map(tuple, graph.ancestors(spark.createDataFrame(edges, "repo string, sha string, parent string, ord int"), spark.createDataFrame(heads, "repo string, sha string")).collect()))
    want = set()
    for repo, head in heads:
        todo = [head]
        while repo is not None and todo:
            sha = todo.pop()
            if sha is not None and (repo, sha) not in want:
                want.add((repo, sha))
                todo += [p for r, s, p, _ in edges if r == repo and s == sha]
    assert got == sorted(want)
    empty = spark.createDataFrame([], "repo string, sha string, parent string, ord int")
    assert graph.ancestors(empty, empty.select("repo", "sha")).collect() == []


def test_ancestors_join_by_join(spark, monkeypatch):
    """However deep a history is, a plan holds two joins at most, and none sends a table through the driver."""
    plans = []
    monkeypatch.setattr(graph, "written", lambda df, label, f=graph.written: plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]) or f(df, label))
    edges = [("a", str(i), str(i - 1), 0) for i in range(1, 300)] + [("a", str(i), f"m{i}", 1) for i in range(7, 300, 7)] + [("a", f"m{i}", str(i - 6), 0) for i in range(7, 300, 7)]
    got = graph.ancestors(spark.createDataFrame(edges, "repo string, sha string, parent string, ord int"), spark.createDataFrame([("a", "290")], "repo string, sha string"))
    assert {r.sha for r in got.collect()} == {str(i) for i in range(291)} | {f"m{i}" for i in range(7, 291, 7)}
    assert max(p.count("Join") for p in plans) <= 2
    assert not any("Broadcast" in p for p in plans)


def test_what_a_scan_reads(spark, tmp_path):
    rows = spark.range(60_000).select(F.concat(F.lit("2025010"), (F.col("id") % 5).cast("string")).alias("day"), F.sha2(F.col("id").cast("string"), 256).alias("wide"), F.lit("PushEvent").alias("type"), "id")
    rows.repartition(2).write.mode("overwrite").partitionBy("day").parquet(str(tmp_path))
    every, one = spark.read.parquet(str(tmp_path)), discovery.scan_events(spark, str(tmp_path), "2025-01-01", "2025-01-01")
    all_, day, narrow = (discovery.scan_cost(df) for df in (every, one, one.select("id")))
    assert all_["partition_filters"] == ["[]"] and "day" in day["partition_filters"][0] and "20250101" in day["partition_filters"][0]
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert 0.8 * size < all_["bytes_processed"] < 1.5 * size
    assert 0 < day["bytes_processed"] < 0.35 * all_["bytes_processed"]
    assert 0 < narrow["bytes_processed"] < 0.5 * day["bytes_processed"]
    assert discovery.scan_cost(every, 1e12)["cost_estimate_usd"] == pytest.approx(all_["bytes_processed"] / 1024**4 * 1e12, rel=0.01)


def test_commit_pages_as_a_data_source(spark, tmp_path):
    commit = lambda repo, i: {"sha": f"{repo}-{i}", "html_url": f"u{i}", "author": {"login": "l"} if i % 3 else None, "commit": {"message": f"m {i}", "author": {"name": "n", "email": "e", "date": f"2025-{12 - i // 28:02d}-{28 - i % 28:02d}T00:00:00Z"}}}
    bodies = []
    for repo, n in (("o/a", 250), ("o/b", 30)):
        folder = tmp_path / repo.replace("/", "__")
        folder.mkdir()
        for page in range(1, n // 100 + 2):
            body = json.dumps([commit(repo, i) for i in range((page - 1) * 100, min(n, page * 100))])
            (folder / f"page-{page}.json").write_text(("\ufeff" if page == 2 else "") + body, encoding="utf-8")
            bodies.append((repo, page, body))
    (tmp_path / "o__c").mkdir()
    (tmp_path / "o__c" / "page-1.json").write_text('{"message": "Not Found"}')
    (tmp_path / "o__c" / "page-2.json").write_text("<html>")
    (tmp_path / "o__c" / "other.txt").write_text("x")
    want = discovery.page_commits(spark.createDataFrame(bodies, "repo string, page int, body string"))
    got = paged.read_commit_pages(spark, str(tmp_path))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert got.rdd.getNumPartitions() == 6
    assert rows(got) == rows(want) and got.count() == 280
    since = "date >= '2025-10-10T00:00:00Z'"
    assert rows(got.where(since)) == rows(want.where(since)) != []
    assert rows(got.where(f"repo = 'o/b' AND {since}")) == rows(want.where(f"repo = 'o/b' AND {since}"))
    assert paged.read_commit_pages(spark, str(tmp_path), 120).groupBy("repo").count().orderBy("repo").collect() == [("o/a", 120), ("o/b", 30)]
    reader = paged.PageReader({"path": str(tmp_path)})
    assert len(list(reader.pushFilters([GreaterThanOrEqual(("date",), "2025-12-20T00:00:00Z"), EqualTo(("repo",), "o/a")]))) == 1
    assert len(reader.partitions()) == 3
    assert [len(list(reader.read(p))) for p in sorted(reader.partitions(), key=lambda p: p.number)] == [9, 0, 0]


def test_batches_and_documents(spark, tmp_path):
    rows = spark.createDataFrame([("success", 5, 7, 2), ("success", 1, None, 1), ("error", None, None, None), (None, 2, 1, 0)], "status string, commits_analyzed long, total_issues_introduced long, total_issues_fixed long")
    assert tuple(results.batch_summary(rows).first()) == (2, 2, 8, 8, 3, 5)
    assert tuple(results.batch_summary(rows.where("1 = 0")).first()) == (0, 0, 0, 0, 0, 0)
    for name in ("x_commits.json", "ai_commits_y.json", "ai_commits_commits.json", "z.txt"):
        (tmp_path / name).write_text("[]")
    assert [f.rsplit("/", 1)[1] for f in results.matching_files(spark, str(tmp_path), ["ai_commits*.json", "*_commits.json"])] == ["ai_commits_commits.json", "ai_commits_y.json", "x_commits.json"]
    for body in ('{"repo": "r", "ai_commits": [{"sha": "a"}]}', '[{"sha": "a"}]', '{"repo": "r", "ai_commit_shas": ["a"]}'):
        twins = spark.createDataFrame([(body,), ("\ufeff \n" + body,)], "value string")
        assert [r.sha for r in commits.commits_of_documents(twins).collect()] == ["a", "a"]
