"""Matchers, units, measures of code and ordered operators against brute force."""

import ast
import random
import re

import pytest
from pyspark.sql import functions as F

from codequarry.functions import code
from codequarry.operators import matching, ordered, units


def greedy(before, after, reach):
    """The two passes as nested loops."""
    used, out = set(), []
    for same in (True, False):
        for i, b in enumerate(before):
            if any(i == x for x, _ in out):
                continue
            best = None
            for j, a in enumerate(after):
                if j in used or (same and a != b):
                    continue
                d = abs(a - b)
                if (same and best is None) or (not same and d <= reach and (best is None or d < best[0])):
                    best = (d, j)
                    if same:
                        break
            if best:
                used.add(best[1])
                out.append((i, best[1]))
    return sorted(out)


def test_nearest_pairs_equal_nested_loops():
    rng = random.Random(1)
    for _ in range(300):
        b, a = (sorted(rng.choices(range(rng.choice([10, 60, 300])), k=rng.randrange(12))) for _ in range(2))
        assert sorted(matching.nearest_pairs(b, a, 40)) == greedy(b, a, 40)


def test_tolerant_pairs_equal_nested_loops():
    rng = random.Random(2)
    for _ in range(300):
        b, a = (sorted(rng.choices(range(30), k=rng.randrange(10))) for _ in range(2))
        used, want = set(), []
        for i, x in enumerate(b):
            j = next((j for j, y in enumerate(a) if j not in used and (x == 0 or y == 0 or abs(x - y) <= 5)), None)
            if j is not None:
                used.add(j)
                want.append((i, j))
        assert matching.tolerant_pairs(b, a, 5) == want


def test_nearest_greedy_over_keys(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([None, *range(100)])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, line long")
    b, a = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    want = []
    for k in ("x", "y", None):
        side = [sorted((r[2] or 0, r[0]) for r in rows if r[1] == k and r[0] % 2 == s) for s in (0, 1)]
        want += [(side[0][i][1], side[1][j][1]) for i, j in greedy([x for x, _ in side[0]], [x for x, _ in side[1]], 40)]
    assert sorted(map(tuple, matching.nearest_greedy(b, a, ["k"]).collect())) == sorted(want)


def test_exact_multiplicity_with_null_keys(spark):
    rows = [(1, None, 1), (2, None, 1), (3, "a", 1), (4, None, 1), (5, "a", 2)]
    df = spark.createDataFrame(rows, "id long, k string, line long")
    got = matching.exact_multiplicity(df.where("id < 4"), df.where("id >= 4"), ["k", "line"]).collect()
    assert sorted(((r.k, r.line, r.before_id, r.after_id) for r in got), key=str) == sorted([(None, 1, 1, 4), (None, 1, 2, None), ("a", 1, 3, None), ("a", 2, None, 5)], key=str)


ISSUE = "id long, type string, rule string, symbol string, message string, line int, file string"


def test_match_issues_and_attribution(spark):
    before = spark.createDataFrame([(1, "t", "r", None, "m", 10, "f"), (2, "t", None, "s", "m", 5, "f"), (3, "t", "r", None, "m", 90, "f")], ISSUE)
    after = spark.createDataFrame([(11, "t", "r", None, "m", 12, "f"), (12, "t", "s", None, "m", 7, "f"), (13, "t", "r", None, "new", 4, "f"), (14, "t", "r", None, "new", None, "f"), (15, "t", "r", None, "new", 6, "f")], ISSUE)
    gone, new = matching.match_issues(before, after, ["file"])
    assert [r.id for r in gone.collect()] == [3]
    assert sorted(r.id for r in new.collect()) == [13, 14, 15]
    changed = spark.createDataFrame([("f", 4), ("f", 4), ("g", 6)], "file string, line int")
    assert sorted(r.id for r in matching.attributed(new, changed, ["file"]).collect()) == [13, 14]
    assert [r.id for r in matching.attributed(new, changed.where("1 = 0"), ["file"]).collect()] == [14]


def test_deep_scans(spark):
    long = "m" * 100
    before = spark.createDataFrame([(1, "t", "r", None, long + "x", 10, "f"), (2, "t", "r", None, "n", 3, "g"), (3, "t", "q", None, "n", 3, "f")], ISSUE)
    after = spark.createDataFrame([(11, "t", "r", None, long + "y", 15, "f"), (12, "t", "r", None, "z", 8, "f"), (13, "t", "r", None, "z", 9, "f"), (14, "t", "r", None, "z", 8, "g")], ISSUE)
    changed, files = spark.createDataFrame([("f", 8), ("g", 8)], "file string, line int"), spark.createDataFrame([("f",)], "file string")
    new, gone = matching.introduced_and_fixed(before, after, changed, [], files)
    assert ([r.id for r in new.collect()], [r.id for r in gone.collect()]) == ([12], [3])
    new, gone = matching.introduced_and_fixed(before, after, changed, [])
    assert (sorted(r.id for r in new.collect()), sorted(r.id for r in gone.collect())) == ([12, 14], [2, 3])


def test_survival_scores(spark):
    old = "import os\nx = compute(1)\ny = 2\nz = 3\nw = 4\n"
    new = "import sys\n# moved\nx = compute(2)\ny = 2\nz = 3\nw = 4\nunrelated line here\n"
    b = spark.createDataFrame([(1, "r", "Msg  A", 3, old), (2, "r", "msg b", 2, old), (3, "q", "msg", 1, old), (4, "r", "far", 5, old)], "id long, rule_name string, message string, line int, content string")
    a = spark.createDataFrame([(11, "r", "msg a", 4, new), (12, "r", "other", 3, new), (13, "p", "msg", 1, new), (14, "r", "FAR", 7, new)], "id long, rule_name string, message string, line int, content string")
    got = {r.before_id: tuple(r)[1:] for r in matching.match_survival(matching.prepared(b, "content"), matching.prepared(a, "content"), []).collect()}
    assert got == {1: (11, 1.0, "line-text-near-exact"), 2: (12, 0.92, "line-text-similar"), 3: (None, 0.0, "no-match"), 4: (14, 0.62, "message-and-line-window")}
    assert matching.survival_score({"text": "", "message": "", "line": 0, "print": "p"}, {"text": "", "message": "", "line": 0, "print": "p"}) == (0.75, "context-fingerprint")
    one = {"text": "abcdefgh xyz", "message": "m", "line": 0, "print": "p"}
    assert matching.survival_score(one, one | {"text": "abcdefgh 1234567", "print": "q"}) == (0.84, "message-and-line-similar")
    ratio = spark.createDataFrame([("abcd", "bcde"), ("", "x"), (None, None)], "a string, b string").select(matching.seq_ratio("a", "b")).collect()
    assert [r[0] for r in ratio] == [0.75, 0.0, 0.0]


def test_augmented(spark):
    schema = "file string, rule_id string, rule string, symbol string, type string, line int, message string"
    own = spark.createDataFrame([("f", "B1", None, None, "t", 3, "Some  text")], schema)
    more = spark.createDataFrame([("f", None, "B1", None, "t", 3, "some text"), ("f", None, "B1", None, "t", 4, "x"), ("f", "", "B1", None, "t", 4, "X"), ("f", None, "B2", None, "t", None, None)], schema)
    assert sorted((r.rule, r.line) for r in matching.augmented(own, more, ["file"]).collect() if r.rule) == sorted([("B1", 4), ("B2", None)], key=str)


SOURCE = '''
class A(Base, mod.X):
    def b(self, x: int, *args, y=1, **kw):
        if x and y or kw:
            return [i for i in args]
    if True:
        async def c(self): pass
    class Inner:
        def d(self): pass

def outer(a: List[int], b: "T" = None):
    def inner(): return 1
    while a: pass
    try: pass
    except E: pass
    return inner

async def e(q: 1 | 2): pass
'''


def test_python_units():
    got = {(k, n): (s, a, b, c) for k, n, s, _, a, b, c in units.python_units(SOURCE)}
    assert got == {
        ("class", "A"): ("Base,mod.X", 2, 9, 0), ("method", "A.b"): ("self,x:int,*args,**kw", 3, 5, 5), ("method", "A.c"): ("self", 7, 7, 1), ("class", "Inner"): ("", 8, 9, 0), ("method", "Inner.d"): ("self", 9, 9, 1),
        ("function", "outer"): ("a:List[...],b:T", 11, 16, 3), ("function", "inner"): ("", 12, 12, 1), ("async_function", "e"): ("q:Any", 18, 18, 1),
    }
    assert [u[1] for u in units.python_units(SOURCE)] == ["A", "A.b", "A.c", "Inner", "Inner.d", "outer", "inner", "e"]
    assert units.python_units("def (") == []
    a, b = (units.python_units(f"def f(x):\n    {s}")[0][3] for s in ("return x  # one", "return   x"))
    assert a == b != units.python_units("def f(x):\n    return y")[0][3]


def test_script_units():
    source = "export async function go(a: string, b = 2, ...rest) {\n  if (a) { x() }\n}\nconst h = (p) => {\n  // c\n  return 1\n}\nexport class K extends L {\n  async run(a) {\n  }\n  stop() {\n  }\n}\nfunction open(\n x) \nlet q = async () => 5\n"
    got = [(k, n, s, a, b) for k, n, s, _, a, b, _ in units.script_units(source)]
    assert got == [("function", "go", "a,b,rest", 1, 3), ("function", "open", "x", 14, 16), ("arrow_function", "h", "", 4, 7), ("arrow_function", "q", "", 16, 16), ("class", "K", "L", 8, 13)]
    assert units.script_units("function f() {\n  a  b\n}")[0][3] == units.script_units("function f() {\n\n  // n\n a b\n}")[0][3]


def test_units_of_files_and_survival(spark):
    before = "class A:\n    def f(self): return 1\n    def g(self): return 2\ndef h(): return 3\ndef gone(): return 9\n"
    after = "class A:\n    def f(self): return 1\n    def g(self, x): return 2\ndef renamed(): return 3\ndef new(): return 4\n"
    files = spark.createDataFrame([(1, "a.py", before, after, [(2, 5)], 0.5), (2, "a.go", "x", "y", None, 0.1), (3, "b.py", "x = 1", "x = 2", None, 0.3), (4, "c.py", before, None, None, None)], "k int, path string, original string, current string, ranges array<struct<s:int,e:int>>, line_rate double")
    got = {r.k: r for r in units.semantic_survival(files, ["k"]).collect()}
    r = got[1]
    assert (r.original_units, r.surviving_units, r.modified_units, r.deleted_units, r.new_units) == (4, 2, 1, 1, 2)
    assert (r.survived_names, r.modified_names, r.deleted_names) == (["A.f", "h->renamed"], ["A.g"], ["gone"])
    assert (r.semantic_survival_rate, r.exact_survival_rate, r.semantic_vs_syntactic_delta) == (0.75, 0.5, 0.25)
    assert (got[2].supported, got[2].original_units) == (False, 0)
    assert (got[3].supported, got[3].original_units, got[3].syntactic_survival_rate) == (True, 0, 0.0)
    assert (got[4].original_units, got[4].deleted_units) == (5, 5)
    found = units.extract_units(files.withColumn("language", units.unit_language(F.col("path"))), ["k"], "original").collect()
    assert [(r.k, r.ord, r.name) for r in found if r.k == 1] == [(1, 0, "A"), (1, 1, "A.f"), (1, 2, "A.g"), (1, 3, "h"), (1, 4, "gone")]


TEXTS = ["", "a\n\nb", "for x:\n  for y:\n  while z:\n for q:\nforeach", "a\nb\nc\nd\ne\n" * 4, "\n" * 12, "x\n" * 14, "def a():\n" + "  y\n" * 60 + "function b()\n  z\nq = (1) =>\n", "if a && b:\n  for c in d:\n    if e: break\n  else: pass\n# if x\nclass K:\n  def f():\n    return f (1)\n", "TODO todo: FIXME\r\nfixmes\x0btodo"]


def duplicates(lines, window=5):
    at = {}
    for i in range(len(lines) - window + 1):
        chunk = "\n".join(lines[i : i + window]).strip()
        if chunk:
            at.setdefault(chunk, []).append(i)
    total = 0
    for places in at.values():
        kept = [places[0]]
        for p in places[1:]:
            if p - kept[-1] >= window:
                kept.append(p)
        total += len(kept) - 1
    return total


def long_functions(lines):
    at = [i for i, x in enumerate(lines) if re.match(code.FUNCTION_HEAD, x)] + [len(lines)]
    return sum(b - a > 50 for a, b in zip(at, at[1:], strict=False))


def indent(line):
    return len(line) - len(line.lstrip())


def nested_by_hand(lines):
    """A loop is nested if, walking up from it to ever lesser indents, another loop is met before its stack is emptied."""
    loops, n = [indent(x) for x in lines if re.search(r"\b(for|while|foreach)\b", x)], 0
    for i, d in enumerate(loops):
        low = min(loops[:i], default=d)
        n += any(loops[j] < d and all(loops[m] > loops[j] for m in range(j + 1, i)) for j in range(i)) if low < d else 0
    return n


def cognitive_by_hand(lines):
    """Each line by itself: the blocks open around it are earlier heads, with all lines between deeper than they are."""
    said, total = [x for x in lines if x.strip() and not x.strip().startswith(("#", "//", "/*", "*"))], 0
    for i, x in enumerate(said):
        around = sum(bool(re.search(code.NESTING_WORDS, said[j])) and all(indent(y) > indent(said[j]) for y in said[j + 1 : i + 1]) for j in range(i))
        words = re.findall(code.FLOW_WORDS, x)
        total += sum(1 if w in ("&&", "||", "else") else 1 + around for w in words) + bool(re.search(code.BREAK_WORDS, x))
    return total


def script_by_hand(lines):
    total, said = 0, [x for x in lines if x.strip() and not x.strip().startswith("#")]
    for i, x in enumerate(said):
        heads = [j for j in range(i + 1) if re.match(r"\s*def\s+\w+", said[j])]
        begin = heads[-1] if heads else 0
        if re.search(code.SCRIPT_NESTING, x.strip()):
            total += 1 + sum(bool(re.search(code.SCRIPT_NESTING, y.strip())) for y in said[begin:i])
        total += bool(re.search(code.SCRIPT_BREAKS, x)) + 2 * bool(re.search(code.SCRIPT_INNER, x))
        if heads and begin < i and re.search(rf"\b{re.match(r'\s*def\s+(\w+)', said[begin])[1]}\s*\(", x):
            total += 3
    return total


def test_measures_of_code(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    t = F.col("t")
    cols = [code.lines_of(t), code.duplicate_chunks(code.lines_of(t)), code.long_functions(t), code.nested_loops(t), code.todo_lines(t), code.fixme_lines(t), code.cognitive_complexity(t), code.cognitive_complexity_python(t)]
    got = [tuple(r) for r in df.orderBy("i").select(*cols).collect()]
    for text, (lines, dup, long, loops, todo, fixme, cc, script) in zip([*TEXTS, ""], got, strict=True):
        want = text.splitlines()
        assert lines == want
        assert (dup, long) == (duplicates(want), long_functions(want))
        assert (todo, fixme) == (sum(bool(re.search(r"\bTODO\b", x, re.I)) for x in want), sum(bool(re.search(r"\bFIXME\b", x, re.I)) for x in want))
        assert (loops, cc, script) == (nested_by_hand(want), cognitive_by_hand(want), script_by_hand(want))
    assert [g[3] for g in got][2] == 3  # all but the first and the last stand deeper than an open one
    assert got[7][6:] == (1 + 2 + 3 + 1 + 1, 1 + 2 + 1 + 1 + 3)


def test_lines_and_fingerprints(spark):
    import hashlib

    text = "one\n two  three \nfour\nfive\nsix\n\tseven\neight"
    lines = [" ".join(x.split()) for x in text.splitlines()]
    df = spark.createDataFrame([(n, text) for n in (0, 1, 4, 7, 9, -3)], "n int, t string")
    got = df.select("n", code.line_text(F.col("t"), F.col("n")), code.fingerprint(F.lit("r"), F.col("n"), F.col("t")), code.line_fingerprints(F.col("t"))).collect()
    for n, line, mark, marks in got:
        assert line == (lines[n - 1] if 1 <= n <= 7 else "")
        near = "\n".join(lines[max(0, n - 4) : max(max(0, n - 4), min(7, n + 3))])
        assert mark == hashlib.md5(f"r:{near}".encode()).hexdigest()
        assert marks == [hashlib.md5("\n".join(lines[max(0, i - 3) : i + 4]).encode()).hexdigest() for i in range(7)]
    rows = spark.createDataFrame([("console.log(any); // @ts-ignore console.logs", ".ts"), (None, ".js")], "t string, s string")
    assert [tuple(r) for r in rows.select(code.console_logs(F.col("t")), code.any_types(F.col("t"), F.col("s")), code.ts_ignores(F.col("t"))).collect()] == [(1, 1, 1), (0, 0, 0)]


def test_floor_quantiles(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, *range(9)])) for k in ("a", "b", None) for _ in range(rng.randrange(1, 40))]
    got = ordered.floor_quantiles(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", {"q1": (1, 4), "q2": (1, 2), "q3": (3, 4)}).collect()
    for r in got:
        s = sorted(v for k, v in rows if k == r.k and v is not None)
        n = len(s)
        assert (r.n, r.q1, r.q2, r.q3) == (n, s[n // 4], s[n // 2], s[3 * n // 4])


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_overlaps_keep_repeated_rows(spark, how):
    rng = random.Random(5)
    left = [(rng.choice(["x", "y", None]), s, s + rng.randrange(90)) for s in rng.choices(range(300), k=60)] * 2
    right = [(rng.choice(["x", None]), s, s + rng.randrange(9)) for s in rng.choices(range(300), k=12)]
    ldf, rdf = spark.createDataFrame(left, "k string, s int, e int"), spark.createDataFrame(right, "k string, rs int, re int")
    meets = lambda r: any(k == r[0] and r[1] <= b and r[2] >= a for k, a, b in right)
    want = [r for r in left if meets(r) == (how == "left_semi")]
    assert sorted(map(tuple, ordered.overlaps(ldf, rdf, ["k"], how).collect()), key=str) == sorted(want, key=str)


def test_enclosing_and_containing(spark):
    rng = random.Random(6)
    rows = [(rng.choice("xy"), s, s + rng.randrange(25)) for s in rng.choices(range(60), k=50)]
    rows += rows[:5]
    inner = [(rng.choice("xy"), s, s + rng.randrange(9)) for s in rng.choices(range(60), k=25)]
    df = spark.createDataFrame(rows, "k string, s int, e int")
    want = [r for r in rows if any(o[0] == r[0] and r[1] <= o[1] and r[2] >= o[2] and r != o for o in rows)]
    assert sorted(map(tuple, ordered.enclosing(df, ["k"]).collect())) == sorted(want)
    right = spark.createDataFrame(inner, "k string, rs int, re int")
    want = [r for r in rows if any(k == r[0] and r[1] < a and b < r[2] for k, a, b in inner)]
    assert sorted(map(tuple, ordered.contains_any(df, right, ["k"]).collect())) == sorted(want)


def test_source_of_the_tests_parses():
    assert ast.parse(SOURCE)
