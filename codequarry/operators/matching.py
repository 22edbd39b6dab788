"""One-to-one matching of findings before and after a change.

What a greedy matcher does depends on all that it did before among rows that may compete, so that part is
Python. Joins, ranks and gaps first leave it as few rows, and as small groups of them, as can be.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType
from pyspark.sql.window import Window

from codequarry.functions import code
from codequarry.operators.ordered import HOT_ROWS, islands, numbered, running_sum

#: Rows of a bucket, about.
BUCKET_ROWS = 50_000


def exact_multiplicity(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join that pairs the n-th equal row before with the n-th equal row after. Null keys are equal to each other."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    b = before.select(*keys, F.col("id").alias("before_id"), nth.alias("nth"))
    a = after.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.col("id").alias("after_id"), nth.alias("_a_nth"))
    joined = b.join(a, [F.col(k).eqNullSafe(F.col(f"_a_{k}")) for k in keys] + [F.col("nth") == F.col("_a_nth")], "full_outer")
    own = [F.when(F.col("before_id").isNotNull(), F.col(k)).otherwise(F.col(f"_a_{k}")).alias(k) for k in keys]
    return joined.select(*own, F.coalesce("nth", "_a_nth").alias("nth"), "before_id", "after_id")


class Free:
    """Places 0..n-1, of which the next free one at or after a place is asked for, or the last before it."""

    def __init__(self, n: int):
        self.up, self.down = list(range(n + 1)), list(range(n + 1))  # down is shifted by one

    def _find(self, link: list[int], i: int) -> int:
        root = i
        while link[root] != root:
            root = link[root]
        while link[i] != root:
            link[i], i = root, link[i]
        return root

    def at_or_after(self, i: int) -> int:
        """n where none is free."""
        return self._find(self.up, i)

    def before(self, i: int) -> int:
        """-1 where none is free."""
        return self._find(self.down, i) - 1

    def take(self, i: int) -> None:
        self.up[i], self.down[i + 1] = i + 1, i


def nearest_pairs(before: list[int], after: list[int], reach: float) -> list[tuple[int, int]]:
    """Of sorted lines: each one before takes the same line first (in turn), then, in order, the strictly nearest
    line after that is still free and at most ``reach`` away; of two as near, the one further up."""
    free, out, rest = Free(len(after)), [], []
    for i, line in enumerate(before):
        j = free.at_or_after(bisect_left(after, line))
        if j < len(after) and after[j] == line:
            free.take(j)
            out.append((i, j))
        else:
            rest.append(i)
    for i in rest:
        at = bisect_left(after, before[i])
        above, below = free.before(at), free.at_or_after(at)
        best = None
        if above >= 0 and before[i] - after[above] <= reach:
            best = free.at_or_after(bisect_left(after, after[above]))  # the first of that line
        if below < len(after) and after[below] - before[i] <= reach and (best is None or after[below] - before[i] < before[i] - after[best]):
            best = below
        if best is not None:
            free.take(best)
            out.append((i, best))
    return out


def tolerant_pairs(before: list[int], after: list[int], tolerance: int) -> list[tuple[int, int]]:
    """Of sorted lines: each one before, in order, takes the first free one after that lies within ``tolerance``. Line 0 is any line."""
    free, out = Free(len(after)), []
    for i, line in enumerate(before):
        j = free.at_or_after(0)
        if line and j < len(after) and after[j]:
            j = free.at_or_after(bisect_left(after, line - tolerance))
            if j < len(after) and after[j] > line + tolerance:
                continue
        if j < len(after):
            free.take(j)
            out.append((i, j))
    return out


def _sides(before: DataFrame, after: DataFrame, keys: list[Column]) -> DataFrame:
    """k1, k2 (names of a key), side, line, id of the rows of both sides."""
    names = [F.xxhash64(*keys).alias("k1"), F.xxhash64(F.lit(7), *keys, *[k.isNull() for k in keys]).alias("k2")]
    line = F.coalesce(F.col("line"), F.lit(0)).cast("long").alias("line")
    one = lambda df, side: df.select(*names, F.lit(side).alias("side"), line, F.col("id").cast("long").alias("id"))
    return one(before, 0).unionByName(one(after, 1))


def runs_of_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a key ends; a table has about a batch, or one key that is larger."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        last = key(b, b.num_rows - 1)
        if held and key(held[-1], held[-1].num_rows - 1) == last:  # all of one key
            held.append(b)
            continue
        low, high = 0, b.num_rows - 1  # where the last key of the batch begins
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if key(b, mid) == last else (mid + 1, high)
        done = [*held, *([b.slice(0, low)] if low else [])]
        held = [b.slice(low)]
        if done:
            yield pa.Table.from_batches(done)
    if held:
        yield pa.Table.from_batches(held)


def _by_island(rows: DataFrame, reach: int, solve: Callable[[list[int], list[int]], list[tuple[int, int]]], hot_rows: int) -> DataFrame:
    """before_id, after_id of the pairs that ``solve`` makes of the sorted lines of each island of a key: rows whose lines are over
    ``reach`` apart, with none between them, never compete. A task reads its islands one after another and holds one at a time."""
    keys = ["k1", "k2", "island"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of_keys(batches, keys):
            names, side, at, ids = [t.column(c).to_numpy() for c in keys], *(t.column(c).to_numpy() for c in ("side", "line", "id"))
            new = np.any([np.diff(x) != 0 for x in names], axis=0)
            edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(at)]]).tolist()
            b, a = [], []
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                mid = begin + int(np.searchsorted(side[begin:end], 1))
                if begin < mid < end:
                    for i, j in solve(at[begin:mid].tolist(), at[mid:end].tolist()):
                        b.append(ids[begin + i])
                        a.append(ids[mid + j])
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(a, pa.int64())], names=["before_id", "after_id"])

    placed = islands(rows, ["k1", "k2"], "line", reach, "island", hot_rows).select(*keys, "side", "line", "id")
    return placed.repartition(*keys).sortWithinPartitions(*keys, "side", "line", "id").mapInArrow(match, "before_id long, after_id long")


def nearest_greedy(before: DataFrame, after: DataFrame, keys: list[str], reach: int = 40, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs (before_id, after_id) within each key: equal lines first, then rows before, in order of line, take the strictly
    nearest row after that is still free and at most ``reach`` lines away; a null line is 0, null keys are equal.

    Equal lines meet in a join on key, line and number; the rest is matched island by island.
    """
    nth = numbered(_sides(before, after, [F.col(k) for k in keys]), ["k1", "k2", "line", "side"], "id", "nth", hot_rows)
    on = ["k1", "k2", "line", "nth"]
    b, a = (nth.where(F.col("side") == k).select(*on, F.col("id").alias(name)) for k, name in ((0, "before_id"), (1, "after_id")))
    both = b.join(a, on, "full_outer")
    rest = both.where("before_id IS NULL OR after_id IS NULL").select("k1", "k2", "line", F.when(F.col("before_id").isNull(), 1).otherwise(0).alias("side"), F.coalesce("before_id", "after_id").alias("id"))
    return both.where("before_id IS NOT NULL AND after_id IS NOT NULL").select("before_id", "after_id").unionByName(_by_island(rest, reach, lambda x, y: nearest_pairs(x, y, reach), hot_rows))


def tolerant_greedy(before: DataFrame, after: DataFrame, tolerance: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs (before_id, after_id) of deep scans: of one file, rule and beginning of the message (100 characters), rows before, in order of line,
    take the first free row after within ``tolerance`` lines; line 0 is any line. Lines are 0 or more.

    If z is the larger number of a key's rows at line 0 of the two sides, the first z rows of both sides pair by their rank: rows
    at 0 come first, and take or are taken by whatever comes next. The rest has no line 0 and is matched island by island.
    """
    keys = [F.coalesce("file", F.lit("")), F.coalesce("rule", F.lit("")), F.substring(F.coalesce("message", F.lit("")), 1, 100)]
    key, of_line = ["k1", "k2"], ["k1", "k2", "side", "line"]
    rows = numbered(_sides(before, after, keys), of_line, "id", "nth", hot_rows)
    per_line = rows.groupBy(*of_line).agg(F.count("*").alias("n"))
    zeros = per_line.where("line = 0").groupBy(*key).agg(F.max("n").alias("z"))
    upto = running_sum(per_line.join(zeros, key), ["k1", "k2", "side"], "line", "n", "upto", hot_rows)
    ranked = rows.join(upto.select(*of_line, (F.col("upto") - F.col("n")).alias("above"), "z"), of_line, "left").withColumn("rank", F.col("above") + F.col("nth"))
    first = ranked.where("rank <= z")
    b, a = (first.where(F.col("side") == k).select(*key, "rank", F.col("id").alias(name)) for k, name in ((0, "before_id"), (1, "after_id")))
    rest = ranked.where("z IS NULL OR rank > z").select(*key, "line", "side", "id")
    return b.join(a, [*key, "rank"]).select("before_id", "after_id").unionByName(_by_island(rest, tolerance, lambda x, y: tolerant_pairs(x, y, tolerance), hot_rows))


def match_issues(before: DataFrame, after: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(resolved rows of ``before``, new rows of ``after``): of one type, rule (its symbol where there is no rule) and message."""
    identity = {"_type": F.coalesce("type", F.lit("")), "_rule": F.coalesce("rule", "symbol", F.lit("")), "_message": F.coalesce("message", F.lit(""))}
    pairs = nearest_greedy(before.withColumns(identity), after.withColumns(identity), [*scope, *identity])
    resolved = before.join(pairs.select(F.col("before_id").alias("id")), "id", "left_anti")
    return resolved, after.join(pairs.select(F.col("after_id").alias("id")), "id", "left_anti")


def attributed(rows: DataFrame, changed: DataFrame, scope: list[str]) -> DataFrame:
    """Rows at line 0 or at a line that the commit changed. ``changed`` has ``scope`` and line; without any, only line 0 counts."""
    rows = rows.withColumn("line", F.coalesce("line", F.lit(0)))
    lines = changed.select(*scope, F.col("line").alias("_line")).distinct()
    on = [rows[k].eqNullSafe(lines[k]) for k in scope] + [rows["line"] == lines["_line"]]
    return rows.where("line = 0").unionByName(rows.where("line <> 0").join(lines, on, "left_semi"))


def introduced_and_fixed(before: DataFrame, after: DataFrame, changed: DataFrame, scope: list[str], files: DataFrame | None = None, tolerance: int = 5) -> tuple[DataFrame, DataFrame]:
    """Deep scans of a commit and its parent: new findings on changed lines, and findings that went; of changed files
    alone where ``files`` (scope, file) are given."""
    pairs = tolerant_greedy(before, after, tolerance)
    new = after.join(pairs.select(F.col("after_id").alias("id")), "id", "left_anti")
    gone = before.join(pairs.select(F.col("before_id").alias("id")), "id", "left_anti")
    if files is not None:
        new, gone = (df.join(files.select("file").distinct(), "file", "left_semi") for df in (new, gone))
    return attributed(new, changed, [*scope, "file"]), gone


def similarity(left: str, right: str) -> float:
    return SequenceMatcher(None, left, right).ratio() if left and right else 0.0


@F.pandas_udf(DoubleType())
def seq_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How alike two texts are (difflib); 0 where one is empty."""
    for x, y in pairs:
        yield pd.Series([similarity(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")


#: How alike lines count as one line, and how alike they are enough with an equal message; and lines of a window.
ALIKE, ALIKE_ENOUGH, NEAR = 0.82, 0.55, 10
#: Classes of characters (code points modulo this) for bounds of how alike two lines can be.
CLASSES = 32
#: Words of 64 characters of a text up to which bounds are found for many pairs at once, and bytes of their bit masks.
WIDE, MASK_BYTES = 16, 1 << 22


def _classes(texts: list[str]) -> list[np.ndarray]:
    """The class of each character of each text."""
    return [(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES).astype(np.uint8) for t in texts]


@F.pandas_udf(ArrayType(IntegerType()))
def class_counts(texts: pd.Series) -> pd.Series:
    """How often each class of characters occurs in a text."""
    return pd.Series([np.bincount(c, minlength=CLASSES).astype(np.int32) for c in _classes(texts.tolist())], dtype=object)


def _common_long(left: np.ndarray, right: np.ndarray) -> int:
    """common_subsequence() of one pair, with one long number for the state."""
    masks, every = {}, (1 << len(left)) - 1
    for c in np.unique(left):
        masks[int(c)] = int.from_bytes(np.packbits(left == c, bitorder="little").tobytes(), "little")
    state = every
    for c in right.tolist():
        u = state & masks.get(c, 0)
        state = ((state + u) | (state - u)) & every
    return len(left) - state.bit_count()


def common_subsequence(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The length of the longest common subsequence of each pair: a bit for each place of the left text, for many pairs at once."""
    out, words = np.zeros(len(left), np.int64), np.array([-(-len(x) // 64) for x in left], np.int64)
    words[words > 4] += words[words > 4] % 2  # fewer sizes
    order = np.lexsort(([len(y) for y in right], words))
    begin = 0
    while begin < len(order):
        w = int(words[order[begin]])
        if w > WIDE:
            out[order[begin]] = _common_long(left[order[begin]], right[order[begin]])
            begin += 1
            continue
        stop = min(int(np.searchsorted(words[order], w, "right")), begin + max(1, MASK_BYTES // (8 * max(w, 1) * (CLASSES + 1))))
        at, begin = order[begin:stop], stop
        if not w:
            continue
        n, steps = len(at), max(len(right[i]) for i in at)
        a, b = np.full((n, 64 * w), CLASSES, np.uint8), np.full((steps, n), CLASSES, np.int64)
        for k, i in enumerate(at.tolist()):
            a[k, : len(left[i])], b[: len(right[i]), k] = left[i], right[i]
        masks = np.zeros((CLASSES + 1, n, w), np.uint64)  # the last: no character
        for c in range(CLASSES):
            masks[c] = np.packbits(a == c, axis=1, bitorder="little").view(np.uint64)
        every = np.packbits(a < CLASSES, axis=1, bitorder="little").view(np.uint64)
        masks, row, state = masks.reshape(-1, w), np.arange(n), np.full((n, w), np.uint64(0xFFFFFFFFFFFFFFFF))
        for step in b:
            u = state & masks.take(step * n + row, 0)
            total = state + u
            carry = total < u
            while w > 1 and carry[:, :-1].any():  # into the next word; that it goes on from there is rare
                more = np.zeros((n, w), np.uint64)
                more[:, 1:] = carry[:, :-1]
                total += more
                carry = total < more
            state = total | (state ^ u)
        out[at] = np.bitwise_count(~state & every).sum(1, dtype=np.int64)
    return out


@F.pandas_udf(DoubleType())
def ratio_from(pairs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How alike two texts are (difflib) where that is ``least`` or more, else 0. Blocks that difflib finds are a common
    subsequence, so twice the longest one, over both lengths, bounds the ratio; difflib runs on what that leaves."""
    for x, y, least in pairs:
        left, right, out = x.tolist(), y.tolist(), np.zeros(len(x))
        sizes = np.array([len(p) + len(q) for p, q in zip(left, right, strict=True)], np.int64)
        may = 2.0 * common_subsequence(_classes(left), _classes(right)) >= least.to_numpy() * sizes - 1e-9
        for i in np.flatnonzero(may).tolist():
            ratio = similarity(left[i], right[i])
            out[i] = ratio if ratio >= least.iloc[i] else 0.0
        yield pd.Series(out)


def survival_score(a: dict, b: dict) -> tuple[float, str]:
    """How surely finding ``b`` is finding ``a`` of the same rule: by their lines' text, by message and text,
    by message and place, or by the lines around."""
    if a["text"] and a["text"] == b["text"]:
        return 1.0, "line-text-near-exact"
    alike, same = similarity(a["text"], b["text"]), bool(a["message"]) and a["message"] == b["message"]
    if alike >= ALIKE:
        return 0.92, "line-text-similar"
    if same and alike >= ALIKE_ENOUGH:
        return 0.84, "message-and-line-similar"
    if same and a["line"] and b["line"] and abs(a["line"] - b["line"]) <= NEAR:
        return 0.62, "message-and-line-window"
    return (0.75, "context-fingerprint") if a["print"] == b["print"] else (0.0, "no-match")


class Choices:
    """The free findings of a key, from which findings before choose in turn: of those of the highest score, the first."""

    def __init__(self):
        self.free: dict[int, tuple] = {}  # the row of each id
        self.of: dict[tuple, deque] = {}  # ids in order, by what they have
        self.alike: dict[str, list[tuple[str, bool]]] = {}  # texts like a text, and whether they are very much so

    def offer(self, row: tuple) -> None:
        """row: id, text, message, line, print (names of texts, messages and prints; None where empty)."""
        i, text, message, line, mark = row
        self.free[i] = row
        for what in (("text", text), ("both", text, message), ("print", mark), ("place", message, line // NEAR if line else None)):
            if None not in what:
                self.of.setdefault(what, deque()).append(i)

    def first(self, *what, good: Callable[[tuple], bool] = lambda row: True) -> int | None:
        ids = self.of.get(what, ())
        while ids and ids[0] not in self.free:
            ids.popleft()
        return next((i for i in ids if i in self.free and good(self.free[i])), None)

    def choose(self, row: tuple) -> tuple[int | None, float, str]:
        _, text, message, line, mark = row
        near = lambda other: message is not None and other[2] == message and bool(line) and bool(other[3]) and abs(other[3] - line) <= NEAR
        like = self.alike.get(text, ())
        least = lambda found: min((i for i in found if i is not None), default=None)
        ladder = (
            (1.0, "line-text-near-exact", lambda: self.first("text", text)),
            (0.92, "line-text-similar", lambda: least(self.first("text", t) for t, very in like if very)),
            (0.84, "message-and-line-similar", lambda: least(self.first("both", t, message) for t, _ in like)),
            (0.75, "context-fingerprint", lambda: self.first("print", mark, good=lambda other: not near(other))),
            (0.62, "message-and-line-window", lambda: least(self.first("place", message, k, good=near) for k in range((line or 0) // NEAR - 1, (line or 0) // NEAR + 2))),
        )
        for score, reason, look in ladder:
            if (i := look()) is not None:
                del self.free[i]
                return i, score, reason
        return None, 0.0, "no-match"


def prepared(rows: DataFrame, content: str) -> DataFrame:
    """Findings (id, scope.., rule_name, message, line) with text, message and print as the survival match compares them; ``content`` goes."""
    line = F.coalesce(F.col("line"), F.lit(0))
    out = rows.withColumns({"text": code.line_text(F.col(content), line), "print": code.fingerprint(F.col("rule_name"), line, F.col(content)), "message": code.message_text(F.col("message")), "line": line})
    return out.drop(content)


def _like_bound(a: Column, b: Column, least: float) -> Column:
    """Whether two texts with their ``counts`` (of characters by class) and lengths can be ``least`` alike: twice what they can have in common over both lengths."""
    common = F.aggregate(F.zip_with(a["counts"], b["counts"], lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    return 2.0 * common >= least * (a["length"] + b["length"]) - 1e-9


def alike_texts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, other, strong (ALIKE and more; else ALIKE_ENOUGH and more), of different texts of the same keys.

    ``left`` and ``right`` have keys, text and message; of two texts whose findings have no message in common, only
    ALIKE counts. Texts meet by the logarithm of their length, each step a factor of (2 - t) / t, the most that lengths can differ
    at a ratio of t; then lengths, characters by class, and the longest common subsequence bound the ratio from above, and difflib runs on what is left.
    """
    step = math.log((2 - ALIKE_ENOUGH) / ALIKE_ENOUGH)

    def sized(df: DataFrame) -> DataFrame:
        said = F.collect_set(F.when(F.col("message") != "", F.xxhash64("message"))).alias("said")
        rows = df.where("text <> ''").groupBy(*keys, "text").agg(said).withColumn("length", F.length("text")).withColumn("counts", class_counts("text"))
        return rows.withColumn("t", F.struct("text", "length", "counts", "said")).withColumn("_bin", F.floor(F.log("length") / step)).select(*keys, "t", "_bin")

    a = sized(left).withColumn("_bin", F.explode(F.array(*[F.col("_bin") + k for k in (-1, 0, 1)])))
    b = sized(right).select(*keys, "_bin", F.col("t").alias("o"))
    x, y = F.col("t"), F.col("o")
    pairs = a.join(b, [*keys, "_bin"]).where(x["text"] != y["text"])
    for_least = lambda t: (2.0 * F.least(x["length"], y["length"]) >= t * (x["length"] + y["length"]) - 1e-9) & _like_bound(x, y, t)
    least = F.when(F.arrays_overlap(x["said"], y["said"]), ALIKE_ENOUGH).otherwise(ALIKE)
    pairs = pairs.where(for_least(least)).withColumn("ratio", ratio_from(x["text"], y["text"], least)).where(F.col("ratio") > 0)
    return pairs.select(*keys, x["text"].alias("text"), y["text"].alias("other"), (F.col("ratio") >= ALIKE).alias("strong"))


def match_survival(before: DataFrame, after: DataFrame, scope: list[str]) -> DataFrame:
    """before_id, after_id, match_score, match_reason of each finding before, null and 0 where it is gone.

    Both sides: prepared(). Only findings of one rule are compared; those before go by ``id``, their order in the input.
    Which texts are alike is found by a join of the different texts of a key (not of its findings). What chooses in turn
    then reads a key's free findings, its like texts and its findings before, as hashes, in this order.
    """
    keys = [F.col(k) for k in scope] + [F.col("rule_name")]
    names = [F.xxhash64(*keys).alias("k1"), F.xxhash64(F.lit(7), *keys).alias("k2")]
    name = lambda c: F.when(F.col(c) != "", F.md5(F.col(c)))
    fields = lambda df, kind: df.select(*names, F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), name("text").alias("text"), name("message").alias("message"), F.col("line").cast("long").alias("line"), F.coalesce("print", F.lit("-")).alias("print"))
    told = lambda df: df.select(*names, "text", "message")
    like = alike_texts(told(before), told(after), ["k1", "k2"])
    like = like.select("k1", "k2", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), name("text").alias("text"), name("other").alias("message"), F.col("strong").cast("long").alias("line"), F.lit(None).cast("string").alias("print"))
    rows = fields(after, 0).unionByName(like).unionByName(fields(before, 2))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, choices = None, Choices()
        for b in batches:
            out = []
            for k1, k2, kind, *row in zip(*[b.column(c).to_pylist() for c in ("k1", "k2", "kind", "id", "text", "message", "line", "print")], strict=True):
                if (k1, k2) != key:
                    key, choices = (k1, k2), Choices()
                if kind == 0:
                    choices.offer(tuple(row))
                elif kind == 1:
                    choices.alike.setdefault(row[1], []).append((row[2], bool(row[3])))
                else:
                    out.append((row[0], *choices.choose(tuple(row))))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["before_id", "after_id", "match_score", "match_reason"])

    order = ["k1", "k2", "kind", "id"]
    return rows.repartition("k1", "k2").sortWithinPartitions(*order).mapInArrow(match, "before_id long, after_id long, match_score double, match_reason string")


def still_there(one: DataFrame, after: DataFrame, scope: list[str]) -> DataFrame:
    """survived, current (the id of the finding that it is now) of a single finding: match_survival() with one row before."""
    return match_survival(one, after, scope).select(F.col("after_id").isNotNull().alias("survived"), F.col("after_id").alias("current"))


def augmented(issues: DataFrame, more: DataFrame, scope: list[str]) -> DataFrame:
    """``issues`` and those of ``more`` that none of them is like in rule, line and message; of equal ones in ``more``, one."""
    name = F.trim(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("rule_id", "rule", "symbol", "type")], F.lit("unknown")))
    keyed = lambda df: df.withColumns({"_rule": name, "_line": F.coalesce("line", F.lit(0)), "_message": code.message_text(F.col("message"))})
    keys = [*scope, "_rule", "_line", "_message"]
    new = keyed(more).dropDuplicates(keys).join(keyed(issues).select(*keys).distinct(), keys, "left_anti")
    return issues.unionByName(new.drop("_rule", "_line", "_message").select(*issues.columns))
