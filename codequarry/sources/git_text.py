"""Captured git output as tables: logs, name-status, numstat, diffs and blame.

Each function takes rows that hold the output as text and keeps the caller's ``keys``, which tell texts apart.
Output of one command is one text, so a text is parsed where it lies and only its lines
are spread out. Where a line belongs to a header above it, the text is cut at its headers; nothing
is ordered or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"


def output_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A row for each line: keys, line_no (from 0), line. A null text has none; the end of the text is no line."""
    lines = F.split(F.regexp_replace(F.col(text), r"\r?\n$", ""), r"\r?\n")
    return df.select(*keys, F.posexplode(F.when(F.col(text) != "", lines)).alias("line_no", "line"))


def log_entries(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """Of lines ``hash|name|email|seconds|subject``: a row for each; a bad time is 0, lines with fewer fields go.
    The subject may hold bars of its own."""
    part = F.split("line", r"\|", 5)
    rows = output_lines(df, keys, text).select(*keys, "line_no", part.alias("f")).where(F.size("f") == 5)
    ts = F.coalesce(F.expr("try_cast(trim(f[3]) AS bigint)"), F.lit(0).cast("long"))
    return rows.select(*keys, "line_no", *[F.get("f", i).alias(c) for i, c in ((0, "commit_hash"), (1, "author_name"), (2, "author_email"))], ts.alias("timestamp"), F.get("f", 4).alias("subject"))


def renamed_path(path: Column) -> Column:
    """The new path of ``a/{x => y}/b`` or ``x => y``; any other path is itself."""
    in_braces = F.regexp_replace(path, r"^([^{]*)\{[^}]*? => ([^}]*)\}(.*)$", "$1$2$3")
    return (
        F.when(~path.contains(" => "), path)
        .when(path.rlike(r"^[^{]*\{[^}]*? => [^}]*\}"), in_braces)
        .otherwise(F.regexp_replace(path, r"^(?s).*? => ", ""))
    )


def name_status(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """A row for each changed file: status as written (R100, C75, M, ..), path (the new one of renames and copies)."""
    f = F.split("line", "\t")
    rows = output_lines(df, keys, text).where(F.trim("line") != "").select(*keys, "line_no", f.alias("f"))
    moved = F.get("f", 0).rlike("^[RC]") & (F.size("f") >= 3)
    return rows.where(F.size("f") >= 2).select(*keys, "line_no", F.get("f", 0).alias("status"), renamed_path(F.when(moved, F.get("f", 2)).otherwise(F.get("f", 1))).alias("path"))


def numstat(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """A row for each file: path, added, deleted; binary files (``-``) have nulls."""
    rows = output_lines(df, keys, text).select(*keys, "line_no", F.split("line", "\t").alias("f")).where(F.size("f") >= 3)
    whole = lambda i: F.expr(f"try_cast(f[{i}] AS int)")
    return rows.select(*keys, "line_no", renamed_path(F.get("f", 2)).alias("path"), whole(0).alias("added"), whole(1).alias("deleted"))


def _hunks(text: Column) -> Column:
    """(first_line, last_line) of each hunk in a text that has lines on the new side."""
    first = lambda x: F.regexp_extract(x, HUNK, 1).cast("int")
    n = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, HUNK, 2), F.lit("")).cast("int"), F.lit(1))
    heads = F.filter(F.split(text, "\n"), lambda x: x.startswith("@@ -") & x.rlike(HUNK))
    ends = F.transform(heads, lambda x: F.struct(first(x).alias("first_line"), n(x).alias("n")))
    ends = F.transform(ends, lambda h: F.struct(h["first_line"].alias("first_line"), (h["first_line"] + h["n"] - 1).alias("last_line")))
    return F.filter(ends, lambda h: h["last_line"] >= h["first_line"])


def changed_ranges(df: DataFrame, keys: list[str], text: str = "patch") -> DataFrame:
    """A row for each hunk of a one-file diff that has lines on the new side: first_line, last_line. A count left out is 1."""
    return df.select(*keys, F.explode_outer(_hunks(F.col(text))).alias("h")).where("h IS NOT NULL").select(*keys, "h.first_line", "h.last_line")


def changed_lines(df: DataFrame, keys: list[str], text: str = "patch") -> DataFrame:
    """A row for each new-side line number that a hunk of a text covers, once."""
    lines = F.flatten(F.transform(_hunks(F.col(text)), lambda h: F.sequence(h["first_line"], h["last_line"])))
    return df.select(*keys, F.explode_outer(F.array_distinct(lines)).alias("line")).where("line IS NOT NULL")


def file_patches(df: DataFrame, keys: list[str], text: str = "diff", fallback: str | None = None) -> DataFrame:
    """A row for each file of a diff: path, lines (of its patch), added (its added lines without the plus).

    The path is that after ``+++``, or of the ``diff --git`` line where that is /dev/null or
    missing. A text without such parts is one patch of the path in column ``fallback``.
    """
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"(?=\ndiff --git)")
    rows = df.select(*keys, F.posexplode(F.filter(parts, lambda p: p.startswith("\ndiff --git"))).alias("part_no", "part"))
    new = F.regexp_extract("part", r"\n\+\+\+ (?:b/)?([^\n]*?)[ \t\r]*(?:\n|$)", 1)
    named = F.regexp_replace(F.coalesce(F.get(F.split(F.get(F.split("part", "\n"), 1), r"\s+"), 3), F.lit("")), "^b/", "")
    rows = rows.select(*keys, "part_no", F.when((new != "") & (new != "/dev/null"), new).otherwise(named).alias("path"), F.filter(F.slice(F.split("part", "\n"), 3, 1 << 30), lambda x: ~x.startswith("+++ ")).alias("lines"))
    rows = rows.where((F.col("path") != "") & (F.size("lines") > 0))
    if fallback:
        bare = df.where(~F.concat(F.lit("\n"), F.col(text)).contains("\ndiff --git") & (F.col(fallback) != ""))
        rows = rows.unionByName(bare.select(*keys, F.lit(0).alias("part_no"), F.col(fallback).alias("path"), F.split(text, "\n").alias("lines")))
    plus = F.filter("lines", lambda x: x.startswith("+") & ~x.startswith("+++"))
    return rows.withColumn("added", F.transform(plus, lambda x: F.substring(x, 2, 1 << 30)))


def _sections(df: DataFrame, keys: list[str], text: str, header: str) -> DataFrame:
    """A row for each line that begins with ``header``: keys, section (it and the lines up to the next). Lines above the first belong to none.

    explode() would cut the texts twice, once to leave out those without sections.
    """
    parts = F.filter(F.split(F.col(text), f"\\n(?={header})"), lambda p: p.rlike(f"^(?:{header})"))
    return df.select(*keys, F.explode_outer(parts).alias("section")).where("section IS NOT NULL")


def added_ranges(df: DataFrame, keys: list[str], text: str = "diff") -> DataFrame:
    """A row for each hunk of a diff of many files that has lines on the new side: path (of the ``+++ b/`` line above it), start, stop."""
    rows = _sections(df, keys, text, r"\+\+\+ b/")
    first = F.substring_index("section", "\n", 1)
    path = F.substring(F.when(first.endswith("\r"), F.substring(first, 1, F.length(first) - 1)).otherwise(first), 7, 1 << 30)
    rows = rows.select(*keys, path.alias("path"), _hunks(F.col("section")).alias("hunks"))
    return rows.select(*keys, "path", F.explode_outer("hunks").alias("h")).where("h IS NOT NULL").select(*keys, "path", F.col("h.first_line").alias("start"), F.col("h.last_line").alias("stop"))


def _content_lines(text: Column) -> Column:
    """How many lines of blame output hold content: a tab comes first."""
    below = F.concat(F.lit("\n"), text)
    return (F.length(below) - F.length(F.replace(below, F.lit("\n\t"), F.lit("\t")))).cast("long")


def blame_counts(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """A row for each commit in porcelain blame output: sha, n_lines: the content lines (tab first) that stand below its headers."""
    rows = _sections(df, keys, text, r"[0-9a-f]{40}(?:\s|$)").select(*keys, F.substring("section", 1, 40).alias("sha"), _content_lines(F.col("section")).alias("n"))
    return rows.where("n > 0").groupBy(*keys, "sha").agg(F.sum("n").alias("n_lines"))


def blame_totals(df: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """keys, total_lines: all content lines of the output."""
    return df.where(F.col(text) != "").groupBy(*keys).agg(F.sum(_content_lines(F.col(text))).alias("total_lines"))
