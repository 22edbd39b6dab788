"""Where results go: JSON documents, CSV tables, detail files, and what keeps repeated runs short."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file in whatever store Spark writes to; it replaces what is there."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_json(spark: SparkSession, document: object, path: str) -> None:
    """A small document, indented, as it is."""
    write_text(spark, path, json.dumps(document, indent=2, ensure_ascii=False, default=str))


def report_document(blocks: dict[str, DataFrame | object], most: int = 10_000) -> dict:
    """A report of many blocks as one document. A block is a report's rows (a few; more than ``most`` is an error) or a plain value."""
    out = {}
    for name, block in blocks.items():
        if isinstance(block, DataFrame):
            rows = block.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"{name} is no report: over {most} rows")
            block = [r.asDict(recursive=True) for r in rows]
        out[name] = block
    return out


def write_lines(df: DataFrame, path: str) -> None:
    """A table of any size as folders of JSON lines."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A table of any size, with a header, and these columns alone; those it lacks are empty."""
    have = set(df.columns)
    df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def repo_tool_rows(repos: DataFrame) -> DataFrame:
    """A row for each repository and tool: repo_name, ai_tool, commit_count, stars, language, url."""
    rows = repos.select("full_name", "stars", "language", "url", F.explode("commit_counts").alias("ai_tool", "commit_count"))
    return rows.select(F.col("full_name").alias("repo_name"), "ai_tool", "commit_count", F.coalesce("stars", F.lit(0)).alias("stars"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce("url", F.lit("")).alias("url"))


def write_details(details: DataFrame, path: str) -> None:
    """A folder for each repository, with the details of its commits; a repository that is written again replaces its folder alone."""
    named = details.withColumn("repo_folder", F.regexp_replace("repo", "/", "_"))
    named.repartition("repo_folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_folder").json(path)


def append_if_absent(spark: SparkSession, path: str, names: list[str]) -> list[str]:
    """A JSON list of names, to which those it lacks are added at its end."""
    try:
        have = json.loads(read_text(spark, path) or "[]")
    except json.JSONDecodeError:
        have = []
    have = have if isinstance(have, list) else []
    new = [n for n in dict.fromkeys(names) if n not in have]
    if new or read_text(spark, path) is None:
        write_json(spark, have + new, path)
    return have + new


def completed(spark: SparkSession, path: str, key: str = "completed") -> list[str]:
    """What a checkpoint says is done; nothing where there is none, or where it can't be read."""
    try:
        found = json.loads(read_text(spark, path) or "{}")
    except json.JSONDecodeError:
        return []
    return found.get(key, []) if isinstance(found, dict) else []


def complete(spark: SparkSession, path: str, done: list[str], key: str = "completed") -> None:
    write_json(spark, {key: sorted(set(completed(spark, path, key)) | set(done))}, path)


def still_to_do(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def newest(spark: SparkSession, pattern: str) -> int | None:
    """When the latest file that ``pattern`` names was changed (milliseconds); of a folder, the files in it."""
    fs, p = _path(spark, pattern)
    found = fs.globStatus(p)
    times = []
    for status in found or []:
        if status.isDirectory():
            inner = fs.listFiles(status.getPath(), True)
            while inner.hasNext():
                times.append(inner.next().getModificationTime())
        else:
            times.append(status.getModificationTime())
    return max(times) if times else None


def needs_update(spark: SparkSession, result: str, inputs: list[str]) -> bool:
    """Whether any input (data or code) is newer than the result, or there is no result."""
    made = newest(spark, result)
    changes = [t for t in (newest(spark, i) for i in inputs) if t is not None]
    return made is None or any(t > made for t in changes)


def cached(spark: SparkSession, result: str, inputs: list[str], build: Callable[[], dict], force: bool = False) -> dict:
    """The document at ``result``, built anew only if an input is newer."""
    if not force and not needs_update(spark, result, inputs):
        return json.loads(read_text(spark, result))
    document = build()
    write_json(spark, document, result)
    return document


def remove(spark: SparkSession, root: str, names: list[str] | None = None) -> list[str]:
    """Delete the named results below ``root``, or all of them; names that lead out of it are refused."""
    fs, p = _path(spark, root)
    if not fs.exists(p):
        return []
    if names is None:
        names = [s.getPath().getName() for s in fs.listStatus(p)]
    if bad := [n for n in names if not re.fullmatch(r"[\w.-]+", n) or n in (".", "..")]:
        raise ValueError(f"not the name of a result: {bad[0]}")
    return [n for n in names if fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p, n), True)]


LATEX = str.maketrans({"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"})


def latex_table(rows: DataFrame | list[list], columns: list[str], caption: str = "", label: str = "", most: int = 1000) -> str:
    """A report's rows as a LaTeX table: numbers to the right, with two places where they are fractions."""
    if isinstance(rows, DataFrame):
        rows = [list(r) for r in rows.select(*columns).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v).translate(LATEX)
    number = lambda i: all(isinstance(r[i], int | float) for r in rows if r[i] is not None)
    spec = "".join("r" if rows and number(i) else "l" for i in range(len(columns)))
    lines = [r"\begin{table}[t]", r"\centering", *([rf"\caption{{{caption.translate(LATEX)}}}"] if caption else []), *([rf"\label{{{label}}}"] if label else []), rf"\begin{{tabular}}{{{spec}}}", r"\toprule"]
    lines += [" & ".join(c.translate(LATEX) for c in columns) + r" \\", r"\midrule", *[" & ".join(map(cell, r)) + r" \\" for r in rows], r"\bottomrule", r"\end{tabular}", r"\end{table}"]
    return "\n".join(lines)


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions of what made a result."""
    import platform

    import pyarrow
    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "spark": spark.version, "pyarrow": pyarrow.__version__, "java": spark._jvm.System.getProperty("java.version"), "system": platform.platform()}


def refresh_server(rebuild: Callable[[str], dict], port: int = 0, default: str = "out") -> ThreadingHTTPServer:
    """A server on this machine whose /refresh?dataset=<name> rebuilds a report and answers with it; names that are no plain names are refused."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body: dict) -> None:
            raw = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            asked = urlparse(self.path)
            name = parse_qs(asked.query).get("dataset", [default])[0]
            if asked.path != "/refresh":
                self.answer(404, {"ok": False, "error": "unknown path"})
            elif not re.fullmatch(r"[\w.-]+", name):
                self.answer(400, {"ok": False, "error": "invalid dataset"})
            else:
                try:
                    self.answer(200, {"ok": True, "result": rebuild(name)})
                except Exception as e:  # the caller is told, the server goes on
                    self.answer(500, {"ok": False, "error": str(e)})

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
