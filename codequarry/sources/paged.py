"""Captured pages of a server's list of commits as a data source of Spark.

    spark.dataSource.register(CommitPages)
    spark.read.format("commit_pages").load("/captured").where("date >= '2025-01-01T00:00:00Z'")

A folder has a folder for each repository (its name with __ for /), with page-1.json, page-2.json, ... as the server gave
them: a JSON list of up to 100 commits, the latest first. Each page is a partition. A lower bound on ``date`` is pushed into
the reader, which stops within a page at the first older commit. Option ``max_commits``: only the first so many of each repository.
Paths are those of pyarrow's file systems (local, hdfs, s3, gs). Nothing is fetched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "repo string, page int, sha string, author_name string, author_email string, login string, date string, message string, url string"
PER_PAGE = 100
_PAGE = re.compile(r"page-(\d+)\.json")


class Page(InputPartition):
    def __init__(self, repo: str, number: int, path: str):
        self.repo, self.number, self.path = repo, number, path


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, most = options["path"], options.get("max_commits")
        self.most = int(most) if most else None
        self.since: str | None = None
        self.repo: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes lower bounds of ``date`` (to end pages early; Spark still tests its own) and one ``repo`` (to leave other folders out)."""
        for f in filters:
            match f:
                case GreaterThanOrEqual(("date",), value) | GreaterThan(("date",), value):
                    self.since = max(self.since or value, value)
                    yield f
                case (EqualTo(("repo",), value) | EqualNullSafe(("repo",), value)) if self.repo is None:
                    self.repo = value
                case _:
                    yield f

    def partitions(self) -> list[Page]:
        from pyarrow import fs

        system, root = _file_system(self.path)
        out = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            folder, name = info.path.rsplit("/", 2)[-2:]
            if info.is_file and (m := _PAGE.fullmatch(name)):
                repo, number = folder.replace("__", "/", 1), int(m[1])
                if self.repo in (None, repo) and (self.most is None or (number - 1) * PER_PAGE < self.most):
                    out.append(Page(repo, number, info.path))
        return out or [Page("", 0, "")]

    def read(self, page: Page) -> Iterator[tuple]:
        if not page.path:
            return
        system, _ = _file_system(self.path)
        with system.open_input_stream(page.path) as f:
            try:
                commits = json.loads(f.read().decode("utf-8-sig", "replace"))
            except ValueError:
                return  # no JSON
        if not isinstance(commits, list):  # an error message
            return
        room = PER_PAGE if self.most is None else self.most - (page.number - 1) * PER_PAGE
        for c in commits[:room]:
            commit = c.get("commit") or {}
            author = commit.get("author") or {}
            if self.since is not None and (author.get("date") or "") < self.since:
                return  # pages run from the latest to the oldest
            yield page.repo, page.number, c.get("sha"), author.get("name"), author.get("email"), (c.get("author") or {}).get("login"), author.get("date"), commit.get("message"), c.get("html_url")


class CommitPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "commit_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options)


def read_commit_pages(spark, path: str, max_commits: int | None = None):
    """The commits of all captured pages at ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CommitPages)
    reader = spark.read.format("commit_pages")
    return (reader.option("max_commits", str(max_commits)) if max_commits else reader).load(path)
