"""Column expressions over file paths and repository names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders whose content is not written by hand.
NOISE_DIRS = [
    "node_modules", "vendor", "bower_components", "dist", "build", "out", ".next", ".nuxt", ".output", ".svelte-kit", ".vercel", ".netlify",
    "__pycache__", ".pytest_cache", ".tox", ".eggs", "*.egg-info", ".venv", "venv", "env", "site-packages", "test_env", "test-env",
    "coverage", ".nyc_output", "htmlcov", ".idea", ".vscode", "third_party", "third-party", "external", ".cache", ".turbo", ".parcel-cache", ".git",
    "wwwroot", "Scripts", "monaco", "codemirror", "ckeditor", "tinymce", "target", "bin", "obj", "_site", "public", "bundles", "packed", "compiled",
    "staticfiles", "media", "migrations", "tmp", "log", "App_Data", "App_Code", "App_GlobalResources", "artifacts", ".angular",
]
# Names and suffixes of files that are not written by hand.
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock"]
NOISE_SUFFIXES = [".min.js", ".min.css", ".bundle.js", ".chunk.js", ".pyc", ".pyo", ".class", ".o", ".so", ".dll", ".map"]
GENERATED_SUFFIXES = [
    ".Designer.cs", ".g.cs", ".g.i.cs", ".AssemblyInfo.cs", ".designer.vb", ".pb.go", ".pb.cc", ".pb.h", ".g.dart", "_generated.rs", ".auto.ts", ".generated.ts", ".gen.go",
]
GENERATED_PREFIXES = ["generated_", "auto_generated_", "autogenerated_"]
VENDOR_STEMS = [
    "jquery", "jquery-ui", "jquery.validate", "jquery.unobtrusive", "bootstrap", "popper", "react", "react-dom", "angular", "vue", "lodash", "underscore",
    "moment", "dayjs", "axios", "d3", "chart", "three", "pixi", "graphiql", "codemirror", "ace", "monaco", "highlight", "prism", "marked", "showdown", "socket.io", "signalr",
]
# Folders, suffixes and names of the path categories.
TEST_DIRS = ["test", "tests", "__tests__", "spec", "specs", "e2e", "integration", "unit"]
TEST_NAMES = [
    "test_", "_test.py", "conftest.py", ".test.js", ".test.ts", ".test.jsx", ".test.tsx", ".spec.js", ".spec.ts", ".spec.jsx", ".spec.tsx",
    "jest.config", "vitest.config", "cypress.config", "playwright.config", "_test.go", "test.java", "tests.java", "test.kt", "_spec.rb", "_test.rb", "test.cs", "tests.cs",
]
DOC_DIRS, DOC_EXTENSIONS = ["docs", "doc", "documentation", "wiki"], [".md", ".rst", ".txt", ".adoc", ".org", ".markdown"]
EXAMPLE_DIRS = ["example", "examples", "demo", "demos", "sample", "samples", "tutorial", "tutorials"]
DATA_DIRS, DATA_EXTENSIONS = ["data", "datasets", "dataset", "fixtures", "testdata", "test_data"], [".csv", ".tsv", ".parquet", ".jsonl"]
CONFIG_EXTENSIONS = [".yaml", ".yml", ".toml", ".json", ".ini", ".cfg", ".conf", ".properties", ".env"]
CONFIG_NAMES = [
    "package.json", "package-lock.json", "pyproject.toml", "setup.cfg", "setup.py", "requirements.txt", "Makefile", "Dockerfile",
    ".gitignore", ".eslintrc", ".prettierrc", "tsconfig.json", "babel.config.js", "webpack.config.js", "vite.config.js", "jest.config.js",
]
CODE_EXTENSIONS = [
    ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rb", ".rs", ".cpp", ".cc", ".c", ".h", ".hpp", ".cs", ".php", ".swift", ".kt", ".kts", ".scala", ".m", ".mm", ".lua", ".sh", ".bat", ".ps1",
]
# Language of each suffix, and the suffix that stands for a language.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".rb": "ruby",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".cpp": "cpp", ".cc": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".php": "php", ".swift": "swift", ".lua": "lua", ".sh": "shell", ".bat": "batch", ".ps1": "powershell",
}
SUFFIXES = {
    "python": ".py", "javascript": ".js", "typescript": ".ts", "go": ".go", "rust": ".rs", "ruby": ".rb", "java": ".java", "kotlin": ".kt", "scala": ".scala",
    "cpp": ".cpp", "c": ".c", "csharp": ".cs", "php": ".php", "swift": ".swift", "lua": ".lua", "shell": ".sh",
}
# What the analyses leave out besides.
ANALYZED_LANGUAGES = ["python", "javascript", "typescript"]
EXAMPLE_MARKS = ["/example", "/demo", "/sample", "/tutorial", "/playground"]
GENERATED_MARKS = ["/generated/", "/gen/", "/_generated/", ".generated.", ".pb.go", ".g.dart", "_generated.rs", ".auto.ts"]
VENDORED_MARKS = ["/vendor/", "/third_party/", "/external/", "/deps/"]
LIFECYCLE_EXTENSIONS = [
    ".json", ".lock", ".yaml", ".yml", ".toml", ".xml", ".md", ".rst", ".txt", ".adoc", ".svg", ".png", ".jpg", ".gif", ".ico", ".css", ".scss", ".less",
]
LIFECYCLE_NAMES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "Gemfile.lock", "poetry.lock", "composer.lock", "go.sum", ".gitignore", ".gitattributes", "LICENSE", "CHANGELOG", "CONTRIBUTING",
]


def falsy(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row: as the variable of a lambda. An expression that other lambdas name is made again for each of their elements."""
    return F.get(F.transform(F.array(value), use), 0)


def any_of(*tests: Column) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def listed(values: list[str]) -> Column:
    """An array of texts without commas; one expression, which is folded into a constant."""
    return F.split(F.lit(",".join(values)), ",")


def quoted(values: list[str]) -> str:
    """Any of some texts, as they are, as a regular expression."""
    return "(?:" + "|".join(f"\\Q{v}\\E" for v in values) + ")"


def has_any(text: Column, marks: list[str]) -> Column:
    return text.rlike(quoted(marks))


def starts_with_any(text: Column, starts: list[str]) -> Column:
    return text.rlike("^" + quoted(starts))


def ends_with_any(text: Column, ends: list[str]) -> Column:
    return text.rlike(quoted(ends) + r"\z")


def bare_path(path: Column) -> Column:
    """Without white space around it, and without slashes before it."""
    given = F.coalesce(path, F.lit(""))
    return F.when(given.rlike(r"^/|\s"), F.regexp_replace(F.regexp_replace(given, r"^\s+|\s+$", ""), "^/+", "")).otherwise(given)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The suffix with its dot; a name that only starts or ends with a dot has none."""
    return F.regexp_extract(F.rtrim(path, F.lit("/")), r"[^/](\.[^./]+)$", 1)


def stem(name: Column) -> Column:
    """A file's name without its suffix."""
    return F.regexp_replace(name, r"^(.+)\.[^./]+$", "$1")


def is_noise_path(path: Column) -> Column:
    """Whether a path lies among build output, dependencies, caches, or bundled and generated files. The path, its parts and its name are made once a row."""
    versions = r"[-.](?:\d|min|prod|production|development|slim|esm|umd|cjs)"
    # Only a name that begins like a vendor's is cut into its stem.
    vendor = lambda name, low: starts_with_any(low, VENDOR_STEMS) & F.get(F.split(F.lower(stem(name)), versions), 0).isin(VENDOR_STEMS)
    by_name = lambda name, low: any_of(
        low.rlike(f"{quoted(NOISE_SUFFIXES)}\\z|^{quoted(GENERATED_PREFIXES)}"), name.rlike(r"(?U)^\d+\.\w+.*\.js$"), name.isin(LOCK_FILES), vendor(name, low), ends_with_any(name, GENERATED_SUFFIXES)
    )
    by_parts = lambda parts: F.exists(parts, lambda x: x.isin(NOISE_DIRS) | x.endswith(".egg-info"))
    names = lambda p: once(F.struct(file_name(p).alias("name"), F.lower(file_name(p)).alias("low")), lambda n: by_name(n["name"], n["low"]))
    return once(bare_path(path), lambda p: once(F.split(p, "/"), by_parts) | names(p))


def path_category(path: Column) -> Column:
    """test, docs, example, data, config, code or other, whichever fits first."""
    p = bare_path(path)
    low, name = F.lower(p), file_name(p)
    parts, suffix = F.split(low, "/"), F.lower(extension(name))
    among = lambda names: F.arrays_overlap(parts, listed(names))
    return (
        F.when(among(TEST_DIRS) | has_any(F.lower(name), TEST_NAMES) | has_any(low, ["src/test/", "src\\test\\"]), "test")
        .when(among(DOC_DIRS) | suffix.isin(DOC_EXTENSIONS), "docs")
        .when(among(EXAMPLE_DIRS), "example")
        .when(among(DATA_DIRS) | suffix.isin(DATA_EXTENSIONS), "data")
        .when(suffix.isin(CONFIG_EXTENSIONS) | name.isin(CONFIG_NAMES), "config")
        .when(suffix.isin(CODE_EXTENSIONS), "code")
        .otherwise("other")
    )


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def language(path: Column) -> Column:
    return _lookup(F.lower(extension(F.coalesce(path, F.lit("")))), LANGUAGES, "other")


def report_language(path: Column) -> Column:
    """The language as reports name it: one of three, or other."""
    name = language(path)
    return F.when(name.isin(ANALYZED_LANGUAGES), name).otherwise("other")


def language_suffix(name: Column) -> Column:
    return _lookup(name, SUFFIXES, ".txt")


def skip_reason(path: Column) -> Column:
    """Why a changed file is not analyzed; null where it is."""
    p = F.coalesce(path, F.lit(""))
    low = F.lower(p)
    return (
        F.when(is_noise_path(p), "noise")
        .when(path_category(p) != "code", "non_code")
        .when(~language(p).isin(ANALYZED_LANGUAGES), "unsupported_language")
        .when(has_any(low, EXAMPLE_MARKS), "example")
        .when(has_any(low, GENERATED_MARKS), "generated")
        .when(has_any(low, VENDORED_MARKS), "vendored")
    )


def in_lifecycle(path: Column) -> Column:
    """Whether the later changes of a file are followed."""
    name = file_name(F.coalesce(path, F.lit("")))
    left_out = name.isin(LIFECYCLE_NAMES) | F.upper(name).isin(LIFECYCLE_NAMES) | F.lower(extension(name)).isin(LIFECYCLE_EXTENSIONS)
    return ~is_noise_path(path) & ~left_out & (path_category(path) == "code")


def in_destiny(path: Column) -> Column:
    """Whether the added lines of a file are looked up later on: code in any known language."""
    return ~is_noise_path(path) & (path_category(path) == "code") & (language(path) != "other")


def is_listed_path(line: Column) -> Column:
    """Whether a line of a commit's file listing is a path, and not the commit's own hash."""
    return (F.trim(line) != "") & ~F.trim(line).rlike("^[0-9a-f]{40}$")


def stability(lines_added: Column, lines_exist: Column, semantic_rate: Column) -> Column:
    """How a file fared: deleted (no line left), stable (0.8 of its units or, where those are unknown, of its lines), or modified."""
    lines = F.when(lines_added > 0, lines_exist / lines_added).otherwise(0.0)
    return F.when((lines_added > 0) & (lines_exist == 0), "deleted").when(F.coalesce(semantic_rate, lines) >= 0.8, "stable").otherwise("modified")


def repo_from_folder(folder: Column) -> Column:
    """Only the first underscore of a folder name stands for the slash."""
    return F.concat_ws("/", F.split(folder, "_", 2))


def repo_name(repo: Column, file: Column) -> Column:
    """The name a document gives, else that of its file (owner_name_commits.json)."""
    named = F.regexp_replace(stem(file_name(file)), "_commits$", "")
    return F.coalesce(falsy(repo), repo_from_folder(named))


def dataset_name(name: Column) -> Column:
    """A data set's name if it is safe as part of a path (letters, digits, dot, dash, underscore); null for any other."""
    return F.when(name.rlike(r"(?U)^[\p{Alnum}._-]+$"), name)


def month_text(ts: Column) -> Column:
    """The author's own month: a text prefix, never shifted to another zone."""
    return F.substring(ts.cast("string"), 1, 7)
