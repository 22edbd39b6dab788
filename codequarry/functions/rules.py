"""Column expressions over analyzer rules: what is blocked, of low signal, or likely no finding at all.

An issue is a row with type, severity, line, rule, symbol, rule_id, message, category, detected_by.
Which of its three names counts as its rule differs from one use to the next, so each function
says which comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.paths import any_of, ends_with_any, falsy, has_any, starts_with_any

# Rules that never count, and that don't count in tests or in simulations.
BLOCKED_RULES = ["no-console", "curly", "import-error", "no-name-in-module"]
TEST_RULES = ["node_api_key", "node_password", "hardcoded_password", "hardcoded_password_default", "hardcoded_password_funcarg", "jwt_exposed", "hardcoded_jwt_secret"]
SIMULATION_RULES = ["node_insecure_random_generator", "insecure_random"]
DEV_TOOL_RULES: list[str] = []
# Rules of style, which are hidden by default.
LOW_SIGNAL_RULES = [
    "line-too-long", "trailing-whitespace", "missing-function-docstring", "missing-module-docstring", "missing-class-docstring", "invalid-name", "bad-indentation",
    "consider-using-f-string", "too-many-arguments", "too-many-locals", "too-many-positional-arguments", "too-few-public-methods", "no-else-return",
    "logging-fstring-interpolation", "import-outside-toplevel", "@typescript-eslint/no-magic-numbers", "no-magic-numbers", "sort-keys", "one-var", "id-length",
    "@typescript-eslint/explicit-member-accessibility", "@typescript-eslint/explicit-function-return-type", "@typescript-eslint/explicit-module-boundary-types",
    "@typescript-eslint/member-ordering", "@typescript-eslint/consistent-type-imports", "@typescript-eslint/no-explicit-any", "@typescript-eslint/no-inferrable-types",
    "@typescript-eslint/init-declarations", "@typescript-eslint/class-methods-use-this", "@typescript-eslint/method-signature-style",
    "@typescript-eslint/no-non-null-assertion", "@typescript-eslint/no-require-imports", "@typescript-eslint/prefer-readonly", "@typescript-eslint/naming-convention",
    "@typescript-eslint/sort-type-constituents", "@typescript-eslint/no-empty-object-type", "capitalized-comments", "camelcase", "class-methods-use-this",
    "consistent-return", "curly", "default-case", "func-names", "func-style", "guard-for-in", "init-declarations", "line-comment-position",
    "logical-assignment-operators", "max-lines", "max-lines-per-function", "max-statements", "multiline-comment-style", "no-bitwise", "no-console", "no-continue",
    "no-inline-comments", "no-negated-condition", "no-nested-ternary", "no-param-reassign", "no-plusplus", "no-ternary", "no-undefined", "no-underscore-dangle",
    "no-use-before-define", "@typescript-eslint/no-use-before-define", "no-var", "no-void", "object-shorthand", "prefer-arrow-callback", "prefer-const",
    "prefer-destructuring", "prefer-named-capture-group", "prefer-rest-params", "prefer-spread", "prefer-template", "require-await", "require-unicode-regexp",
    "sort-imports", "sort-vars", "strict", "vars-on-top", "no-invalid-this", "@typescript-eslint/array-type", "@typescript-eslint/max-params",
    "@typescript-eslint/consistent-type-definitions", "@typescript-eslint/parameter-properties", "@typescript-eslint/prefer-for-of",
    "@typescript-eslint/no-empty-function", "no-empty-function", "@typescript-eslint/prefer-nullish-coalescing", "@typescript-eslint/no-unnecessary-condition",
]
# Names that are defined by the surroundings of a script, and how such names begin.
AMBIENT_NAMES = [
    "$", "_", "$derived", "$state", "AbortSignal", "Bun", "Byond", "CloseEvent", "Deno", "DOMException", "Document", "Electron", "Hi", "Image", "Intl", "JSX",
    "MessageEvent", "MediaQueryList", "MediaQueryListEvent", "Meteor", "MouseEvent", "Node", "NodeJS", "ReadableStream", "React", "RequestInit", "SVGElement",
    "SVGSVGElement", "Template", "TouchEvent", "Window", "WebdriverIO", "YT", "alert", "assert", "chrome", "customElements", "define", "jQuery", "ko", "location",
    "postMessage", "self", "setImmediate",
]
AMBIENT_PREFIXES = [
    "Abort", "ArrayBuffer", "BigInt", "Blob", "Canvas", "CustomEvent", "DataView", "DOM", "Document", "Element", "Event", "File", "Float", "FormData", "HTML",
    "Headers", "Image", "Intersection", "Intl", "Keyboard", "Map", "MediaQuery", "Message", "Mutation", "Node", "Observer", "Promise", "Proxy", "React", "Readable",
    "Reflect", "Request", "Resize", "Response", "Set", "SVG", "Symbol", "Text", "Touch", "URL", "Uint", "Weak", "Window", "Writable",
]
SIMULATION_WORDS = ["simulation", "simulator", "simulate", "mock", "mocked", "mocking", "stub", "stubbed", "fake", "faked", "quantum"]
# Patterns of test files (any case, then this case), and of developers' tools.
TEST_PATTERNS = [
    r"[/\\]tests?[/\\]", r"[/\\]__tests__[/\\]", r"[/\\]spec[/\\]", r"[/\\]fixtures?[/\\]", r"[/\\]mocks?[/\\]", r"[/\\]testdata[/\\]", r"[/\\]testing[/\\]",
    r"_test\.py$", r"test_[^/\\]+\.py$", r"[/\\]conftest\.py$", r"\.test\.[jt]sx?$", r"\.spec\.[jt]sx?$", r"[/\\]jest\.config\.[jt]s$", r"[/\\]vitest\.config\.[jt]s$",
    r"[/\\]cypress[/\\]", r"[/\\]playwright[/\\]", r"_test\.go$", r"[/\\]src[/\\]test[/\\]", r"[/\\]tests[/\\][^/\\]+\.rs$", r"_spec\.rb$", r"_test\.rb$", r"[/\\][^/\\]+\.Tests?[/\\]",
]
TEST_PATTERNS_BY_CASE = [r"Test\.java$", r"Tests\.java$", r"Test\.kt$", r"Tests?\.cs$"]
DEV_TOOL_PATTERNS = [
    r"[/\\]cli\.py$", r"[/\\]__main__\.py$", r"[/\\]cli\.[jt]s$", r"[/\\]cli[/\\]index\.[jt]s$", r"[/\\]scripts?[/\\][^/\\]+\.(py|js|ts|sh|rb)$", r"[/\\]bin[/\\][^/\\]+$",
    r"[/\\]tools?[/\\][^/\\]+\.(py|js|ts|sh|go)$", r"dev[-_]?server\.[jt]sx?$", r"[/\\]serve\.[jt]s$", r"[/\\]cmd[/\\][^/\\]+[/\\]main\.go$",
]
LOW_SEVERITIES = ["low", "info", "style", "convention", "refactor"]


def _either(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def counted_rule(rule: Column, symbol: Column, rule_id: Column) -> Column:
    """The name that findings are counted by."""
    return F.coalesce(falsy(symbol, rule, rule_id), F.lit("unknown"))


def signal_rule(rule: Column, symbol: Column, rule_id: Column) -> Column:
    """The name that decides on low signal."""
    return _text(falsy(rule, symbol, rule_id))


def family_rule(rule: Column, symbol: Column, rule_id: Column) -> Column:
    """The name that decides on security and family."""
    return _text(falsy(rule_id, symbol, rule))


def survival_rule(rule: Column, symbol: Column, rule_id: Column, kind: Column, check_id: Column | None = None) -> Column:
    """The name that survival is matched and summed by."""
    checks = [check_id] if check_id is not None else []
    return F.trim(F.coalesce(falsy(rule_id, rule, symbol, *checks, kind), F.lit("unknown")))


def introduced_rule(rule: Column, symbol: Column, kind: Column) -> Column:
    """The name that an introduced finding is handed on to the survival match by."""
    return F.coalesce(falsy(symbol, rule, kind), F.lit("unknown"))


def is_test_file(path: Column) -> Column:
    return _text(path).rlike(f"(?i){_either(TEST_PATTERNS)}") | _text(path).rlike(_either(TEST_PATTERNS_BY_CASE))


def is_dev_tool(path: Column) -> Column:
    return _text(path).rlike(f"(?i){_either(DEV_TOOL_PATTERNS)}")


def is_simulation(path: Column, content: Column | None = None) -> Column:
    """A word of simulations anywhere in the path, or as a whole word in the content."""
    found = has_any(F.lower(_text(path)), SIMULATION_WORDS)
    return found if content is None else found | F.lower(_text(content)).rlike(rf"(?U)\b({'|'.join(SIMULATION_WORDS)})\b")


def filter_context(path: Column, content: Column | None = None, given: Column | None = None) -> Column:
    """Struct is_test, is_simulation, is_dev of a file; one that is given goes first."""
    made = F.struct(is_test_file(path).alias("is_test"), is_simulation(path, content).alias("is_simulation"), is_dev_tool(path).alias("is_dev"))
    return made if given is None else F.coalesce(given, made)


def is_blocked(rule: Column, context: Column) -> Column:
    """Rules that don't count at all, or not in the context."""
    r = _text(rule)
    # The rule goes first: the context of a file takes long patterns, and few rules ask for it.
    within = lambda k, names: r.isin(names) & F.coalesce(context[k], F.lit(False))
    return any_of(r.isin(BLOCKED_RULES), within("is_test", TEST_RULES), within("is_simulation", SIMULATION_RULES), *([within("is_dev", DEV_TOOL_RULES)] if DEV_TOOL_RULES else []))


def block_rule(rule_key: Column, symbol: Column) -> Column:
    """The name that blocking goes by: that under the analyzer's own key, else the symbol."""
    return _text(falsy(rule_key, symbol))


def unblocked_issues(issues: DataFrame, path: str = "file_path", rule_key: str = "rule", content: str | None = None, context: str | None = None) -> DataFrame:
    """The rows of ``issues`` that blocking leaves."""
    around = filter_context(F.col(path), F.col(content) if content else None, F.col(context) if context else None)
    return issues.where(~is_blocked(block_rule(F.col(rule_key), F.col("symbol")), around))


def is_ambient_no_undef(rule: Column, message: Column, path: Column) -> Column:
    """An undefined name that only an analysis out of its project calls so."""
    low = F.lower(F.replace(_text(path), F.lit("\\"), F.lit("/")))
    name = F.regexp_extract(_text(message), r"^'([^']+)' is not defined\.\n?$", 1)
    known = (name != "") & (name.isin(AMBIENT_NAMES) | starts_with_any(name, AMBIENT_PREFIXES))
    return (_text(rule) == "no-undef") & (low.endswith(".d.ts") | (ends_with_any(low, [".js", ".jsx", ".ts", ".tsx"]) & known))


def is_low_signal(rule: Column, message: Column, path: Column, rules: list[str] | None = None) -> Column:
    """``rule``: as signal_rule() has it. ``rules`` replaces the list of rules of style."""
    r, m = _text(rule), _text(message)
    return any_of(
        r.isin(LOW_SIGNAL_RULES if rules is None else rules),
        (r == "no-redeclare") & m.contains("built-in global variable"),
        (r == "@typescript-eslint/no-unused-vars") & m.contains("only used as a type"),
        is_ambient_no_undef(r, m, path),
    )


def is_low_severity(severity: Column, low_signal: Column) -> Column:
    return F.lower(F.coalesce(severity, F.lit("unknown"))).isin(LOW_SEVERITIES) | low_signal


#: The display's own lists: older, and so shorter or longer than those of the analyses.
DISPLAY_BLOCKED_RULES = ["B101", *BLOCKED_RULES]
DISPLAY_TEST_RULES = [*TEST_RULES, "B105", "B106", "B107"]
DISPLAY_DEV_TOOL_RULES = ["B404", "B108"]
DISPLAY_LOW_SIGNAL_RULES = LOW_SIGNAL_RULES[: LOW_SIGNAL_RULES.index("vars-on-top") + 1]
# Rules that a severity of their own is set for, rules of style, of convention, and that are likely wrong.
SEVERITY_OVERRIDES = {"node_insecure_random_generator": "LOW", "insecure_random": "LOW", "B404": "LOW"}
STYLE_RULES = ["line-too-long", "trailing-whitespace", "missing-final-newline", "bad-indentation", "wrong-import-order", "wrong-import-position", "superfluous-parens", "trailing-newlines"]
CONVENTION_RULES = ["missing-function-docstring", "missing-class-docstring", "missing-module-docstring", "invalid-name", "disallowed-name", "empty-docstring"]
LIKELY_WRONG_RULES = ["no-member", "not-an-iterable", "not-callable", "unexpected-keyword-arg", "no-undef", "used-before-assignment", "no-value-for-parameter", "no-self-argument"]
NOISE_RULES = sorted({*STYLE_RULES, *CONVENTION_RULES, *LIKELY_WRONG_RULES, *LOW_SIGNAL_RULES})
# Paths of installed and of vendored code, and rules that mean little in scripts.
EMBEDDED_MARKS = ["/site-packages/", "/dist-packages/", "/.venv/", "/venv/", "/env/", "/virtualenv/"]
DEPENDENCY_MARKS = ["/_vendor/", "/vendor/", "/third_party/", "/third-party/", "/external/", "/node_modules/"]
SCRIPT_RULES = ["logging-fstring-interpolation", "import-outside-toplevel", "unspecified-encoding"]
# Messages and rules of ESLint that tell of its surroundings, not of the code.
ESLINT_MESSAGES = ["Cannot find module", "Unable to resolve path", "Definition for rule", "Failed to load plugin", "Cannot read config file"]
ESLINT_PREFIXES = ["import/", "node/", "react/"]
# The tools that reports look at by themselves.
FOCUSED_TOOLS = ["claude", "copilot", "cursor", "devin", "gemini"]


def false_positive_pattern(path: Column, rule: Column) -> Column:
    """embedded_env, vendored_dependency, dev_tool_context, or null."""
    p = F.lower(F.replace(_text(path), F.lit("\\"), F.lit("/")))
    return (
        F.when(has_any(p, EMBEDDED_MARKS), "embedded_env")
        .when(has_any(p, DEPENDENCY_MARKS), "vendored_dependency")
        .when(_text(rule).isin(SCRIPT_RULES) & p.rlike("(^|/)(scripts?|tools?|cli|bin)(/|$)"), "dev_tool_context")
    )


def is_actionable(rule: Column, pattern: Column, low_signal: Column) -> Column:
    """``rule``: as counted_rule() has it."""
    return ~rule.isin(NOISE_RULES) & pattern.isNull() & ~low_signal


def overridden_severity(rule: Column, severity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_OVERRIDES.items() for x in kv]), rule), severity)


def is_eslint_artefact(rule_id: Column, message: Column) -> Column:
    """No rule at all, a parsing error, or something missing around the code."""
    m = _text(message)
    return rule_id.isNull() | m.startswith("Parsing error") | has_any(m, ESLINT_MESSAGES) | starts_with_any(rule_id, ESLINT_PREFIXES)


def size_reason(content: Column, language: Column, limit: int = 1 << 20) -> Column:
    """Why a file's content is not analyzed: it is too large, or, of JavaScript and TypeScript, minified or bundled. Null where it is."""
    at, n = F.instr(content, "\n"), F.length(content)
    first = F.when(at > 0, at - 1).otherwise(n)
    lines = n - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    script = language.isin("javascript", "typescript")
    return (
        F.when(F.octet_length(content) > limit, "too_large")
        .when(script & (first > 5000), "minified")
        .when(script & (n > 10_000) & (n / lines > 500), "bundled")
    )
