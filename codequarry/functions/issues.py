"""Column expressions over analyzer findings: severity, security, family, tainted commits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions.paths import falsy

# Rules that tell of a bug.
BUG_RULES = [
    "undefined-variable", "possibly-used-before-assignment", "not-callable", "not-an-iterable", "missing-kwoa", "function-redefined",
    "access-member-before-definition", "assignment-from-no-return", "unsubscriptable-object", "unreachable", "no-unreachable", "no-redeclare",
    "no-dupe-keys", "no-dupe-args", "no-dupe-else-if", "no-func-assign", "no-import-assign", "no-self-assign", "no-self-compare", "use-isnan",
    "no-setter-return", "getter-return", "no-constant-binary-expression", "no-constructor-return", "valid-typeof", "no-loss-of-precision",
]


def _low(*cols: Column) -> Column:
    return F.lower(F.coalesce(falsy(*cols), F.lit("")))


def severity_level(kind: Column, detected_by: Column, severity: Column) -> Column:
    """high, medium or low; each analyzer has words of its own for it, and what none knows is medium."""
    t, s = _low(kind, detected_by), _low(severity)
    pylint = F.when(s.isin("fatal", "error"), "high").when(s == "warning", "medium").otherwise("low")
    eslint = F.when(s == "error", "high").otherwise("medium")
    other = F.when(s.isin("high", "error", "critical", "blocker", "fatal"), "high").when(s.isin("low", "info", "minor", "style", "convention", "refactor"), "low").otherwise("medium")
    return F.when(t == "pylint", pylint).when(t == "eslint", eslint).otherwise(other)


def is_security(kind: Column, detected_by: Column, category: Column, rule: Column) -> Column:
    """By category, by analyzer, or by a rule named B and digits (the next three characters, or all there are)."""
    named = F.coalesce(rule, F.lit("")).rlike(r"^B([0-9]{3}|[0-9]{1,2}$)")
    return (_low(category) == "security") | _low(kind, detected_by).isin("security", "bandit", "semgrep") | named


def issue_family(kind: Column, detected_by: Column, category: Column, rule: Column) -> Column:
    bug = F.coalesce(rule, F.lit("")).isin(BUG_RULES) | _low(category).isin("bug", "reliability", "correctness")
    return F.when(is_security(kind, detected_by, category, rule), "security").when(bug, "bug").otherwise("code_smell")


def is_tainted(files_total: Column, statuses: Column) -> Column:
    """More than 200 files, all of them added: the parent was out of reach, so the whole tree counts as new."""
    return F.coalesce((files_total > 200) & (F.size(statuses) > 0) & F.forall(statuses, lambda s: F.coalesce(s == "A", F.lit(False))), F.lit(False))


def survival_valuation(rate: Column) -> Column:
    return F.when(rate >= 0.8, "HIGH").when(rate >= 0.5, "MEDIUM").otherwise("LOW")
