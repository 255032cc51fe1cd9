"""Rules and policies as data, compiled into Column expressions.

Literal ``rlike`` patterns compile once per task and stay in whole-stage codegen; a pattern that
comes from a column is compiled per row.  Rule sets are small configuration, so they are unrolled.
Larger sets (``MAX_UNROLLED``) have to use the join form in ``operators.artifacts``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from provlake import vocab

MAX_UNROLLED = 256
#: Unicode classes, and only \n as a line end.
CASE_SENSITIVE = "(?Ud)"
NO_STRINGS = "array<string>"
_CLASSES = re.compile(r"\\[wWbBsSdD]")


def search(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Find ``pattern``; Unicode classes are only switched on where the pattern uses a class."""
    fold = "iu" if ignore_case else ""
    return text.rlike(f"(?{fold}{'U' if _CLASSES.search(pattern) else ''}d){pattern}")


def check_size(rules: Iterable) -> list:
    rules = list(rules)
    if len(rules) > MAX_UNROLLED:
        raise ValueError(f"{len(rules)} rules exceed {MAX_UNROLLED}; use the join form")
    return rules


def strings(*values: Column) -> Column:
    """The non-null values as an array of strings."""
    return F.array_compact(F.array(*values)).cast(NO_STRINGS)


def matching(text: Column, rules: list, pick=lambda r: F.lit(r.id), ignore_case=True) -> Column:
    """``pick(rule)`` of every rule whose pattern is found in ``text``, in rule order."""
    return strings(*[F.when(search(text, r.pattern, ignore_case), pick(r))
                     for r in check_size(rules)])


# ── condition language ──────────────────────────────────────────────────────────────────────
OPERATORS = ("eq", "ne", "gte", "gt", "lte", "lt", "in", "contains", "contains_any", "matches",
             "is_true", "is_false")


def condition(op: str, actual: Column | None, expected, kind: str = "string") -> Column:
    """One condition as a never-null boolean.  ``actual=None`` is a path nobody supplied."""
    if op not in OPERATORS:
        raise ValueError(f"unknown condition operator {op!r}")
    missing = actual is None
    if op == "eq":
        if expected is None:
            return F.lit(True) if missing else actual.isNull()
        return F.lit(False) if missing else F.coalesce(actual == F.lit(expected), F.lit(False))
    if op == "ne":
        return ~condition("eq", actual, expected, kind)
    if op == "in":
        values = [v for v in (expected or []) if v is not None]
        null_ok = None in (expected or [])
        if missing:
            return F.lit(null_ok)
        hit = F.coalesce(actual.isin(*values), F.lit(False)) if values else F.lit(False)
        return hit | actual.isNull() if null_ok else hit
    if op == "is_true":
        return F.lit(False) if missing else F.coalesce(actual == F.lit(True), F.lit(False))
    if op == "is_false":
        return F.lit(True) if missing else ~F.coalesce(actual == F.lit(True), F.lit(False))
    if missing:
        return F.lit(False)
    if op == "contains":
        if kind == "array":
            hit = F.array_contains(actual, expected)
        else:
            hit = (actual != "") & actual.contains(expected)
    elif op == "contains_any":
        have = actual if kind == "array" else F.split(actual, "")
        wanted = list(expected or [])
        if not wanted:
            return F.lit(False)
        hit = F.arrays_overlap(have, F.array(*[F.lit(x) for x in wanted]))
    elif op == "matches":
        hit = (actual.cast("string") != "") & search(actual.cast("string"), expected)
    else:
        value = F.lit(expected)
        hit = {"gte": actual >= value, "gt": actual > value,
               "lte": actual <= value, "lt": actual < value}[op]
    return F.coalesce(hit, F.lit(False))


def when_holds(when: dict, context: dict[str, Column]) -> Column:
    """All conditions of a ``when`` block; an empty block holds."""
    out = F.lit(True)
    for path, cond in when.items():
        actual = context.get(path)
        kind = "array" if path in ARRAY_PATHS else "string"
        for op, expected in (cond if isinstance(cond, dict) else {"eq": cond}).items():
            out = out & condition(op, actual, expected, kind)
    return out


#: Context paths that hold lists.
ARRAY_PATHS = ("session.taint", "artifact.labels", "call.markers")


def in_scope(policy: vocab.Policy, action: Column, posture: Column) -> Column:
    out = F.lit(True)
    if policy.actions:
        out = out & action.isin(*policy.actions)
    if policy.postures:
        out = out & posture.isin(*policy.postures)
    return F.coalesce(out, F.lit(False))
