"""Ordered text rules, folded over a Column.

A rule is (kind, pattern, replacement): kind "text" replaces a literal, kind
"regex" a Java regular expression with $1-style groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str, str]


def apply(column: Column, rules: list[Rule]) -> Column:
    """``column`` with every rule applied in order."""

    def one(c: Column, rule: Rule) -> Column:
        kind, pattern, replacement = rule
        if kind == "text":
            return F.replace(c, F.lit(pattern), F.lit(replacement))
        return F.regexp_replace(c, pattern, replacement)

    return reduce(one, rules, column)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
