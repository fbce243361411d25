"""Rewrite rules shared by cleaning and tokenising.

A rule is a pattern and its replacement, where ``{1}`` names a group. Patterns
avoid ``\\s``, ``\\S`` and ``.``, whose meaning depends on the regex engine, and
spell the class out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space below and above U+00FF. Written so that one
# table test and one range test settle most characters.
_SPACE_LATIN = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x{85}\x{a0}"
_SPACE_OTHER = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = rf"[{_SPACE_LATIN}[\x{{1680}}-\x{{3000}}&&[{_SPACE_OTHER}]]]"
NON_SPACE = f"[^{_SPACE_LATIN}{_SPACE_OTHER}]"


@dataclass(frozen=True)
class Rule:
    pattern: str
    replacement: str

    def apply(self, text: Column) -> Column:
        replacement = re.sub(r"\{(\d)\}", r"$\1", self.replacement)
        return F.regexp_replace(text, F.lit(self.pattern), F.lit(replacement))


@dataclass(frozen=True)
class Guarded:
    """Rules for texts containing one of some literals; others stay as they are.

    A byte scan for a literal costs far less than a failing regex.
    """

    needs: tuple[str, ...]
    rules: tuple[Rule, ...]

    def apply(self, text: Column) -> Column:
        def replace_if_present(t: Column) -> Column:
            present = reduce(or_, (F.contains(t, F.lit(literal)) for literal in self.needs))
            return F.when(present, apply_rules(t, self.rules)).otherwise(t)

        return bind(text, replace_if_present)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def apply_rules(text: Column, rules: tuple[Rule | Guarded, ...]) -> Column:
    return reduce(lambda col, rule: rule.apply(col), rules, text)


def guarded(pattern: str, replacement: str, *needs: str) -> Guarded:
    return Guarded(needs, (Rule(pattern, replacement),))
