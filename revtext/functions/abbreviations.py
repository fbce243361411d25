"""Periods of abbreviations, kept where a learned table knows the word before them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from revtext.functions.rules import SPACE, bind

#: Stands for the period of an abbreviation while sentence ends are split off. A
#: noncharacter, so no text should hold it; one that does has it read as U+FFFD.
MARK, MARK_IN_TEXT = "﷐", "�"

WORD = r"[\p{L}\p{M}]+(?:['’.-][\p{L}\p{M}]+)*"
_BEFORE = r"""[(\[{<"'«“‘„`]*"""
_AFTER = r"""[\])}>"'»”’,;:!?]*"""

#: A piece between white space: its word, and its period if one follows the word.
PIECE = rf"^{_BEFORE}({WORD})(\.?){_AFTER}$"

#: A piece whose period the tokeniser would split off, with the white space behind it.
_SPLIT_OFF = rf"""^({_BEFORE}({WORD}))\.([\])}}>"'»”’]*{SPACE})$"""


def pieces(text: Column) -> Column:
    """What lies between white space."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def words_before_period(text: Column) -> Column:
    """Distinct words of a text whose period may belong to them."""
    dotted = F.filter(pieces(text), lambda p: F.contains(p, F.lit(".")))
    found = F.transform(dotted, lambda p: F.when(p.rlike(rf"^{_BEFORE}{WORD}\.{_AFTER}$"), F.regexp_extract(p, PIECE, 1)))
    return F.array_distinct(F.filter(found, lambda w: w.isNotNull()))


def mark_abbreviations(text: Column, known: Callable[[Column], Column]) -> Column:
    """``MARK`` in place of periods behind known words; the last word of a text ends a sentence."""

    def marked(piece: Column) -> Column:
        word = F.regexp_extract(piece, _SPLIT_OFF, 2)
        is_known = (word != "") & F.coalesce(known(word), F.lit(False))
        return F.when(is_known, F.regexp_replace(piece, _SPLIT_OFF, f"$1{MARK}$3")).otherwise(piece)

    def in_text(t: Column) -> Column:
        parts = F.split(F.regexp_replace(t, rf"{SPACE}+\z", ""), f"(?<={SPACE})")
        return F.array_join(F.transform(parts, lambda p: F.when(F.contains(p, F.lit(".")), marked(p)).otherwise(p)), "")

    clean = F.replace(text, F.lit(MARK), F.lit(MARK_IN_TEXT))
    return bind(clean, lambda t: F.when(F.contains(t, F.lit(".")), in_text(t)).otherwise(t))


def unmark(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.replace(t, F.lit(MARK), F.lit(".")))
