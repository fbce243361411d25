"""Word tokens: splitting, stop words, punctuation."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from revtext.functions.abbreviations import mark_abbreviations, unmark
from revtext.functions.rules import SPACE, Guarded, Rule, apply_rules, guarded

# Treebank-style rules over lower-case text, in order. Every period before
# white space ends a sentence, unless it belongs to a known abbreviation.
OPENING = (
    guarded("([«“‘„]|`+)", " {1} ", "«", "“", "‘", "„", "`"),
    Guarded(
        ('"', "'"),
        (
            Rule('^"', "`` "),
            Rule(r"""([ (\[{<])("|'')""", "{1} `` "),
            Rule(r"(?U)(')([a-ce-lo-ru-z0-9_])\b", "{1} {2}"),
        ),
    ),
)
PUNCTUATION = (
    # Starting at the period, not before it, lets the search skip to periods.
    Rule(rf"""(\.)(?<=[^.]\.)([\])}}>"'»”’ ]*)({SPACE}+|\z)""", " {1} {2} {3}"),
    Rule(r"([:,])(\P{Nd}|\z)", " {1} {2}"),
    Rule(r"([;@#$%&?!*\]\[(){}<>»])", " {1} "),
    guarded("([”’])", " {1} ", "”", "’"),
    guarded(r"(\.\.+)", " {1} ", ".."),
    guarded(r"--", " -- ", "--"),
    guarded(r"([^'])' ", "{1} ' ", "' "),
)
CLOSING = (
    Guarded(
        ('"', "'"),
        (
            Rule("''", " '' "),
            Rule('"', " '' "),
            # From the apostrophe or the "n" on, which few characters are.
            Rule(r"('(?<=[^' ]')[smd]?) ", " {1} "),
            Rule(r"('(?<=[^' ]')(?:ll|re|ve)|n(?<=[^' ]n)'t) ", " {1} "),
        ),
    ),
    # Contractions written as one word.
    Guarded(
        ("cannot", "d'ye", "gimme", "gonna", "gotta", "lemme", "more'n", "wanna", " 't"),
        (
            Rule(r"(?U)\b(can)(not)\b", " {1} {2} "),
            Rule(r"(?U)\b(d)('ye)\b", " {1} {2} "),
            Rule(r"(?U)\b(gim)(me)\b", " {1} {2} "),
            Rule(r"(?U)\b(gon)(na)\b", " {1} {2} "),
            Rule(r"(?U)\b(got)(ta)\b", " {1} {2} "),
            Rule(r"(?U)\b(lem)(me)\b", " {1} {2} "),
            Rule(r"(?U)\b(more)('n)\b", " {1} {2} "),
            Rule(rf"(?U)\b(wan)(na)({SPACE})", " {1} {2}{3}"),
            Rule(r"(?U) ('t)(is|was)\b", " {1} {2} "),
        ),
    ),
)

# English stop words.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
    yourselves he him his himself she she's her hers herself it it's its itself they them their
    theirs themselves what which who whom this that that'll these those am is are was were be
    been being have has had having do does did doing a an the and but if or because as until
    while of at by for with about against between into through during before after above below
    to from up down in out on off over under again further then once here there when where why
    how all any both each few more most other some such no nor not only own same so than too
    very s t can will just don don't should should've now d ll m o re ve y ain aren aren't
    couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma
    mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren
    weren't won won't wouldn wouldn't
    """.split()
)

# ASCII punctuation.
PUNCTUATION_CLASS = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def tokenize(text: Column, abbreviation: Callable[[Column], Column] | None = None) -> Column:
    """Split cleaned text into word tokens, order kept.

    Words that ``abbreviation`` is true of keep their period, but for the last of the text.
    """
    if abbreviation is not None:
        return unmark(tokenize(mark_abbreviations(text, abbreviation)))
    spaced = apply_rules(text, OPENING + PUNCTUATION)
    spaced = F.concat(F.lit(" "), spaced, F.lit(" "))
    spaced = apply_rules(spaced, CLOSING)
    return F.array_remove(F.split(spaced, f"{SPACE}+"), "")


def remove_stop_words(tokens: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Drop exact stop-word tokens; repeats of other tokens stay."""
    words = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def strip_punctuation(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.regexp_replace(t, f"{PUNCTUATION_CLASS}+", ""))


def drop_empty_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")
