"""Review cleaning: markup, links, entities and addresses out, lower case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from revtext.functions.rules import NON_SPACE, Guarded, apply_rules, bind, guarded

# The address characters, and below the five cleaning patterns.
_ADDRESS = r"[A-Za-z0-9.\-+_]"


@dataclass(frozen=True)
class UpToLast:
    """A rule for the text up to the last ``literal``, which every match must end with.

    Behind it each start of a match would be followed to the end in vain.
    """

    literal: str
    rule: Guarded

    def apply(self, text: Column) -> Column:
        def parted(t: Column) -> Column:
            rest = F.substring_index(t, self.literal, -1)
            head = F.left(t, F.length(t) - F.length(rest))
            return F.concat(self.rule.apply(head), rest)

        return bind(text, parted)


MARKUP = UpToLast(">", guarded(r"<[^>]+>", " ", "<"))
HTTP = guarded(f"http{NON_SPACE}+", "", "http")
# Any character but a line feed may follow "www".
WWW = guarded(rf"www[^\n]{NON_SPACE}+", "", "www")
ENTITY = guarded(r"&#[0-9]+;", "", "&#")
# An address starts where a run of its characters starts, or where the last
# match ended; saying so keeps the search linear on long runs.
EMAIL = guarded(
    rf"(?:\G|(?<!{_ADDRESS})){_ADDRESS}++@{_ADDRESS}+\.[A-Za-z0-9]+", "", "@"
)


def fill_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def remove_markup(text: Column) -> Column:
    return MARKUP.apply(text)


def remove_http(text: Column) -> Column:
    return HTTP.apply(text)


def remove_www(text: Column) -> Column:
    return WWW.apply(text)


def remove_entities(text: Column) -> Column:
    return ENTITY.apply(text)


def remove_emails(text: Column) -> Column:
    return EMAIL.apply(text)


def clean_text(text: Column) -> Column:
    """All cleaning steps in their fixed order; lower-casing comes last."""
    return F.lower(apply_rules(fill_null(text), (MARKUP, HTTP, WWW, ENTITY, EMAIL)))
