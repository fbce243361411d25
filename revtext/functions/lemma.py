"""Verb lemmas by suffix rules over a lexicon.

A word is looked up among the forms its lexicon's lemmas can take. Candidates
of a listed irregular form are the form itself and its listed lemmas; those of
any other word are the word itself and what one suffix rule makes of it. The
shortest candidate in the lexicon wins, earlier candidates on ties. A word
without any goes through the rules again, for as long as they still apply.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from revtext.functions.lookup import Lookup
from revtext.functions.rules import bind

# Verb suffixes and what replaces them, in order.
SUFFIX_RULES = (
    ("s", ""),
    ("ies", "y"),
    ("es", "e"),
    ("es", ""),
    ("ed", "e"),
    ("ed", ""),
    ("ing", "e"),
    ("ing", ""),
)

# Seed lexicon of common English verbs; pass a full one for production.
VERBS = tuple(
    """
    accept add allow appear arrive ask attach be beat become begin believe bend blow break bring
    build burn buy call care carry catch change charge check choose clean click close come compare
    complain connect consider contain continue copy cost cover create cut damage deal decide
    deliver die display do download draw drive drop eat end enjoy expect explain fail fall feel
    fight fill find finish fit fix fly follow forget freeze get give go grow happen hate have hear
    help hit hold hope include install keep kill know last lay lead learn leave let lie like listen
    live load look lose love make match mean meet mention mount move need notice offer open order
    pass pay plan play plug prefer print produce provide pull purchase push put read realize
    receive recommend reduce refund remember remove repair replace report require reset return
    review ride ring rise run save saw say search see seem sell send serve set ship show shut sing
    sit sleep solve speak spend stand start stay stick stop store suggest support take talk teach
    tell thank think throw touch travel try turn type understand update upgrade use wait wake walk
    want waste watch wear win wish work worry write
    """.split()
)

# Irregular verb forms and their lemmas.
IRREGULAR = {
    form: tuple(lemmas.split(","))
    for form, lemmas in (
        pair.split("=")
        for pair in """
        am=be are=be is=be was=be were=be been=be ate=eat eaten=eat became=become began=begin
        begun=begin bent=bend blew=blow blown=blow bought=buy broke=break broken=break
        brought=bring built=build burnt=burn came=come caught=catch chose=choose chosen=choose
        dealt=deal did=do done=do drawn=draw drew=draw driven=drive drove=drive dropped=drop
        fallen=fall fell=fall felt=feel fitted=fit flew=fly flown=fly forgot=forget
        forgotten=forget fought=fight found=find froze=freeze frozen=freeze gave=give given=give
        gone=go got=get gotten=get grew=grow grown=grow had=have has=have heard=hear held=hold
        kept=keep knew=know known=know laid=lay lain=lie learnt=learn led=lead left=leave lost=lose
        made=make meant=mean met=meet paid=pay planned=plan plugged=plug putting=put rang=ring
        ran=run ridden=ride risen=rise rode=ride rose=rise running=run rung=ring said=say sang=sing
        sat=sit sawn=saw saw=see seen=see sent=send setting=set shipped=ship shown=show
        shutting=shut sitting=sit slept=sleep sold=sell spent=spend spoke=speak spoken=speak
        stood=stand stopped=stop stuck=stick sung=sing taken=take taught=teach thought=think
        threw=throw thrown=throw told=tell took=take tried=try understood=understand went=go
        woke=wake woken=wake won=win wore=wear worn=wear written=write wrote=write
        beginning=begin cutting=cut dropping=drop dying=die fitting=fit forgetting=forget
        getting=get hitting=hit letting=let lying=lie planning=plan plugging=plug shipping=ship
        stopping=stop travelled=travel travelling=travel winning=win
        """.split()
    )
}

_ENDING = "(?:s|ed|ing)"
_LAST_SUFFIX = r"(?:es|s|ed|ing)\z"


def regular_forms(lexicon: Iterable[str]) -> dict[str, str]:
    """Every form one suffix rule leads back to a lemma, with the best lemma."""
    best: dict[str, tuple[int, int, str]] = {}
    for lemma in lexicon:
        ways = [(0, lemma)]
        for order, (suffix, replacement) in enumerate(SUFFIX_RULES, start=1):
            if lemma.endswith(replacement):
                ways.append((order, lemma[: len(lemma) - len(replacement)] + suffix))
        for order, form in ways:
            rank = (len(lemma), order, lemma)
            best[form] = min(best.get(form, rank), rank)
    return {form: rank[2] for form, rank in best.items()}


def irregular_forms(
    lexicon: Iterable[str], exceptions: Mapping[str, Sequence[str]]
) -> dict[str, str]:
    """Lemma of each listed form; a form none of whose lemmas is known stays."""
    known = set(lexicon)
    return {
        form: min((c for c in (form, *lemmas) if c in known), key=len, default=form)
        for form, lemmas in exceptions.items()
    }


class VerbLemmatizer:
    """Column function from a word to its verb lemma."""

    def __init__(
        self,
        lexicon: Iterable[str] = VERBS,
        exceptions: Mapping[str, Sequence[str]] = IRREGULAR,
    ):
        lexicon = tuple(lexicon)
        regular = regular_forms(lexicon)
        self.empty = not lexicon
        self.longest = max(map(len, regular), default=0)
        self._regular = Lookup(regular, "string")
        self._first = Lookup({**regular, **irregular_forms(lexicon, exceptions)}, "string")

    def lemma(self, word: Column) -> Column:
        if self.empty:
            return word
        # The plain suffix tests spare most words the regex.
        ending = word.endswith("s") | word.endswith("ed") | word.endswith("ing")
        stacked = ending & F.rlike(word, F.lit(rf"{_ENDING}(?:e?s|ed|ing)\z"))
        return F.coalesce(
            self._first.get(word), F.when(stacked, self._later_rounds(word)), word
        )

    def lemmas(self, tokens: Column) -> Column:
        return tokens if self.empty else F.transform(tokens, self.lemma)

    def _later_rounds(self, word: Column) -> Column:
        """Strip suffixes one by one until what is left is a form of a lemma.

        After a round only the stem without its whole suffix can still end in
        one, so the rounds follow a single chain of stems. No stem longer than
        the longest form can be one, so the chain starts at its first stem that
        is short enough; a possessive loop finds that without recursion.
        """
        run = rf"\A([\s\S]{{0,{self.longest}}})(?:es|ed|ing|(?<!e)s)++\z"
        near = F.regexp_extract(word, run, 1)
        short = F.when(F.length(word) > self.longest, near).otherwise(word)
        return bind(short, self._rounds)

    def _rounds(self, word: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            stem = F.regexp_replace(state["stem"], _LAST_SUFFIX, "")
            going = state["lemma"].isNull() & F.rlike(state["stem"], F.lit(rf"{_ENDING}\z"))
            return F.when(
                going, F.struct(stem.alias("stem"), self._regular.get(stem).alias("lemma"))
            ).otherwise(state)

        start = F.struct(word.alias("stem"), self._regular.get(word).alias("lemma"))
        # No more rounds than letters in the run of suffixes at the end.
        letters = F.length(F.regexp_extract(word, r"((?:e?s|ed|ing)+)\z", 1))
        rounds = F.when(letters > 0, F.sequence(F.lit(1), letters)).otherwise(F.array(F.lit(1)))
        return F.aggregate(rounds, start, step, lambda state: state["lemma"])
