"""Cleaning, tokens and lemmas, against Python's own regex and plain loops."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from revtext.functions.cleaning import clean_text, remove_markup
from revtext.functions.lemma import IRREGULAR, SUFFIX_RULES, VERBS, VerbLemmatizer
from revtext.functions.lookup import MAX_JSON_KEY, Lookup
from revtext.functions.tokens import (
    STOP_WORDS,
    drop_empty_tokens,
    remove_stop_words,
    strip_punctuation,
    tokenize,
)
from revtext.plans.encode import word_tokens

NBSP, LS = " ", " "


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()
    return [row.x for row in rows]


CLEAN = [
    (None, ""),
    ("", ""),
    ("a<b\nc>d", "a d"),
    ("a < b and c", "a < b and c"),
    ("awwwesome stuff", "a stuff"),
    ("www\nabc", "www\nabc"),
    ("www\rabc", ""),
    (f"see http://x.y{NBSP}next", f"see {NBSP}next"),
    (f"see http://x.y{LS}next", f"see {LS}next"),
    ("it&#34;s &amp; OK", "its &amp; ok"),
    ("Mail a.b+c@d-e.co.uk now", "mail  now"),
    ("a@b.c_d@e.f", ""),
    ("xx@@y.z", "xx@@y.z"),
    ("<>empty<x>", "<>empty "),
]


def test_clean_cases(spark):
    assert column(spark, [raw for raw, _ in CLEAN], clean_text) == [clean for _, clean in CLEAN]


def python_clean(text):
    text = text or ""
    # The five cleaning patterns.
    for pattern, new in (
        (r"<[^>]+>", " "),
        (r"http\S+", ""),
        (r"www.\S+", ""),
        (r"&#[0-9]+;", ""),
        (r"[A-Za-z0-9.\-+_]+@[A-Za-z0-9.\-+_]+\.[A-Za-z0-9]+", ""),
    ):
        text = re.sub(pattern, new, text)
    return text.lower()


def test_clean_agrees_with_python(spark):
    pieces = ["a", "<", ">", "http", "www", ".", "@", "_", "-", " ", "\n", "\t", NBSP, LS, "\x1c",
              "\x85", "&#3;", "&#", "É", "b.c", "　", "w", "+"]
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(1500)]
    assert column(spark, texts, clean_text) == [python_clean(t) for t in texts]


TOKENS = [
    ("don't", ["nt"]),
    ("you'll see", ["ll", "see"]),
    ("john's box", ["john", "s", "box"]),
    ("and/or", ["andor"]),
    ("1,000 units", ["1000", "units"]),
    ("end.next", ["endnext"]),
    ("came with. then", ["came"]),
    ("I cannot stop", ["stop"]),
    ("it was gonna fail...", ["gon", "na", "fail"]),
    ("'tis good", ["t", "good"]),
    ("wow!!great (really) --yes", ["wow", "great", "really", "yes"]),
    ("“quoted” word…", ["“", "quoted", "”", "word…"]),
    (f"tab\tline\nnbsp{NBSP}ls{LS}x", ["tab", "line", "nbsp", "ls", "x"]),
    ("rock 'a roll", ["rock", "roll"]),
    (",,the end", ["the", "end"]),
    (None, []),
]


def test_word_tokens(spark):
    got = column(spark, [raw for raw, _ in TOKENS], lambda c: word_tokens(c, lemmatizer=VerbLemmatizer(())))
    assert got == [tokens for _, tokens in TOKENS]


def test_token_steps_keep_order_and_repeats(spark):
    values = [["the", "good", "good", "n't", "it's", "--", "a.b", "“"]]
    kind = "array<string>"
    assert column(spark, values, remove_stop_words, kind) == [["good", "good", "n't", "--", "a.b", "“"]]
    assert column(spark, values, strip_punctuation, kind) == [
        ["the", "good", "good", "nt", "its", "", "ab", "“"]
    ]
    assert column(spark, [["", "x", ""]], drop_empty_tokens, kind) == [["x"]]
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 179


def test_all_ascii_punctuation_goes(spark):
    import string

    assert column(spark, [[f"a{c}b" for c in string.punctuation]], strip_punctuation,
                  "array<string>") == [["ab"] * len(string.punctuation)]


def python_lemma(word, lexicon=frozenset(VERBS), exceptions=IRREGULAR):
    def shortest(forms):
        known = [f for f in forms if f in lexicon]
        return min(known, key=len) if known else None

    def rules(forms):
        return [f[: len(f) - len(s)] + r for f in forms for s, r in SUFFIX_RULES if f.endswith(s)]

    if word in exceptions:
        return shortest([word, *exceptions[word]]) or word
    forms = rules([word])
    found = shortest([word, *forms])
    while found is None and forms:
        forms = rules(forms)
        found = shortest(forms)
    return found or word


def test_lemma_agrees_with_plain_rules(spark):
    import random

    rng = random.Random(9)
    stems = list(VERBS) + ["item", "hop", "bus", "x", "", "class"]
    ends = ["", "s", "es", "ed", "ing", "ies", "ss", "e", "y"]
    words = [rng.choice(stems) + "".join(rng.choices(ends, k=rng.randint(0, 4))) for _ in range(3000)]
    words += list(IRREGULAR) + [w + "s" for w in IRREGULAR]
    lemmatizer = VerbLemmatizer()
    assert column(spark, words, lemmatizer.lemma) == [python_lemma(w) for w in words]


def test_lemma_cases(spark):
    toy = VerbLemmatizer(("hope", "hop", "be", "see", "saw"), {"was": ("be",), "saw": ("see",), "x": ("y",)})
    words = ["hoping", "was", "saw", "item", "x", "hopss"]
    assert column(spark, words, toy.lemma) == ["hop", "be", "saw", "item", "x", "hop"]
    assert column(spark, ["hoping"], VerbLemmatizer(()).lemma) == ["hoping"]


def test_long_words_are_lemmatised_in_time(spark):
    words = ["x" * 200_000 + "ss", "work" + "s" * 500, "http" * 50_000 + "ingss"]
    got = column(spark, words, VerbLemmatizer().lemma)
    assert got == [words[0], "work", words[2]]


def test_lookup_long_and_odd_keys(spark):
    long = "k" * (MAX_JSON_KEY + 1)
    entries = {long: 1, 'q"\\': 2, "é ": 3, "": 4, "a": 5}
    lookup = Lookup(entries, "int")
    assert column(spark, [*entries, "b", None], lookup.get) == [1, 2, 3, 4, 5, None, None]


RUNS = [2_000, 20_000, 200_000]


@pytest.mark.parametrize("n", RUNS)
def test_any_run_of_suffixes_is_safe(spark, n):
    runs = ["s" * n, "work" + "s" * n, "es" * n, "call" + "ing" * n, "x" + "ed" * n, "s" * n + "x" + "ss", "e" + "s" * n]
    start = time.perf_counter()
    got = column(spark, runs, VerbLemmatizer().lemma)
    assert time.perf_counter() - start < 3
    assert got == [runs[0], "work", runs[2], "call", runs[4], runs[5], runs[6]]


def test_long_stems_agree_with_plain_rules(spark):
    rng = random.Random(4)
    ends = ["s", "es", "ed", "ing", "e", "d", "ss", "work", "x"]
    words = [rng.choice(["work", "call", "x", "", "miss"]) + "".join(rng.choices(ends, k=rng.randint(6, 20))) for _ in range(2000)]
    assert column(spark, words, VerbLemmatizer().lemma) == [python_lemma(w) for w in words]


@pytest.mark.parametrize("text", ["<", "<a", "< >", "<<>", "<" * 5 + "b> tail <", "&#", "http", "www", "a@", "a.", "'", ".", ". ", "`", "-", ",", ")"])
def test_cleaning_and_splitting_take_linear_time(spark, text):
    long = text * (200_000 // len(text))
    start = time.perf_counter()
    column(spark, [long], lambda t: tokenize(clean_text(t)))
    assert time.perf_counter() - start < 6


def test_markup_up_to_the_last_sign(spark):
    texts = ["a<b>c", "<", ">", "a < b and c", "<<x>y", "<>z", "a>b<c>d<e", "<a\nb>", "é<b>😀<"]
    assert column(spark, texts, remove_markup) == [re.sub("<[^>]+>", " ", t) for t in texts]


def test_everyday_forms(spark):
    forms = {
        "getting": "get", "stopping": "stop", "shipping": "ship", "planning": "plan", "dropping": "drop",
        "plugging": "plug", "fitting": "fit", "cutting": "cut", "letting": "let", "winning": "win",
        "beginning": "begin", "lying": "lie", "dying": "die", "hitting": "hit",
    }
    assert column(spark, [*forms], VerbLemmatizer().lemma) == [*forms.values()]
