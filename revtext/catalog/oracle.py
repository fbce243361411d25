"""DuckDB SQL stating what each registered query returns."""

from __future__ import annotations

from revtext.functions.lemma import IRREGULAR, SUFFIX_RULES, VERBS
from revtext.functions.tokens import STOP_WORDS

# RE2 spellings of the patterns.
_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ADDR = r"[A-Za-z0-9.\-+_]"
_PUNCT = r"[!-/:-@\[-`{-~]"
MARKUP = (r"<[^>]+>", " ")
HTTP = (f"http[^{_WS}]+", "")
WWW = (rf"www[^\n][^{_WS}]+", "")
ENTITY = (r"&#[0-9]+;", "")
EMAIL = (rf"{_ADDR}+@{_ADDR}+\.[A-Za-z0-9]+", "")
CLEANING = (MARKUP, HTTP, WWW, ENTITY, EMAIL)

# One rule per step of the published token rules, unlike the fused Spark ones.
BEFORE_PADDING = (
    ("([«“‘„]|[`]+)", r" \1 "),
    ('^"', "`` "),
    (r"""([ (\[{<])("|'')""", r"\1 `` "),
    (r"(')([a-ce-lo-ru-z0-9_])\b", r"\1 \2"),
    (rf"""([^.])(\.)([\])}}>"'»”’ ]*)([{_WS}]+|\z)""", r"\1 \2 \3 "),
    (r"([:,])(\P{Nd})", r" \1 \2"),
    (r"([:,])\z", r" \1 "),
    (r"(\.\.+)", r" \1 "),
    (r"([;@#$%&?!*])", r" \1 "),
    (r"([^'])' ", r"\1 ' "),
    (r"([\]\[(){}<>])", r" \1 "),
    ("--", " -- "),
)
AFTER_PADDING = (
    ("([»”’])", r" \1 "),
    ("''", " '' "),
    ('"', " '' "),
    (r"([^' ])('s|'m|'d|') ", r"\1 \2 "),
    (r"([^' ])('ll|'re|'ve|n't) ", r"\1 \2 "),
    (r"\b(can)(not)\b", r" \1 \2 "),
    (r"\b(d)('ye)\b", r" \1 \2 "),
    (r"\b(gim)(me)\b", r" \1 \2 "),
    (r"\b(gon)(na)\b", r" \1 \2 "),
    (r"\b(got)(ta)\b", r" \1 \2 "),
    (r"\b(lem)(me)\b", r" \1 \2 "),
    (r"\b(more)('n)\b", r" \1 \2 "),
    (rf"\b(wan)(na)([{_WS}])", r" \1 \2\3"),
    (r" ('t)(is|was)\b", r" \1 \2 "),
)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def replaced(expression: str, *rules: tuple[str, str]) -> str:
    for pattern, new in rules:
        expression = f"regexp_replace({expression}, {text(pattern)}, {text(new)}, 'g')"
    return expression


def cleaned(expression: str) -> str:
    return f"lower({replaced(expression, *CLEANING)})"


def tokenized(expression: str) -> str:
    padded = f"' ' || {replaced(expression, *BEFORE_PADDING)} || ' '"
    spaced = replaced(f"({padded})", *AFTER_PADDING)
    return f"list_filter(string_split_regex({spaced}, {text(f'[{_WS}]+')}), lambda t: t <> '')"


def stopped(expression: str) -> str:
    words = ", ".join(text(w) for w in STOP_WORDS)
    return f"list_filter({expression}, lambda t: t NOT IN ({words}))"


def stripped(expression: str) -> str:
    return f"list_transform({expression}, lambda t: regexp_replace(t, {text(_PUNCT)}, '', 'g'))"


def dropped(expression: str) -> str:
    return f"list_filter({expression}, lambda t: t <> '')"


def point(key: str, use: str = "split") -> str:
    return f"('0x' || substr(md5('{use}:1234:' || {key}::VARCHAR), 1, 15))::BIGINT"


def share(hundredths: int) -> int:
    return 2**60 * hundredths // 100


REVIEWS = """
reviews AS (
  SELECT d.doc_id AS review_id, d.text AS review_body,
    CASE WHEN quality IS NULL THEN 3 WHEN quality = 1 AND toxic = 0 THEN 5 WHEN quality = 1 THEN 4
         WHEN toxic = 0 THEN 2 ELSE 1 END AS star_rating
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

TEXTS = """
texts AS (
  SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS part, text FROM documents
  UNION ALL SELECT 'page', page_id, 0, html FROM pages
  UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations
  UNION ALL SELECT 'item', item_id, 0, text FROM benchmark)"""


def _domain(num_classes: int) -> str:
    return "(1, 2, 4, 5)" if num_classes == 2 else "(1, 2, 3, 4, 5)"


def lemma_ctes(words: str) -> str:
    """``best(form, lemma)`` of the distinct tokens of ``words``."""
    lexicon = ", ".join(f"({text(v)})" for v in VERBS)
    listed = ", ".join(
        f"({text(form)}, {i}, {text(lemma)})"
        for form, lemmas in IRREGULAR.items()
        for i, lemma in enumerate((form, *lemmas))
    )
    rules = ", ".join(f"({i}, {text(s)}, {text(r)})" for i, (s, r) in enumerate(SUFFIX_RULES, 1))
    return f"""
lex(lemma) AS (VALUES {lexicon}),
listed(form, ord, lemma) AS (VALUES {listed}),
suffix_rules(rule, suf, rep) AS (VALUES {rules}),
forms AS (SELECT DISTINCT token AS form FROM {words}),
derived(form, cand, depth, ord) AS (
  SELECT form, form, 0, '' FROM forms WHERE form NOT IN (SELECT form FROM listed)
  UNION ALL
  SELECT d.form, left(cand, length(cand) - length(suf)) || rep, depth + 1, ord || rule
  FROM derived d JOIN suffix_rules ON suffix(cand, suf)),
candidates AS (
  SELECT form, cand, greatest(depth, 1) AS round, depth, ord FROM derived
  UNION ALL
  SELECT form, lemma, 1, 0, ord::VARCHAR FROM listed WHERE form IN (SELECT form FROM forms)),
best AS (
  SELECT form, cand AS lemma FROM candidates WHERE cand IN (SELECT lemma FROM lex)
  QUALIFY row_number() OVER (PARTITION BY form ORDER BY round, length(cand), depth, ord) = 1)"""


def token_ctes(num_classes: int, rows: str = "true") -> str:
    """``kept`` reviews, ``words(review_id, pos, token)`` lemmatised."""
    words = dropped(stripped(stopped(tokenized(cleaned("review_body")))))
    return f"""{REVIEWS},
kept AS MATERIALIZED (SELECT * FROM reviews WHERE star_rating IN {_domain(num_classes)}),
lists AS MATERIALIZED (SELECT review_id, {words} AS tokens FROM kept WHERE {rows}),
raw_words AS MATERIALIZED (
  SELECT review_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM lists),
{lemma_ctes("raw_words")},
words AS MATERIALIZED (
  SELECT review_id, pos, coalesce(lemma, token) AS token
  FROM raw_words LEFT JOIN best ON token = form)"""


def vocab_ctes(
    num_classes: int, rows: str = "true", fit: str = "true", size: int = 10_000
) -> str:
    """Vocabulary of the words of ``fit`` rows, applied to all chosen rows."""
    return f"""{token_ctes(num_classes, rows)},
counts AS (SELECT token, count(*) AS n FROM words WHERE {fit} GROUP BY token),
vocab AS MATERIALIZED (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, token)::INTEGER AS idx
  FROM counts ORDER BY n DESC, token LIMIT {size}),
indexed AS MATERIALIZED (
  SELECT review_id, pos, coalesce(idx, 0) AS idx FROM words LEFT JOIN vocab USING (token))"""


def encoded_ctes(num_classes: int, rows: str = "true", fit: str = "true") -> str:
    """``encoded(review_id, star_rating, features)``, features a list of 100."""
    return f"""{vocab_ctes(num_classes, rows, fit)},
encoded AS MATERIALIZED (
  SELECT review_id, any_value(star_rating) AS star_rating,
    list_resize(coalesce(list(idx ORDER BY pos) FILTER (WHERE pos <= 100), []), 100, 0) AS features
  FROM indexed JOIN kept USING (review_id) GROUP BY review_id HAVING max(idx) > 0)"""


def one_hot(num_classes: int) -> str:
    if num_classes == 2:
        return "CASE WHEN star_rating <= 2 THEN '1 0' ELSE '0 1' END"
    return "rtrim(repeat('0 ', star_rating - 1) || '1 ' || repeat('0 ', 5 - star_rating))"


def class_index(num_classes: int) -> str:
    return "(star_rating > 2)::INTEGER" if num_classes == 2 else "star_rating - 1"


WORK = f"{point('review_id')} < {share(95)}"
TRAIN = f"{point('review_id')} < {share(90)}"
EVAL = f"({point('review_id')} >= {share(90)} AND {point('review_id')} < {share(95)})"
TEST = f"{point('review_id')} >= {share(95)}"


def bayes_ctes(num_classes: int, rows: str = WORK) -> str:
    """``prior`` and ``loglik`` of the training rows, fitted on features."""
    k = num_classes
    return f"""{encoded_ctes(k, rows, WORK)},
train AS (
  SELECT review_id, {class_index(k)} AS class, features FROM encoded WHERE {TRAIN}),
classes AS (SELECT unnest(range({k}))::INTEGER AS class),
prior AS (
  SELECT c.class, count(t.class) AS n,
    ln(count(t.class) + 1) - ln((SELECT count(*) FROM train) + {k}) AS log_prior
  FROM classes c LEFT JOIN train t ON c.class = t.class GROUP BY c.class),
seen AS (
  SELECT class, idx, count(*) AS n
  FROM (SELECT class, unnest(features) AS idx FROM train) WHERE idx > 0 GROUP BY class, idx),
totals AS (
  SELECT c.class, coalesce(sum(n), 0)::BIGINT AS total
  FROM classes c LEFT JOIN seen s ON c.class = s.class GROUP BY c.class),
loglik AS MATERIALIZED (
  SELECT t.class, g.idx, coalesce(s.n, 0) AS n,
    ln(coalesce(s.n, 0) + 1) - ln(total + 10000) AS loglik
  FROM totals t CROSS JOIN (SELECT unnest(range(1, 10001))::INTEGER AS idx) g
  LEFT JOIN seen s ON s.class = t.class AND s.idx = g.idx)"""


def score_ctes(num_classes: int, rows: str = EVAL, encode: str = WORK) -> str:
    """``scored(review_id, class, score, p)`` of the chosen encoded rows."""
    return f"""{bayes_ctes(num_classes, encode)},
occurrences AS (
  SELECT review_id, unnest(features) AS idx FROM encoded WHERE {rows}),
sums AS (
  SELECT review_id, class, sum(loglik) AS s
  FROM occurrences JOIN loglik USING (idx) GROUP BY review_id, class),
joint AS (
  SELECT e.review_id, e.star_rating, p.class, log_prior + coalesce(s, 0) AS score
  FROM encoded e CROSS JOIN prior p LEFT JOIN sums s
    ON s.review_id = e.review_id AND s.class = p.class
  WHERE {rows.replace("review_id", "e.review_id")}),
tops AS (SELECT *, max(score) OVER (PARTITION BY review_id) AS top FROM joint),
scored AS MATERIALIZED (
  SELECT review_id, star_rating, class, score,
    exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY review_id) AS p FROM tops),
predicted AS MATERIALIZED (
  SELECT review_id, star_rating, class AS prediction FROM scored
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY p DESC, class) = 1)"""


#: Each evaluation row's rounded score for each class, and whether it is of the class.
_HITS = "SELECT review_id, class, round(p, 6) AS s, class = star_rating - 1 AS hit FROM scored"


def sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


def _texts(expression: str) -> str:
    return sql(TEXTS, f"SELECT kind, id, part, {expression} AS text FROM texts")


def _token_texts(expression: str) -> str:
    return sql(
        f"{TEXTS}, split AS (SELECT kind, id, part, {expression} AS words FROM texts)",
        "SELECT kind, id, part, len(words)::INTEGER AS n, array_to_string(words, ' ') AS tokens "
        "FROM split",
    )


_BEFORE = r"""[(\[{<"'«“‘„`]*"""
_WORD = r"[\p{L}\p{M}]+(?:['’.-][\p{L}\p{M}]+)*"
_PIECE = rf"""^{_BEFORE}({_WORD})(\.?)[\])}}>"'»”’,;:!?]*$"""
_SPLIT_OFF = rf"""^({_BEFORE}({_WORD}))\.([\])}}>"'»”’]*[{_WS}])$"""

ABBREVIATIONS = f"""{TEXTS},
clean AS MATERIALIZED (SELECT kind, id, part, {cleaned("text")} AS text FROM texts),
pieces AS (SELECT unnest(string_split_regex(text, {text(f"[{_WS}]+")})) AS piece FROM clean),
met AS (
  SELECT regexp_extract(piece, {text(_PIECE)}, 1) AS word, regexp_extract(piece, {text(_PIECE)}, 2) = '.' AS final
  FROM pieces),
periods AS (
  SELECT word, count(*) FILTER (WHERE final) AS n_final, count(*) FILTER (WHERE NOT final) AS n_plain
  FROM met WHERE word <> '' GROUP BY word),
share AS (SELECT sum(n_final) / (sum(n_final) + sum(n_plain)) AS p FROM periods),
lengths AS (SELECT *, length(replace(word, '.', '')) AS letters FROM periods, share WHERE n_final > 0),
scored AS MATERIALIZED (
  SELECT word, n_final, n_plain,
    -2 * (n_final * ln(p) + n_plain * ln(1 - p) - n_final * ln(0.99) - n_plain * ln(1 - 0.99))
    * exp(-letters) * (length(word) - letters + 1) * pow(letters::DOUBLE, -n_plain) AS score
  FROM lengths)"""


def _tokenize_learned() -> str:
    trimmed = f"regexp_replace(text, {text(f'[{_WS}]+$')}, '')"
    parts = f"regexp_extract_all({trimmed}, {text(f'[^{_WS}]*[{_WS}]|[^{_WS}]+')})"
    marked = (
        f"list_transform({parts}, lambda p: CASE WHEN list_contains(known, regexp_extract(p, {text(_SPLIT_OFF)}, 2)) "
        f"THEN regexp_replace(p, {text(_SPLIT_OFF)}, '\\1{chr(0xFDD0)}\\3') ELSE p END)"
    )
    words = f"list_transform({tokenized('text')}, lambda t: replace(t, '{chr(0xFDD0)}', '.'))"
    return sql(
        f"""{ABBREVIATIONS},
known AS (SELECT coalesce(list(word), []) AS known FROM scored WHERE score >= 0.3),
marked AS MATERIALIZED (
  SELECT kind, id, part, coalesce(array_to_string({marked}, ''), '') AS text FROM clean, known),
split AS (SELECT kind, id, part, {words} AS words FROM marked)""",
        "SELECT kind, id, part, len(words)::INTEGER AS n, array_to_string(words, ' ') AS tokens FROM split",
    )


def _lemmatized() -> str:
    words = dropped(stripped(stopped(tokenized(cleaned("text")))))
    return sql(
        f"""{TEXTS},
lists AS MATERIALIZED (SELECT kind, id, part, {words} AS words FROM texts),
raw_words AS MATERIALIZED (
  SELECT kind, id, part, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM lists),
{lemma_ctes("raw_words")},
joined AS (
  SELECT kind, id, part, count(*)::INTEGER AS n,
    string_agg(coalesce(lemma, token), ' ' ORDER BY pos) AS tokens
  FROM raw_words LEFT JOIN best ON token = form GROUP BY kind, id, part)""",
        "SELECT kind, id, part, coalesce(n, 0) AS n, coalesce(tokens, '') AS tokens "
        "FROM lists LEFT JOIN joined USING (kind, id, part)",
    )


def _encoded(num_classes: int) -> str:
    return sql(
        encoded_ctes(num_classes),
        "SELECT review_id, star_rating, array_to_string(features, ' ') AS features, "
        f"{one_hot(num_classes)} AS label_ohe FROM encoded",
    )


def _index(select: str) -> str:
    return sql(
        vocab_ctes(5),
        f"SELECT review_id, {select} FROM lists LEFT JOIN indexed USING (review_id) "
        "GROUP BY review_id",
    )


def _line(num_classes: int, rows: str) -> str:
    return sql(
        encoded_ctes(num_classes, WORK),
        "SELECT array_to_string(features, ',') || ',' || "
        f"replace({one_hot(num_classes)}, ' ', ',') AS line FROM encoded WHERE {rows}",
    )


def _xy(num_classes: int, rows: str, key: str = "") -> str:
    return sql(
        encoded_ctes(num_classes, WORK),
        f"SELECT {key} array_to_string(features, ' ') AS features, "
        f"{one_hot(num_classes)} AS label_ohe FROM encoded WHERE {rows}",
    )


def _by_class(value: str, name: str, count: int) -> str:
    return ", ".join(
        f"round(max({value}) FILTER (WHERE class = {i}), 6) AS {name}{i}" for i in range(count)
    )


PROBABILITY = sql(
    score_ctes(2),
    f"SELECT review_id, {_by_class('p', 'p', 2)}, "
    "max(prediction) AS prediction FROM scored JOIN predicted USING (review_id) GROUP BY review_id",
)
SCORES = sql(
    score_ctes(2),
    f"SELECT review_id, {_by_class('score', 'score', 2)} FROM scored GROUP BY review_id",
)
TOKEN_INDEX = _index("coalesce(string_agg(idx::VARCHAR, ' ' ORDER BY pos), '') AS idx")


CSV_LABEL = f"replace({one_hot(2)}, ' ', ',')"
CSV_ROW = f"array_to_string(features, ',') || ',' || {CSV_LABEL}"

ORACLE: dict[str, str] = {
    "project_text_label": sql(REVIEWS, "SELECT review_id, review_body, star_rating FROM reviews"),
    "filter_binary": sql(
        REVIEWS, "SELECT review_id, star_rating FROM reviews WHERE star_rating IN (1, 2, 4, 5)"
    ),
    "filter_multi": "SELECT d.doc_id AS review_id, quality * 5 AS star_rating FROM documents d "
    "JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1",
    "fill_null_rating": "SELECT d.doc_id AS review_id, coalesce(quality, 0) AS star_rating "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "split_test": sql(
        REVIEWS,
        f"SELECT review_id, star_rating, CASE WHEN {TEST} THEN 'test' ELSE 'work' END AS part "
        "FROM reviews",
    ),
    "split_train_eval": sql(
        REVIEWS,
        f"SELECT review_id, star_rating, CASE WHEN {TRAIN} THEN 'train' ELSE 'eval' END AS part "
        f"FROM reviews WHERE {WORK}",
    ),
    "sample_train": sql(
        REVIEWS,
        "SELECT review_id, star_rating FROM reviews "
        f"WHERE {TRAIN} AND {point('review_id', 'sample')} < {share(10)}",
    ),
    "clean_null": "SELECT doc_id AS review_id, text AS review_body FROM documents "
    "UNION ALL SELECT -1, ''",
    "clean_markup": _texts(replaced("text", MARKUP)),
    "clean_http": _texts(replaced("text", HTTP))
    + " UNION ALL SELECT 'url', page_id, 0, "
    + replaced("'see ' || url || ' there'", HTTP)
    + " FROM pages",
    "clean_www": _texts(replaced("text", WWW)),
    "clean_entities": _texts("replace(text, '\"', '')"),
    "clean_email": _texts(replaced("text", EMAIL)),
    "clean_lower": _texts("lower(text)"),
    "clean_text": _texts(cleaned("text")),
    "tokenize": _token_texts(tokenized(cleaned("text"))),
    "abbreviations": sql(ABBREVIATIONS, "SELECT word, n_final, n_plain, round(score, 6) + 0.0 AS score FROM scored"),
    "tokenize_learned": _tokenize_learned(),
    "stop_words": _token_texts(stopped(tokenized(cleaned("text")))),
    "strip_punct": _token_texts(stripped(stopped(tokenized(cleaned("text"))))),
    "drop_empty_tokens": _token_texts(dropped(stripped(stopped(tokenized(cleaned("text")))))),
    "lemmatize": _lemmatized(),
    "term_count": sql(vocab_ctes(5), "SELECT token, n FROM counts"),
    "vocab_topk": sql(vocab_ctes(5), "SELECT token, n, idx FROM vocab"),
    "vocab_two_pass": sql(vocab_ctes(5), "SELECT token, n, idx FROM vocab"),
    "vocab_large": sql(vocab_ctes(5, size=50_000), "SELECT token, n, idx FROM vocab"),
    "token_index": TOKEN_INDEX,
    "token_index_join": TOKEN_INDEX,
    "drop_empty": sql(encoded_ctes(5), "SELECT review_id, star_rating FROM encoded"),
    "pad_trim": _index(
        "array_to_string(list_resize(coalesce(list(idx ORDER BY pos) "
        "FILTER (WHERE pos <= 100), []), 100, 0), ' ') AS features"
    ),
    "index_sum": _index("coalesce(sum(idx), 0)::BIGINT AS total"),
    "normalize_idx": _index(
        "coalesce(string_agg((idx * 100)::VARCHAR, ' ' ORDER BY pos), '') AS millionths"
    ),
    "encode_binary": _encoded(2),
    "encode_multi": _encoded(5),
    "one_hot_multi": sql(REVIEWS, f"SELECT review_id, {one_hot(5)} AS label_ohe FROM reviews"),
    "one_hot_binary": sql(
        REVIEWS,
        f"SELECT review_id, {one_hot(2)} AS label_ohe FROM reviews WHERE star_rating <> 3",
    ),
    "features_flat": sql(
        encoded_ctes(2),
        "SELECT review_id, array_to_string(features, ' ') || ' ' || "
        f"{one_hot(2)} AS row FROM encoded",
    ),
    "split_xy": sql(
        encoded_ctes(2),
        f"SELECT review_id, array_to_string(features, ' ') AS x, {one_hot(2)} AS y FROM encoded",
    ),
    "nb_prior": sql(
        bayes_ctes(2), "SELECT class, n, round(log_prior, 6) AS log_prior FROM prior"
    ),
    "nb_word_loglik": sql(
        bayes_ctes(2), "SELECT class, idx, n, round(loglik, 6) AS loglik FROM loglik"
    ),
    "nb_score": SCORES,
    "nb_score_join": SCORES,
    "class_probability": sql(
        score_ctes(2), f"SELECT review_id, {_by_class('p', 'p', 2)} FROM scored GROUP BY review_id"
    ),
    "argmax_class": sql(
        score_ctes(2),
        f"SELECT review_id, prediction, {class_index(2)} AS label, "
        "CASE prediction WHEN 0 THEN 'negative' ELSE 'positive' END AS name FROM predicted",
    ),
    "stars": sql(
        score_ctes(5), "SELECT review_id, star_rating, prediction + 1 AS stars FROM predicted"
    ),
    "accuracy_eval": sql(
        score_ctes(2),
        f"SELECT count(*) AS n, round(avg((prediction = {class_index(2)})::INTEGER), 6) AS accuracy "
        "FROM predicted",
    ),
    "accuracy": sql(
        score_ctes(2, TEST, "true"),
        f"SELECT count(*) AS n, round(avg((prediction = {class_index(2)})::INTEGER), 6) AS accuracy "
        "FROM predicted",
    ),
    "job_predict": sql(
        score_ctes(5, "true", "true"),
        "SELECT review_id, prediction + 1 AS stars FROM reviews LEFT JOIN predicted USING (review_id)",
    ),
    "log_loss": sql(
        score_ctes(2),
        "SELECT count(*) AS n, round(-avg(ln(least(greatest(p, 1e-7), 1 - 1e-7))), 6) AS log_loss "
        f"FROM scored WHERE class = {class_index(2)}",
    ),
    "score_batch_udf": PROBABILITY,
    "src_model": PROBABILITY,
    "src_reviews_tsv": sql(
        REVIEWS,
        r"SELECT review_id, regexp_replace(review_body, '[\t\r\n]', ' ', 'g') AS review_body, "
        "star_rating FROM reviews",
    ),
    "snk_test_tsv": sql(
        REVIEWS, f"SELECT review_id, review_body, star_rating FROM reviews WHERE {TEST}"
    ),
    "snk_train_csv": _line(2, TRAIN),
    "src_train_csv": _xy(5, TRAIN),
    "src_one_file": _xy(2, EVAL),
    "snk_eval_xy": _xy(2, EVAL, "review_id,"),
    "src_xy_files": _xy(2, EVAL),
    "snk_train_sample": _line(5, f"{TRAIN} AND {point('review_id', 'sample')} < {share(20)}"),
    "snk_dictionary": sql(
        vocab_ctes(2),
        "SELECT token, idx FROM vocab",
    ),
    "src_dictionary": sql(vocab_ctes(5), "SELECT token, idx FROM vocab"),
    "snk_predictions": sql(
        score_ctes(5), "SELECT review_id || ',' || (prediction + 1) AS line FROM predicted"
    ),
    "snk_model": sql(
        bayes_ctes(2),
        "SELECT class, 0 AS idx, n, round(log_prior, 6) AS value FROM prior "
        "UNION ALL SELECT class, idx, n, round(loglik, 6) FROM loglik",
    ),
    "snk_predictions_binary": sql(
        score_ctes(2),
        "SELECT review_id || ',' || prediction || ',' || "
        "CASE prediction WHEN 0 THEN 'negative' ELSE 'positive' END AS line FROM predicted",
    ),
    "accuracy_train": sql(
        score_ctes(2, f"{TRAIN} AND {point('review_id', 'sample')} < {share(20)}"),
        f"SELECT count(*) AS n, round(avg((prediction = {class_index(2)})::INTEGER), 6) AS accuracy "
        "FROM predicted",
    ),
    "train_lr": sql(
        encoded_ctes(2, WORK),
        f"SELECT {class_index(2)} AS class, count(*) AS n, true AS mean_is_share "
        f"FROM encoded WHERE {TRAIN} GROUP BY {class_index(2)}",
    ),
    "train_trigrams": sql(
        encoded_ctes(2, WORK),
        f"SELECT {class_index(2)} AS class, count(*) AS n, true AS mean_is_share "
        f"FROM encoded WHERE {TRAIN} GROUP BY {class_index(2)}",
    ),
    "train_history": sql(
        encoded_ctes(2, WORK),
        "SELECT slice::INTEGER AS slice, (SELECT count(*) FROM encoded WHERE "
        f"{EVAL}) AS n, true AS loss_falls, true AS best_chosen FROM range(1, 4) r(slice)",
    ),
    "job_reuse": " UNION ALL ".join(
        f"SELECT {run} AS run, {reused} AS reused, r.rows, r.words FROM ("
        + sql(
            token_ctes(classes),
            "SELECT (SELECT count(*) FROM kept) AS rows, (SELECT count(*) FROM words) AS words",
        )
        + ") r"
        for run, reused, classes in ((1, "false", 2), (2, "true", 2), (3, "false", 5))
    ),
    "lemmatize_table": _lemmatized(),
    "src_reviews_rescued": sql(
        f"""{REVIEWS},
flat AS (
  SELECT review_id, star_rating, coalesce(regexp_replace(review_body, '[\\t\\r\\n]', ' ', 'g'), '') AS body,
    {point("review_id", "damage")} % 10 AS damage
  FROM reviews)""",
        """SELECT CASE WHEN damage > 2 THEN review_id END AS review_id, CASE WHEN damage > 2 THEN star_rating END AS star_rating,
  CASE WHEN damage > 2 THEN body END AS review_body,
  CASE damage WHEN 0 THEN concat_ws(chr(9), review_id, star_rating, body, 'more')
    WHEN 1 THEN concat_ws(chr(9), review_id, star_rating) WHEN 2 THEN concat_ws(chr(9), review_id, 'five', body) END AS rescued
FROM flat""",
    ),
    "job_all": sql(
        score_ctes(2),
        "SELECT (SELECT count(*) FROM predicted) AS n, "
        f"(SELECT round(avg((prediction = {class_index(2)})::INTEGER), 6) FROM predicted) AS accuracy, "
        "(SELECT round(-avg(ln(least(greatest(p, 1e-7), 1 - 1e-7))), 6) FROM scored "
        f"WHERE class = {class_index(2)}) AS log_loss",
    ),
    "score_lr": sql(
        encoded_ctes(2, WORK),
        "SELECT review_id, true AS sums_to_one, true AS first_largest "
        f"FROM encoded WHERE {EVAL}",
    ),
    "train_mlp": sql(
        encoded_ctes(2, WORK),
        "SELECT count(*) AS n, true AS well_formed, true AS beats_guess "
        f"FROM encoded WHERE {EVAL}",
    ),
    "prepare_incremental": sql(
        encoded_ctes(2, WORK),
        f"""SELECT 'train' AS dataset, review_id || ',' || array_to_string(features, ',') AS line FROM encoded WHERE {TRAIN}
UNION ALL SELECT 'eval', review_id || ',' || array_to_string(features, ',') FROM encoded WHERE {EVAL}
UNION ALL SELECT 'test', review_id || ',' || md5(review_body) FROM kept WHERE {TEST}
UNION ALL SELECT 'dictionary', idx || ',' || token FROM vocab""",
    ),
    "auc_eval": sql(
        score_ctes(5),
        f"""SELECT a.class, count(DISTINCT a.review_id) FILTER (WHERE a.hit) AS positives,
  count(DISTINCT a.review_id) FILTER (WHERE NOT a.hit) AS negatives,
  round(sum(CASE WHEN NOT a.hit OR b.hit THEN 0 WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END)
    / nullif((count(DISTINCT a.review_id) FILTER (WHERE a.hit)) * (count(DISTINCT a.review_id) FILTER (WHERE NOT a.hit)), 0), 9) AS auc
FROM ({_HITS}) a JOIN ({_HITS}) b ON a.class = b.class GROUP BY a.class""",
    ),
    "confusion": sql(
        f"""{score_ctes(5)},
cells AS (SELECT l.class AS label, p.class AS prediction FROM classes l CROSS JOIN classes p),
counted AS (SELECT star_rating - 1 AS label, prediction, count(*) AS n FROM predicted GROUP BY ALL)""",
        """SELECT c.label, c.prediction, coalesce(n, 0) AS n,
  round(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY c.label), 0), 6) AS share
FROM cells c LEFT JOIN counted USING (label, prediction)""",
    ),
    "calibration": sql(
        f"""{score_ctes(5)},
hits AS ({_HITS}),
bins AS (
  SELECT class, least(floor(s * 10), 9)::INTEGER AS bin, count(*) AS n, avg(s) AS mean_score, avg(hit::DOUBLE) AS observed
  FROM hits GROUP BY ALL),
errors AS (SELECT class, sum(abs(mean_score - observed) * n) / sum(n) AS error FROM bins GROUP BY class)""",
        """SELECT class, bin, n, round(mean_score, 6) AS mean_score, round(observed, 6) AS observed, round(error, 6) AS error
FROM bins JOIN errors USING (class)""",
    ),
    "job_prepare": sql(
        encoded_ctes(2, WORK),
        f"""SELECT 'train' AS dataset, {CSV_ROW} AS line FROM encoded WHERE {TRAIN}
UNION ALL SELECT 'sample', {CSV_ROW} FROM encoded
  WHERE {TRAIN} AND {point('review_id', 'sample')} < {share(20)}
UNION ALL SELECT 'eval_x', review_id || ',' || array_to_string(features, ',') FROM encoded WHERE {EVAL}
UNION ALL SELECT 'eval_y', review_id || ',' || {CSV_LABEL} FROM encoded WHERE {EVAL}
UNION ALL SELECT 'test', review_id || ',' || md5(review_body) FROM kept WHERE {TEST}
UNION ALL SELECT 'dictionary', idx || ',' || token FROM vocab""",
    ),
}
