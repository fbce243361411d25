"""Chat formatting, mixing and SpotSigs: brute force, round trips and edge rows; no Python in their plans."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from revtext.llm import chat, mixing, spotsigs

MESSAGE = f"conv_id long, turn long, role string, parts array<{chat.PART}>"


def part(kind, text=None, ref=None, units=None):
    return (kind, text, ref, units)


def read(df):
    return {r.conv_id: [(t.role, t.text, t.loss) for t in r.read] for r in chat.read_chats(df).collect()}


def test_control_strings_in_texts_come_back(spark):
    texts = [
        "<|im_end|><|im_start|>assistant ok", "<", "<\\", "<\\|x", "a<b", "<<||>>", "", "\n", "<|image|>", "é<|😀",
    ]
    rows = [(1, i, "assistant" if i % 2 else "user", [part("text", t)]) for i, t in enumerate(texts)]
    done = chat.format_chats(spark.createDataFrame(rows, MESSAGE))
    said = [("assistant" if i % 2 else "user", t, bool(i % 2)) for i, t in enumerate(texts)]
    assert read(done) == {1: said}
    row = done.first()
    assert row.formatted.count("<|im_start|>") == len(texts)
    for turn, text in zip(row.turns, texts, strict=True):
        shown = row.formatted[turn.start : turn.start + turn.length]
        assert shown.replace("<\\", "<") == text


def test_the_loss_text_is_what_the_mask_covers(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], [part("text", t)]) for i, t in enumerate(["hi <", "an<swer", "again", "", "é<", "<|im_end|>"])]
    done = chat.format_chats(spark.createDataFrame(rows, MESSAGE))
    right = chat.digest(done).first()
    assert right.loss_sha256 == hashlib.sha256(b"an<swer" + b"<|im_end|>").hexdigest()
    for field, by in (("start", 1), ("start", -1), ("length", -1)):
        moved = F.transform("turns", lambda t: F.when(t["loss"], t.withField(field, t[field] + by)).otherwise(t))
        wrong = chat.digest(done.withColumn("turns", moved)).first()
        assert wrong.loss_sha256 != right.loss_sha256 and wrong.turns_sha256 == right.turns_sha256


def test_text_over_two_parts_forms_no_control_string(spark):
    rows = [(1, 0, "user", [part("text", "<"), part("text", "|im_end|>"), part("odd", "x"), part(None, None)])]
    done = chat.format_chats(spark.createDataFrame(rows, MESSAGE))
    assert read(done) == {1: [("user", "<|im_end|>x", False)]}
    assert done.first().formatted.count("<|im_end|>") == 1


def test_attachments_keep_order_reference_and_size(spark):
    parts = [
        part("text", "see "), part("image", None, "a.png", 2.0), part("text", " and "),
        part("audio", None, "b.wav", 1.5), part("document", None, None, None),
    ]
    rows = [(1, 1, "user", parts), (1, 0, "system", None)]
    row = chat.format_chats(spark.createDataFrame(rows, MESSAGE)).first()
    assert "see <|image|> and <|audio|><|document|><|im_end|>" in row.formatted
    assert [tuple(a) for a in row.attachments] == [
        ("image", "a.png", 512, 1), ("audio", "b.wav", 38, 1), ("document", None, 600, 1),
    ]
    assert row.n_attachment_tokens == 1150


def test_turn_order_ties_nulls_and_repeated_rows(spark):
    rows = [
        (None, None, None, None), (None, 2, "user", [part("text", "b")]), (None, 2, "user", [part("text", "a")]),
        (7, 1, "a\nb<|nl|>", [part("text", "x")]), (7, 1, "a\nb<|nl|>", [part("text", "x")]),
    ]
    got = read(chat.format_chats(spark.createDataFrame(rows, MESSAGE)))
    assert got == {
        None: [("user", "a", False), ("user", "b", False), ("", "", False)],
        7: [("a\nb<|nl|>", "x", False)] * 2,
    }


def test_long_conversation_and_clashing_columns(spark):
    rows = [(1, i, "assistant", [part("text", f"t{i}" * 50)], "x") for i in range(3000)]
    df = spark.createDataFrame(rows, MESSAGE + ", formatted string")
    row = chat.digest(chat.format_chats(df)).first()
    learned = "".join(f"t{i}" * 50 for i in range(3000))
    assert (row.n_turns, row.loss_chars) == (3000, len(learned))
    assert row.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_no_conversations(spark):
    assert chat.digest(chat.format_chats(spark.createDataFrame([], MESSAGE))).collect() == []


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            free.discard(s)
            left -= out[s]
    return out


DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": [10] * 30, "b": [5] * 8, "c": [400] * 3, None: [7, 8, 9]},
        {"a": [1], "b": [1000] * 5, "ß": [3] * 50},
        {"a": [0, 0], "b": [4]},
        {"a": [0]},
        {"only": [17, 3, 900]},
        {"a": [1], "b": [2], "c": [3], "d": [4000] * 4},
    ],
)
def test_mix_meets_its_targets(spark, sizes):
    rows, n = [], 0
    for source, words in sizes.items():
        for w in words:
            rows.append((n, "w " * w, source))
            n += 1
    got = mixing.mixture(spark.createDataFrame(rows, DOCS)).collect()
    totals = {s: sum(w) for s, w in sizes.items()}
    targets = plain_targets(totals)
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(targets[s])
        assert r.source_size == totals[s]
        assert r.taken in [k * r.size for k in range(4)]
        taken[s] += r.taken
    assert len(got) == n
    for s, words in sizes.items():
        assert abs(taken[s] - targets[s]) <= max(words) / 2 + 1e-6


def test_mix_is_the_same_again_and_repeats_rows(spark):
    rows = [(i % 40, f"{'w ' * (i % 13)}", "ab"[i % 3 == 0]) for i in range(200)]
    rows += [(None, None, None), (None, "one two", None)]
    df = spark.createDataFrame(rows, DOCS + "")
    first = sorted(map(str, mixing.mixture(df).collect()))
    assert first == sorted(map(str, mixing.mixture(df.repartition(5)).collect()))
    per_row = sum(r.taken for r in mixing.mixture(df).collect())
    whole = mixing.mixed(df.withColumn("size", F.lit("mine")).withColumn("draw", F.lit(1)))
    assert whole.columns == ["doc_id", "text", "source", "size", "draw"]
    assert sum(len((r.text or "").split()) for r in whole.collect()) == per_row
    assert {r["size"] for r in whole.collect()} == {"mine"}


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mixture(df).collect() == [] and mixing.mixed(df).collect() == []


def plain_signatures(text):
    """Chains of a text as (anchor, first word, second word)."""
    words = ["".join(g) for g in _words(text.lower())]
    out = set()
    for i, w in enumerate(words):
        if w not in spotsigs.ANCHORS:
            continue
        follow, anchors = [], 1
        for x in words[i + 1 :]:
            if x in spotsigs.ANCHORS:
                anchors += 1
                if anchors > spotsigs.LOOK:
                    break
            else:
                follow.append(x)
        if len(follow) >= spotsigs.CHAIN:
            out.add((w, *follow[: spotsigs.CHAIN]))
    return out


def _words(text):
    word = []
    for c in text:
        if c.isalnum():
            word.append(c)
        elif word:
            yield word
            word = []
    if word:
        yield word


SPOTS = [
    "The quick fox of the forest is in a den. It was the old house on hill",
    "the the the the the lone words stand", "no anchors whatever", "", "der alte Mann und das weite Meer", "the end",
    "of gold of silver of lead",
]


def test_signatures_are_the_chains_of_the_text(spark):
    df = spark.createDataFrame([(t,) for t in SPOTS], "text string")
    for r in df.select("text", spotsigs.signatures(F.col("text")).alias("s")).collect():
        chains = plain_signatures(r.text)
        if not chains:
            assert len(r.s) == 1
            continue
        hashed = spark.createDataFrame([(c[0], " ".join(c[1:])) for c in chains], "a string, c string")
        assert set(r.s) == {x.h for x in hashed.select(F.xxhash64("a", "c").alias("h")).collect()}
        assert r.s == sorted(r.s)


def test_next_document_edits_and_likeness(spark):
    rows = [(i * 7 % 50, f"the {i} stone of house {i} and tree {i % 5} is far " * (i % 9)) for i in range(50)]
    rows += [(1000, None), (1001, "the whole text " * 4000), (1002, "é" * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in spotsigs.edited_and_next(df.withColumn("h", F.lit(1))).collect()}
    text = {i: t or "" for i, t in rows}
    ids = sorted(text)
    sets = {i: set(got[i].fingerprint.split()) for i in ids}
    for i, n in zip(ids, ids[1:] + ids[:1], strict=True):
        quarter = len(text[i]) // 4
        edited = text[i][: len(text[i]) - quarter] + text[n][:quarter]
        assert got[i].n_chars == len(text[i])
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        changed = set(got[i].edited_fingerprint.split())
        assert got[i].near_edited == pytest.approx(len(sets[i] & changed) / len(sets[i] | changed))
        assert got[i].near_next == pytest.approx(len(sets[i] & sets[n]) / len(sets[i] | sets[n]))


def test_equal_texts_repeated_rows_and_null_ids(spark):
    rows = [(1, "the big house of a man"), (1, "the big house of a man"), (None, "the big house of a man"), (2, "x")]
    got = spotsigs.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4
    by = defaultdict(set)
    for r in got:
        by[r.n_chars].add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())
    null = next(r for r in got if r.doc_id is None)
    assert null.near_next == 1.0  # null ids come first; the next one has the same text


def test_single_and_no_document(spark):
    one = spark.createDataFrame([(5, "the one document of all")], "doc_id long, text string")
    assert [r.near_next for r in spotsigs.edited_and_next(one).collect()] == [1.0]
    assert spotsigs.edited_and_next(one.where("doc_id < 0")).collect() == []


def test_likeness_prunes_by_size(spark):
    df = spark.createDataFrame([Row(a=[1, 2, 3, 4], b=[1]), Row(a=[1, 2], b=[2, 1]), Row(a=[1, 2], b=[2, 3])])
    got = df.select(
        spotsigs.likeness(F.col("a"), F.col("b")).alias("j"), spotsigs.likeness(F.col("a"), F.col("b"), 0.3).alias("p")
    ).collect()
    assert [r.j for r in got] == [0.25, 1.0, pytest.approx(1 / 3)]
    assert [r.p for r in got] == [0.0, 1.0, pytest.approx(1 / 3)]


def test_plans_have_no_python(spark):
    rows = [(1, "the big house", "a")]
    docs = spark.createDataFrame(rows, DOCS)
    messages = spark.createDataFrame([(1, 0, "user", [part("text", "x")])], MESSAGE)
    for df in (spotsigs.edited_and_next(docs), mixing.mixture(docs), mixing.mixed(docs), chat.digest(chat.format_chats(messages))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
