"""Operators that run numpy in tasks: brute force, round trips, held-out accuracy and edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revtext.llm import batches, compression, packing, perplexity, pii, tokenfile, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string"
LONG = "lorem ipsum dolor " * 20_000


def frame(spark, texts, extra=""):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = ["", None, " \n\t", "a", "x" * 30_000, LONG, "a b c", "a b c", "é ß 😀 中", "<|endoftext|> tail", "1.1.1." * 9_000]


# --- token ids -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda t: fresh.encode(t or "", add_special_tokens=False).ids


def test_cached_ids_are_the_tokenizers(plain):
    rng = random.Random(5)
    parts = ["a", "Be", "é", "ß", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "’", "12", "²", "中", "\x1c", "\x85",
             "<|endoftext|>", "😀", "-", " the", "́", "ª", "\r\n", "'ll", "!!", "_", " word.\nNext"]
    enc = tokens.Encoder(tokens.tokenizer_path())
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4_000)] + [LONG, "y" * 30_000]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == plain(text), repr(text)[:80]


def test_ids_of_slices_nulls_and_batches(plain):
    enc = tokens.Encoder(tokens.tokenizer_path())
    column = pa.array(["skipped ", " the", None, "", "a \n b\nc.", "\n", " ", "x <|endoftext|> y", "a\u00a0 b", "tab\there"])
    for part in (column, column.slice(1), column.slice(2, 2), column.slice(3, 0)):
        assert [ids.tolist() for ids in enc.encode(part)] == [plain(t) for t in part.to_pylist()]
    assert plain("a <|endoftext|> b") == enc.encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]


def test_a_full_cache_starts_anew(plain, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(tokens, "TOGETHER", 2)
    enc = tokens.Encoder(tokens.tokenizer_path())
    for text in ("one two three four five", "two six, seven!", "one éa ñandú (two)"):
        assert enc.encode([text])[0].tolist() == plain(text)


def test_batches_are_cut_by_rows_and_bytes(spark):
    rows = pa.record_batch({"t": ["x" * 100] * 1000 + ["y" * 50_000] * 3 + [""] * 7})
    cut = list(batches.sliced([rows], 300, 20_000))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([rows]))
    assert all(b.num_rows <= 300 and (b.nbytes <= 20_000 or b.num_rows == 1) for b in cut)
    rows_setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_setting)
    spark.conf.set(batches.BYTES_SETTING, "64m")
    assert batches.map_batches(spark.range(5).selectExpr("string(id) t"), lambda b: b, "t string").count() == 5
    assert spark.conf.get(rows_setting) == before and batches._bytes(spark.conf.get(batches.BYTES_SETTING)) == batches.BATCH_BYTES
    assert [batches._bytes(x) for x in ("7", "7b", "3k", "2MB")] == [7, 7, 3072, 2 << 20]


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], [7] * 13])
def test_values_round_trip(values):
    values = np.array(values, np.uint32)
    control, data = tokenfile.encode_values(values)
    assert len(control) == -(-len(values) // 4)
    assert tokenfile.decode_values(control, data, len(values)).tolist() == values.tolist()


def test_random_values_round_trip_and_damage_is_seen():
    rng = np.random.default_rng(0)
    values = (rng.integers(0, 2**32, 10_001) >> rng.integers(0, 32, 10_001)).astype(np.uint32)
    control, data = tokenfile.encode_values(values)
    assert np.array_equal(tokenfile.decode_values(control, data, len(values)), values)
    with pytest.raises(ValueError):
        tokenfile.decode_values(control, data[:-1], len(values))


def test_token_files_round_trip(spark, plain, tmp_path):
    docs = frame(spark, EDGES).withColumn("start", F.lit("clash")).repartition(3)
    tokenfile.write_token_files(docs, str(tmp_path / "t"))
    got = {r.doc_id: r for r in tokenfile.digest(tokenfile.read_token_files(spark, str(tmp_path / "t"))).collect()}
    at = 0
    for i, text in enumerate(EDGES):
        ids = np.array([*plain(text), 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    blocks = spark.read.parquet(str(tmp_path / "t/blocks"))
    first = [r.d for r in blocks.orderBy("part", "block").select(F.col("doc_ids")[0].alias("d")).collect()]
    assert first == sorted(first)


def test_token_files_with_null_and_repeated_ids_and_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(3, "b"), (None, "a"), (3, "b"), (3, None)], "doc_id long, text string")
    tokenfile.write_token_files(docs, str(tmp_path / "a"))
    got = tokenfile.digest(tokenfile.read_token_files(spark, str(tmp_path / "a"))).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (3, 2, 1), (3, 3, 2), (3, 5, 2)]
    tokenfile.write_token_files(docs.where("doc_id > 9"), str(tmp_path / "b"))
    assert tokenfile.read_token_files(spark, str(tmp_path / "b")).collect() == []


# --- packing ---------------------------------------------------------------------------------


def test_shards_do_not_depend_on_the_place_of_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BYTES", 20_000)
    docs = frame(spark, [f"w{i} " * (i % 90 * 20) for i in range(120)])
    columns = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    runs = [docs.repartition(2), docs.orderBy(F.desc("doc_id")).repartition(5)]
    first, second = (sorted(map(tuple, packing.placements(packing.pack(d)).select(*columns).collect())) for d in runs)
    assert first == second and len({r[4] >> 32 for r in first}) > 3


def plain_best_fit(lengths, window):
    free, placed = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(room, w) for w, room in enumerate(free) if room >= lengths[i]]
        if fits:
            room = min(fits)[0]
            w = [w for r, w in fits if r == room]
            w = w[0]
        else:
            free.append(window)
            w = len(free) - 1
        placed[i] = (window - free[w], free[w])
        free[w] -= lengths[i]
    return sorted(free), placed


@pytest.mark.parametrize("window", [1, 7, 64, 2048])
def test_tightest_window_is_found(window):
    rng = np.random.default_rng(window)
    lengths = rng.integers(1, window + 1, 400)
    placed, offsets = packing.best_fit_decreasing(lengths, window)
    free, where = plain_best_fit(lengths.tolist(), window)
    used = np.zeros(placed.max() + 1, np.int64)
    np.add.at(used, placed, lengths)
    assert sorted((window - used).tolist()) == free
    assert {i: int(o) for i, o in enumerate(offsets)} == {i: o for i, (o, _) in where.items()}


def test_packed_pieces_cover_every_document(spark, plain):
    docs = frame(spark, EDGES).withColumn("length", F.lit("clash")).repartition(3)
    sequences = packing.pack(docs)
    rows = packing.placements(sequences, ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(EDGES):
        ids, at = [*plain(text), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            own = np.array(ids[r.start : r.start + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(own.tobytes()))
            assert np.frombuffer(r.ids, "<u2").tolist() == own.tolist()
            at += r.length
        assert at == len(ids)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, None)], "doc_id long, text string")
    rows = packing.placements(packing.pack(docs)).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows) == [("1", 2), ("1", 2), ("2", 1), ("None", 2)]
    assert len({r.sequence_id for r in rows}) == 1
    assert packing.pack(docs.where("doc_id > 5")).collect() == []


# --- personal data ---------------------------------------------------------------------------

# The contract's patterns as they stand.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    def digits(m):
        return re.sub("[^0-9]", "", m)

    def luhn(d):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])]
        return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0

    keep = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)),
        "phone": lambda m: 10 <= len(digits(m)) <= 15,
    }
    found = [
        (m.start(), k, kind, m.end())
        for k, (kind, rule) in enumerate(RULES.items())
        for m in re.finditer(rule, text)
        if keep[kind](m[0])
    ]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@", ".", ".de", "-", " ", "+", "(", ")", "1", "25", "255", "4111111111111111", "00", "é",
             "+49 30 1234567", "192.168.", "%", "_", "1.2.3.4", "x@y.z", "5500 0000 0000 0004", "\n", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        base = [(s.kind, s.start, s.end) for s in pii.find_spans(text) if s.kind in pii.BASE]
        assert base == plain_base(text), repr(text)


def test_further_kinds_need_check_sums_or_context():
    kinds = lambda t: [s.kind for s in pii.find_spans(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == ["iban"]
    assert kinds("pay to DE89 3704 0044 0532 0130 01 now") == []
    assert kinds("isbn order DE89370400440532013000") == []
    assert kinds("bank account isbn DE89370400440532013000") == ["iban"]
    assert kinds("her social security number 078-05-1120.") == ["ssn"]
    assert kinds("the part 078-05-1120.") == []
    assert kinds("call 030 123 4567 today") == ["local_phone"]
    assert kinds("see 030 123 4567 today") == []


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "1." * 500_000, "@a" * 500_000, "+1(" * 300_000, "a.b@" * 250_000,
                                  "@" + "a." * 500_000, "AA00" * 250_000, "1-" * 500_000, "0 12 " * 200_000])
def test_long_texts_take_linear_time(text):
    pii.find_spans(text)


def test_personal_data_rows(spark):
    texts = ["mail x@y.org or 10.0.0.1", None, "", "no data", "x@y.org"]
    df = frame(spark, texts).withColumn("n_chars", F.length("text").cast("long")).withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(df)).collect()}
    assert got[0].spans == "email:5:12,ip:16:24"
    assert got[0].base_sha256 == hashlib.sha256(got[0].spans.encode()).hexdigest()
    assert [got[i].spans for i in (1, 2, 3)] == ["", "", ""]
    clean = pii.redacted(df)
    assert clean.columns == df.columns
    rows = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert rows[0] == ("mail [EMAIL] or [IP]", 20)
    assert rows[1] == (None, None) and rows[2] == ("", 0) and rows[3] == ("no data", 7)
    assert pii.redacted(df.where("doc_id > 9")).collect() == []


# --- quality rules ---------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_are_those_of_the_rules():
    rng = random.Random(8)
    for _ in range(2_000):
        text = "".join(rng.choices(["a", "b", " ", " ", "\n", "é", "#", "\t", "\x0b", "\x85", "c "], k=rng.randint(0, 60)))
        assert perplexity.word_counts(text, perplexity.code_points(text)) == plain_counts(text)


def plain_discounts(counts):
    c1, c2, c3, c4 = (sum(n == k for n in counts.values()) for k in (1, 2, 3, 4))
    if not (c1 and c2):
        return [0, 0.5, 0.5, 0.5]
    y = c1 / (c1 + 2 * c2)
    found = [1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3 if c3 else 1.5]
    return [0, *(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found, strict=True))]


def plain_kneser_ney(sequences, order, symbols):
    """Interpolated modified Kneser-Ney by dictionaries of tuples."""
    counts = [Counter() for _ in range(order + 1)]
    for s in sequences:
        for i in range(order - 1, len(s)):
            counts[order][tuple(s[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] += 1
    cuts = [None] + [plain_discounts(counts[k]) for k in range(1, order + 1)]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (symbols + 1)
        same = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total = sum(same.values())
        spared = sum(cuts[k][min(n, 3)] for n in same.values()) / total
        n = same.get(gram, 0)
        return (n - cuts[k][min(n, 3)]) / total + spared * p(gram[1:])

    return p


def half(text):
    return perplexity.half_of(perplexity.runs(perplexity.code_points(text)))


def symbols_of(text):
    return [perplexity.START] * (perplexity.ORDER - 1) + perplexity.SYMBOL_OF[perplexity.code_points(text)].tolist()


MODEL_TEXTS = [
    ("the cat sat on the mat", "en"), ("the dog sat", "en"), ("a cat and a dog 12 #", "en"), ("zzz tttt tttt", None),
    ("Über die Brücke", "de"), ("日本語の文 中文です", "ja"), ("The Cat", "en"), ("the cat sat on the mat", "en"),
]


@pytest.mark.parametrize("part_runs", [perplexity.PART_RUNS, 20])
def test_perplexity_is_modified_kneser_ney(spark, part_runs):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([*MODEL_TEXTS, ("", "en"), (None, "en"), ("# # 3", "en")])]
    scored = perplexity.score(spark.createDataFrame(rows, DOCS).repartition(3), part_runs)
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == len(rows)
    for i, (text, lang) in enumerate(MODEL_TEXTS):
        own = [t for _, t, x, _ in rows if x == lang and t]
        known = {c for t in own for c in symbols_of(t)[perplexity.ORDER - 1 :]}
        other = [symbols_of(t) for t in own if half(t) != half(text)]
        p = plain_kneser_ney(other, perplexity.ORDER, len(known))
        s = symbols_of(text)
        nats = -sum(np.log(p(tuple(s[k : k + perplexity.ORDER]))) for k in range(len(text)))
        words = len(re.findall(r"[\u3040-\u30ff\u3400-\u9fff]|[^\s\u3040-\u9fff]*[a-zA-ZÜü][^\s\u3040-\u9fff]*", text))
        assert got[i].log_perplexity == pytest.approx(nats / words, rel=1e-5)
    assert all(got[i].log_perplexity is None for i in (8, 9, 10))


def test_near_copies_are_mostly_in_one_half():
    rng = random.Random(7)
    same, texts = 0, ["".join(rng.choices("abcdefgh ", k=rng.randint(1, 900))) for _ in range(600)]
    for text in texts:
        at = rng.randrange(len(text))
        same += half(text) == half(text[:at] + "X" + text[at + 1 :])
    assert same > 540 and 240 < sum(map(half, texts)) < 360


def test_letter_words():
    def plain(text):
        cjk = [c for c in text if "一" <= c <= "鿿"]
        rest = "".join("" if c in cjk else c for c in text)
        return len(cjk) + sum(any(c.isalpha() for c in w) for w in re.split(r"[\x20\x09-\x0D]+", rest))

    rng = random.Random(5)
    for _ in range(2_000):
        text = "".join(rng.choices(["a", "é", " ", " ", "\n", "#", "1", "中", "|", "\x0b"], k=rng.randint(0, 40)))
        assert perplexity.letter_words(perplexity.code_points(text)) == plain(text)


def test_signs_between_words_are_rejected_and_copies_are_not(spark):
    rng = random.Random(6)
    syllables = ["sto", "ne", "ri", "ver", "gre", "en", "wal", "ks", "un", "der"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(80)) for _ in range(300)]
    bad = [" | ".join(word() for _ in range(40)), " ".join(word() + "&&&" for _ in range(60))]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts + texts[:1] * 900 + bad)]
    got = {r.doc_id: r for r in perplexity.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(got[len(rows) - k].kept or got[len(rows) - k].base_failed for k in (1, 2))
    assert all(got[i].kept for i in range(len(rows) - 2) if not got[i].base_failed)
    assert all(got[i].kept for i in (0, 300, 1199))


def test_counts_cover_the_corpus_and_bands_reject_noise(spark):
    rng = random.Random(4)
    words = ["stone", "house", "river", "green", "walks", "over", "under", "light", "small", "bridge"]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(300)]
    noise = "".join(rng.choices("qxzjkvw#&%", k=400)).replace("q", " ")
    df = frame(spark, [*texts, noise, *EDGES]).withColumn("run", F.lit(1)).withColumn("perplexity", F.lit(2))
    total = perplexity.count_runs(df).agg(F.sum(F.col("n0") + F.col("n1"))).first()[0]
    assert total == sum(len(t or "") for t in [*texts, noise, *EDGES])
    got = {r.doc_id: r for r in perplexity.quality_rules(df).collect()}
    assert len(got) == 301 + len(EDGES)
    assert not got[300].base_failed and not got[300].kept
    assert sum(got[i].kept for i in range(300) if not got[i].base_failed) >= 0.97 * sum(not got[i].base_failed for i in range(300))
    for i, t in enumerate(EDGES, 301):
        assert tuple(got[i][c] for c in perplexity.COUNTS) == plain_counts(t or "")
    assert got[301].base_failed and got[301].perplexity is None


def test_null_languages_and_nothing(spark):
    rows = [(1, "a b c " * 9, None, "s"), (None, "a b d " * 9, "xx", "s"), (2, None, None, None), (2, None, None, None)]
    rows += [(3, "\u2003 " * 12, "en", "s"), (4, "# " * 3 + "1 2 3 4 5 6 7 8", "en", "s"), (5, "q" * 1_000_000, "en", "s")]
    df = spark.createDataFrame(rows, DOCS)
    got = perplexity.quality_rules(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in got) == [
        (0, 27, True, False), (1, 27, True, False), (2, 0, True, False), (2, 0, True, False),
        (3, 12, True, False), (4, 11, False, False), (5, 1, True, False),
    ]
    assert perplexity.quality_rules(df.where("doc_id > 9")).collect() == []


# --- classifiers -----------------------------------------------------------------------------


def labelled(rng, n, make):
    return [(make(y).encode(), y) for y in (rng.randint(0, 1) for _ in range(n))]


def good_or_bad(rng):
    good = ["river", "stone", "the", "walked", "over", "green", "hill", "and", "a", "house"]
    bad = ["CLICK!!", "BUY$$", "WIN", "###", "NOW!!", "free%%", "HOT"]
    return lambda y: " ".join(rng.choices(good if y else bad, k=rng.randint(20, 200)))


def test_compression_tells_good_from_bad():
    rng = random.Random(1)
    make = good_or_bad(rng)
    model = compression.train(labelled(rng, 300, make))
    coders = model.compressors()
    held = labelled(rng, 200, make)
    scores = model.probability(np.array([compression.normalised_difference(t, *coders) for t, _ in held]))
    assert np.mean((scores >= 0.5) == np.array([y for _, y in held])) >= 0.98


@pytest.mark.parametrize("sample", [[], [(b"a", 1)], [(b"a b", 0), (b"c", 1)], [(b"", 0), (b"", 1)]])
def test_small_samples_give_a_model(sample):
    for train in (compression.train, toxicity.train):
        train(sample)


def toxic_or_not(rng):
    words = ["river", "stone", "walked", "over", "green", "hill", "house", "light", "small", "bridge"]

    def make(y):
        text = rng.choices(words, k=rng.randint(10, 150))
        if y:
            for _ in range(1 + len(text) // 40):
                text[rng.randrange(len(text))] = rng.choice(["scum", "idiot,", "idiots"])
        return " ".join(text)

    return make


def test_network_finds_toxic_windows(spark):
    rng = random.Random(6)
    make = toxic_or_not(rng)
    net = toxicity.train(labelled(rng, 400, make))
    held = labelled(rng, 200, make)
    scores = toxicity.Scorer(net).score([t.decode() for t, _ in held])
    assert np.mean((scores >= 0.5) == np.array([y for _, y in held])) >= 0.95
    df = frame(spark, [*EDGES, "river " * 3_000 + "you idiot, scum " + "stone " * 3_000])
    got = {r.doc_id: r for r in toxicity.classify(df.withColumn("score", F.lit("clash")), net).collect()}
    assert len(got) == len(EDGES) + 1 and all(0 <= r.score <= 1 for r in got.values())
    assert got[0].score == got[1].score == got[2].score
    assert got[len(EDGES)].score > 0.5
    assert toxicity.classify(df.where("doc_id > 99"), net).collect() == []


def test_gradients_of_the_network(monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW", 6)
    net = toxicity.start(["ab", "cd"], 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["ab", "cd", "xyz", "hello", "q"]
    ids, (slots, counts) = np.array([1, 2, 0, 0, 0]), toxicity.char_slots(words)
    windows = np.random.default_rng(0).integers(0, 5, (4, 6)).astype(np.int32)
    windows[1, 4:] = windows[3, 2:] = -1
    y = np.array([1, 0, 1, 0.0])

    def loss():
        gates = net.inputs(ids, slots, counts) @ net.p["wx"] + net.p["bx"]
        z = toxicity.window_scores(net, gates, windows).astype(float)
        return np.mean(np.logaddexp(0, z) - y * z)

    grads = toxicity.gradients(net, windows, y, ids, slots, counts)
    for name, values in net.p.items():
        for i in np.argsort(-np.abs(grads[name]).ravel())[:2]:
            flat, kept = values.ravel(), values.ravel()[i]
            flat[i] = kept + 1e-2
            up = loss()
            flat[i] = kept - 1e-2
            down = loss()
            flat[i] = kept
            assert grads[name].ravel()[i] == pytest.approx((up - down) / 2e-2, rel=2e-2, abs=2e-5)


def test_windows_overlap_and_cover():
    for n in (0, 1, 47, 48, 49, 80, 81, 1000):
        rows = toxicity.window_rows(np.arange(n, dtype=np.int32))
        assert set(rows[rows >= 0].tolist()) == set(range(n))
        assert all(a[toxicity.STEP :].tolist() == b[: toxicity.WINDOW - toxicity.STEP].tolist() for a, b in zip(rows, rows[1:]))


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = [(i, f"text {i} of the sample", "en", "s") for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    learn = F.coalesce(~compression.held_out(1), F.lit(False))
    sample = compression.labelled_sample(docs, labels, "quality", learn)
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {int(t.split()[1]) for t, _ in sample} == set(range(300)) - held
    few = compression.labelled_sample(docs, labels, "quality", learn, max_texts=5)
    assert Counter(y for _, y in few) == {0: 5, 1: 5}
    null = spark.createDataFrame([(None, "x", "en", "s"), (0, None, "en", "s")], DOCS)
    assert compression.labelled_sample(null, labels, "quality", learn) == []


def test_quality_scores_of_edge_rows(spark):
    rng = random.Random(1)
    model = compression.train(labelled(rng, 60, good_or_bad(rng)))
    df = frame(spark, EDGES)
    got = {r.doc_id: r for r in compression.classify(df, model).collect()}
    assert len(got) == len(EDGES) and got[0].score == got[1].score
    assert compression.classify(df.where("doc_id > 99"), model).collect() == []
    with pytest.raises(ValueError):
        compression.classify(df.withColumn("score", F.lit(1)), model)


def test_long_words_are_read_whole():
    assert toxicity.words_of("short words stay, also with_signs!") == ["short", "words", "stay,", "also", "with_signs!"]
    handle = "this_is_a_very_long_handle_badword_hidden_in_the_middle"
    assert "badword" in toxicity.words_of(f"see {handle} there")
    rng = random.Random(12)
    for size in (25, 40, 41, 56, 57, 300):
        word = "".join(rng.choices("abcdefghij", k=size))
        parts = toxicity.words_of(word)
        assert all(len(p) <= toxicity.WORD_CHARS for p in parts)
        joined = parts[0]
        for p in parts[1:]:
            shared = toxicity.WORD_CHARS - toxicity.PART_STEP
            assert joined[-shared:] == p[:shared]
            joined += p[shared:]
        assert joined == word
    assert toxicity.words_of("") == [] and toxicity.words_of("_" * 30) == []


def test_words_that_differ_in_the_middle_score_differently():
    net = toxicity.start(["w"])
    a, b = ("x" * 30 + middle + "y" * 30 for middle in ("stone" * 3, "river" * 3))
    first, second = toxicity.Scorer(net).score([f"one {a} two", f"one {b} two"])
    assert first != second
    assert len(toxicity.Scorer(net).score(["", "_" * 40, "x" * 1_000_000, "字" * 5000])) == 4
