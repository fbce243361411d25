"""Single-precision training, sums of slots, the cache of units, batches of texts."""

import numpy as np
import pyarrow as pa

from revtext.llm import batches, tokenfile, tokens, toxicity


def test_training_stays_in_single_precision():
    net = toxicity.start(["ab", "cd"], 3)
    ids, (slots, counts) = np.array([1, 2, 0]), toxicity.char_slots(["ab", "cd", "longer"])
    assert net.inputs(ids, slots, counts).dtype == np.float32
    windows = np.full((2, toxicity.WINDOW), -1, np.int32)
    windows[0, :3], windows[1, :2] = [0, 1, 2], [2, 2]
    grads = toxicity.gradients(net, windows, np.array([1, 0], np.float32), ids, slots, counts)
    assert {k: g.dtype for k, g in grads.items()} == {k: np.float32 for k in net.p}


def test_slot_sums_are_those_of_each_word():
    rng = np.random.default_rng(4)
    table, counts = rng.standard_normal((50, 3)), rng.integers(1, 30, 40)
    slots = rng.integers(0, 50, counts.sum())
    want = [table[own].sum(axis=0) for own in np.split(slots, np.cumsum(counts)[:-1])]
    assert np.allclose(toxicity.slot_sums(table, slots, counts), want)


def test_states_are_those_of_one_window_at_a_time():
    net = toxicity.start(["w"], 5)
    p, h = net.p, toxicity.HIDDEN
    gates = np.random.default_rng(2).standard_normal((9, 6 * h)).astype(np.float32)
    for length in (1, 5, toxicity.WINDOW):
        windows = np.full((2, toxicity.WINDOW), -1, np.int32)
        windows[0, :length] = np.arange(length) % 9
        windows[1] = 3
        rows, mask = toxicity._rows_and_mask(windows)
        got = toxicity._states(gates, rows, mask, p)[:, :, 0]
        for d, u in enumerate((p["uf"], p["ub"])):
            state, order = np.zeros(h), range(length)
            for t in order if d == 0 else order[::-1]:
                x, hu = gates[windows[0, t], 3 * h * d : 3 * h * (d + 1)], state @ u
                z, r = (1 / (1 + np.exp(-(x + hu)[a : a + h])) for a in (0, h))
                n = np.tanh(x[2 * h :] + r * hu[2 * h :])
                state = n + z * (state - n)
                assert np.allclose(got[t, d * h : (d + 1) * h], state, atol=1e-5)


def plain_ids(enc, text):
    return enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_are_encoded_as_in_their_text():
    enc = tokens.Encoder(tokens.tokenizer_path())
    assert enc.words is not None
    letters = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)]))
    rows = [f"Ab cDé {a}x y{a}{b} {b}" for a, b in zip(letters, letters[1:])]
    rows += ["ĊĊ Ġa Ċ x\nĊ", "a\u00d7b \u00f7 c", "it's we'LL don't''s", "  two  spaces ", "ſo ŉe ƀ ǆ"]
    for part in (rows, rows[::-1]):
        assert [x.tolist() for x in enc.encode(part)] == [plain_ids(enc, t) for t in part]


def test_units_met_again_stay_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 6)
    enc = tokens.Encoder(tokens.tokenizer_path())
    for k in range(12):
        rows = [f"often word{chr(97 + k)} often{' also' * k}, {'long' * 20}"]
        assert enc.encode(rows)[0].tolist() == plain_ids(enc, rows[0])
        assert len(enc.units) <= 6 and (k == 0 or pa.scalar(b"often", pa.binary()) in list(enc.units))
        assert len(enc.ids) == enc.sizes.sum() and len(enc.met) == len(enc.units)


def test_batches_are_joined_up_to_a_size():
    parts = [pa.RecordBatch.from_arrays([pa.array([i] * 10)], ["i"]) for i in range(7)]
    got = list(batches.joined(iter(parts), 200))
    assert [b.num_rows for b in got] == [30, 30, 10]
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches(parts).combine_chunks())
    assert list(batches.joined([], 200)) == []


def test_values_of_every_width_come_back():
    rng = np.random.default_rng(9)
    for top in (1, 0x100, 0x101, 0x10000, 0x10001, 0x1000000, 0x1000001, 1 << 32):
        for count in (0, 1, 3, 4, 1001):
            values = rng.integers(0, top, count, dtype=np.uint32)
            values[:1] = top - 1
            control, data = tokenfile.encode_values(values)
            assert len(control) == -(-count // 4)
            assert len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values)
            assert tokenfile.decode_values(control, data, count).tolist() == values.tolist()
