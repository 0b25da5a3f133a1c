"""Personal data: spans equal to plain patterns, time in proportion to unbroken texts, context words of four languages."""

import random
import re
import time

import pytest

from cuewright.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_proposals_equal_plain_patterns():
    pick = random.Random(1)
    for _ in range(20_000):
        text = "".join(pick.choice("aB1.@-+ %(9é,") for _ in range(pick.randrange(60)))
        for rule in pii.RULES[:4]:
            assert list(rule.propose(text)) == [m.span() for m in re.finditer(PLAIN[rule.kind], text)], (text, rule.kind)


@pytest.mark.parametrize("text", ["a" * 10_000_000 + "@.1", "1" * 10_000_000 + ".a@", "f0" * 3_000_000 + "@", "a@" * 500_000, "+1 " * 1_000_000, "AB12" * 500_000, "." * 5_000_000 + "@1", "a@b.c1 " * 50_000])
def test_unbroken_texts_take_seconds(text):
    began = time.perf_counter()
    pii.redact(text)
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("words", ["visa card {} thanks", "meine Kreditkarte {} danke", "ma carte {} merci", "mi tarjeta {} gracias"])
def test_context_words_of_each_language_raise_the_score(words):
    number = "4111 1111 1111 1111"
    score = lambda t: [s for k, _, _, s, _ in pii.find(t) if k == "card"][0]
    assert score(words.format(number)) > score(f"so {number} then") > score(f"ISBN {number} then")


def test_overlapping_spans_are_replaced_as_one():
    assert pii.redact("x +1 202 555 0100@b.co y 1.2.3.4,1.2.3.4") == "x <phone> y <ip>,<ip>"
