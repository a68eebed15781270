"""Secrets in long word runs: the same places as by one pattern, in time that grows with the text."""

import random
import re
import time

from evigrain.llm import secrets

PLAIN = re.compile(r"""(?:pass|pwd|secret|token|api|key|auth|cred)\w*["']?\s{0,4}[:=]\s{0,4}["']?(?:bearer\s)?(?=[A-Za-z0-9+/_.-]{8})""", re.I)


def plain_ends(text):
    found = set()
    for at in range(len(text)):
        m = PLAIN.match(text, at)
        if m:
            found.add(m.end())
    return found


def test_places_after_key_words():
    rng = random.Random(6)
    parts = ["api", "Key", "_", "token", "=", ": ", " ", "'", '"', "abcdefgh", "ABCD1234efgh", "bearer ", "x", "é", "İ", "\n", "PWD"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert secrets.key_ends(text) == plain_ends(text), text


def test_long_word_runs_take_linear_time():
    began = time.time()
    for text in ("api_key" * 150_000, "api_key" * 150_000 + "=abcdefgh1234", "İ" + "token" * 200_000, "key=" * 250_000):
        secrets.key_ends(text)
        secrets.pieces(text)
    assert time.time() - began < 20
