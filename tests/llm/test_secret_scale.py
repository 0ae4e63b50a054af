"""Secret scans: linear in long texts, blind to words that merely hold a sensitive one, measured on planted secrets."""

import random
import string
import time

import pytest

from termloom.llm import secrets_scan

from .fixtures import words


@pytest.mark.parametrize("text", ["key" + " " * 100_000, "key " * 50_000, "key" * 100_000, "token" + "=" * 200_000, "key: " + "A1b" * 100_000, "passwordkey.secret-" * 20_000, "key\n" * 50_000 + "x" * 100_000])
def test_long_texts_take_linear_time(text):
    began = time.perf_counter()
    secrets_scan.masked(text)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("text", ["monkey Chapter12Verse34Section", "turkey InternationalBusiness2024Report", "Monkey Chapter12Verse34Section", "TURKEY INTERNATIONAL12BUSINESS", "the author Chapter12Verse34Section", "keyboard: InternationalBusiness", "authentic InternationalBusiness2024Report", "the key Chapter12Verse34Section"])
def test_words_that_hold_a_sensitive_one(text):
    assert not secrets_scan.novel_spans(text)


@pytest.mark.parametrize("name", ["apiKey", "API_KEY", "ssh-key", "privatekey", "authToken", "AUTH", "keys", "client.auth", "myPassword"])
def test_parts_of_names_are_sensitive(name):
    key = "Zk9x8Qw2LmN4pR7tVb3y"
    text = f"{name}: {key}"
    assert [text[s:e] for s, e, _ in secrets_scan.novel_spans(text)] == [key]


def test_planted_secrets_are_found_and_prose_is_not():
    rng = random.Random(8)
    kinds = {
        "base64": lambda: "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=rng.randint(20, 44))),
        "url": lambda: "".join(rng.choices(string.ascii_letters + string.digits + "-_", k=rng.randint(20, 44))),
        "hex": lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([32, 40, 64]))),
        "base32": lambda: "".join(rng.choices(string.ascii_uppercase + "234567", k=rng.randint(16, 32))),
        "lower": lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(16, 32))),
    }
    shapes = ("key: {}", 'authorization = "{}"', "bearer {}", "the passphrase is {}", "credentials ({})", "DB_PWD={}", "session_id={}", '"signature": "{}"')
    got = {}
    for kind, make in kinds.items():
        hits = 0
        for n in range(200):
            key = make()
            before, after = words(n, 40), words(n + 500, 40)
            text = f"{before} {rng.choice(shapes).format(key)} {after}"
            at = text.index(key)
            hits += any(s <= at and at + len(key) <= e for s, e, _ in secrets_scan.novel_spans(text) + secrets_scan.base_spans(text))
        got[kind] = hits / 200
    assert min(got.values()) >= 0.95, got
    clean = 0
    for n in range(500):
        prose = words(9_000 + n, 30).split()
        for at in range(0, 30, 6):
            prose[at] = rng.choice(["key", "token", "secret", "auth", "password", "signature"])
        prose.insert(3, rng.choice(["https://www.example.com/about/index.html", "internationalization", "2024-01-01T10:00:00", "user@example.com", "MAX_BUFFER_LENGTH", "getElementById"]))
        clean += not secrets_scan.novel_spans(" ".join(prose))
    assert clean >= 0.98 * 500, clean
