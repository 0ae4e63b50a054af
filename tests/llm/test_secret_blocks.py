"""Private keys by the block, lines that belong together, providers' tokens, context on either side, digits."""

import random
import string

import pytest

from termloom.llm import secrets_scan

from .fixtures import words


def body(rng, lines, width=64):
    return ["".join(rng.choices(string.ascii_letters + string.digits + "+/", k=width)) for _ in range(lines)] + ["".join(rng.choices(string.ascii_letters + string.digits, k=21)) + "=="]


@pytest.mark.parametrize("kind", ["RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY"])
@pytest.mark.parametrize("prefix", ["", "    ", "# ", "> "])
def test_no_line_of_a_private_key_stays(kind, prefix):
    lines = body(random.Random(kind + prefix), 20)
    text = words(1, 30) + "\n" + "\n".join(prefix + x for x in [f"-----BEGIN {kind}-----", *lines, f"-----END {kind}-----"]) + "\n" + words(2, 30)
    for cut in (text, text.replace(f"-----END {kind}-----", "")):
        out = secrets_scan.masked(cut)
        assert not [x for x in lines if x in out] and words(1, 30) in out and words(2, 30) in out


def test_a_key_in_one_string_and_two_keys():
    rng = random.Random(3)
    lines = body(rng, 6)
    text = 'key = "-----BEGIN PRIVATE KEY-----\\n' + "\\n".join(lines) + '\\n-----END PRIVATE KEY-----\\n"'
    out = secrets_scan.masked(text + "\nplain words\n" + text)
    assert not [x for x in lines if x in out] and "plain words" in out


def test_lines_after_a_reported_one_go_with_it():
    lines = body(random.Random(5), 9, 48)
    text = "secret:\n" + "\n".join(lines) + "\nand then ordinary words follow here\n"
    out = secrets_scan.masked(text)
    assert not [x for x in lines if x in out] and "\nand then ordinary words follow here\n" in out


@pytest.mark.parametrize("text", ["-----BEGIN PRIVATE KEY-----\nyour key here\n-----END PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----\n", "-----BEGIN PRIVATE KEY-----", "sk-learn-contributors-and-friends", "npm_config_registry_default", "hf_transformers_training_arguments"])
def test_placeholders_stay(text):
    assert secrets_scan.masked(text) == text


def test_provider_tokens_and_context_behind():
    rng = random.Random(6)
    make = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    for _ in range(50):
        for token in ("ghp_" + make(36), "sk_live_" + make(24), f"xoxb-{rng.randrange(10**11)}-{rng.randrange(10**11)}-{make(24)}", "AIza" + make(35), "glpat-" + make(20), "hf_" + make(34)):
            text = f"{words(1, 12)} {token} {words(2, 12)}"
            assert token not in secrets_scan.masked(text), token
    hits = 0
    for _ in range(200):
        key = make(24)
        hits += key not in secrets_scan.masked(f"{words(3, 9)} {key} is my github token {words(4, 9)}")
    assert hits >= 196


def test_digits_only_where_assigned():
    rng = random.Random(7)
    hits = clean = 0
    for _ in range(200):
        digits = "".join(rng.choices(string.digits, k=rng.randint(16, 22)))  # the base pattern takes 24 and more
        hits += digits not in secrets_scan.masked(f"key: {digits} {words(4, 9)}")
        clean += digits in secrets_scan.masked(f"the key of the order of {digits} {words(4, 9)}")
    assert hits >= 180 and clean >= 196, (hits, clean)


@pytest.mark.parametrize("text", ["-----BEGIN PRIVATE KEY-----\n" * 20_000, "-----BEGIN PRIVATE KEY-----\n" + "Ab1+" * 50_000, "token\n" + "Ab1+\n" * 50_000, "ghp_" * 60_000, ("A1b2" * 20 + " key ") * 3_000, "-----BEGIN PRIVATE KEY-----" + "\\n" * 100_000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.perf_counter()
    secrets_scan.masked(text)
    assert time.perf_counter() - began < 8
