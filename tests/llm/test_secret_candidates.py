"""Secrets near a sensitive word, not just right after it, and strings of one case without digits."""

import pytest

from termloom.llm import secrets_scan

KEY = "Zk9x8Qw2LmN4pR7tVb3y"


@pytest.mark.parametrize(
    "text",
    [f'DB_PASSWORD_PROD = "{KEY}"', f"client_secret_value: {KEY}", f"token_v2 = '{KEY}'", f"key_prod: {KEY}", f"the tokens: {KEY}", f"password for admin is {KEY}", f"auth: Basic {KEY}", f"pwd_main={KEY}", f"bearer {KEY}"],
)
def test_keys_at_a_distance(text):
    assert [text[s:e] for s, e, _ in secrets_scan.novel_spans(text)] == [KEY]
    assert KEY not in secrets_scan.masked(text)


@pytest.mark.parametrize("key", ["qzxvkjwpmhtgbrfd", "MZXWQYTBOJUXKGRCVDHL", "3f9a0c7b1d2e4f60"])
def test_strings_of_one_case_and_short_hexadecimal(key):
    for text in (f"passphrase: {key}", f"the password of the admin is {key} now"):
        assert [text[s:e] for s, e, _ in secrets_scan.novel_spans(text)] == [key]


@pytest.mark.parametrize("text", ["a key to internationalization and administration", "the author's responsibilities", "Schlüssel, key: Verantwortungsbereich", "token, dated 2024-01-01T10", "auth at https://www.example.com/index.html"])
def test_words_and_addresses_are_no_secrets(text):
    assert not secrets_scan.novel_spans(text)
