"""A secret that stands twice is reported and masked twice."""

from termloom.llm import secrets_scan


def test_a_key_given_twice_is_novel_at_both_places():
    key = "Zk9x8Qw2LmN4pR7tVb3y"
    text = f"auth key: {key} and again, credential: {key} end"
    assert [text[s:e] for s, e, _ in secrets_scan.novel_spans(text)] == [key, key]
    assert key not in secrets_scan.masked(text)
