import random
import string

from keelson.llm import secrets


def share(alphabet, size, context):
    rng = random.Random(5)
    found = 0
    for _ in range(400):
        token = "".join(rng.choices(alphabet, k=size))
        text = f"{context} {token} end"
        found += secrets.novel_spans(text, []) == [(len(context) + 1, len(context) + 1 + size, "novel")]
    return found / 400


def test_inflected_words_are_context():
    for context in ("the password is", "passwd", "Authorization: Basic", "authentication", "credentials", "tokens", "secrets"):
        assert share(string.ascii_letters + string.digits, 32, context) > 0.99, context
    assert share(string.ascii_letters + string.digits, 32, "secretary") == 0
    assert share(string.ascii_letters + string.digits, 32, "the author") == 0


def test_alphabets_and_short_tokens():
    assert share(string.ascii_uppercase + "234567", 32, "token") > 0.95
    assert share(string.ascii_lowercase + string.digits, 24, "token") > 0.98
    assert share(string.ascii_letters, 32, "token") > 0.9
    assert share(string.ascii_letters + string.digits, 12, "token") > 0.7
    for name in ("required", "user-authentication-service", "AbstractAuthenticationProvider", "committee2024meetingroom", "2024-01-01"):
        assert not secrets.novel_spans(f"the token {name} end", [])
