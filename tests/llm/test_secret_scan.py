"""What the secret scan must not lose."""

import random
import string

import pytest

from ridgeline.llm import secret_scan

NOVELTY = secret_scan.Novelty()


def novel(text):
    return [text[a:b] for a, b, _ in secret_scan.novel_spans(text, NOVELTY)]


def test_random_secrets_of_any_make():
    rng = random.Random(3)
    for letters in (string.ascii_letters, string.ascii_letters + string.digits):
        for n in (16, 20, 24, 40):
            for _ in range(100):
                word = "".join(rng.choice(letters) for _ in range(n))
                if secret_scan.entropy(word) >= secret_scan.ENTROPY:
                    assert novel(f'the access key "{word}" here') == [word]
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    assert novel(f'access key: "{key}"') == [key]


@pytest.mark.parametrize("name", ["secretKey", "privateKey", "accessKey", "encryptionKey", "signingKey", "dbPassword", "db_password", "AWSSecretValue", "tokenValue", "my_private_value"])
def test_names_in_parts(name):
    assert novel(f'{name} = "q7Rk2mXw9TzLp4Vb"') == ["q7Rk2mXw9TzLp4Vb"]


@pytest.mark.parametrize("text", ["monkeyHouse q7Rk2mXw9TzLp4Vb", "access key ----------------", "keyboard q7Rk2mXw9TzLp4Vb"])
def test_no_secrets(text):
    assert novel(text) == []
