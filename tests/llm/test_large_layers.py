"""Secrets in decompressed layers of any size are found the same way."""

import base64
import gzip

import pytest

from graupel.llm import secrets

SECRET = b"password=hunter2hunter2"


@pytest.mark.parametrize("inner", [b"\x00\x01 " + gzip.compress(SECRET), SECRET.decode().encode("utf-16-le"), b"ends in " + SECRET], ids=["compressed inside", "two bytes a character", "plain"])
@pytest.mark.parametrize("most", [1 << 12, 1 << 24])
def test_results_do_not_depend_on_the_size_of_a_layer(inner, most, monkeypatch):
    monkeypatch.setattr(secrets, "MAX_LAYER", most)
    monkeypatch.setattr(secrets, "CHUNK", 1 << 11)
    token = base64.b64encode(gzip.compress(b"plain words, and more.\n" * 1000 + inner)).decode()
    text = f"one {token} two"
    spans, layers = secrets.layer_spans(text, [])
    assert spans == {(4, 0, 4 + len(token))}
    monkeypatch.setattr(secrets, "MAX_LAYER", 1 << 30)
    assert secrets.layer_spans(text, []) == (spans, layers)
