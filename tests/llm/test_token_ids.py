"""Token ids are what the tokenizers library gives for whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from locuspark.llm import tokenbin

ALPHABET = [
    *"abzJTHWYAE.,,..  \n\t'0129<|>-_$(", "'s", "'ll", "̌", "̈", "̱", "̊", "́", "ͅ", "İ", "Σ", "ς", "É",
    "Ÿ", "ſ", "ŉ", "ª", "µ", " ", "\u0085", "ẞ", "ΐ", "한", "ᄀ", "ᅡ", "\x1c", "\U0001f44d",
    "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "word", "Word.", "café,",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path(tokenbin.TOKENIZER))


def ids(own, text):
    return np.frombuffer(own.encode([text])[0], own.width).tolist()


def test_random_strings(plain):
    own, r = tokenbin.Parts(public_tokenizers.path(tokenbin.TOKENIZER)), random.Random(7)
    for _ in range(20_000):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14)))
        assert ids(own, text) == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_character_alone_and_inside_words(plain):
    own = tokenbin.Parts(public_tokenizers.path(tokenbin.TOKENIZER))
    for c in [*range(0x500), *range(0x1E00, 0x2100), 0x212A, 0x3000, 0xFB01, 0x10400]:
        for text in (chr(c), f"a{chr(c)}b {chr(c)}.", f"{chr(c)}, A{chr(c)}"):
            assert ids(own, text) == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_slices_and_generations(plain, monkeypatch):
    monkeypatch.setattr(tokenbin, "SLICE", 40)
    monkeypatch.setattr(tokenbin, "REMEMBERED", 5)
    own, r = tokenbin.Parts(public_tokenizers.path(tokenbin.TOKENIZER)), random.Random(8)
    for _ in range(200):
        text = " ".join("".join(r.choice("abcdeAB.") for _ in range(r.randint(0, 6))) for _ in range(60)) + "x" * 120
        assert ids(own, text) == plain.encode(text, add_special_tokens=False).ids


def test_wide_ids(spark):
    import zlib

    from locuspark.llm import common

    path = public_tokenizers.path(tokenbin.TOKENIZER)
    rows = [(5, "some words here"), (5, "other words"), (None, "x"), (-3, None), (7, "")]
    uri = common.fresh_path(spark, "wide")
    manifest = tokenbin.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), uri, path, bits=32)
    assert {x.bits for x in manifest.collect()} == {32}
    plain = Tokenizer.from_file(path)
    want = sorted((d or 0, zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t in rows)
    assert sorted((x.doc_id or 0, x.ids_crc32) for x in tokenbin.read_tokens(manifest, uri).collect()) == want
