"""Both tokenizers against the library over every code point, and over whole documents."""

import sys

import pytest

from termloom.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

EVERY = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
CHUNKS = [EVERY[at : at + 64] for at in range(0, len(EVERY), 64)]


@pytest.mark.parametrize("shape", ["{} ", "a{}B1 ", "É{}́ς "])
def test_word_bpe_on_every_code_point(shape):
    own, library = bpe.codec(P.path("word_bpe_49k.json")), tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["".join(shape.replace("{}", c) for c in chunk) for chunk in CHUNKS]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        if own.encode(text).tolist() != found.ids:
            for c in text.split(" "):
                assert own.encode(c).tolist() == library.encode(c, add_special_tokens=False).ids, ascii(c)
            raise AssertionError(ascii(text))


def test_byte_bpe_on_every_code_point():
    library, own = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.tokenizer(P.path("byte_bpe_50k.json"))
    texts = ["".join(f"a{c}B1 " for c in chunk) + "".join(chunk) for chunk in CHUNKS]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text).tolist() == found.ids, ascii(text)


@pytest.mark.parametrize("name, make", [("word_bpe_49k.json", bpe.codec), ("byte_bpe_50k.json", packing.tokenizer)])
def test_whole_documents(name, make):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    own, library = make(P.path(name)), tokenizers.Tokenizer.from_file(P.path(name))
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text).tolist() == found.ids
