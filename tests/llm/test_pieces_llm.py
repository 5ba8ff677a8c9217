"""Encoding and decoding against the library."""

import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import pieces as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    v = P.Vocabulary(MODEL)
    return P.Encoder(v), P.Decoder(v), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(tools, text):
    encoder, decoder, library = tools
    ids = memoryview(encoder.encode(text)).cast("I").tolist()
    assert ids == library.encode(text, add_bos=True, add_eos=True)
    assert decoder.decode(ids) == library.decode(ids)


@settings(max_examples=600, deadline=None)
@given(text=st.lists(st.sampled_from(["a", "b", " ", "  ", "▁", "\n", "é", "中", "🙂", "‍", "7", "the", "ing", " of", "<s>", "<0x0A>", "\x00", "eee", "�", "́", "ab", "tion"]), max_size=30).map("".join))
def test_as_the_library(tools, text):
    same(tools, text)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=40))
def test_any_text(tools, text):
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        same(tools, text)


def test_long_runs(tools):
    for t in ("", " ", "e" * 3000, " " * 300, "ab" * 2000, "中文" * 500, "xq" * 1000 + " " + "th" * 900):
        same(tools, t)


def test_damaged_bytes(tools):
    _, decoder, library = tools
    ids = [1, *(library.piece_to_id(f"<0x{b:02X}>") for b in (0xE4, 0xB8, 0x41, 0xFF, 0xC3, 0xA9, 0xF0)), 2]
    assert decoder.decode(ids) == library.decode(ids)


def test_without_cuts(tools):
    encoder, _, library = tools
    encoder.cuts = False
    try:
        same(tools, "The quick brown  fox, and that.\nNext line " * 5)
    finally:
        encoder.cuts = True


def test_operator(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = P.encode_decode(odd, MODEL, keep=True).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert P.encode_decode(none, MODEL).count() == 0
