import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectrafleet.llm import bpe, token_files
from spectrafleet.llm._shared import new_path
from spectrafleet.llm.encoding import Encoder
from spectrafleet.llm.queries import bpe_digests, tokenizer_path

WORD, BYTE = str(tokenizer_path("word_bpe_49k.json")), str(tokenizer_path("byte_bpe_50k.json"))
TEXT = st.text(st.sampled_from("ab'sT é.,!1 \x1c　\n\t  <|endoftext|>́ß日本"), max_size=60)


def plain(path, text):
    return Encoder.load(path).tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=400, deadline=None)
@given(text=st.one_of(TEXT, st.text(max_size=80), st.just("a <|endoftext|> b  <|endoftext|>\n c")))
def test_pieces_give_the_whole_texts_ids(path, text):
    e = Encoder.load(path)
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == plain(path, text)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_encoded_together(path):
    rng = np.random.default_rng(0)
    letters = list("abcdefgzABCZäÖßéÿ")
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 12))) + rng.choice(["", "", ",", "!!", "$$$", "'s", "İ,", "1"]) for _ in range(700)) for _ in range(6)]
    e = Encoder(path)
    for t, got in zip(texts, e.encode_many(texts), strict=True):
        assert np.frombuffer(got, e.dtype).tolist() == plain(path, t)


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(TEXT, max_size=6))
def test_joined_pieces_give_the_whole_texts_ids(parts):
    e = Encoder.load(WORD)
    joined = bpe.join_pieces(e, [bpe.encoded_piece(e, p) for p in parts])
    assert np.frombuffer(joined, e.dtype).tolist() == plain(WORD, "".join(parts))
    assert e.decode_joined(joined).decode() == e.tokenizer.decode(plain(WORD, "".join(parts)), skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(text=st.text(max_size=3000))
def test_chunks_are_the_text(text):
    assert b"".join(bpe.chunk(text.encode())) == text.encode()
    [c.decode() for c in bpe.chunk(text.encode())]


def test_chunks_move_with_their_content():
    rng = np.random.default_rng(1)
    shared = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"], 3000)).encode()
    a, b = bpe.chunk(b"first " * 30 + shared), bpe.chunk(b"another start " * 9 + shared)
    assert len(set(a) & set(b)) > 0.8 * len(set(a))


def rows():
    rng = np.random.default_rng(3)
    words = ["the", "Überfluß", "it's", "n0t", "x" * 40, "\n", "ende."]
    shared = " ".join(rng.choice(words, 900))
    texts = [None, "", " ", "one", shared, shared, "intro " + shared + " outro", "x" * 5000, "y" + "x" * 5000 + shared[:4000]]
    return list(enumerate(texts)) + [(None, "no id"), (4, shared)]


def test_documents_match_the_library(spark):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows()], "doc_id long, text string, row string, h1 int")
    got = bpe.encode_documents(docs, WORD, bpe_digests, "n_tokens long, ids_sha256 string, decoded_sha256 string").collect()
    tok = Encoder.load(WORD).tokenizer
    want = []
    for i, t in rows():
        ids = plain(WORD, t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    ids = bpe.encode_documents(docs.filter("doc_id = 3"), WORD)
    assert bpe.decode_documents(ids, WORD).first()["text"] == tok.decode(plain(WORD, "one"), skip_special_tokens=False)
    assert bpe.encode_documents(docs.limit(0), WORD).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_documents(docs, BYTE)


def test_a_full_filter_changes_nothing(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    few = bpe.encode_documents(docs, WORD, filter_bits=64).collect()
    assert sorted(few, key=str) == sorted(bpe.encode_documents(docs, WORD).collect(), key=str)


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in reversed(rows())], "doc_id long, text string, part int")
    out = new_path(spark, "files")
    manifest = token_files.write_token_files(docs, BYTE, out, 2)
    got = token_files.read_token_files(manifest, out).collect()
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for i, t in ordered:
        ids = [*plain(BYTE, t or ""), 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    empty = new_path(spark, "files")
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), BYTE, empty, 2), empty).count() == 0
