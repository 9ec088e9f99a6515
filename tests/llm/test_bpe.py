import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe_transducer as B

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = B.load_ranks(PATH)
OTHER = B.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = B.Encoder(RANKS, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_the_library_does(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


@settings(max_examples=500, deadline=None)
@given(st.text(st.characters(max_codepoint=255), max_size=40))
def test_latin_splitter_splits_alike(text):
    assert B.latin_splitter(P.PATTERN)(text) == ENCODER.split(text)
    assert B.latin_splitter(r"\w+") is None


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_any_bytes_merge_alike(raw):
    assert tuple(ENCODER.transducer.encode(raw)) == B.merge_encode(raw, RANKS)


def test_other_vocabulary_and_small_state_table():
    rng = random.Random(5)
    for limit in (10, B.MAX_STATES):
        t = B.Transducer(OTHER, max_states=limit)
        for _ in range(150):
            raw = "".join(rng.choice(["th", "on", " ", "é", "ß", "ing", "x", "的", "1"]) for _ in range(rng.randint(1, 25))).encode()
            assert tuple(t.encode(raw)) == B.merge_encode(raw, OTHER)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 4))
def test_streaming_decode_is_the_same_at_any_cut(raw, step):
    tokens = {i: bytes([i]) for i in range(256)}
    whole, parts = B.Decoder(tokens), B.Decoder(tokens)
    text = whole.feed(raw) + whole.finish()
    assert text == "".join(parts.feed(raw[i : i + step]) for i in range(0, len(raw), step)) + parts.finish()
    try:
        assert text == raw.decode()
    except UnicodeDecodeError:
        assert "�" in text


def check(df):
    want = {}
    for r in df.collect():
        ids = REFERENCE.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids)] = (hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = B.roundtrip(df, PATH, P.PATTERN).collect()
    assert len(got) == df.count()
    assert all(want[r["doc_id"], r["n_tokens"]] == (r["ids_sha256"], r["decoded_sha256"]) for r in got)


def test_query_against_the_library(docs):
    check(docs)


def test_edges(edge_docs, no_docs):
    check(edge_docs)
    assert B.roundtrip(no_docs, PATH, P.PATTERN).count() == 0
    with pytest.raises(KeyError):
        B.Decoder({}).feed([1])
