import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from bidlake.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS_FILE)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def encode(texts):
    ids, counts = bpe.encode_texts(texts, PATH)
    out, at = [], 0
    for n in counts.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "é", "9", "²", ".", "!", "　", "\x85", "\x1c", "中", "😀", "\0", "'s", "'ll"]


def test_mixed_pieces(library):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(5000)]
    assert encode(texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=1, max_size=5))
def test_any_text(library, texts):
    assert encode(texts) == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000 + "x", "ab" * 2000, "é" * 999, ""])
def test_long_pieces(library, text):
    assert encode([text]) == [library.encode_ordinary(text)]


def test_scan_equals_stepping():
    import numpy as np

    codes = np.random.default_rng(0).integers(0, 256, 70_001).astype(np.uint8)
    state, want = 0, []
    for c in codes.tolist():
        want.append(state)
        state = (c >> (2 * state)) & 3
    assert bpe.scan_states(codes).tolist() == want


def test_query_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello, it's  me", "y"), (3, "Hello, it's  me", "y"), (None, "null id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.bpe_digests(docs).collect()
    assert len(out) == 5
    for (doc_id, text, _), r in zip(sorted(rows, key=str), sorted(out, key=lambda r: str((r["doc_id"], r["n_tokens"]))), strict=True):
        ids = library.encode_ordinary(text or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.bpe_digests(docs.limit(0)).count() == 0


def test_offsets_decode_a_range(spark):
    text = "Grüße an alle, it's 12 o'clock"
    r = bpe.bpe_encode(spark.createDataFrame([("", None), (text, 1)], "text string, offsets int")).collect()[1]
    ids, _ = bpe.encode_texts([text], PATH)
    vocab, start, size = bpe.vocabulary(PATH)
    for token, at in zip(r["ids"], r["offsets"], strict=True):
        assert text.encode()[at : at + size[token]] == vocab[start[token] : start[token] + size[token]].tobytes()
