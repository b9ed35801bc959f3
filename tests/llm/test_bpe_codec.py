import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex

from cellgrid.llm import bpe_codec as B

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", "a", "Hello, world! it's 12ab", "  lead\n\n and  trail  ", "é" * 50 + "日本 語", "x" * 3000, "tab\tand\r\nlines  nbsp", "we'll they're I'd'"]


@pytest.fixture(scope="module")
def encoding():
    return B.load_encoding(RANKS, P.PATTERN)


def whole(encoding, text):
    return encoding.encode_ordinary(text)


def test_cut_texts_encode_as_whole_ones(encoding, monkeypatch):
    split = regex.compile(P.PATTERN)
    long = " ".join(TEXTS) * 3
    for chunk, longest in ((7, 10_000), (50, 10_000), (7, 8)):
        monkeypatch.setattr(B, "CHUNK", chunk)
        monkeypatch.setattr(B, "LONGEST", longest)
        monkeypatch.setattr(B.chunks, "__defaults__", (chunk,))
        for text in [*TEXTS, long]:
            assert B.encode_text(encoding, split, text).tolist() == whole(encoding, text), (chunk, text[:40])


def test_runs_without_a_safe_place(encoding):
    split = regex.compile(P.PATTERN)
    for text in ("." * 400_000, "a" * 300_000 + " b", " " * 300_000 + "x"):
        ids = B.encode_text(encoding, split, text)
        assert encoding.decode_bytes(ids.tolist()) == text.encode()


def test_digests_of_edge_rows(spark, encoding):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "a", "x"), (1, "a", "x"), (99, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.digests(frame, RANKS, P.PATTERN).collect())
    want = []
    for i, t, _ in rows:
        ids = np.array(whole(encoding, t or ""), "<u4")
        want.append((i if i is not None else -1, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert B.digests(frame.limit(0), RANKS, P.PATTERN).count() == 0
