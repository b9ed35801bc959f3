"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text longer than ``CHUNK`` characters is cut before it is given to the library, at places
where no match of the splitting pattern can cross:

* between a character that is no white space and one that is: every alternative of the pattern
  that takes both kinds starts with the white space;
* between an ASCII letter and an ASCII digit, either way round.

A stretch without such a place (a run of one million dots, say) is split by the pattern here,
and each match goes through the library's merge routine by itself, so that neither the pattern
engine's backtracking limit nor its stack bounds the length of a text. Patterns whose matches cross
a safe place (such as those that take line ends after punctuation) are refused.

Null texts count as empty: no ids, no bytes. Rows are mapped one to one, so repeated rows, ties
and empty tables need no care, and columns other than the named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import arrow_map, table

CHUNK = 65_536
#: A chunk that stays longer than this is split by the pattern before it meets the library.
LONGEST = 4 * CHUNK
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@lru_cache(maxsize=4)
def load_encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, read once in each Python worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    name = hashlib.sha256(f"{rank_file}\0{pattern}".encode()).hexdigest()[:16]
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Texts around every kind of safe place; a pattern is fit for cutting if it splits none of them across one.
PROBES = ("a b", "a\n\nb", "a\r\nb", "a1b22", "don't 1st", "x. y!\n", "!?\n\n z", "é ß\u3000中 文", "a\t\tb", "12 34\n", "... \n...", "A's 9's", "_a _1", "-1\n", "中\n1", "ab\u00a0cd", "a/\nb", "//\r\n")


@lru_cache(maxsize=4)
def checked(pattern: str) -> str:
    """The pattern, if no match of it crosses a safe place of the probes; else an error, as long texts would be cut wrongly."""
    split = regex.compile(pattern)
    for probe in PROBES:
        ends = {m.end() for m in split.finditer(probe)}
        crossed = [m.start() for m in SAFE.finditer(probe) if m.start() not in ends]
        if crossed:
            raise ValueError(f"the pattern takes {probe!r} across place {crossed[0]}, where long texts are cut")
    return pattern


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Cut a text at the first safe place after every ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoding: tiktoken.Encoding, pattern: regex.Pattern, text: str) -> np.ndarray:
    """Token ids of a whole text as little-endian unsigned 32-bit integers."""
    if len(text) <= CHUNK:
        return np.array(encoding.encode_ordinary(text), dtype="<u4")
    parts = []
    for chunk in chunks(text):
        if len(chunk) <= LONGEST:
            parts.append(np.array(encoding.encode_ordinary(chunk), dtype="<u4"))
        else:
            for match in pattern.finditer(chunk):
                parts.append(np.array(encoding._core_bpe.encode_single_piece(match.group().encode()), dtype="<u4"))
    return np.concatenate(parts)


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of each row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding, split = load_encoding(rank_file, checked(pattern)), regex.compile(pattern)
        ids = [encode_text(encoding, split, text.as_py() or "") for text in batch.column(1)]
        return pa.record_batch(
            [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
            names=[id_col, "n_tokens", "ids"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, F.col(text_col).alias("text")), kernel, f"{id_col} {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` with ``decoded``, the raw bytes that each row's ids stand for.

    Bytes and not text: a cut inside a character leaves no valid UTF-8, and raw bytes lose nothing.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding = load_encoding(rank_file, pattern)
        out = [encoding.decode_bytes(np.frombuffer(ids.as_py(), dtype="<u4").tolist()) for ids in batch.column(2)]
        return pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=[id_col, "n_tokens", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return arrow_map(encoded.select(id_col, "n_tokens", "ids"), kernel, f"{id_col} {kind}, n_tokens long, ids binary, decoded binary")


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids, ids_sha256 and decoded_sha256 of each row: encoded, and decoded from the same ids' bytes, in one kernel.

    The decoded bytes are digested where they arise, so neither a second worker nor the JVM holds them.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding, split = load_encoding(rank_file, checked(pattern)), regex.compile(pattern)
        counts, stored, of_ids, of_bytes = [], [], [], []
        for text in batch.column(1):
            ids = encode_text(encoding, split, text.as_py() or "").tobytes()
            decoded = encoding.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())
            counts.append(len(ids) // 4), stored.append(ids)
            of_ids.append(hashlib.sha256(ids).hexdigest()), of_bytes.append(hashlib.sha256(decoded).hexdigest())
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(stored, pa.binary()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
        return pa.record_batch(columns, names=[id_col, "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, F.col(text_col).alias("text")), kernel, f"{id_col} {kind}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def digests(documents: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Counts and digests of every document's ids and decoded bytes."""
    return round_trip(documents, rank_file, pattern).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
