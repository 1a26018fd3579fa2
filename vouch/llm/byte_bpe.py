"""Byte-level BPE by tiktoken: a local rank file, pre-splitting of long texts at safe boundaries, raw-byte decoding.

A text longer than `part_chars` is cut before a space that stands between two ASCII letters. There the split pattern
always ends a match (no match holds a space after a letter, and a space alone only starts one), so the ids of the parts,
concatenated, are the ids of the text; a text without such a place stays whole. Parts bound what one call of the
library holds. The ranks are sent to the executors, where each Python worker builds one encoding.

Null and empty texts have no ids; their digests are those of no bytes. Rows that repeat stay, each with its own result.
An empty table gives an empty result; no columns but doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vouch.llm.common import arrow_schema, slices, whole_texts

PART_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_DIGEST_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_IDS_DDL = "doc_id long, ids binary"


@cache
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def parts(text: str, part_chars: int = PART_CHARS) -> Iterator[str]:
    at = 0
    while len(text) - at > part_chars:
        cut = _SAFE.search(text, at + part_chars)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, ranks: bytes, pattern: str, part_chars: int = PART_CHARS) -> np.ndarray:
    """The ids of the whole text as little-endian unsigned 32-bit integers."""
    enc = _encoding(ranks, pattern)
    return np.concatenate([np.array(enc.encode_ordinary(part), "<u4") for part in parts(text, part_chars)])


def decode(ids: np.ndarray, ranks: bytes, pattern: str) -> bytes:
    """The raw bytes of the ids; they need not be whole characters."""
    return _encoding(ranks, pattern).decode_bytes(ids.tolist())


def _ranks(spark, rank_file: str):
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't grow with the data


def encoded(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and its ids (binary, little-endian unsigned 32-bit)."""
    ranks, schema = _ranks(docs.sparkSession, rank_file), arrow_schema(_IDS_DDL)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ids = [encode(t, ranks.value, pattern).tobytes() for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], schema=schema)

    return whole_texts(docs).mapInArrow(run, _IDS_DDL)


def decoded(ids: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for."""
    ranks, ddl = _ranks(ids.sparkSession, rank_file), "doc_id long, content binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "ids"):
                content = [decode(np.frombuffer(x, "<u4"), ranks.value, pattern) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(content, pa.binary())], schema=schema)

    return ids.select("doc_id", "ids").mapInArrow(run, ddl)


def round_trip_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to."""
    ranks, schema = _ranks(docs.sparkSession, rank_file), arrow_schema(_DIGEST_DDL)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column(1).to_pylist():
                    ids = encode(text, ranks.value, pattern)
                    rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(ids, ranks.value, pattern)).hexdigest()))
                n, ids_sha, decoded_sha = zip(*rows, strict=True)
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], schema=schema)

    return whole_texts(docs).mapInArrow(run, _DIGEST_DDL)
