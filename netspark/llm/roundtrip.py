"""BPE encoding and decoding of whole texts (operator 4); the method is in ``tokens``.

Null text is empty: no ids, empty text.  Special-token strings in a text become their ids, as in the library's
default.  Rows that repeat a doc_id (or have none) are rows of their own; an empty table gives an empty result; columns
other than ``doc_id`` and ``text`` are not read.  Texts are encoded where they are read; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from netspark.llm.common import slices, table, whole_texts
from netspark.llm.tokens import shared_encoder

_CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[bytes], list[bytes]]]:
    enc = shared_encoder(path)
    for b in slices(batches, 64):
        ids = enc.encode_many(b.column(1).to_pylist())
        yield b.column(0), ids, list(map(enc.decode, ids))
    enc.rest()


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, ids (little-endian unsigned 32-bit), decoded (UTF-8 of what the ids stand for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, ids, decoded in _coded(batches, path):
            yield table(_CODED, doc, ids, decoded)

    return whole_texts(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, made where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, ids, decoded in _coded(batches, path):
            sha = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (ids, decoded)]
            yield table(_DIGEST, doc, [len(x) // 4 for x in ids], *sha)

    return whole_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
