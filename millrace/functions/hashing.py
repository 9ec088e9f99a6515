"""Content hashes, chunk identities and corpus fingerprints as column expressions and plain Python.

A versioned hash covers a domain, a scope and fields, each after its byte length as eight big-endian
bytes, so no two field lists share a preimage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOMAIN = b"millrace:sha256:v1\0"
PREFIX = "sha256:v1:"


def framed(value: str) -> bytes:
    raw = value.encode()
    return len(raw).to_bytes(8, "big") + raw


def versioned_hash(scope: str, fields: Iterable[str]) -> str:
    """The hash in plain Python, for parsers."""
    return PREFIX + hashlib.sha256(DOMAIN + framed(scope) + b"".join(map(framed, fields))).hexdigest()


def framed_column(value: Column) -> Column:
    raw = value.cast("string").cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0")), raw)


def versioned_hash_column(scope: str, *fields: Column) -> Column:
    """The same hash as a column."""
    head = F.unhex(F.lit((DOMAIN + framed(scope)).hex()))
    return F.concat(F.lit(PREFIX), F.sha2(F.concat(head, *[framed_column(x) for x in fields]), 256))


def chunk_id(parent: Column, ordinal: Column, kind: Column, text: Column) -> Column:
    """chunk-v1:parent:number:digest; ordinals count from 0, numbers from 1."""
    digest = F.substring(F.sha2(F.concat_ws("\0", parent, kind, text).cast("binary"), 256), 1, 16)
    return F.concat_ws(":", F.lit("chunk-v1"), parent, (ordinal + 1).cast("string"), digest)


def chunk_hash(chunk: Column, lexical: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.sha2(F.concat_ws("\0", chunk, lexical).cast("binary"), 256))


def _little(value: str) -> bytes:
    raw = value.encode()
    return len(raw).to_bytes(8, "little") + raw


def fingerprint(pairs: Iterable[tuple[str, str]]) -> str:
    """SHA-256 of (id, hash) pairs in the given order, upper-case hex."""
    digest = hashlib.sha256()
    for a, b in pairs:
        digest.update(_little(a) + _little(b))
    return digest.hexdigest().upper()


def corpus_fingerprint(records: DataFrame, id_column: str = "id", hash_column: str = "content_hash") -> str:
    """The fingerprint of a corpus in id order.

    SHA-256 is a chain, so rows stream to it one sorted partition at a time; the driver holds one
    partition's packed frames and the digest's state, never the corpus.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = b"".join(_little(a) + _little(b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["packed"])

    rows = records.select(F.col(id_column).cast("string").alias("id"), F.col(hash_column).cast("string").alias("hash")).orderBy("id", "hash")
    digest = hashlib.sha256()
    for row in rows.mapInArrow(pack, "packed binary").toLocalIterator():
        digest.update(row["packed"])
    return digest.hexdigest().upper()
