"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

#: A text longer than this is cut, always where the pattern must end a match.
CHUNK = 1 << 16
#: A match holds white space only at its start, or nothing but white space, so
#: it ends wherever white space follows something else, whatever stands around.
#: U+001C to U+001F are white space for Python, but not for the pattern.
SAFE = re.compile(r"(?<=[\S\x1c-\x1f])(?=[^\S\x1c-\x1f])")


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def make_encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Pieces of `text` of about `size` characters whose encodings concatenate to
    that of the whole. Where no safe boundary comes, the piece grows."""
    start = 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(encoder, text: str, size: int = CHUNK) -> list[int]:
    if len(text) <= size:
        return encoder.encode_ordinary(text)
    return [i for piece in chunks(text, size) for i in encoder.encode_ordinary(piece)]


def _encoded(shared, pattern: str, digest: bool):
    held: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(make_encoder(shared.value, pattern))
        enc = held[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                every = [encode(enc, t or "") for t in part.column(1).to_pylist()]
                cols = [part.column(0), pa.array(map(len, every), pa.int64())]
                if digest:
                    cols += [
                        pa.array([hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() for ids in every], pa.string()),
                        pa.array([hashlib.sha256(enc.decode_bytes(ids)).hexdigest() for ids in every], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(every, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])

    return run


def _prepared(docs: DataFrame, id_col: str, text_col: str, path: str | None, pattern: str | None):
    import public_tokenizers as public

    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path or public.path("byte_bpe_50k.tiktoken")))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shared, pattern or public.PATTERN


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids: the token ids of each whole text.

    Special tokens are ordinary text. A null text counts as empty and has no
    ids. Every row gives one row, repeated ids included; other columns are
    ignored. The rank file (under 1 MB) is read on the driver and broadcast, so
    executors need no copy of it.
    """
    rows, shared, pattern = _prepared(docs, id_col, text_col, path, pattern)
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lean(_encoded(shared, pattern, False)), f"doc_id {kind}, n_tokens long, ids array<int>")


def _decoded(shared, pattern: str):
    held: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(make_encoder(shared.value, pattern))
        for batch in batches:
            data = [None if ids is None else held[0].decode_bytes(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return run


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, data: the raw bytes of each id list; null ids give null. Bytes are
    not checked to be UTF-8, as ids may end within a character."""
    rows, shared, pattern = _prepared(encoded, id_col, ids_col, path, pattern)
    kind = encoded.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_decoded(shared, pattern), f"doc_id {kind}, data binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode, decode again, and return digests of both: doc_id, n_tokens,
    ids_sha256, decoded_sha256. Edge cases are those of `encode_documents`."""
    rows, shared, pattern = _prepared(docs, id_col, text_col, path, pattern)
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lean(_encoded(shared, pattern, True)), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
