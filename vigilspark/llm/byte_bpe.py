"""Byte-level BPE encoding and decoding with the tiktoken library.

The encoder is built in each task from a local rank file and a split pattern.
Long texts are cut before encoding where no match of the pattern can cross: in
front of a single space between two characters that are not white space (a
match holds a space only as its first character, or is white space alone).
Decoding joins the tokens' raw bytes, so a token may end inside a character.

Defined cases: a null text is empty and has no tokens; a text without a safe
boundary is encoded in one piece; repeated rows give a row each; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

CHUNK = 1 << 16  # characters after which the next safe boundary ends a piece
SAFE = re.compile(r"(?<=\S) (?=\S)")


def load_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, chunk: int = CHUNK):
    """The text in pieces that encode separately to the same ids."""
    at = 0
    while len(text) - at > chunk and (m := SAFE.search(text, at + max(1, chunk))):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def encode(encoding, text: str, chunk: int = CHUNK) -> np.ndarray:
    parts = [encoding.encode_ordinary(p) for p in pieces(text, chunk)]
    return np.array(parts[0] if len(parts) == 1 else [i for p in parts for i in p], dtype="<u4")


def decode(encoding, ids) -> bytes:
    return encoding.decode_bytes(ids.tolist())


def _texts(part):
    return [(x or b"").decode("utf-8", "replace") for x in part.column("text").cast(pa.binary()).to_pylist()]


def _encode(path, pattern):
    def run(batches):
        encoding = load_encoding(path, pattern)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                ids = [encode(encoding, t) for t in _texts(part)]
                yield pa.RecordBatch.from_arrays([*part.drop_columns(["text"]).columns, pa.array([x.astype(np.int64).tolist() for x in ids], pa.list_(pa.int32()))],
                                                 [*part.drop_columns(["text"]).schema.names, "ids"])
    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, ids array<int>) per row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_encode(path, pattern), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _decode(path, pattern):
    def run(batches):
        encoding = load_encoding(path, pattern)
        for batch in batches:
            raw = [decode(encoding, np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])
    return run


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids); null ids give no bytes."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path, pattern), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def _round_trip(path, pattern):
    def run(batches):
        encoding = load_encoding(path, pattern)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                n, coded, back = [], [], []
                for t in _texts(part):
                    ids = encode(encoding, t)
                    n.append(len(ids))
                    coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    back.append(hashlib.sha256(decode(encoding, ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def round_trip(docs: DataFrame, path: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids_sha256 (ids as
    little-endian unsigned 32-bit integers), decoded_sha256."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_round_trip(path, pattern), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
