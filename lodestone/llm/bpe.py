"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding by the byte table.

Texts are split by public_tokenizers.PATTERN, and the library encodes each pre-token that isn't remembered yet. Pre-tokens are encoded
each for itself by definition, so the ids are those of the whole text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import arrow_pass, list_array, pick, spread, table, with_row
from lodestone.llm.tokens import splitter

VOCABULARY = "byte_bpe_50k.json"


@cache
def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary: printable ones stand for themselves, others for the next from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def vocabulary_path(name: str) -> str:
    """A path is taken as it is; a bare name is a file of the public vocabularies, found on each machine."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def codec(name: str) -> tuple:
    """The tokenizer of a vocabulary file, once a process, and the bytes of each id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    tokenizer.encode_special_tokens = True
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # what it gets is split already
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    pieces: list[bytes] = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return tokenizer, pieces


class Ids(dict):
    """The ids of pre-tokens as little-endian unsigned 32-bit integers, remembered up to `most` characters."""

    def __init__(self, name: str, most: int = 1 << 21):
        self.tokenizer, self.most, self.held = codec(name)[0], most, 0

    def of(self, pieces: list[str]) -> np.ndarray:
        if self.held > self.most:
            self.clear()
            self.held = 0
        new = [p for p in dict.fromkeys(pieces) if p not in self]
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self[p] = np.array(e.ids, "<u4").tobytes()
            self.held += len(p)
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), "<u4")


@cache
def remembered(name: str) -> Ids:
    return Ids(name)


def encoded(texts: pa.Array, name: str = VOCABULARY) -> Iterator[tuple[str, np.ndarray]]:
    """Each text with its ids, null as empty."""
    known = remembered(name)
    for text in texts:
        text = text.as_py() or ""
        yield text, known.of(splitter().findall(text))


def decoded_bytes(ids: np.ndarray | list[int], name: str = VOCABULARY) -> bytes:
    pieces = codec(name)[1]
    return b"".join([pieces[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])


@cache
def lengths(name: str) -> np.ndarray:
    """The bytes of each id."""
    return np.array([len(p) for p in codec(name)[1]], np.int64)


def character_offsets(text: str, ids: np.ndarray, name: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters, end exclusive. A token with a part of a character covers the character, as do its neighbours with the other parts."""
    data = np.frombuffer(text.encode(), np.uint8)
    end = np.cumsum(lengths(name)[ids])
    start = end - lengths(name)[ids]
    if len(data) == len(text):
        return start, end
    char = np.concatenate([np.cumsum((data & 0xC0) != 0x80), [len(text) + 1]])
    return char[start] - 1, char[end - 1]


def with_ids(rows: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(row, text) -> (row, ids, starts, ends): the ids of each text and their offsets in characters."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [(ids, *character_offsets(text, ids, name)) for text, ids in encoded(batch.column(1), name)]
        counts = np.array([len(ids) for ids, _, _ in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), *[list_array(counts, pa.array(np.concatenate(x).astype(np.int32))) for x in zip(*found, strict=True)]], ["row", "ids", "starts", "ends"])

    many = T.ArrayType(T.IntegerType())
    return arrow_pass(rows, run, with_row(rows, ("ids", many), ("starts", many), ("ends", many)))


def with_text(rows: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(row, ids) -> (row, decoded): bytes that make no character, as when ids end within one, become U+FFFD."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [decoded_bytes(x or [], name).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "decoded"])

    return arrow_pass(rows, run, with_row(rows, ("decoded", T.StringType())))


def digests(docs: DataFrame, name: str = VOCABULARY, keep: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256), a row for each row of docs; keep: with the ids.

    The last is over the start and end of each token in characters, little-endian unsigned 32-bit integers, pair by pair. Null and empty texts have no tokens. Strings of special tokens in a text are ordinary text. Nothing is grouped, so
    repeated rows and null ids are encoded each for itself. Other columns are ignored. No rows: no rows.
    """
    own = pick(docs, "doc_id", "text")
    said = lambda x: hashlib.sha256(x).hexdigest()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [(ids, np.stack(character_offsets(text, ids, name), 1).astype("<u4")) for text, ids in encoded(batch.column(1), name)]
        counts = np.array([len(ids) for ids, _ in found])
        out = [pa.array(counts, pa.int64()), *[pa.array(x, pa.string()) for x in ([said(i.tobytes()) for i, _ in found], [said(decoded_bytes(i, name)) for i, _ in found], [said(o.tobytes()) for _, o in found])]]
        if keep:
            out.append(list_array(counts, pa.array(np.concatenate([i for i, _ in found]).astype(np.int32))))
        yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["row", *names])

    names = ["n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", *(["ids"] if keep else [])]
    kinds = [T.LongType(), *[T.StringType()] * 3, T.ArrayType(T.IntegerType())]
    rows = own.select(F.struct("doc_id").alias("row"), F.col("text").cast("string").alias("text"))
    return arrow_pass(rows, run, with_row(rows, *zip(names, kinds, strict=False))).select("row.doc_id", *names)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spread(table(spark, sf_dir, "documents")))
