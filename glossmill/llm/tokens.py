"""Problem 5: encoding a corpus with a public byte-level BPE vocabulary.

The vocabulary (a file of base64 tokens and ranks) is serialised on the driver
as a sentencepiece BPE model: one piece for each token, its bytes mapped to
printable characters, scored by its negative rank, with identity normalisation.
The model is about 1 MB whatever the corpus, is broadcast after a check of that
size, and encodes pre-tokens inside the tasks. No shuffle: one pass over the text.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary lies unless the caller names another folder.
TOKENIZERS = os.environ.get("GLOSSMILL_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: A vocabulary above this size isn't broadcast but refused.
MODEL_BYTES_MAX = 64 << 20
#: Pre-tokens remembered by a Python worker before it starts anew.
REMEMBERED = 200_000
#: Chunks of text that are looked up together.
CHUNKS_AT_ONCE = 100_000

# The pattern of pre-tokens, the vocabulary's byte alphabet, white space as Unicode has it.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPACE = "\t-\r \x85\xa0  -     　"


def byte_alphabet() -> list[str]:
    """A printable character for each byte; bytes that aren't printable follow from U+0100 on."""
    rest = (b for b in range(256) if b not in set(PRINTABLE))
    table = {b: chr(b) for b in PRINTABLE} | {b: chr(0x100 + n) for n, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError(f"{path}: ranks aren't 0 to {len(tokens) - 1}")
    return [tokens[n] for n in range(len(tokens))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model whose piece ids are the ranks; the piece for unknowns comes last."""
    alphabet = byte_alphabet()
    pieces = []
    for rank, token in enumerate(tokens):
        piece = "".join(alphabet[b] for b in token).encode()
        score = _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
        pieces.append(_field(1, _field(1, piece) + score + _field(3, 1)))
    pieces.append(_field(1, _field(1, b"<unk>") + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes texts in a task; chunks seen before are looked up."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PRETOKEN).findall
        # A chunk is a run without white space, with the one blank before it; no pre-token crosses a chunk's end.
        self.chunks = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]").findall
        self.alphabet = byte_alphabet()
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers

    def _learn(self, chunks: list[str]) -> None:
        map_byte = self.alphabet.__getitem__
        words, ends = [], []
        for chunk in chunks:
            words += ["".join(map(map_byte, w.encode("utf-8", "surrogatepass"))) for w in self.split(chunk)]
            ends.append(len(words))
        ids = self.pieces.encode(words, out_type=int, num_threads=1) if words else []
        start = 0
        for chunk, end in zip(chunks, ends, strict=True):
            self.known[chunk] = array("i", chain.from_iterable(ids[start:end])).tobytes()
            start = end

    def split_all(self, texts: list[str | None]) -> Iterator[list[list[str]]]:
        """The chunks of each text, some texts at a time, once the ids of all these chunks are known."""
        group: list[list[str]] = []
        size = 0
        for n, text in enumerate(texts, 1):
            group.append(self.chunks(text) if text else [])
            size += len(group[-1])
            if size > CHUNKS_AT_ONCE or n == len(texts):
                new = set().union(*group).difference(self.known)
                if new and len(self.known) + len(new) > REMEMBERED:
                    self.known.clear()
                    new = set().union(*group)
                self._learn(list(new))
                yield group
                group, size = [], 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end in it (a 0 first)."""
        look = self.known.__getitem__
        parts = [b"".join(map(look, chunks)) for group in self.split_all(texts) for chunks in group]
        ends = np.concatenate([[0], np.cumsum([len(part) // 4 for part in parts])]).astype(np.int32)
        return np.frombuffer(b"".join(parts), np.int32), ends

    def ids(self, text: str | None) -> list[int]:
        return self.encode([text])[0].tolist()

    def counts(self, texts: list[str | None]) -> list[int]:
        look = self.known.__getitem__
        return [sum(map(len, map(look, chunks))) // 4 for group in self.split_all(texts) for chunks in group]


def encoder_of(model: Broadcast) -> Encoder:
    """The worker's encoder, kept from task to task."""
    kept = sys.modules.setdefault("_glossmill_encoder", type(sys)("_glossmill_encoder"))
    if getattr(kept, "model", None) != hash(model.value):
        kept.encoder, kept.model = Encoder(model.value), hash(model.value)
    return kept.encoder


def broadcast_model(spark: SparkSession, folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> Broadcast:
    model = sentencepiece_model(read_ranks(os.path.join(folder, name)))
    if len(model) > MODEL_BYTES_MAX:
        raise ValueError(f"{name}: a model of {len(model)} bytes isn't broadcast")
    return spark.sparkContext.broadcast(model)


def encode(df: DataFrame, *, key: str = "doc_id", text: str = "text", ids: str = "ids", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): one row for each row of df, the token ids of its text without special tokens.

    Null and empty texts have no ids (an empty list, never null); the string of a
    special token is ordinary text; rows, null keys and repeated keys stay as they
    are; other columns aren't read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    model = broadcast_model(spark, folder)
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            flat, ends = encoder.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "ids"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), F.col("ids").alias(ids))


def count_tokens(df: DataFrame, *, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens): as encode(), but only the number of ids; 0 for null and empty texts."""
    spark = df.sparkSession
    model = broadcast_model(spark, folder)
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            sizes = encoder.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["key", "n_tokens"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens long").select(F.col("key").alias(key), "n_tokens")


def decode(df: DataFrame, *, key: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text): the text that each list of ids stands for; a null or empty list gives an empty text.

    The inverse mapping: ids to pieces, characters to bytes, bytes to text. Bytes
    that aren't UTF-8 become U+FFFD; an id outside the vocabulary is an error.
    """
    model = broadcast_model(df.sparkSession, folder)
    source = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        inverse = {c: b for b, c in enumerate(encoder.alphabet)}
        piece = encoder.pieces.id_to_piece
        for batch in batches:
            texts = [
                bytes(inverse[c] for i in value or () for c in piece(i)).decode("utf-8", "replace")
                for value in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, text string").select(F.col("key").alias(key), "text")
