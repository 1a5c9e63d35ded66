"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import lean, table, worker_state

#: Byte b stands as the character FIRST + b in the model's pieces: letters that no normalisation touches.
FIRST = 0x100
#: Pre-tokens whose ids a worker remembers; beyond that many it starts anew.
REMEMBERED = 300_000
#: Text of about so many bytes makes one batch of results.
SLICE_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def as_letters(token: bytes) -> str:
    return "".join([chr(FIRST + b) for b in token])


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A BPE ModelProto: piece 0 is the unknown one, piece rank + 1 the token of that rank, scored by the negative rank.

    So sentencepiece merges what merging by lowest rank merges. The ranks must be 0, 1, 2 and so on.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("the ranks have gaps")

    def piece(text: str, score: float, kind: int) -> bytes:
        return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    normal, unknown, bpe = 1, 2, 2
    pieces = [piece("<unk>", 0.0, unknown), *(piece(as_letters(t), -float(r), normal) for r, t in enumerate(tokens))]
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, 0) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser)


class Ids(dict):
    """The ids of pre-tokens, as bytes of int32; what isn't known yet is encoded."""

    def __init__(self, model: bytes):
        super().__init__()
        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode

    def __missing__(self, token: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.encode(as_letters(token.encode())), np.int32) - 1
        if len(ids) and ids.min() < 0:
            raise ValueError("the vocabulary lacks a byte")
        self[token] = found = ids.tobytes()
        return found


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        return self.bytes[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()


def _kept(key: tuple, make):
    """What make() gave in this worker before; a reused worker loads no model twice."""
    kept = worker_state()
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """Adds ids (array<int>) and decoded (binary, from the ids alone) to docs, for the whole text; a null text is empty.

    Each match of the pattern is encoded by itself, without special tokens. All other columns pass through; one named
    like a new column is replaced. The rank file is read on the driver only.
    """
    ranks = read_ranks(ranks_path)
    model = serialise_model(ranks)
    name = (ranks_path, len(model), pattern)
    kept = docs.drop(ids, decoded)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.BinaryType())])
    # Python's and Rust's \s differ in four control characters.
    white = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known, decode = _kept(name, lambda: (regex.compile(white).findall, Ids(model), Decoder(ranks)))
        ids_of = known.__getitem__
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64) + 64)
            cuts = [0, *(np.flatnonzero(np.diff(sizes // SLICE_BYTES)) + 1), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                found = [b"".join(map(ids_of, find(t.as_py() or ""))) for t in texts[int(a) : int(b)]]
                arrays = [np.frombuffer(f, np.int32) for f in found]
                offsets = np.cumsum([0, *(len(x) for x in arrays)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))
                back = pa.array([decode(x) for x in arrays], pa.binary())
                part = batch.slice(int(a), int(b - a))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, back], [*part.schema.names, ids, decoded])

    return kept.mapInArrow(lean(run, keep=True), schema)


def digests(out: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 and ids of encode_decode()'s rows."""
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))).drop("ids")
