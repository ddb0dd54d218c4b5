"""Byte-level BPE by a sentencepiece model that is written directly from a rank file.

Each token's bytes are mapped to visible characters, one for a byte, and become a piece
scored by its negative rank, so sentencepiece merges the pair of the lowest rank first,
the leftmost among equals. Normalisation is the identity. Texts are cut into pre-tokens
by a pattern and each is encoded separately; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

#: Pre-tokens whose ids a Python worker remembers; beyond, it forgets all and begins anew.
CACHE = 400_000


def byte_characters() -> list[str]:
    """A visible character for each byte: itself where it is visible, else from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {b: chr(b) for b in visible}
    for b in range(256):
        of.setdefault(b, chr(256 + len(of) - len(visible)))
    return [of[b] for b in range(256)]


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[tuple[bytes, int]]) -> bytes:
    """A sentencepiece ModelProto of type BPE: piece 0 is unknown, piece k + 1 is tokens[k]."""
    chars = byte_characters()
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))
    pieces = [piece("<unk>", 0.0, 2), *(piece("".join(chars[b] for b in t), -float(rank), 1) for t, rank in tokens)]
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + _number(41, 2**64 - 1) + _number(42, 2**64 - 1) + _number(43, 2**64 - 1)
    normalizer = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as lines:
        return sorted(((base64.b64decode(a), int(b)) for a, b in map(bytes.split, filter(bytes.strip, lines))), key=lambda x: x[1])


class Codec:
    """Encoder and decoder of one rank file; made once in each Python worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.find = regex.compile(pattern).findall
        self.whole = dict(tokens)
        self.bytes_of = {rank: t for t, rank in tokens}
        self.rank = [-1, *(rank for _, rank in tokens)]
        self.chars = str.maketrans({bytes([b]).decode("latin-1"): c for b, c in enumerate(byte_characters())})
        self.known: dict[str, list[int]] = {}

    def _learn(self, pre_tokens: list[str]) -> None:
        split = []
        for p in pre_tokens:
            # a pre-token that is itself a token is encoded as that token
            if (rank := self.whole.get(p.encode())) is not None:
                self.known[p] = [rank]
            else:
                split.append(p)
        mapped = [p.encode().decode("latin-1").translate(self.chars) for p in split]
        for p, ids in zip(split, self.model.encode(mapped, num_threads=1) if mapped else [], strict=True):
            self.known[p] = [self.rank[i] for i in ids]

    def encode(self, text: str) -> list[int]:
        found = self.find(text)
        different = set(found)
        if new := [p for p in different if p not in self.known]:
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = list(different)
            self._learn(new)
        known, out = self.known, []
        for p in found:
            out += known[p]
        return out

    def decode(self, ids: list[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row; null text counts as empty, which gives no ids."""

    def run(texts: list) -> list[pa.Array]:
        own = codec(path, pattern)
        return [pa.array([own.encode(t) for t in texts], pa.list_(pa.int32()))]

    return per_text(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), run, "id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, data binary) for each row of (id, ids); null ids count as none, unknown ids raise."""

    def run(rows: list) -> list[pa.Array]:
        own = codec(path, pattern)
        return [pa.array([own.decode(x or []) for x in rows], pa.binary())]

    return per_text(encoded.select("id", "ids"), run, "id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded in one pass."""

    def run(texts: list) -> list[pa.Array]:
        own = codec(path, pattern)
        n, a, b = [], [], []
        for t in texts:
            ids = own.encode(t)
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return per_text(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
