"""Byte-level BPE encoding and decoding over Arrow batches with the ``tokenizers`` library.

Method. A text falls into pre-tokens (``public_tokenizers.PATTERN``); each is mapped byte by byte to
stand-in characters and encoded alone by the library's model, with bounded tables for what was seen
before (``pretokens``). Texts with characters outside Latin-1, or with white space beside a space, go
to the library whole. Decoding reverses the vocabulary's byte-to-character table; bytes are joined
before UTF-8 decoding, so characters split over several
tokens come back whole.

Defined results: a null text counts as empty; an empty text has no ids and the digests of no bytes;
special tokens' strings in a text are ordinary text; very long texts cost time and memory in proportion to
their length, ties of merges go by rank; repeated rows give repeated results; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import map_slices
from loomtrace.llm.pretokens import PreTokens, byte_characters

#: Characters for which the Latin-1 form of the pattern below is exact.
LATIN = re.compile("[\t-\r\x20-\x7e\xa0-\xff]*")
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \xa0"
#: public_tokenizers.PATTERN with its classes written out for Latin-1.
PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: The pattern that PRE and ``chunks`` stand for; another one needs others.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BESIDE = re.compile(f" [{_S}]|[{_S}] ")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(text: str) -> list[str] | None:
    """Cut before every space; exact if no space has white space beside it."""
    return text.split(" ") if LATIN.fullmatch(text) and not _BESIDE.search(text) else None


def ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a file of ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBPE(PreTokens):
    """One tokenizer file in a worker: ``ids(texts)`` as little-endian bytes, ``raw(ids)`` back to bytes.

    Without a path the public vocabulary is taken, after its ids and pattern were held against the file of ranks.
    """

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        of_ranks = None if path else ranks(vocabulary_path("byte_bpe_50k.tiktoken"))
        path = path or vocabulary_path()
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        super().__init__(library, PRE, chunks, prefix=" ")
        back = {c: b for b, c in byte_characters().items()}
        vocab = library.get_vocab()
        self.pieces: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        if of_ranks is not None:
            import public_tokenizers

            if public_tokenizers.PATTERN != PATTERN or any(self.pieces[i] != token for token, i in of_ranks.items()):
                raise ValueError("the tokenizer file, the file of ranks and the pattern written out here differ")

    def raw(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character that each id touches; ids inside one character share it."""
        lengths = np.array([len(self.pieces[i]) for i in np.frombuffer(ids, "<u4").tolist()], np.int64)
        data = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(lengths)
        return char[ends - lengths], char[ends - 1] + 1


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> ByteBPE:
    """One codec a worker process, so that its table serves all tasks of the process."""
    return ByteBPE(path)


def _texts(piece: pa.RecordBatch) -> list[str]:
    return [t or "" for t in piece.column("text").to_pylist()]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids, and the character offsets (starts, ends) of each id in the text."""

    def task():
        bpe = codec(path)

        def each(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = _texts(piece)
            found = bpe.ids(texts)
            spans = [bpe.offsets(t, x) for t, x in zip(texts, found, strict=True)]
            kind = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([np.frombuffer(x, "<u4") for x in found], kind), pa.array([s for s, _ in spans], kind), pa.array([e for _, e in spans], kind)], names=["doc_id", "ids", "starts", "ends"])

        return each

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id and the decoded text; bytes that are no UTF-8 (a cut inside a character) become U+FFFD."""

    def task():
        bpe = codec(path)

        def each(piece: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.asarray(x if x is not None else [], "<u4").tobytes() for x in piece.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([bpe.raw(x).decode("utf-8", "replace") for x in ids], pa.string())], names=["doc_id", "text"])

        return each

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), task, f"doc_id {kind}, text string", "ids")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and keep the digests of both."""

    def task():
        bpe = codec(path)

        def each(piece: pa.RecordBatch) -> pa.RecordBatch:
            found = bpe.ids(_texts(piece))
            return pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(bpe.raw(x)).hexdigest() for x in found], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return each

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
