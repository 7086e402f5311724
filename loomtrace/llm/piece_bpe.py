"""SentencePiece encoding and decoding by a table of distinct chunks.

Method. In a model whose pieces hold the white-space marker only in front, no merge reaches from a
character into the marker behind it. A normalised text then falls into marked words (a run of markers and
the characters after it), each with the same ids wherever it stands. A slice of texts is cut into marked
words, each distinct one is segmented once by the library, and the ids are joined back by position; words
stay in the worker's table for the next slices, until it is full and starts anew. Whether a model is of
this kind is read from its pieces; texts of any other model go to the library whole. Decoding is the
library's, over all ids of a text.

Defined results: a null text counts as empty; an empty text has the begin and end ids only; a marker in the
text itself is a space, as the library has it; markers at the end are a word of their own; very long texts
and words cost time and memory in proportion to their length; repeated rows give repeated results; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import map_slices

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Entries of a worker's table, and the longest word that stays in it.
TABLE, LONGEST = 400_000, 48


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """One model in a worker: ``ids(texts)`` as little-endian bytes, ``texts(ids)`` back."""

    def __init__(self, path: str | None = None, table: int = TABLE):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path or model_path())
        self.begin, self.end = (x.to_bytes(4, "little") if x >= 0 else b"" for x in (self.library.bos_id(), self.library.eos_id()))
        self.apart = self._apart()
        self.size, self.table = table, {}

    def _apart(self) -> bool:
        """Whether marked words are segmented alone: a marker before each word, and none behind another character of a piece."""
        sp = self.library
        crossing = re.compile(f"[^{MARK}]{MARK}")
        ordinary = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        return sp.normalize("a b") == f"{MARK}a{MARK}b" and sp.piece_to_id(MARK) != sp.unk_id() and not any(map(crossing.search, ordinary))

    def _segment(self, words: list[str]) -> list[bytes]:
        """Ids of marked words; the library puts the first marker back, but for a lone one."""
        found = self.library.encode([w[1:] for w in words], num_threads=1)
        lone = [self.library.piece_to_id(MARK)]
        return [np.asarray(lone if w == MARK else x, "<u4").tobytes() for w, x in zip(words, found, strict=True)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, begin and end included, as little-endian unsigned 32-bit integers."""
        if not self.apart:
            return [self.begin + np.asarray(x, "<u4").tobytes() + self.end for x in self.library.encode(texts, num_threads=1)]
        cut = [_WORDS.findall(self.library.normalize(t)) for t in texts]
        if len(self.table) > self.size:
            self.table.clear()
        new = list(set().union(*cut) - self.table.keys())
        self.table.update(zip(new, self._segment(new), strict=True))
        look = self.table.__getitem__
        out = [self.begin + b"".join(map(look, words)) + self.end for words in cut]
        for w in new:
            if len(w) > LONGEST:
                del self.table[w]
        return out

    def texts(self, ids: list[bytes]) -> list[str]:
        return [self.library.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]


@lru_cache(maxsize=2)
def pieces(path: str | None = None) -> Pieces:
    """One model a worker process, so that its table serves all tasks of the process."""
    return Pieces(path)


def _projected(df: DataFrame, id_col: str, column: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(column).alias(name))


def _texts(piece: pa.RecordBatch) -> list[str]:
    return [t or "" for t in piece.column("text").to_pylist()]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids, with the begin and end ids."""

    def task():
        def each(piece: pa.RecordBatch) -> pa.RecordBatch:
            found = pieces(path).ids(_texts(piece))
            return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([np.frombuffer(x, "<u4") for x in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])

        return each

    return map_slices(_projected(df, id_col, text_col, "text"), task, f"doc_id {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id and the text of the ids; null ids give an empty text."""

    def task():
        def each(piece: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.asarray(x if x is not None else [], "<u4").tobytes() for x in piece.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(pieces(path).texts(ids), pa.string())], names=["doc_id", "text"])

        return each

    return map_slices(_projected(df, id_col, ids_col, "ids"), task, f"doc_id {df.schema[id_col].dataType.simpleString()}, text string", "ids")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and keep the digests of both."""

    def task():
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def each(piece: pa.RecordBatch) -> pa.RecordBatch:
            model = pieces(path)
            found = model.ids(_texts(piece))
            columns = [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(map(sha, found), pa.string()), pa.array([sha(t.encode()) for t in model.texts(found)], pa.string())]
            return pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return map_slices(_projected(df, id_col, text_col, "text"), task, f"doc_id {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
