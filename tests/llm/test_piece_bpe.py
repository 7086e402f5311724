"""Ids and decoded texts against the sentencepiece library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor

from loomtrace.llm import piece_bpe

HARD = ["", None, " ", "  ", "▁", "a▁b", "▁ a ▁", " a", "a ", "a  b   ", "\t\n x\n y", "a\0b", "　a b", "ﬁ ½ é é", "<s> </s> <unk> <0x0A>", "日本語 テキスト 🙂 👩‍👩‍👧", "x" * 30_000, " " * 5000, "word " * 4000, "ab▁" * 40, "� \U0010ffff"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def made(n: int) -> list[str]:
    rng = random.Random(n)
    letters = "abcdeéßあ▁🙂  \n\t<>0" + "  "
    return ["".join(rng.choices(letters, k=rng.choice([1, 5, 30, 200]))) for _ in range(n)]


def want(library, text: str | None) -> list[int]:
    return library.encode(text or "", add_bos=True, add_eos=True)


def test_equals_library_and_decodes(spark, library):
    texts = HARD + made(400) + HARD
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string")
    got = {r.doc_id: r for r in piece_bpe.digests(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = want(library, t)
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), t
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest(), t
    assert piece_bpe.digests(df.limit(0)).count() == 0


def test_encode_and_decode_frames(spark, library):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    found = piece_bpe.encode(df)
    for r in found.collect():
        assert r.ids == want(library, HARD[r.doc_id])
    for r in piece_bpe.decode(found.union(spark.sql("SELECT 99L, CAST(NULL AS array<int>)"))).collect():
        assert r.text == ("" if r.doc_id == 99 else library.decode(want(library, HARD[r.doc_id])))


def test_table_is_bounded_and_starts_anew(library):
    own, texts = piece_bpe.Pieces(table=50), made(300)
    assert own.apart
    for a in range(0, 300, 20):
        part = texts[a : a + 20]
        assert own.ids(part) == [np.asarray(want(library, t), "<u4").tobytes() for t in part]
    assert max(map(len, own.table)) <= piece_bpe.LONGEST


def test_a_model_whose_pieces_cross_goes_whole(library):
    own = piece_bpe.Pieces()
    own.apart = False
    assert own.ids(["a b", ""]) == [np.asarray(want(library, t), "<u4").tobytes() for t in ("a b", "")]

    class Crossing:
        def __getattr__(self, name):
            return getattr(library, name)

        def id_to_piece(self, i):
            return "▁a▁b" if i == 300 else library.id_to_piece(i)

    own.library = Crossing()
    assert not own._apart()
