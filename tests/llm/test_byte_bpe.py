import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

from loomtrace.llm import byte_bpe

HARD = ["", None, "a", " ", "\n", "  \n x", "it's we'll 'stuff '", "naïve café ½ 12 ²3", "x" * 5000, "日本語 テキスト 🙂🙂", "a\x1c b\x85c\xa0 d", "<|endoftext|> <|endoftext|>", "tab\t\tend  ", "word " * 3000, "ſ İ ς Σ́"]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_rank_library(spark):
    rows = [(i, t, "x") for i, t in enumerate(HARD * 2)]
    got = {r.doc_id: r for r in byte_bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()}
    enc = reference()
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_round_trip_and_offsets(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    found = byte_bpe.encode(df)
    back = {r.doc_id: r.text for r in byte_bpe.decode(found).collect()}
    enc = reference()
    for r in found.collect():
        t = HARD[r.doc_id] or ""
        assert back[r.doc_id] == t
        if r.ids:
            assert r.starts[0] == 0 and r.ends[-1] == len(t)
            assert all(a <= b for a, b in zip(r.starts, r.ends))
            data, at = t.encode(), 0
            for i, s, e in zip(r.ids, r.starts, r.ends):
                at += len(enc.decode_single_token_bytes(i))
                assert len(data[:at].decode("utf-8", "ignore")) in (e, e - 1)


def test_empty_table(spark):
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
