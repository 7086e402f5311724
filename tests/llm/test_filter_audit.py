"""The audit's counts and table against a plain loop over documents and orders."""

import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomtrace.llm import filter_audit as audit

HARD = ["", None, " ", "\n\t", "a", "a" * 200, ("a" * 100 + " ") * 3, "É" * 9, "A B", "x y z", "a\x1cb a\x85b", "日本 日本 テ", "#", "ab\0c ab\0c", "word " * 70, " ".join(f"W{k}" for k in range(60))]
#: Sums of equal length that agree modulo 2 ** 64 for any odd base.
MORSE = "".join("ab"[k.bit_count() % 2] for k in range(2048))
TWINS = [MORSE + " " + MORSE.translate(str.maketrans("ab", "ba")), f"{MORSE} {MORSE}"]


def counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall("[#$%&*|]", text)), len(text)


def scanned(texts: list[str | None]) -> list[tuple[int, ...]]:
    found = audit.scan(pa.array(texts, pa.string()), audit.classes())
    return list(zip(*[found[c].tolist() for c in audit.COUNTS]))


def made(n: int) -> list[str]:
    rng = random.Random(n)
    return ["".join(rng.choices("aAbB é日\n\t$|  ", k=rng.choice([0, 3, 40, 700]))) for _ in range(n)]


@pytest.mark.parametrize("window", [1 << 20, 1, 7, 64])
def test_scan_equals_loop(monkeypatch, window):
    monkeypatch.setattr(audit, "WINDOW", window)
    audit._powers.cache_clear()
    texts = HARD + TWINS + made(60)
    assert scanned(texts) == [counts(t) for t in texts]
    audit._powers.cache_clear()


def test_slices_and_single_texts():
    texts = HARD + TWINS
    whole = pa.array(texts, pa.string())
    for a in range(len(texts)):
        found = audit.scan(whole.slice(a, 2), audit.classes())
        assert list(zip(*[found[c].tolist() for c in audit.COUNTS])) == [counts(t) for t in texts[a : a + 2]]
    assert scanned([]) == []


def test_colliding_hashes_are_verified():
    data, offsets = audit.buffers(pa.array(TWINS))
    starts, ends = audit.word_bounds(data != 32, offsets)
    assert len(set(audit.word_hashes(data, starts, ends).tolist())) == 1  # the hash alone is no proof
    assert audit.distinct_words(data, offsets, starts, ends).tolist() == [2, 1]
    assert audit.equal_words(data, starts[:1], starts[1:2], (ends - starts)[:1]).tolist() == [False]
    same = np.frombuffer(b"xabcabcx" + b"y" * 300, np.uint8)
    assert audit.equal_words(same, np.array([1, 8, 1]), np.array([4, 9, 8]), np.array([3, 200, 3])).tolist() == [True, True, False]


def brute(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    """docs: doc_id, text, source."""
    out = set()
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    rows = []
    for d, t, s in docs:
        words, distinct, capitals, symbols, chars = counts(t)
        same = d is not None and any(e is not None and e < d and (u or "") == (t or "") for e, u, _ in docs)
        rows.append((s or "", d, {c for c, x in zip("ABCDE", (words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * chars, symbols > 0, same)) if x}))
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley, found = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[2]]
                left = [r for r in left if c not in r[2]]
                shapley[c] += len(gone)
                fails = sum(c in r[2] for r in own)
                found.append(("".join(order), step, len(left), len(gone), fails - len(gone), sum(r[2] == {c} for r in own), sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)))
        out |= {(part, *x, shapley[x[0][x[1] - 1]]) for x in found}
    return out


def test_audit_equals_loop_and_sql(spark):
    rng = random.Random(5)
    pool = HARD + made(12) + ["the same text " * 5] * 3 + [" ".join(f"w{k}" for k in range(80)) + x for x in ("", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZABC")]
    docs = [(k, rng.choice(pool), rng.choice(["a", "a", "a", "", None, "b"])) for k in range(120)] + [(7, "again", "a"), (7, "again", "a"), (7, "again", "b"), (9, "again", None), (None, "again", "b"), (None, None, "c")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 120, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    extra = spark.createDataFrame([(*d, 1, "x", 3) for d in docs], "doc_id long, text string, source string, part int, digest string, n int")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(docs, labels)
    got = audit.audit(extra, said).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    con = duckdb.connect()
    con.register("documents", extra.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", said.toPandas().astype("Int64"))
    rows = con.execute(audit.oracle_sql()).fetchall()
    assert len(rows) == len(want) and set(rows) == want
    assert audit.audit(extra.limit(0), said).count() == 0
    assert {tuple(r)[:-3] for r in audit.audit(extra, said.limit(0)).collect()} == {r[:-3] for r in want}


def test_all_orders_of_two_filters(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b " * 60, "x")], "doc_id long, text string, source string")
    said = spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in audit.audit(docs, said, filters={"A": "n_words < 50"}).collect()}
    assert got == {("AE", 1): (1, 2, 0, 1, 1, 3), ("AE", 2): (1, 0, 1, 0, 0, 1), ("EA", 1): (2, 1, 0, 0, 1, 1), ("EA", 2): (1, 1, 1, 1, 0, 3)}
