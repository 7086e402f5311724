import numpy as np
import pytest

from loomtrace.llm import masked_lm as lm


def test_words_outside_the_vocabulary_score_by_their_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", lm.WORDS + 20)
    common = [f"w{k}" for k in range(lm.WORDS)] * 12
    texts = [" ".join(common), " ".join(f"often{k}" for k in range(40) for _ in range(9)), " ".join(f"rare{k}" for k in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    vocab, share = lm.vocabulary(df)
    net = lm.Network.initial(share)
    assert len(vocab) == lm.WORDS and len(vocab.held) == 20 and share.sum() == pytest.approx(1)
    asked = ["often3", "often3 often38", "rare7", "xqzzk", "w5", "rare7 rare7", None, "rare7 xqzzk"]
    own = spark.createDataFrame([(k % 7, t) for k, t in enumerate(asked)], "doc_id int, text string")
    got = sorted((r.doc_id, r.n_tokens, round(r.log_prob, 3)) for r in lm.score(own, vocab, net).collect())

    counts = {f"often{k}": 9 for k in range(40)} | {f"rare{k}": 1 for k in range(300)}
    of_bucket = {}
    for w, n in counts.items():
        of_bucket[vocab[w]] = of_bucket.get(vocab[w], 1) + n
    want = []
    for k, t in enumerate(asked):
        n, z = lm.score_texts([t], vocab, net)
        for w in lm.words(t):
            if w not in vocab:
                z[0] += (np.log(counts[w]) if w in counts else lm.spelt(len(w.encode()))) - np.log(of_bucket.get(vocab[w], 1))
        want.append((k % 7, n[0], round(z[0], 3)))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(want)], atol=0.01)
    by = {t: z for t, (_, _, z) in zip(asked, want, strict=True)}
    assert by["w5"] > by["often3"] > by["rare7"] > by["xqzzk"] + 5


def test_words_are_looked_up_without_python_calls(monkeypatch):
    vocab = lm.Vocabulary({"a": 0, "b": 1})
    found = ["a", "x", "日本", "b", "x", ""]
    want = [vocab[w] for w in found]
    monkeypatch.setattr(lm.Vocabulary, "__missing__", lambda self, w: pytest.fail("a call for a word"))
    assert vocab.tokens(found).tolist() == want and vocab.tokens([]).tolist() == []
    tokens, at, n = lm.positions(["a x", None, "b"], vocab)
    assert tokens[at].tolist() == [want[0], want[1], want[3]] and n.tolist() == [2, 0, 1]
