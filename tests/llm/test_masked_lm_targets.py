from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from loomtrace.llm import masked_lm as lm


class Local:
    """A table of one partition, run in this process so that the targets can be watched."""

    def __init__(self, batches):
        self.batches = batches
        self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

    def select(self, *_):
        return self

    repartition = select

    def mapInArrow(self, run, _):  # noqa: N802
        return Local(list(run(iter(self.batches))))

    def collect(self):
        return [r for b in self.batches for r in b.to_pylist()]


def test_fit_has_every_position_as_target_once(spark, monkeypatch):
    texts = [" ".join(f"w{(k * 7 + j) % 50}" for j in range(k % 23)) for k in range(200)] + [None, "", "one"]
    vocab, share = lm.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"))
    monkeypatch.setattr(lm, "vocabulary", lambda *_: (vocab, share))
    seen = Counter()
    monkeypatch.setattr(lm.Network, "gradient", lambda self, context, target, into: seen.update(target.tolist()))
    lm.fit(Local([pa.record_batch({"text": pa.array(texts[a : a + 60], pa.string())}) for a in range(0, len(texts), 60)]))
    assert seen == Counter(vocab[w] for t in texts for w in lm.words(t))


def test_sets_are_disjoint_and_cover_all():
    n = np.array([0, 1, 2, 10, 0, 7])
    at = np.arange(int(n.sum())) * 3
    parts = [lm.targets(at, n, 3, k).tolist() for k in range(3)]
    assert sorted(sum(parts, [])) == at.tolist()
