import random
import zlib
from collections import Counter

import corpus_pipeline
from loomtrace.llm import packing, pii, quality, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    words = ["the", "thon", "river", "nation", "and", "of", "house", "ering", "blend"]
    clean = [" ".join(rng.choice(words) + rng.choice(["", "s", "ea", "ing"]) for _ in range(rng.randint(60, 220))) + "." for _ in range(120)]
    rows = clean + clean[:10] + [None, "", "short one"] + [" ".join(w + "###" for w in t.split()) for t in clean[20:30]]
    bad = []
    for t in clean[30:70]:
        w = t.split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum"]))
        bad.append(" ".join(w))
    rows += bad + [" ".join(reversed(t.split())) + " write to rhokk.73@mail2.example.com or +1 (988) 555-2485" for t in clean[70:80]]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(rows)], {i for i, t in enumerate(rows) if t in set(bad)}


def test_stages_equal_brute_force(spark, tmp_path):
    rows, bad = documents()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] in bad)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    want = {r[0]: r[1] for r in rows}

    found = {i: quality.counts(t) for i, t in want.items()}
    post = quality.estimate(Counter(map(quality.votes, found.values())))
    want = {i: t for i, t in want.items() if not quality.base_failed(found[i]) and post[quality.votes(found[i])] >= quality.KEEP}
    docs = corpus_pipeline.quality_rules(spark, docs, sf)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id: r.text for r in docs.collect()} == want
    assert 150 <= len(want) <= 185

    train = sorted((i, t, int(i in bad)) for i, t in want.items() if zlib.crc32(str(i).encode()) % 3 != 1)
    scorer = toxicity.fit([t for _, t, _ in train], [y for _, _, y in train]).scorer()
    ids = sorted(want)
    want = {i: want[i] for i, z in zip(ids, scorer.logits([want[i] for i in ids])) if z < 0.8472978603872034}
    docs = corpus_pipeline.toxic(spark, docs, sf)
    assert {r.doc_id: r.text for r in docs.collect()} == want and not bad & set(want)

    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in want.items())}
    kept = set()
    for i in sorted(want):
        near, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for j in want:
                if j not in near and 5 * len(shingles[x] & shingles[j]) >= 4 * len(shingles[x] | shingles[j]):
                    near.add(j)
                    todo.append(j)
        kept.add(min(near))
    want = {i: want[i] for i in kept}
    docs = corpus_pipeline.near_dedup(spark, docs, sf)
    assert {r.doc_id: r.text for r in docs.collect()} == want

    finder = pii.Finder(pii.fitted())
    want = {i: pii.mask(t, finder.spans(t)[1]) for i, t in want.items()}
    docs = corpus_pipeline.personal_data(spark, docs, sf)
    got = docs.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert any("[EMAIL] or [PHONE]" in t for t in want.values())

    last = corpus_pipeline.run(spark, sf).collect()
    lengths = {i: len(x) // 4 + 1 for i, x in zip(want, packing.word_bpe().ids(list(want.values())))}
    total = Counter()
    for r in last:
        total[r.doc_id] += r.length
    assert total == lengths


def test_repeated_ids_clashing_names_and_empty_tables(spark, tmp_path):
    rows, bad = documents()
    other = rows[5][1]
    rows = rows[:60] + [(3, other + " but with some more words at the end of it here", "en", "s", 9), (3, other + " but with some more words at the end of it here", "en", "s", 9), (None, rows[7][1], "en", "s", 1)]
    more = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' as votes", "1 as node", "2 as component_id", "3 as fp", "'y' as spans", "4 as score", "5 as size", "6 as n", "7 as _pattern", "8 as _n", "9 as _kept", "10 as _row", "'z' as _votes", "11 as posterior", "12 as _posterior")
    labels = spark.createDataFrame([(r[0], 1, int(r[0] in bad)) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == more.columns, name
    kept = docs.select("doc_id", "text").collect()
    assert len([r for r in kept if r.doc_id == 3]) == 2 and len({r.text for r in kept if r.doc_id == 3}) == 2
    assert len([r for r in kept if r.doc_id is None]) == 1
    empty = more.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0, name
