from loomtrace.llm import toxicity
from tests.llm.test_toxicity import corpus


def test_words_after_sixty_joined_characters():
    scorer = toxicity.fit(*corpus(300)).scorer()
    chained = "-".join(["river", "house"] * 8)
    plain, bad, last = scorer.logits([chained, f"{chained}-idiot-{chained}", f"{chained}.idiot"])
    assert plain < 0 < min(bad, last)
    unbroken = "riverhouse" * 8
    plain, bad, last = scorer.logits([unbroken, f"{unbroken}scumbag{unbroken}", f"{unbroken}idiot"])
    assert bad > plain + 1 and last > plain + 1


def test_stretches_hold_every_gram_and_no_other():
    for n in (1, 13, 14, 15, 16, 17, 23, 24, 60, 61, 203):
        run = "".join(chr(0x4E00 + k) for k in range(n))
        first, *cut = toxicity.words(run)
        assert first == run and bool(cut) == (n + 2 > toxicity.PIECE)
        whole = set(toxicity.grams(run))
        inner = {b for w in cut for b in toxicity.grams(w) if b != toxicity.zlib.crc32(w[1:].encode()) % toxicity.BUCKETS}
        assert not cut or whole - {toxicity.zlib.crc32(f"<{run}>".encode()) % toxicity.BUCKETS} == inner
    assert toxicity.words("a-b c " + "x" * 14) == ["a-b", "c", "x" * 14]


def test_one_more_character_changes_little():
    """No length of a word is a cliff."""
    scorer = toxicity.fit(*corpus(300)).scorer()
    for word in ("riverhouse" * 9, "idiot" + "riverhouse" * 9):
        scores = [scorer.logits([word[:n]])[0] for n in range(30, 90)]
        assert max(abs(a - b) for a, b in zip(scores, scores[1:])) < 2.5
