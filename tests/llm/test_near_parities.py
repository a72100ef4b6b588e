"""The parity bound of near copies: it loses no pair, and edited copies that are too far apart are not read again."""

import random

import numpy as np

from stagewise.llm import near_copies
from stagewise.llm.common import ready


def test_parities_never_differ_more_than_sets():
    rng = random.Random(3)
    for size in (1, 7, 300, 5000):
        for _ in range(20):
            both = [rng.getrandbits(64) for _ in range(size)]
            a, b = (np.array(both + [rng.getrandbits(64) for _ in range(rng.randrange(size))], np.uint64) for _ in "ab")
            x, y = (near_copies._parities(np.unique(v)).view(np.uint8) for v in (a, b))
            assert x.size == 8 * near_copies.PARITIES
            assert np.unpackbits(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_far_copies_of_one_text_are_not_verified_in_pairs(spark, monkeypatch):
    ready(spark)
    rng, texts, hub = random.Random(4), [], [f"w{i}" for i in range(400)]
    for i in range(80):  # each pair is about 0.71 alike
        words = list(hub)
        for at in rng.sample(range(400), 7):
            words[at] = f"new{i}x{at}"
        texts.append((i, " ".join(words)))
    other = [f"o{i}" for i in range(300)]
    texts += [(80, " ".join(other)), (81, " ".join(other[:-1] + ["end"]))]
    verify, seen = near_copies._verified, []

    def counted(pairs, *args):
        seen.append(pairs.count())
        return verify(pairs, *args)

    monkeypatch.setattr(near_copies, "_verified", counted)
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found[81] == 80
    assert len(set(found.values())) >= 75
    assert sum(seen) <= 4 * len(texts), seen
