import random
import time

import numpy as np
import pytest

from corvex.llm import nearcopies


def similar(texts, share, width=3, least=40):
    sets = {}
    for k, t in texts.items():
        w = t.lower().split()
        if len(w) >= least:
            sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) - 1e-9}


def edited_copies(rng, sizes, copies):
    texts = {}
    for size in sizes:
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, size // 12)):
                i = rng.randrange(len(words))
                words[i : i + rng.randrange(2)] = [f"w{rng.randrange(3000)}"] * rng.randrange(3)
            texts[len(texts)] = " ".join(words)
    return texts


@pytest.mark.parametrize("share, frequent, tokens, posting, size", [(0.7, 3, 1 << 17, 1000, 1), (0.7, 3, 40, 3, 8), (0.5, 2, 1 << 17, 4, 2), (0.8, 4, 5, 1000, 3)])
def test_classes_overflow_and_blocks(spark, monkeypatch, share, frequent, tokens, posting, size):
    for name, value in (("FREQUENT_DF", frequent), ("FREQUENT_TOKENS", tokens), ("POSTING", posting), ("CLASS", size)):
        monkeypatch.setattr(nearcopies, name, value)
    texts = edited_copies(random.Random(size), (41, 90, 250, 700), 7)
    texts[len(texts)] = "a b " * 30
    texts[len(texts)] = "a b " * 30 + "c"
    df = spark.createDataFrame([*texts.items()], "k long, t string")
    want = similar(texts, share)
    assert len(want) > 20
    assert {tuple(r) for r in nearcopies.similar_pairs(df, "k", "t", share=share).collect()} == want


def test_keys_follow_the_size_not_its_square(spark):
    frequent = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 200_000).astype(np.uint64))
    for size in (1000, 5000, 50_000):
        tokens = np.unique(np.random.default_rng(1).choice(frequent, size, replace=False) << np.uint64(32))
        head, rare = nearcopies.prefix(tokens, 0.7, frequent, np.arange(len(frequent)))
        keys, *_ = nearcopies.keys_of(head, np.arange(len(head)) < rare, len(tokens), 0.7)
        assert rare == 0 and len(keys) < 6 * size
    texts = edited_copies(random.Random(1), (20_000,), 30)
    df = spark.createDataFrame([*texts.items()], "k long, t string")
    began = time.perf_counter()
    found = {tuple(r) for r in nearcopies.similar_pairs(df, "k", "t").collect()}
    assert time.perf_counter() - began < 120
    assert found == similar(texts, 0.7) and len(found) > 100
