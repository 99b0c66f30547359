"""What hashing holds of a batch stays bounded."""

import tracemalloc

import numpy as np
import pandas as pd

from faultline.functions import embedding


def test_hashing_holds_few_numbers_per_character():
    rng = np.random.default_rng(1)
    words = np.array(["alpha", "b2", "Gamma", "delta-x", "é7"])
    texts = pd.Series([" ".join(rng.choice(words, 60_000)) for _ in range(20)])
    size = sum(map(len, texts))
    tracemalloc.start()
    matrix = embedding.count_matrix(texts)
    peak = tracemalloc.get_traced_memory()[1] - matrix.nbytes
    tracemalloc.stop()
    assert peak < 12 * size  # was above 60
    row, bucket, count = embedding.count_buckets(texts.iloc[:1])
    assert (matrix[0, bucket] == count).all() and matrix[0].sum() == count.sum()


def test_a_text_of_several_pieces_counts_as_one(monkeypatch):
    texts = pd.Series(["one two one", None, "", "three two-two one" * 9, "é"], dtype=object)
    want = embedding.count_buckets(texts)
    monkeypatch.setattr(embedding, "SLICE", 5)
    assert all((a == b).all() for a, b in zip(embedding.count_buckets(texts), want))
    assert (embedding.count_matrix(texts) == np.bincount(want[0] * 768 + want[1], want[2], 5 * 768).reshape(5, 768)).all()
