import re
from collections import Counter

import pytest

from faultline.llm import phrases, queries
from llm_tables import ODD, listed, none, odd


def brute(rows, least=10, longest=3, covered=50, kept=2000):
    """The contract word by word, over lists."""
    total, counts = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    found = {k: c for k, c in counts.items() if len(k[1]) > 1 and c >= least}
    out = []
    for (lang, words), a in found.items():
        inside = any(
            other == lang and len(w) > len(words) and 100 * f >= covered * a
            and any(w[i : i + len(words)] == words for i in range(len(w)))
            for (other, w), f in found.items()
        )
        if not inside:
            cut = min(
                (1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))
            )
            l, r = counts[lang, words[: cut[1]]], counts[lang, words[cut[1] :]]
            out.append((lang, -cut[0], -a, " ".join(words).encode(), l, r))
    rows, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= kept:
            rows.append((lang, rank[lang], phrase.decode(), -a, l, r, total[lang], -score))
    return rows


def found(docs, **how):
    return sorted(tuple(r.values()) for r in listed(phrases.phrases(docs, **how)))


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_small_heads_and_sieves_change_nothing(spark, sf, longest):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.lang, r.text) for r in docs.collect()], longest=longest)
    assert found(docs, longest=longest) == want and len(want) > 50
    assert found(docs.repartition(5), longest=longest, head=7, head_phrases=9, cells=16) == want


def test_query_names(spark, sf):
    query = queries.op13_phrases(spark, sf)
    assert query.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in query.dtypes[3:]} == {"bigint"}


def test_odd_rows(spark):
    rows = [
        (1, "New York, new\tyork! NEW  YORK\x0bnew york", None, None, None, None, None),
        (1, None, None, None, None, None, None),
        (2, "", "und", None, None, None, None),
        (None, "new york " * 3, "und", None, None, "x", None),
        (3, "x" * 300 + " " + "é ß new york " * 9, "de", None, None, None, None),
        (4, "a a a a a a a a a a a a", "", None, None, None, None),
    ]
    docs = odd(spark, rows * 4)
    want = brute([(r[2], r[1]) for r in rows * 4])
    assert found(docs) == want and found(docs, head=1, head_phrases=1, cells=1) == want
    assert found(odd(spark)) == brute([(r[2], r[1]) for r in ODD])
    assert found(none(spark)) == []


def test_long_texts_are_joined_over_slices(spark, monkeypatch):
    text = "one two three. four " * 3000 + "y" * 5000 + " one two"
    words = [w for part in phrases.slices(text.encode()) for w in part if w]
    monkeypatch.setattr(phrases, "SLICE", 7)
    assert [w for part in phrases.slices(text.encode()) for w in part if w] == words


def test_tiles_count_dense_and_thin(monkeypatch):
    import numpy as np

    monkeypatch.setattr(phrases, "DENSE", 20)
    monkeypatch.setattr(phrases, "TILE", 4)
    rng = np.random.default_rng(1)
    tiles, want = phrases.Tiles(64), Counter()
    for _ in range(5):
        a, b = rng.integers(0, 64, 400) // rng.integers(1, 16, 400), rng.integers(0, 64, 400)
        tiles.add(a, b)
        tiles.merge()
        want.update(zip(a.tolist(), b.tolist()))
    codes, counts = tiles.all()
    assert tiles.dense and len(tiles.codes)
    assert {(c >> 32, c & 0xFFFFFFFF): n for c, n in zip(codes.tolist(), counts.tolist())} == want
    assert (np.diff(codes) > 0).all()


def test_scores_past_64_bits(spark):
    row = spark.createDataFrame([(10**12, 3 * 10**12, 10**12 + 7)], "a long, l long, r long")
    score = row.select(phrases._score(*map(phrases.F.col, "alr")).alias("s")).first().s
    assert score == 1000000 * 10**24 // (3 * 10**12 * (10**12 + 7))
