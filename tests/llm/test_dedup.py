import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import embedding_dedup, exact_dedup, links, near_dedup, queries
from llm_tables import ODD, listed, none, odd
from test_oracles import duck, plain  # noqa: F401


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op10_embedding_dedup"])
def test_sql(name, spark, sf, duck):
    query, sql = queries.registry()[name]
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_links_against_union_find(spark):
    rng = random.Random(11)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(300 + i, 200 + i) for i in rng.sample(range(40), 40)]
    pairs += [(1000, 1000 + i) for i in range(1, 50)] + [tuple(rng.sample(range(2000, 2100), 2)) for _ in range(60)]
    pairs += [(5, 5), (-7, -9), (-7, -9)]
    sets = Sets()
    for a, b in pairs:
        if a != b:
            sets.join(a, b)
    found = {r["id"]: r["component"] for r in listed(links.components(spark.createDataFrame(pairs, "a long, b long")))}
    assert found == {x: sets.find(x) for x in sets.up}
    assert listed(links.components(spark.createDataFrame([], "a long, b long"))) == []


def exact(rows):
    groups = defaultdict(list)
    for row in rows:
        body = "".join(c for c in row[1] or "" if c not in " \t\n\v\f\r")
        groups[body].append(row)
    found = []
    for group in groups.values():
        ids = [r for r in group if r[0] is not None]
        most = max(len(r[1] or "") for r in group)
        best = [r for r in group if len(r[1] or "") == most]
        keep = min((r[0] for r in best if r[0] is not None), default=None)
        assert ids or keep is None
        found += [(r[0], keep, len(group)) for r in group]
    return sorted(map(repr, found))


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda body: F.length(body) % 2])
def test_exact_groups_even_where_the_hash_collides(spark, hashed):
    found = listed(exact_dedup.duplicate_groups(odd(spark), hashed))
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"])) for r in found) == exact(ODD)
    # Of rows that repeat text and id one is kept.
    assert sum(r["kept"] for r in found) == len({r["text_sha256"] for r in found})


def test_exact_rows_that_stay(spark):
    found = listed(exact_dedup.drop_duplicates(odd(spark)).toDF("doc_id", "text", "lang", "source", "n", "t", "d"))
    assert len(found) == len({repr(r) for r in found}) == 8
    assert {4, 1, 2**62} <= {r["doc_id"] for r in found} and not {2, 3} & {r["doc_id"] for r in found}
    assert sum(r["doc_id"] is None for r in found) == 1
    assert exact_dedup.drop_duplicates(none(spark)).columns == none(spark).columns
    assert listed(exact_dedup.duplicate_groups(none(spark))) == []


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near(rows):
    sets, ids = Sets(), [r[0] for r in rows if r[0] is not None]
    full = {i: shingles(t) for i, t in ((r[0], r[1]) for r in rows) if i is not None}
    order = sorted(full)
    for k, a in enumerate(order):
        sets.find(a)
        for b in order[:k]:
            both = len(full[a] & full[b])
            if full[a] and full[b] and 100 * both >= 85 * len(full[a] | full[b]):
                sets.join(a, b)
    return {i: (len(full[i]), sets.find(i)) for i in ids}


def made_texts():
    """A family whose members drift apart, copies, shared passages, and short texts."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    base, rows = [rng.choice(words) for _ in range(120)], []
    passage = " ".join(rng.choice(words) for _ in range(60))
    for i in range(60):
        if i % 3 == 0:
            base[rng.randrange(120)] = rng.choice(words)
        text = list(base)
        for _ in range(i % 3):
            text[rng.randrange(120)] = rng.choice(words)
        rows.append((1000 - i, " ".join(text)))
    rows += [(2000 + i, " ".join(rng.choice(words) for _ in range(30)) + " " + passage) for i in range(40)]
    rows += [(3000 + i, rows[i % 4][1].upper()) for i in range(20)]
    rows += [(4000 + i, "same few words") for i in range(5)] + [(4100, "Same  few\nwords"), (4200, "few words")]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = made_texts()
    found = listed(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == near(rows)
    assert len(found) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_odd_rows(spark):
    found = listed(near_dedup.near_duplicates(odd(spark)))
    wanted = near(ODD)
    assert len(found) == len(ODD)
    for row in found:
        if row["doc_id"] is None:
            assert row["component_id"] is None and not row["kept"]
        else:
            assert (row["n_shingles"], row["component_id"]) == wanted[row["doc_id"]]
    assert listed(near_dedup.near_duplicates(none(spark))) == []
    kept = near_dedup.drop_near_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = [r[0] for r in kept.collect()]
    assert 2**62 not in ids and ids.count(None) == 2 and {1, 2, 3, 4, 5} <= set(ids)


def test_limits_are_covered():
    for percent, least in ((100, 64), (85, 40)):
        assert near_dedup.agreement(percent) == least
    for percent in range(20, 101):
        least, share = near_dedup.agreement(percent), percent / 100
        chances = [math.comb(64, k) * share**k * (1 - share) ** (64 - k) for k in range(64)]
        assert least >= 1 and sum(chances[:least]) <= near_dedup.MISS < sum(chances[: least + 1]) + (least == 64)
    for percent in (-5, 0, 10, 101):
        with pytest.raises(ValueError):
            near_dedup.agreement(percent)


def test_pipeline_links_from_four_fifths_on(spark, sf):
    rng, rows = random.Random(6), []
    for i in range(60):
        words = [f"w{i}x{j}" for j in range(54)]  # of 50 shingles 5 change, or 6
        other = list(words)
        for at in (20,) if i % 2 else (20, 53):
            other[at] = f"n{rng.randrange(10**9)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    sets, linked = [shingles(t) for _, t in rows], Sets()
    for a in range(len(rows)):
        linked.find(a)
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                linked.join(a, b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"] for r in listed(corpus_pipeline.near_copies_out(spark, docs, sf))}
    between = [(a, a + 1) for a in range(0, 120, 2) if 80 <= 100 * len(sets[a] & sets[a + 1]) / len(sets[a] | sets[a + 1]) < 85]
    assert len(between) > 20
    assert found == {a for a in linked.up if linked.find(a) == a}


def test_a_unique_text_stays_beside_a_copy_with_its_id(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, one), (5, one + " more"), (5, two), (6, one), (6, one.upper()), (7, "c d e"), (5, ""), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(repr, ((r[0], r[1]) for r in near_dedup.drop_near_duplicates(docs).collect())))
    assert kept == sorted(map(repr, [(1, one), (5, two), (7, "c d e"), (5, ""), (None, one)]))


def test_near_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = listed(queries.op9_near_dedup(spark, sf))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == near(rows)


VECTORS = [
    (1, [1.0, 0.0, 0.0], 0), (2, [2.0, 0.0, 0.0], 0), (3, [1.0, 0.1, 0.0], 0), (4, [1.0, 0.35, 0.0], 0),
    (5, [1.0, 0.0, 0.0], 1), (6, [1.0, 0.0, 0.0], None), (7, None, 0), (8, [], 0), (9, [0.0, 0.0, 0.0], 0),
    (10, [1.0, None, 0.0], 0), (11, [math.nan, 1.0, 0.0], 0), (12, [math.inf, 1.0, 0.0], 0), (13, [1.0, 0.0], 0),
    (None, [1.0, 0.0, 0.0], 0), (1, [1.0, 0.0, 0.0], 0), (14, [1e300, 1e299, 0.0], 0), (15, [-1.0, 0.0, 0.0], 0),
]


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int, LABEL string"
    rows = spark.createDataFrame([(*v, "x") for v in VECTORS], schema)
    found = sorted((repr(r["vec_id"]), r["n_links"], r["component_id"]) for r in listed(embedding_dedup.near_vectors(rows)))
    # 1, 1, 2, null, 3 and 14 are all linked; 3 and 14 point the same way and reach 4.
    wanted = [("1", 5, 1), ("1", 5, 1), ("2", 5, 1), ("None", 5, None), ("3", 5, 1), ("14", 5, 1)]
    cosine = (1 + 0.1 * 0.35) / math.sqrt(1.01 * (1 + 0.35**2))
    assert cosine < 0.98
    wanted += [(str(i), 0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15)]
    assert found == sorted(wanted)
    assert listed(embedding_dedup.near_vectors(spark.createDataFrame([], schema))) == []


def test_cells_and_chunks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 40)
    monkeypatch.setattr(embedding_dedup, "CHUNK_ROWS", 30)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    points = np.concatenate([c + rng.normal(scale=0.15, size=(40, 8)) for c in centres])
    points /= np.linalg.norm(points, axis=1)[:, None]
    rows = [(int(i), p.tolist(), int(i % 2)) for i, p in zip(rng.permutation(len(points)), points)]
    sets, count = Sets(), defaultdict(int)
    for k, (a, x, la) in enumerate(rows):
        sets.find(a)
        for b, y, lb in rows[:k]:
            if la == lb and float(np.dot(x, y)) >= 0.98:
                sets.join(a, b)
                count[a] += 1
                count[b] += 1
    found = listed(embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == {r[0]: (count[r[0]], sets.find(r[0])) for r in rows}
    assert sum(count.values()) > 500
