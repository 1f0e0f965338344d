import random
import re
from fractions import Fraction

import numpy as np
import pytest

from tintframe.llm import components, jaccard_join

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute(docs, width=5):
    sets = {}
    for i, t in docs:
        w = [x.lower() for x in WORD.findall((t or "").encode())]
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = " ".join(word() for _ in range(30))
    docs = []
    for i in range(120):
        text = [word() for _ in range(rng.randrange(1, 90))]
        if i % 3 == 0:
            text[3:3] = passage.split()
        docs.append(text)
    for i in range(90):  # chains and groups of near copies
        text = list(docs[rng.randrange(len(docs))] if i % 2 else docs[7] + docs[8])
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = word()
        docs.append(text)
    return list(enumerate(map(" ".join, docs)))


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_against_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(jaccard_join, "_KEYS_A_SHARD", 500)
    docs = corpus() + [(1000, None), (1001, ""), (1002, "One two"), (1003, "one  TWO\n"), (1004, "one"), (1005, "É a b c d e"), (1006, "x y " * 20_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, component_id int").repartition(4)
    got = jaccard_join.jaccard_components(df).drop("row").collect()
    assert sorted(map(tuple, got)) == brute(docs)
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, c in brute(docs) if c == i]


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (None, "other words"), (9, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert rows == sorted([(5, 5), (5, 5), (None, 5), (None, None), (9, 9)], key=str)
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(2)
    vectors = rng.poisson(1.5, (300, 16)) * rng.integers(0, 2, (300, 1))
    n, t = vectors.sum(axis=1), Fraction(3, 4)
    tree = jaccard_join.CountTree(n, vectors, leaf=5, fan=3)
    for i in range(0, 300, 7):
        want = [j for j in range(300) if np.minimum(vectors[i], vectors[j]).sum() >= jaccard_join.least_overlap(n[i], n[j], t) and n[j] >= t * n[i] and n[i] >= t * n[j]]
        got = set(tree.search(int(n[i]), vectors[i], t).tolist())
        assert set(want) <= got


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_components_of_a_long_chain_in_any_order(spark):
    ids = list(range(3000))
    random.Random(7).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids[:-1], ids[1:], strict=True), (5000, 5001), (6000, 6000)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == dict.fromkeys(range(3000), 0) | {5000: 5000, 5001: 5000, 6000: 6000}


def test_least_need_is_a_lower_bound():
    rng, t = np.random.default_rng(5), Fraction(3, 4)
    for _ in range(200):
        n = np.sort(rng.integers(1, 60, 8))
        fits = lambda i, j: i != j and n[i] >= t * n[j] and n[j] >= t * n[i]  # noqa: B023, E731
        want = [min((int(jaccard_join.least_shared(n[[i]], n[[j]], t)[0]) for j in range(8) if fits(i, j)), default=None) for i in range(8)]
        got = jaccard_join._least_need(n, np.zeros(8, np.int64), t)
        assert all(w is None or 1 <= g <= max(w, 1) <= g + 1 for g, w in zip(got.tolist(), want, strict=True))


def test_few_shared_keys_make_no_suspects(spark, monkeypatch):
    """Sets with a single key in common are no suspects; blocks of several shards with like members are one."""
    rows, plain = {}, jaccard_join.save

    def counted(df, name):
        out = plain(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "save", counted)
    monkeypatch.setattr(jaccard_join, "_KEYS_A_SHARD", 100)
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = [text(5) for _ in range(400)]
    docs = [" ".join(sum((text(12) + shared[rng.randrange(400)] for _ in range(6)), [])) for _ in range(60)]
    near = text(200)
    docs += [" ".join(near), " ".join([*near[:-1], "other"])]
    got = jaccard_join.jaccard_components(spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: min(i, 60) for i in range(62)}
    assert rows["suspects"] == 2 and rows["blocks"] == 2
