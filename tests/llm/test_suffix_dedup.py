import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tintframe.llm import suffix_dedup


def brute(docs, length):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(docs, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int((gone[1:] > gone[:-1]).sum()) + int(gone[0])
        out.append((doc_id, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [some(n) for n in (19, 20, 21, 40, 75)]
    docs = [(i, some(rng.randrange(200)) + rng.choice(passages) + some(rng.randrange(60)) + rng.choice(passages)) for i in range(80)]
    docs += [(100 + i, docs[3][1]) for i in range(3)] + [(200 + i, docs[5][1][:50] + some(1) + docs[5][1][51:]) for i in range(20)]
    return docs + [(300, None), (301, ""), (302, "x" * 5000), (303, "ab" * 30), (304, passages[0]), (304, passages[4]), (None, some(10)), (305, some(19)), (306, some(19))]


@pytest.mark.parametrize(("length", "hot"), [(20, 20_000), (20, 2), (33, 20_000)])
def test_against_brute_force(spark, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "_SAMPLES_A_SHARD", 300)
    docs = corpus(length)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, id int").repartition(5)
    got = suffix_dedup.remove_repeats(df, length=length).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(docs, length)
    assert all(r.kept is None or hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_names_are_equal_just_for_equal_strings():
    raw = np.frombuffer(b"abcabcabcdabcabcabcx" * 3, np.uint8)
    for length in (3, 7, 10, 20):
        by_name = {}
        for at, name in enumerate(suffix_dedup.names(raw, length)):
            by_name.setdefault(raw[at : at + length].tobytes(), set()).add(int(name))
        assert all(len(v) == 1 for v in by_name.values()) and len({*map(min, by_name.values())}) == len(by_name)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
