import hashlib
import math
import re

import pytest

from tintframe.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DDL = "doc_id long, text string, source string, rate int, copy int, rated_source int, Rate_ int"


def brute(docs, share=1.5, weights=(3.0, 1.0, 2.0), cap=2.0, seed=11):
    """doc_id, size, source_size, target, copies; excess goes round until no target is above its cap."""
    size = lambda t: len(WORD.findall(t or ""))
    totals = {}
    for _, t, s in docs:
        totals[s] = totals.get(s, 0) + size(t)
    ranked = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ranked)}
    wanted, target, free = share * sum(totals.values()), {}, set(ranked)
    while free:
        left = wanted - sum(target.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > cap * totals[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: cap * totals[s] for s in over}
        free -= set(over)
    out = []
    for i, t, s in docs:
        rate = target[s] / totals[s] if totals[s] else 0.0
        draw = int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        out.append((i, size(t), totals[s], target[s], math.floor(rate) + (draw < rate - math.floor(rate))))
    return out


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], DDL).repartition(3)


CASES = {
    "several": [(i, "w " * (i % 17), f"s{i * i % 7}") for i in range(300)] + [(None, "a b", None), (400, None, "s1"), (401, "", "s2"), (402, " \n\t", None), (403, "x" * 9, "only empty"), (404, "y " * 20_000, "s3")],
    "one source": [(i, "a b c", "s") for i in range(50)],
    "null source alone": [(i, "a b c", None) for i in range(20)],
    "no words": [(i, None, f"s{i}") for i in range(5)],
    "binding cap": [(i, "a b c d", "big") for i in range(300)] + [(1000 + i, "a", f"small{i}") for i in range(4)],
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case):
    docs = CASES[case]
    got = mixing.plan_mix(frame(spark, docs)).select("doc_id", "size", "source_size", "target", "copies").collect()
    want = brute(docs)
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[4] == w[4] and g[3] == pytest.approx(w[3])
    assert all(r[4] <= 2 for r in want)
    if case == "binding cap":
        assert {r.source: r.target for r in mixing.plan_mix(frame(spark, docs)).collect()}["small0"] == 2.0


def test_mix_keeps_rows_and_clashing_columns(spark):
    docs = CASES["several"]
    df = frame(spark, docs)
    got = mixing.mix(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert all(tuple(r)[3:] == (1, 2, 3, 4) for r in rows)
    copies = {i: c for i, *_, c in brute(docs)}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _, _ in docs for _ in range(copies[i]))
    assert sorted(map(str, mixing.mix(df.repartition(5)).collect())) == sorted(map(str, rows))


def test_repeated_rows_draw_alike_and_empty_table(spark):
    docs = [(7, "a b c", "s"), (7, "a b c", "s"), (8, "a b", "s")]
    got = mixing.plan_mix(frame(spark, docs)).filter("doc_id = 7").collect()
    assert len(got) == 2 and got[0] == got[1]
    empty = frame(spark, docs).limit(0)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0
