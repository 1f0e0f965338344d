import random
import re

import pytest

from tintframe.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if name is None else str(name))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, met = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    met |= found
        runs = []
        for i in sorted(hit):
            if runs and sum(runs[-1]) == i:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((i, 1))
        out.append((doc_id, len(w), runs, sorted(met)))
    return out


def random_case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c", "ñ", "d9", "日本"])
    some = lambda n: rng.choice([" ", ", ", "\n", "'"]).join(word() for _ in range(n))
    items = [(i % 9, some(rng.randrange(0, 9))) for i in range(14)] + [(None, "zz zz zz zz"), (3, None), (50, ""), (51, " .,! "), (52, "qq"), (53, "qq")]
    docs = [(i, some(rng.randrange(0, 60))) for i in range(40)] + [(None, None), (7, ""), (8, "QQ"), (8, "QQ"), (9, items[2][1] or ""), (10, "zz " * 7), (11, "e " * 30_000 + some(40))]
    return docs, items


@pytest.mark.parametrize("window", [1, 2, 4, 7])
@pytest.mark.parametrize("block_words", [6, 100_000])
def test_against_brute_force(spark, window, block_words):
    docs, items = random_case(window)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in dc.find_passages(df, bench, window=window, block_words=block_words).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(docs, items, window), key=key)


def test_automaton_of_many_random_items():
    for seed in range(60):
        rng = random.Random(seed)
        items = [(str(i), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 12))]) for i in range(rng.randrange(1, 8))]
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(80)]
        automaton = dc.Automaton(items, 4)
        n, spans, met = automaton.scan(b" ".join(text))
        want = brute([(0, b" ".join(text).decode())], [(i, b" ".join(w).decode()) for i, w in items], 4)[0]
        assert (n, spans, sorted(met)) == want[1:]


def test_passages_over_bites(monkeypatch):
    from tintframe.llm import common

    monkeypatch.setattr(dc, "bites", lambda data: common.bites(data, 7))
    automaton = dc.Automaton([("x", [b"one", b"two", b"three", b"four"])], 3)
    assert automaton.scan(b"zero one two three four five two three") == (8, [(1, 4)], {"x"})


DDL = "doc_id long, text string, n_words int, Spans string, items int, item_id long"


def test_remove_passages_and_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "short one")], "item_id long, text string")
    docs = [
        (1, "So: The QUICK, brown-fox jumps! And more of it all to read here.", 1, "s", 2, 3),
        (2, "the quick brown fox jumps", 1, None, 2, 3),
        (3, None, 1, "s", 2, None),
        (4, "", 1, "s", 2, 3),
        (5, "nothing, at all", 1, "s", 2, 3),
        (5, "nothing, at all", 1, "s", 2, 3),
    ]
    df = spark.createDataFrame(docs, DDL)
    got = dc.remove_passages(df, bench, window=4)
    assert got.columns == df.columns
    rows = sorted(map(tuple, got.collect()), key=lambda r: r[0])
    assert rows == [(1, "So: ! And more of it all to read here.", 1, "s", 2, 3), *docs[2:]]
    assert dc.remove_passages(df.limit(0), bench).count() == 0
    assert sorted(map(str, dc.remove_passages(df, bench.limit(0)).collect())) == sorted(map(str, df.collect()))
