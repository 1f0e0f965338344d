import random

import numpy as np
import pytest

from tintframe.llm import line_dedup

BLANK = " \t\r\x0b\x0c"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(docs, errors, least):
    lines = [(d, at, line.strip(BLANK)) for d, t in sorted(docs) for at, line in enumerate((t or "").split("\n"))]
    out = {d: ([], []) for d, _ in docs}
    for k, (d, at, line) in enumerate(lines):
        before = {x for _, _, x in lines[:k]}
        if len(line) >= least and any(abs(len(x) - len(line)) <= errors and edits(x, line) <= errors for x in before if len(x) >= least):
            out[d][0].append(at)
            if line not in before:
                out[d][1].append(at)
    return sorted((d, len((dict(docs)[d] or "").split("\n")), *x) for d, x in out.items())


def changed(rng, line, n):
    for _ in range(n):
        at = rng.randrange(len(line))
        line = rng.choice([line[:at] + line[at + 1 :], line[:at] + rng.choice("abé") + line[at:], line[:at] + rng.choice("abé") + line[at + 1 :]])
    return line


def test_banded_check_against_the_full_table():
    rng = random.Random(3)
    for errors in (0, 1, 2, 3, 7, 20, 30):
        pairs = []
        for _ in range(300):
            a = "".join(rng.choice("abé") for _ in range(rng.randrange(errors + 1, 40)))
            b = changed(rng, a, rng.randrange(errors + 3))
            pairs.append((a, b) if len(a) >= len(b) else (b, a))
        pairs = [(a, b) for a, b in pairs if len(b) > errors]
        got = line_dedup.within([a for a, _ in pairs], [b for _, b in pairs], errors)
        assert got.tolist() == [edits(a, b) <= errors for a, b in pairs]


@pytest.mark.parametrize("errors", [0, 2, 3])
def test_against_brute_force(spark, monkeypatch, errors):
    monkeypatch.setattr(line_dedup, "_ENTRIES_A_SHARD", 500)
    monkeypatch.setattr(line_dedup, "_PAIRS", 97)
    rng = random.Random(errors)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(6, 40))) for _ in range(40)]
    docs = []
    for i in range(30):
        docs.append((i, "\n".join(changed(rng, rng.choice(pool), rng.randrange(5)) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(1, 6)))))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[3][1]), (104, "é" * 300 + "\n" + "é" * 301)]
    df = spark.createDataFrame([(*d, [1]) for d in docs], "doc_id long, text string, removed array<int>").repartition(4)
    got = line_dedup.duplicate_lines(df, errors=errors, least=10).drop("row").collect()
    assert sorted(map(tuple, got)) == brute(docs, errors, 10)
    cut = line_dedup.drop_lines(df, errors=errors, least=10)
    assert cut.columns == df.columns
    gone = {d: set(x) for d, _, x, _ in brute(docs, errors, 10)}
    want = {d: "\n".join(line for at, line in enumerate(t.split("\n")) if at not in gone[d]) if t is not None else None for d, t in docs}
    assert {r.doc_id: r.text for r in cut.collect()} == want


def test_batches_whose_lines_have_no_keys(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["one two three", "!!!", "-", "one two threes"])], "doc_id long, text string").repartition(1)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = line_dedup.duplicate_lines(df, errors=0, least=1).drop("row").collect()
    assert sorted(map(tuple, got)) == brute(docs, 0, 1)


def test_very_long_lines(spark):
    df = spark.createDataFrame([(1, "ab" * 30_000), (2, "ab" * 30_000 + "c"), (3, "ba" * 30_000 + "xyz")], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.duplicate_lines(df).collect()} == {1: [], 2: [0], 3: []}


def test_repeated_rows_and_empty_table(spark):
    line = "a line that is long enough to be compared at all"
    df = spark.createDataFrame([(5, line), (5, line), (None, line), (7, line + "!")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in line_dedup.drop_lines(df).collect()), key=str) == [(5, line), (5, line), (7, ""), (None, "")]
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


def test_tallies_bound_the_edits():
    rng = random.Random(9)
    for _ in range(200):
        a = "".join(rng.choice("abcdefgh") for _ in range(40))
        b = changed(rng, a, rng.randrange(6))
        t = [line_dedup.entries([x], 2)[3] for x in (a, b)]
        assert line_dedup.tally_gap(*t)[0] <= 2 * edits(a, b)
    assert np.array_equal(line_dedup.segment(np.array([11]), 2, 2)[0], [7])


def test_exact_repeats_of_short_lines_go(spark):
    df = spark.createDataFrame([(1, "MIT\n\nAll rights reserved.\n}"), (2, "MIT\n\nAll rights reserved!\n} "), (3, "MIP\n\n" + "x" * 18 + "yz\n" + "x" * 18 + "y")], "doc_id long, text string")
    got = {r.doc_id: (r.removed, r.near) for r in line_dedup.duplicate_lines(df).collect()}
    assert got == {1: ([], []), 2: ([0, 2, 3], [2]), 3: ([3], [3])}


def test_a_line_below_a_step_is_a_witness(spark):
    line = "a line of just as many characters as forty"[:39]
    df = spark.createDataFrame([(1, line), (2, "X" + line[:20] + line[21:] + "Y"), (3, "XX" + line[:-2])], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.duplicate_lines(df).collect()} == {1: [], 2: [], 3: []}
    df = spark.createDataFrame([(1, line), (2, line[:20] + "Z" + line[21:] + "Y")], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.duplicate_lines(df).collect()} == {1: [], 2: [0]}


def test_word_edits_grow_with_the_line(spark):
    rng = random.Random(4)
    docs, want = [], {}
    for i in range(60):
        n = rng.choice([19, 20, 39, 40, 59, 60, 100, 800])
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
        other = list(words)
        for at in rng.sample(range(len(words)), e := max(1, n // 20 + rng.randrange(2))):
            other[at] = rng.choice(["", f"changed{at}", f"one{at} more{at}" if e == 1 else "changed"])
        first, second = " ".join(words), " ".join(" ".join(other).split())
        p, q = sorted((first.split(), second.split()), key=len, reverse=True)
        docs += [(2 * i, first), (2 * i + 1, second)]
        want |= {2 * i: [], 2 * i + 1: [0] if edits(p, q) <= len(p) // 20 else []}
        assert line_dedup.words_within([hash(w) % 2**60 for w in p], [hash(w) % 2**60 for w in q], len(p) // 20) == (edits(p, q) <= len(p) // 20)
    assert 15 < sum(map(len, want.values())) < 55
    got = line_dedup.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.removed for r in got.collect()} == want


def test_packed_entries_come_back():
    rng = np.random.default_rng(5)
    ids, ranks, counts = rng.integers(-(2**62), 2**62, 5), np.array([0, 1, 70, 2.0**20, np.inf], np.float32), np.array([1, 3, 1, 300, 2])
    key, at = rng.integers(0, 2**64, 307, np.uint64), rng.integers(-2, 2**20, 307)
    got = line_dedup._unpack(line_dedup._pack(ids, ranks, counts, key, at))
    want = key & np.uint64(2**48 - 1), np.repeat(ids, counts), np.repeat(ranks, counts), at
    assert all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))


def test_fine_tallies_bound_the_word_edits():
    rng = random.Random(12)
    for n in (1, 40, 300):
        a = [rng.randrange(2**60) for _ in range(n)]
        for e in (0, 1, n // 20, n):
            b = list(a)
            for at in rng.sample(range(n), min(e, n)):
                b[at] = rng.randrange(2**60)
            sets = line_dedup._fine_bags(line_dedup.mix(np.array(a + b, np.uint64)), np.array([n, n]))
            assert line_dedup.fine_gap(sets[:1], sets[1:])[0] <= 2 * min(e, n)
    apart = line_dedup._fine_bags(line_dedup.mix(np.arange(200, dtype=np.uint64)), np.array([100, 100]))
    assert line_dedup.fine_gap(apart[:1], apart[1:])[0] > 100


def test_a_group_of_copies_just_too_far_apart_makes_few_candidates(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"word{rng.randrange(10**6)}" for _ in range(100)]
    docs = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(100), 6):  # any two differ by some 12 words, 5 are allowed
            words[at] = f"other{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    made, plain = {}, line_dedup.save

    def counted(df, name):
        out = plain(df, name)
        if name.endswith("-candidates"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "save", counted)
    lines = [t.split() for _, t in docs]
    near = [[sum(x != y for x, y in zip(lines[i], lines[j], strict=True)) <= 5 for j in range(i)] for i in range(120)]
    got = line_dedup.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.removed for r in got.collect()} == {i: [0] if any(x) else [] for i, x in enumerate(near)}
    assert len(made) == 3 and sum(made.values()) < 120 * 119 // 2 // 10
