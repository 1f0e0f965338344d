import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tintframe.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DDL = "doc_id long, text string, lang string, source string, term string, n int, other string, df int"


def brute(docs, least, add=5, scale=10**9, top=50):
    groups, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang, source].update(terms)
        df[lang].update(set(terms))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + scale * (count[t] + add) // (n + add * len(kept)) for t in kept}

        p = {s: shares(groups[lang, s]) for s in sources}
        q = shares(sum((groups[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def random_docs(seed, n, sources):
    rng = random.Random(seed)
    words = [*"abcdefghij", "Été", "日本", "Zoë", "x1y"]
    word = lambda: words[min(int(rng.expovariate(0.3)), len(words) - 1)]
    return [(" ".join(word() for _ in range(rng.randrange(0, 12))), rng.choice(["en", "de", None, "xx"]), rng.choice(sources)) for _ in range(n)]


def frame(spark, docs):
    return spark.createDataFrame([(i, *d, "x", 1, "y", 2) for i, d in enumerate(docs)], DDL).repartition(4)


CASES = {
    "several": random_docs(1, 300, ["s1", "s2", "", None, "Ś", "s10"]) + [(None, "en", "no text"), ("a " * 50_000, "en", "s1"), ("", "only empty", "s"), ("", "only empty", "t"), ("a b", "rare", "s")],
    "ties": [("a b c", "en", f"s{i % 4}") for i in range(80)],
    "one source": [("a b a", "en", "s")] * 40,
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("least", [1, 12])
def test_against_brute_force(spark, case, least):
    docs = CASES[case]
    got = divergence.source_divergence(frame(spark, docs), least=least, top=4)
    assert sorted(map(tuple, got.collect())) == brute(docs, least, top=4)


def test_empty_table(spark):
    assert divergence.source_divergence(frame(spark, CASES["ties"]).limit(0)).count() == 0


def test_small_buffers_and_counts_beyond_64_bits(spark, monkeypatch):
    rng = np.random.default_rng(0)
    term, group, n = np.repeat(np.arange(30), 5), np.tile(np.arange(5), 30), rng.integers(1, 4, 150)
    whole = divergence._joint(term, group, n)
    monkeypatch.setattr(divergence, "_CELLS", 7)
    assert all((a == b).all() for a, b in zip(whole, divergence._joint(term, group, n), strict=True))
    from pyspark.sql import functions as F

    count, of = 10**12 + 7, 10**13 + 1
    got = spark.range(1).select(divergence._share(F.lit(count), F.lit(of), F.lit(3), 5, 10**9).alias("p")).first().p
    assert got == 1 + 10**9 * (count + 5) // (of + 15)


def test_counts_told_in_many_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "_HELD", 2)
    rows = [("en", "s", b"A b c"), ("en", "s", b"a a"), ("de", "s", b"a"), ("en", "t", b"")]
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "source": [r[1] for r in rows], "text": pa.array([r[2] for r in rows], pa.binary())})
    total = Counter()
    for out in divergence._tally(iter([batch, batch])):
        for r in out.to_pylist():
            total[r["lang"], r["source"], r["term"], "n"] += r["n"]
            total[r["lang"], r["source"], r["term"], "df"] += r["df"]
    assert total["en", "s", "a", "n"] == 6 and total["en", "s", "a", "df"] == 4 and total["de", "s", "a", "n"] == 2
