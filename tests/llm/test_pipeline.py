from collections import Counter

import corpus_pipeline
from tintframe.llm import packing  # noqa: F401
from tintframe.llm.common import save

from .test_jaccard_join import brute as components
from .test_packing import check

GOOD = "The {0} of a long sentence about w{0} and w{1}, which has a few more words in it for good measure here."
SHARED = "This very line is shared by a good many documents of the corpus, word for word."


def test_stages_in_turn_against_brute_force(spark, tmp_path):
    docs, labels = [], []
    for i in range(160):
        good = i % 4 != 0
        body = "\n".join(GOOD.format(f"{i}x{j}", i * j % 53) for j in range(3)) if good else "BUY!! NOW!! | | $$$ " * (2 + i % 5)
        docs.append((i, body + ("\n" + SHARED if good and i % 5 == 0 else ""), "en", f"s{i % 3}", len(body)))
        labels.append((i, int(good), 0))
    docs += [(500 + i, docs[5][1].replace("about", "on", 1), "en", "s0", 1) for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        at = save(stage(spark, at, str(tmp_path)), name.replace(" ", "-"))
        seen.append(at.collect())
    good, lines, unique, mixed, packed = seen
    assert [s[0].__fields__ for s in seen[:4]] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    want = {d[0] for d in docs if d[0] >= 500 or d[0] % 4}
    assert {r.doc_id for r in good} == want
    first = min(d for d in want if d < 500 and d % 5 == 0)
    assert [r.doc_id for r in lines if SHARED in r.text] == [first]
    assert sorted(r.doc_id for r in unique) == [i for i, _, c in components([(r.doc_id, r.text) for r in lines]) if i == c]
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in unique} and max(copies.values()) <= 2
    size, taken = Counter(), Counter()
    for r in unique:
        size[r.source] += len(r.text.split())
    for r in mixed:
        taken[r.source] += len(r.text.split())
    assert abs(sum(taken.values()) / sum(size.values()) - 1.5) < 0.25
    once = [r for r in packed if copies[r.doc_id] == 1]
    assert sum(r.length for r in packed) == sum(r.doc_tokens * copies[r.doc_id] for r in {r.doc_id: r for r in packed}.values())
    assert once and packing.pack(spark.createDataFrame(unique)).count() > 0
    check(packing.pack(spark.createDataFrame(unique)).collect(), [(r.doc_id, r.text) for r in unique], 2048)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row long, Removed string, copy int, rate double, score double"


def run_on(spark, path, docs, labels):
    spark.createDataFrame([(*d, 1, "x", 2, 3.0, 4.0) for d in docs], CLASHING).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    at, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        at = save(stage(spark, at, str(path)), name.replace(" ", "-"))
        seen.append(at)
    return seen


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    docs = [(i, "\n".join(GOOD.format(f"{i}y{j}", i * j % 31) for j in range(3)) if i % 3 else "$$$ BUY NOW " * 4, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 1) for i in range(60)]
    docs += [docs[4], docs[4], (None, docs[7][1], None, None, None), (None, None, None, None, None), (900, None, "en", "s1", 0), (901, "", "en", "s1", 0), (902, " \n\n ", "en", "s1", 3)]
    seen = run_on(spark, tmp_path, docs, [(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (5, None, None)])
    for stage in seen[:4]:
        assert stage.columns == [c.split()[0] for c in CLASHING.split(", ")]
        assert {tuple(r)[5:] for r in stage.collect()} == {(1, "x", 2, 3.0, 4.0)}
    good = {r.doc_id for r in seen[0].collect()}
    assert {i for i in range(60) if i % 3} <= good and not {i for i in range(60) if i % 3 == 0} & good
    once = Counter(r.doc_id for r in seen[2].collect())
    assert once[4] == 1 and {r.doc_id for r in seen[4].collect()} <= {r.doc_id for r in seen[3].collect()}


def test_empty_tables(spark, tmp_path):
    seen = run_on(spark, tmp_path, [], [])
    assert [s.count() for s in seen] == [0] * 5
