"""The registered corpus queries: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, divergence, exact_dedup, jaccard_join, language_id, language_model, line_dedup, mixing, packing, quality, suffix_dedup, topk_search
from .common import documents, fold


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), keep_bytes=False)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir)).drop("row")


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words
), sized AS (SELECT doc_id, s, len(s)::BIGINT AS n FROM sets
), shingles AS (SELECT doc_id, n, unnest(s) AS x FROM sized
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) + any_value(b.n) AS total
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM met WHERE 100 * common >= 75 * (total - common)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sized
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, any_value(s.n) AS n_shingles, min(r.other) AS component_id FROM sized s JOIN reach r USING (doc_id) GROUP BY s.doc_id
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), keep_ids=False).drop("ids")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those that go, and of these the ones only near an earlier line."""
    found = line_dedup.duplicate_lines(documents(spark, sf_dir))
    return found.select("doc_id", F.col("n_lines").cast("long"), F.size("removed").cast("long").alias("n_removed"), F.size("near").cast("long").alias("n_near"), F.array_join("removed", ",").alias("removed_lines"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


OP6_SQL = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM normal WINDOW w AS (PARTITION BY t)
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan_mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), limited AS (
  SELECT *, [3.0, 1.0, 2.0][((rank - 1) % 3) + 1]::DOUBLE AS weight, source_size::DOUBLE * 2.0::DOUBLE AS lim FROM totals
), levels AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS wanted,
    coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE) AS before,
    sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
  FROM limited
), settled AS (
  SELECT *, first_value((wanted - before) / onward) OVER (
    ORDER BY CASE WHEN (wanted - before) / onward <= lim / weight THEN 0 ELSE 1 END, lim / weight, rank
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM levels
), rates AS (
  SELECT source, source_size, least(lim, level * weight) AS target,
    CASE WHEN source_size > 0 THEN least(lim, level * weight) / source_size ELSE 0 END AS rate FROM settled
)
SELECT s.doc_id, s.size, r.source_size, r.target,
  s.size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('11:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
"""

def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP8_SQL = """
WITH clean AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM clean q JOIN clean c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.quality_scores(documents(spark, sf_dir), labels)
    return scored.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", quality.predicted(F.col("score")).alias("predicted"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold(F.col("doc_id")) == 1)
    model = language_model.train(docs.filter(~F.col("held_out")))
    return language_model.score(docs, model)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_passages(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, unnest([array_to_string(w[i : i + least(len(w), 10) - 1], ' ') for i in range(1, len(w) - least(len(w), 10) + 2)]) AS x FROM items WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT row, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(w[i : i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) AS x FROM docs, sizes
), met AS (SELECT p.row, p.i, p.n, v.item FROM places p JOIN windows v ON p.n = v.n AND p.x = v.x
), hit AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS k FROM met) GROUP BY row
), found AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row, item FROM met) GROUP BY row
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(f.names, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hit h USING (row) LEFT JOIN found f USING (row)
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), lists AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang
), grams AS (
  SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS g FROM lists, (SELECT unnest([1, 2, 3]) AS k)
), f AS (SELECT lang, k, g, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT lang, k, g, f AS a, unnest(range(1, k)) AS cut, string_split(g, ' ') AS w FROM f WHERE k > 1
), scored AS (
  SELECT c.lang, c.k, c.g, c.a, c.cut, h.f AS l, t.f AS r, (1000000::HUGEINT * c.a * c.a) // (h.f * t.f) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.g = array_to_string(list_slice(c.w, 1, c.cut), ' ') JOIN f t ON t.lang = c.lang AND t.g = array_to_string(list_slice(c.w, c.cut + 1, c.k), ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), inner_parts AS (
  SELECT lang, f, string_split(g, ' ') AS w, unnest([1, 2]) AS i FROM f WHERE k = 3
), covered AS (SELECT lang, array_to_string(list_slice(w, i, i + 1), ' ') AS g, max(f) AS longer FROM inner_parts GROUP BY ALL
), stays AS (SELECT b.* FROM best b LEFT JOIN covered c USING (lang, g) WHERE c.longer IS NULL OR 100 * c.longer < 50 * b.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM stays)
SELECT lang, rank::INT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))


OP13_SQL = r"""
WITH named AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (SELECT row, lang, source, unnest(w) AS term FROM named
), counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS df FROM words GROUP BY ALL
), kept AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM counted GROUP BY ALL HAVING sum(df) >= 30
), langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM named
), cells AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sizes AS (SELECT lang, source, sum(n)::HUGEINT AS size FROM cells GROUP BY ALL
), shares AS (
  SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 5)) // (s.size + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (c.total + 5)) // (l.n + 5 * l.v) AS q
  FROM cells c JOIN sizes s USING (lang, source) JOIN langs l USING (lang)
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_jaccard_join, op3_packing, op4_language_id, op5_line_dedup, op6_exact_dedup, op7_mixing, op8_topk_search, op9_quality, op10_language_model, op11_decontamination, op12_collocations, op13_source_divergence)}
ORACLES = {"op2_jaccard_join": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op7_mixing": OP7_SQL, "op8_topk_search": OP8_SQL, "op11_decontamination": OP11_SQL, "op12_collocations": OP12_SQL, "op13_source_divergence": OP13_SQL}
