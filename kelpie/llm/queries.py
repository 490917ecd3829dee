"""Queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, licences, merkle, mixing, near, negatives, odd, passages, quality, rules, suffixes, topk, urls

#: SQL of the queries that SQL expresses at the scale of its check; the others are tested against brute force.
_ORACLE = {
    "op5_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.w, d.w), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_passage_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE n > 1),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
y AS (SELECT x.doc_id, x.j, x.word, c.j IS NOT NULL AS gone FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.j = c.j),
z AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM y GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN z USING (doc_id)""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w, row_number() OVER () AS k FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.k, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, b.k AS row, CAST(coalesce(list_sum(list_transform(list_zip(a.w, b.w), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.k <> b.k
), p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id, row) AS n FROM s WHERE same),
g AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.k, p.n ORDER BY s.score DESC, s.vec_id, s.row) AS rank
  FROM p JOIN s ON s.k = p.k AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.n <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 5""",
    "op12_odd_sketch_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS least FROM n UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.d AND r.least < e.b),
c AS (SELECT d, min(least) AS least FROM r GROUP BY d)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.d = doc_id""",
    "op13_merkle_manifest": """
WITH RECURSIVE c AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 5 = 0 AS hit
  FROM documents
), f AS (
  SELECT doc_id, source, hit, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS changed
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM c)
), t AS (
  SELECT *, coalesce('1' || source, '0') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM f
), lv AS (
  SELECT tree, 0 AS l, i, leaf AS h, n FROM t
  UNION ALL SELECT tree, l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM lv WHERE n > 1 GROUP BY tree, l, i // 16, n
), s AS (SELECT tree, l, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
up AS (
  SELECT 0 AS l, i, h, n FROM s
  UNION ALL SELECT l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY l, i // 16, n
), r AS (SELECT h AS root FROM up WHERE n = 1),
p AS (
  SELECT t.tree, t.i, x.l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS a, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS b
  FROM t JOIN lv x ON x.tree = t.tree AND x.n > 1 AND x.i = t.i // CAST(pow(16, x.l) AS BIGINT) JOIN lv y ON y.tree = x.tree AND y.l = x.l AND y.i // 16 = x.i // 16 GROUP BY t.tree, t.i, x.l
), q AS (
  SELECT s.tree, x.l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS a, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS b
  FROM s JOIN up x ON x.n > 1 AND x.i = s.i // CAST(pow(16, x.l) AS BIGINT) JOIN up y ON y.l = x.l AND y.i // 16 = x.i // 16 GROUP BY s.tree, x.l
), w AS (
  SELECT t.tree, t.i, list(a || '?' || b ORDER BY o, l) FILTER (a IS NOT NULL) AS steps
  FROM t LEFT JOIN (SELECT tree, i, 0 AS o, l, a, b FROM p UNION ALL SELECT t.tree, t.i, 1, q.l, q.a, q.b FROM q JOIN t ON t.tree = q.tree) z ON z.tree = t.tree AND z.i = t.i GROUP BY t.tree, t.i
), e AS (
  SELECT t.doc_id, t.leaf, s.h AS subroot, r.root, sha256(replace(coalesce(array_to_string(w.steps, ''), ''), '?', '')) AS proof_sha256,
    list_reduce(list_prepend(CASE WHEN t.hit THEN t.changed ELSE t.leaf END, coalesce(w.steps, [])), lambda x, y: sha256(replace(y, '?', x))) AS folded_root
  FROM t JOIN w ON w.tree = t.tree AND w.i = t.i JOIN s ON s.tree = t.tree CROSS JOIN r
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM e""",
}


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path():
    """The byte-level vocabulary file of the public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark, sf_dir):
    return quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark, sf_dir):
    return suffixes.remove_repeats(_read(spark, sf_dir, "documents"))


def op3_jaccard_join(spark, sf_dir):
    return near.join(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")


def op4_url_filter(spark, sf_dir):
    return urls.judge(_read(spark, sf_dir, "pages"))


def op5_exact_topk(spark, sf_dir):
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark, sf_dir):
    out = rules.judge(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_license_scan(spark, sf_dir):
    return licences.scan(_read(spark, sf_dir, "documents"))


def op8_source_mixing(spark, sf_dir):
    return mixing.plan(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op9_passage_dedup(spark, sf_dir):
    return passages.remove_passages(_read(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark, sf_dir):
    return bpe.encode_decode(_read(spark, sf_dir, "documents"), tokenizer_path())


def op11_hard_negatives(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings")
    return negatives.hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_odd_sketch_dedup(spark, sf_dir):
    return odd.near_duplicates(_read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.audit(_read(spark, sf_dir, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    return dict(_ORACLE)
