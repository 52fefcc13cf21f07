"""The corpus queries by name, and SQL for those that SQL can state."""

from __future__ import annotations

from drayage.llm import ann, bpe, jaccard, langid, lm, packing, pii, quality, substring, topk
from drayage.llm.store import table


def _op8(spark, d):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.tokenised(table(spark, d, "documents"), path, public_tokenizers.PATTERN, ids=False)


QUERIES = {
    "op1_substring_dedup": lambda spark, d: substring.passages(table(spark, d, "documents")),
    "op2_jaccard_join": lambda spark, d: jaccard.join(table(spark, d, "documents")),
    "op3_language_id": lambda spark, d: langid.predictions(table(spark, d, "documents")),
    "op4_pii": lambda spark, d: pii.report(table(spark, d, "documents")),
    "op5_quality": lambda spark, d: quality.scores(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_ann_search": lambda spark, d: ann.search(table(spark, d, "embeddings")),
    "op7_exact_topk": lambda spark, d: topk.search(table(spark, d, "embeddings")),
    "op8_byte_bpe": _op8,
    "op9_packing": lambda spark, d: packing.packed(table(spark, d, "documents")),
    "op10_lm_scoring": lambda spark, d: lm.scores(table(spark, d, "documents")),
}

ORACLES = {
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh
  FROM w),
s AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM g),
l AS (
  SELECT a.doc_id AS p, b.doc_id AS q
  FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (
  SELECT doc_id AS p, doc_id AS q FROM g
  UNION
  SELECT r.p, l.q FROM r JOIN l ON r.q = l.p)
SELECT g.doc_id, CAST(len(g.sh) AS BIGINT) AS n_shingles, c.component_id
FROM g JOIN (SELECT p, min(q) AS component_id FROM r GROUP BY p) c ON c.p = g.doc_id""",
    "op7_exact_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([x[1] * x[2] FOR x IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
