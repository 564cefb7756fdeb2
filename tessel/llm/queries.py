"""The corpus operators' registered queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from .embedding_dedup import embedding_near_copies, op8_embedding_dedup
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .packing import op2_best_fit_packing
from .pii import op1_pii
from .sentence_pieces import op3_sentence_pieces
from .simhash import op4_simhash
from .suffix_dedup import op6_suffix_dedup
from .token_counts import WORDS_SQL, op9_token_counts, token_counts_words
from .toxicity import op5_toxicity
from .warc import op7_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_warc": op7_warc,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "token_counts_words": token_counts_words,
    "embedding_near_copies": embedding_near_copies,
}

#: The result of op6 by counting every 200-byte string.
OP6_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
     w AS (SELECT doc_id, i, md5_number(b[i : i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200)),
     r AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
     g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k
           FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM r)),
     runs AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS z FROM g GROUP BY doc_id, k),
     cuts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS final FROM runs),
     kept AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans,
                     string_agg(CASE WHEN p + 1 < a THEN hex(b[p + 1 : a - 1]) ELSE '' END || CASE WHEN final AND z < n THEN hex(b[z + 1 : n]) ELSE '' END, '' ORDER BY a) AS rest
              FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN rest IS NULL THEN b ELSE unhex(rest) END) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: The result of op7 as its contract states it; the query gets it through archives that it writes and reads back.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top, strlen(h) AS n FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""

#: The result of op8 by comparing all pairs, for small tables.
_LINKS_SQL = """
WITH RECURSIVE v AS ({vectors}),
     l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
     r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
     c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON x = vec_id
"""
OP8_SQL = _LINKS_SQL.format(vectors="SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings")
#: The tables' own vectors have next to no links; with a changed copy of each there are links on both sides of the threshold.
COPIES_SQL = _LINKS_SQL.format(
    vectors="""
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  UNION ALL SELECT vec_id + 1000000000, list_concat([CAST(embedding[1] AS DOUBLE) + 0.04 * (vec_id % 11)], CAST(embedding AS DOUBLE[])[2:]) FROM embeddings"""
)

#: The others have no SQL form: tokenizers, iterative links, learned models. tests/llm holds them against brute force.
ORACLE_SQL = {"op6_suffix_dedup": OP6_SQL, "op7_warc": OP7_SQL, "op8_embedding_dedup": OP8_SQL, "embedding_near_copies": COPIES_SQL, "op10_exact_dedup": OP10_SQL, "token_counts_words": WORDS_SQL}
