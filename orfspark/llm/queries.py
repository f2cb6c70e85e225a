"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from .chat import op7_chat
from .decontaminate import op3_decontaminate
from .embeddings import op10_embeddings
from .fim import op13_fim
from .licences import op5_licences
from .mtree import op12_topk
from .packing import op8_packing
from .quality import op1_quality
from .simhash import op4_simhash
from .spelling import op11_spelling
from .substrings import op9_substrings
from .toxicity import op6_toxicity
from .urls import op2_urls

QUERIES = {
    "op1_quality": op1_quality,
    "op2_urls": op2_urls,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_licences": op5_licences,
    "op6_toxicity": op6_toxicity,
    "op7_chat": op7_chat,
    "op8_packing": op8_packing,
    "op9_substrings": op9_substrings,
    "op10_embeddings": op10_embeddings,
    "op11_spelling": op11_spelling,
    "op12_topk": op12_topk,
    "op13_fim": op13_fim,
}

#: Letters of the ASCII alphabet.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Of the others, fingerprints need XXH64, packing a tokenizer, spelling CRC32, and models a fit.
ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": f"""WITH d AS (SELECT doc_id, coalesce({TERMS}, []) AS ws FROM documents), b AS (SELECT DISTINCT item_id, {TERMS} AS ws FROM benchmark),
 k AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[p:p + 12], ' ') AS k FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
 g AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM k))),
 m AS (SELECT doc_id, item_id, g.n, p FROM g JOIN k ON k.n = g.n AND k.k = g.k),
 h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM m) GROUP BY 1),
 i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
 FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op9_substrings": r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
 w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
 k AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM w),
 f AS (SELECT *, CASE WHEN p <= n - 12 THEN CAST(doc_id > min(CASE WHEN p <= n - 12 THEN doc_id END) OVER (PARTITION BY k) AS INT) ELSE 0 END AS s FROM k),
 r AS (SELECT doc_id, p, word, max(s) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
 c AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM r GROUP BY 1)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)""",
    "op10_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
 t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a)
 SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM t WHERE a = vec_id), vec_id)) AS component_id,
 vec_id = least(vec_id, coalesce((SELECT min(b) FROM t WHERE a = vec_id), vec_id)) AS kept FROM v""",
    "op12_topk": """WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
 s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
    "op13_fim": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 w AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ws, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
 p AS (SELECT doc_id, t, ws, len(ws) AS n, CAST(least(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) AS BIGINT) AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
 c AS (SELECT doc_id, t, n, form, coalesce(array_to_string(ws[1:a], ''), '') AS p, coalesce(array_to_string(ws[a + 1:z], ''), '') AS m, coalesce(array_to_string(ws[z + 1:], ''), '') AS s FROM p)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
}
