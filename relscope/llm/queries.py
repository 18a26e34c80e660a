"""Queries of the training-data operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from relscope.llm import decontaminate, merkle, prefix_trie, topk, warc
from relscope.llm.embed_dedup import op4_lattice
from relscope.llm.html_extract import op1_main_text
from relscope.llm.language_id import op2_language
from relscope.llm.mixing import op9_mix
from relscope.llm.quality import op8_quality
from relscope.llm.simhash import op3_simhash
from relscope.llm.substring_dedup import op5_passages
from relscope.llm.token_count import op6_tokens

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_language": op2_language,
    "op3_simhash": op3_simhash,
    "op4_lattice": op4_lattice,
    "op5_passages": op5_passages,
    "op6_tokens": op6_tokens,
    "op7_warc": warc.op7_warc,
    "op8_quality": op8_quality,
    "op9_mix": op9_mix,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_merkle": merkle.op11_merkle,
    "op12_topk": topk.op12_topk,
    "op13_trie": prefix_trie.op13_trie,
}

OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a, good b
  WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links,
  least(v.vec_id, coalesce(least.b, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(least.b, v.vec_id)) AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN least ON v.vec_id = least.a
"""

ORACLE = {"op4_lattice": OP4_SQL, "op7_warc": warc.SQL, "op10_decontaminate": decontaminate.SQL, "op11_merkle": merkle.SQL, "op12_topk": topk.SQL, "op13_trie": prefix_trie.SQL}
