"""The queries of this subpackage by name, and the SQL of those that SQL can express at all sizes.

What SQL can't express (models, tries, sketches, encoders, seeded selections) or is
too slow for on whole tables is tested in tests/llm against brute force.
"""

from __future__ import annotations

from .bpe import op2_bpe
from .embedding import op5_embedding_near_dedup
from .fingerprint import op8_document_fingerprints
from .langid import op7_language_id
from .license import op4_license_scans
from .lm import op1_lm_scoring
from .mixing import op9_mixing
from .sharding import op10_sharding
from .simhash import op3_simhash_near_dedup
from .substring import op6_substring_dedup

QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_bpe, op3_simhash_near_dedup, op4_license_scans, op5_embedding_near_dedup, op6_substring_dedup, op7_language_id, op8_document_fingerprints, op9_mixing, op10_sharding)}

ORACLE_SQL = {
    "op6_substring_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM t WHERE len(w) >= 13),
g AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM p),
m AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g),
c AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS i FROM g JOIN m ON g.g = m.g WHERE m.low < g.doc_id),
gone AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM c GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id
""",
}
