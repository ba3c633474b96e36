"""Longer DuckDB SQL of the registered queries."""

#: Removes words covered by 35-word windows that start at two places or more.
SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
h AS (SELECT doc_id, i, sha256(array_to_string(words[i:i+34], ' ')) AS x FROM s),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY x) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM d),
a AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w),
m AS (SELECT a.doc_id, count(*) FILTER (WHERE g.k IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY a.k) FILTER (WHERE g.k IS NULL) AS kept FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.k = g.k GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN m ON w.doc_id = m.doc_id
"""
