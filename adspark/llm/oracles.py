"""SQL of the queries that SQL can express, for DuckDB."""

_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"

OP4 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '') AS loss,
    sum(24 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM whole
"""

OP5 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM words, unnest(range(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS r(i)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * inter >= 85 * (p.n + q.n - inter)
), reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.id = d.doc_id GROUP BY d.doc_id
"""

OP8 = """
WITH RECURSIVE doubles AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
sound AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM doubles WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id <> y.vec_id AND x.norm > 0 AND y.norm > 0
  WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.95
), reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept
FROM embeddings JOIN reach ON id = vec_id GROUP BY vec_id
"""
