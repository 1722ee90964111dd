"""DuckDB statements for the operators that SQL can express on whole tables."""

from __future__ import annotations

_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLDED}, '{_SPACED}'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) ELSE w END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""

DECONTAMINATE = f"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLDED}, '{_PLAIN}'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({_FOLDED}, '{_PLAIN}'), []) AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS part FROM b WHERE len(w) > 0),
pos AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d, (SELECT DISTINCT size FROM k) WHERE len(w) >= size),
h AS (SELECT doc_id, pos.size, i, item_id FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS part FROM pos) pos JOIN k ON k.size = pos.size AND k.part = pos.part),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_SPACED}'), []) AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS part FROM pos),
f AS (SELECT part, min(doc_id) AS first FROM k GROUP BY part),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN f USING (part) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL = {"op3_setsketch": NEAR_DUPLICATES, "op4_decontaminate": DECONTAMINATE, "op5_fm_index": SUBSTRING}
