"""SQL of the exact operators, for an engine that runs it over the same tables."""

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

CONTAINED = rf"""
WITH dw AS (SELECT doc_id, {_WORDS.format(r"regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g')")} AS w FROM documents WHERE doc_id IS NOT NULL),
bw AS (SELECT item_id, {_WORDS.format(r"regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g FROM (SELECT *, least(5, len(w)) AS k FROM bw) WHERE k > 0),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g FROM dw JOIN (SELECT DISTINCT k FROM b) ON len(w) >= k)
SELECT doc_id, item_id, n_item, count(*) AS n_common FROM d JOIN b USING (k, g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE [concat(w[i], ' ', w[i + 1]) FOR i IN range(1, len(w))] END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sn AS (SELECT s.*, n.n FROM s JOIN n USING (doc_id)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM sn x JOIN sn y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
 GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS least_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.least_id, w.doc_id)) AS component_id, coalesce(c.least_id, w.doc_id) >= w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

REPEATS = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
low AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (g) WHERE doc_id > d),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM w),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS kept FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""
