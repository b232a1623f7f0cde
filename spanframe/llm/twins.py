"""SQL twins of the queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LEAKS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(l)) AS m, array_to_string(l[i : i + least(10, len(l)) - 1], ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(1, len(l) - least(10, len(l)) + 2)) AS i) WHERE len(l) > 0),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(l[i : i + m - 1], ' ') AS win FROM d, sizes, LATERAL (SELECT unnest(range(1, len(l) - m + 2)) AS i) WHERE len(l) >= m),
hits AS (SELECT doc_id, i, dw.m, item FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
words AS (SELECT doc_id, count(DISTINCT k) AS n FROM hits, LATERAL (SELECT unnest(range(i, i + m)) AS k) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(w.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.list, '')) AS items_sha256, w.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words w USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

COPIES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) > 1 THEN list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) ELSE l END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT g, count(*) AS f FROM s GROUP BY 1),
r AS (SELECT s.doc_id, g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f, g) AS k FROM s JOIN n USING (doc_id) JOIN f USING (g)),
p AS (SELECT doc_id, g, n FROM r WHERE k <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y USING (g) WHERE x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
v AS (SELECT a, b, count(*) AS shared FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY 1, 2),
e AS (SELECT a, b FROM v JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, links.b FROM reach JOIN links ON links.a = reach.y),
least_of AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN least_of USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OWNERS = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
FROM d WINDOW w AS (PARTITION BY bare ORDER BY points DESC, doc_id)
"""

# CRC-32 of a list of bytes: a table of 256 remainders, then one step a byte
CRC_TABLE = "(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i))"


def crc(data: str) -> str:
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


PREFIXES = rf"""
WITH c AS (SELECT conv_id, {crc("list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), {CRC_TABLE}),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h
  UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h),
l AS (SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS turns FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
p AS (SELECT conv_id, len(turns) AS size, d, turns[1:d] AS path FROM l, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends,
  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(any_value(path[d].text), '[^\x20\x09-\x0D]+')) END AS saved FROM p GROUP BY 1, 2),
k AS (SELECT n.path, n.d, count(m.path) AS n_children FROM n LEFT JOIN n m ON m.d = n.d + 1 AND m.path[1:n.d] = n.path GROUP BY 1, 2),
s AS (SELECT n.path, n.d, sum(m.saved) AS saved, count(*) FILTER (WHERE k.n_children = 0) AS leaves FROM n JOIN n m ON m.d >= n.d AND m.path[1:n.d] = n.path JOIN k ON k.path = m.path AND k.d = m.d GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, k.n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN k USING (path, d) JOIN s USING (path, d) LEFT JOIN n q ON q.d = n.d - 1 AND q.path = n.path[1:n.d - 1]
"""

SPELLINGS = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
b AS (SELECT run, n, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END)) AS bytes FROM runs),
h AS (SELECT run, n, {crc("bytes")} AS h FROM b, {CRC_TABLE}),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h
  GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (SELECT x.word AS a, y.word AS b FROM x JOIN x y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, w.word FROM x JOIN w ON w.word = x.rest UNION SELECT w.word, x.word FROM x JOIN w ON w.word = x.rest),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS near, first(w.n ORDER BY w.n DESC, b) AS near_n FROM pairs JOIN w ON w.word = b GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
ups(word, ends) AS (SELECT word, word FROM f UNION ALL SELECT ups.word, f.form FROM ups JOIN f ON f.word = ups.ends WHERE f.form IS NOT NULL)
SELECT f.word, f.form, ups.ends AS root, f.n, f.n_near, f.form_n FROM f JOIN ups USING (word) JOIN f AS g ON g.word = ups.ends AND g.form IS NULL
"""
