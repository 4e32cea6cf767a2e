"""SQL that must give the rows of the training-data queries, written from their definitions and not from their methods."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Every byte string of 50 bytes with the smallest document it starts in; bytes as pairs of hex digits.
REPEATED_BYTES_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (
  SELECT doc_id, unnest(range(0, length(h) // 2)) AS b,
    unnest(list_transform(range(0, length(h) // 2), lambda b: substr(h, 2 * b + 1, 2))) AS byte FROM docs
), windows AS (
  SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS b,
    unnest(list_transform(range(0, length(h) // 2 - 49), lambda b: md5(substr(h, 2 * b + 1, 100)))) AS w FROM docs
),
firsts AS (SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w),
hits AS (SELECT doc_id, b AS hit FROM windows JOIN firsts USING (w) WHERE first_doc < doc_id),
marked AS (
  SELECT p.doc_id, b, byte,
    coalesce(b - max(hit) OVER (PARTITION BY p.doc_id ORDER BY b) < 50, false) AS gone
  FROM places p LEFT JOIN hits x ON x.doc_id = p.doc_id AND x.hit = p.b
), runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY b), false) AS begins FROM marked),
summed AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
    string_agg(byte, '' ORDER BY b) FILTER (NOT gone) AS kept
  FROM runs GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN summed USING (doc_id)
"""

# Every sequence of 13 words with the smallest document it starts in.
REPEATED_WORDS_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), places AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS b, unnest(ws) AS word FROM docs),
windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS b,
    unnest(list_transform(range(1, len(ws) - 11), lambda b: array_to_string(ws[b:b + 12], ' '))) AS w FROM docs
),
firsts AS (SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w),
hits AS (SELECT doc_id, b AS hit FROM windows JOIN firsts USING (w) WHERE first_doc < doc_id),
marked AS (
  SELECT p.doc_id, b, word, coalesce(b - max(hit) OVER (PARTITION BY p.doc_id ORDER BY b) < 13, false) AS gone
  FROM places p LEFT JOIN hits x ON x.doc_id = p.doc_id AND x.hit = p.b
), summed AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY b) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN summed USING (doc_id)
"""

# All inner products of the query vectors; whole numbers below 2^53, so doubles are exact.
NEAREST_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def phrases_sql(min_count: int = 30, drop_percent: int = 80, top: int = 2000) -> str:
    """All word sequences of 1 to 4 words, counted, cut, compared with longer ones and ranked."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {' || chr(32) || '.join(f'w{i}' for i in range(1, k + 1))} AS phrase, {k} AS k, count(*) AS a "
        f"FROM grams WHERE w{k} IS NOT NULL GROUP BY ALL"
        for k in range(1, 5)
    )
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t
  FROM documents
), pieces AS (
  SELECT d, lang, unnest(ps) AS piece, unnest(range(len(ps))) AS p
  FROM (SELECT d, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS ps FROM texts)
), words AS (
  SELECT d, lang, p, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT d, lang, p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces)
), grams AS (
  SELECT lang, w AS w1, lead(w, 1) OVER q AS w2, lead(w, 2) OVER q AS w3, lead(w, 3) OVER q AS w4
  FROM words WINDOW q AS (PARTITION BY d, p ORDER BY i)
), f AS ({grams}),
candidates AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {min_count}),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[j + 1:], ' ')
), lowest AS (
  SELECT lang, phrase, a, l, r, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS n FROM cuts) WHERE n = 1
), parts AS (
  SELECT lang, a, array_to_string(ws[s:s + n - 1], ' ') AS part
  FROM (SELECT *, unnest(range(1, k - n + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS n FROM candidates))
), dropped AS (
  SELECT DISTINCT p.lang, p.part FROM parts p JOIN f ON f.lang = p.lang AND f.phrase = p.part
  WHERE 100 * p.a >= {drop_percent} * f.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest ANTI JOIN dropped ON lowest.lang = dropped.lang AND lowest.phrase = dropped.part
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) USING (lang)
WHERE rank <= {top}
"""


def linked_sql(shingle_words: int = 3, similarity_percent: int = 85) -> str:
    """All pairs of shingle sets that share a shingle, and everything reachable over the links."""
    return rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < {shingle_words} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {shingle_words - 2}), lambda i: array_to_string(ws[i:i + {shingle_words - 1}], ' ')) END) AS s FROM docs)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * both_have >= {similarity_percent} * (p.n + q.n - both_have)
), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, w.y FROM reached r JOIN ways w ON r.y = w.x
), components AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM components LEFT JOIN sizes USING (doc_id)
"""
