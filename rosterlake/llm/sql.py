"""DuckDB SQL of the queries that SQL can express."""

OP2 = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), q AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS raw_host, r FROM p
), h AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(r, length(raw_host) + 1) AS rest
  FROM q
), k AS (
  SELECT page_id, host, regexp_extract(rest, '^[^?#]*') AS path, host || rest AS target FROM h
), w AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM k
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(target, '(^|[^0-9A-Za-z_%])(spam|casino|porn|xxx|viagra|phishing|malware|doubleclick|adserver)($|[^0-9A-Za-z_%])') THEN 'block'
  WHEN regexp_matches(target, '\.exe($|[^0-9A-Za-z_%])') THEN 'block'
  WHEN regexp_matches(target, '(?s)(^|[^0-9A-Za-z_%])login($|[^0-9A-Za-z_%])(.*[^0-9A-Za-z_%])?redirect($|[^0-9A-Za-z_%])') THEN 'block'
  ELSE 'allow' END AS verdict
FROM w
"""

OP6 = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM t
), f AS (
  SELECT *, cap / weight AS ratio,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), g AS (
  SELECT *, CASE WHEN ratio <= level THEN cap ELSE weight * (SELECT arg_min(level, (ratio, rank)) FROM f WHERE ratio > level) END AS target,
    CAST(ceil(source_size / 64.0::DOUBLE) AS BIGINT) AS blocks
  FROM f
), h AS (
  SELECT *, least(CASE WHEN source_size > 0 THEN CAST(round(target * blocks / source_size) AS BIGINT) ELSE 0 END, 2 * blocks) AS slots FROM g
), m AS (
  SELECT greatest(least(CAST(ceil(sum(slots) / 1024.0::DOUBLE) AS BIGINT), 65536), 1) AS shards FROM h
), d AS (
  SELECT rank, blocks, unnest(range(slots)) AS draw FROM h
), i AS (
  SELECT rank, blocks, draw, CAST(('0x' || substr(md5('17:' || rank || ':' || draw), 1, 8))::BIGINT * shards // 4294967296 AS BIGINT) AS shard FROM d, m
), j AS (
  SELECT rank, blocks, shard, row_number() OVER (PARTITION BY rank ORDER BY shard, draw) - 1 AS slot FROM i
), c AS (
  SELECT rank, shard, CAST(((slot % blocks)::HUGEINT * (([1000000000000000003, 1000000000000000009, 1000000000000000031, 1000000000000000079, 1000000000000000177, 1000000000000000183, 1000000000000000201])[((rank + slot // blocks) % 7) + 1] % blocks)
      + ((rank + slot // blocks + 1) * 7919) % blocks) % blocks AS BIGINT) AS block
  FROM j
), n AS (
  SELECT rank, block, count(*) AS times, min(shard) AS block_shard FROM c GROUP BY ALL
), p AS (
  SELECT s.doc_id, s.size, h.rank, h.source_size, h.target,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY h.rank ORDER BY s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM s JOIN h ON s.source IS NOT DISTINCT FROM h.source
), e AS (
  SELECT *, CASE WHEN size > 0 THEN unnest(range(place // 64, (place + greatest(size, 1) - 1) // 64 + 1)) END AS block FROM p
), r AS (
  SELECT e.*, least(place + size, (block + 1) * 64) - greatest(place, block * 64) AS words, coalesce(times, 0) AS times, block_shard
  FROM e LEFT JOIN n USING (rank, block)
)
SELECT doc_id, size, source_size, target, CAST(coalesce(sum(words * times), 0) AS BIGINT) AS taken, min(block_shard) AS first_shard
FROM r WHERE size > 0 OR block IS NULL GROUP BY doc_id, rank, place, size, source_size, target
"""

OP9 = r"""
WITH i AS (
  SELECT item_id, w, least(5, len(w)) AS gram FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) > 0
), s AS (
  SELECT DISTINCT item_id, gram, array_to_string(w[k:k + gram - 1], ' ') AS shingle
  FROM (SELECT item_id, gram, w, unnest(range(1, len(w) - gram + 2)) AS k FROM i)
), n AS (
  SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id
), d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, gram, array_to_string(w[k:k + gram - 1], ' ') AS shingle
  FROM (SELECT doc_id, gram, w, unnest(range(1, len(w) - gram + 2)) AS k FROM d, (SELECT DISTINCT gram FROM i))
), h AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM g JOIN s USING (gram, shingle) GROUP BY ALL
)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM h JOIN n USING (item_id)
WHERE 10 * n_shared >= 8 * n_item
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s AS x JOIN s AS y USING (shingle) JOIN n AS nx ON nx.doc_id = x.doc_id JOIN n AS ny ON ny.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, nx.n, ny.n
  HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

OP13 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, array_to_string(w[k:k + 1], ' ') FROM (SELECT lang, w, unnest(range(1, len(w))) AS k FROM w)
  UNION ALL SELECT lang, 3, array_to_string(w[k:k + 2], ' ') FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS k FROM w)
), f AS (
  SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL
), t AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND n >= 10
), k AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
), s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.n AS l, y.n AS r, CAST(1000000::HUGEINT * k.a * k.a // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM k JOIN f AS x ON x.lang = k.lang AND x.phrase = k.head JOIN f AS y ON y.lang = k.lang AND y.phrase = k.tail
), b AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM s
), h AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE m = 3) GROUP BY ALL
), o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE place = 1 AND (longer IS NULL OR 100 * longer < 50 * a)
)
SELECT o.lang, rank, phrase, a, l, r, t.n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000
"""
