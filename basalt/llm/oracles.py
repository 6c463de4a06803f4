"""DuckDB SQL for the queries of this subpackage that SQL can express."""

MIXING = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0))::DOUBLE AS level
      FROM w WINDOW r AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(level, cap::DOUBLE / weight) FROM l WHERE cap >= level * weight)) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS coin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + (coin < rate - floor(rate))::BIGINT))::BIGINT AS taken FROM r
"""

LINES = r"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM x),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS lost FROM k LEFT JOIN o ON k.key = o.key AND length(k.key) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

EXACT = r"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

NEAR = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM t),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
g AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS reach FROM t UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.reach = g.a),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM t JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: crc32 by bits, over the decimal digits.
PANES = r"""
WITH d AS (SELECT * FROM clicks WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY arrived_at NULLS FIRST, ts, kind NULLS FIRST, value NULLS FIRST) = 1),
i AS (SELECT *, CASE WHEN click_id IS NOT NULL THEN 4294967295::BIGINT - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(click_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))) END AS crc,
      date_diff('day', DATE '1970-01-01', coalesce(arrived_at, ts)::DATE)::BIGINT AS day FROM d),
b AS (SELECT click_id, coalesce(kind, 'none') AS kind, least(7, (day % 8 + 8) % 8 + coalesce(greatest(0, crc % 30 - 23), 0)) AS batch, epoch_us(ts) - (day - (day % 8 + 8) % 8) * 86400000000 AS event,
      CASE WHEN isfinite(value) AND abs(value * 100 + 0.5) < 9e15 THEN floor(value * 100 + 0.5)::BIGINT ELSE 0 END AS cents FROM i),
h AS (SELECT *, floor(event / 3600000000.0)::BIGINT AS hour FROM b),
w AS (SELECT k AS batch, (SELECT max(event) FROM h WHERE h.batch < k) AS w FROM range(8) r(k)),
l AS (SELECT h.*, coalesce(w >= (hour + 97) * 3600000000, false) AS late FROM h JOIN w USING (batch)),
a AS (SELECT batch, kind, hour, count(*) AS n, sum(cents) AS c FROM l WHERE NOT late GROUP BY ALL),
c AS (SELECT batch, kind, hour, sum(n) OVER p AS n, sum(c) OVER p AS c, coalesce(sum(n) OVER q, 0) AS old_n, coalesce(sum(c) OVER q, 0) AS old_c FROM a
      WINDOW p AS (PARTITION BY kind, hour ORDER BY batch), q AS (PARTITION BY kind, hour ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT kind, hour, min(batch) AS first FROM a GROUP BY ALL),
e AS (SELECT kind, hour, (SELECT min(w.batch) FROM w WHERE w.batch >= first AND w.w >= (hour + 7) * 3600000000) AS due FROM f),
t AS (SELECT kind, hour, due, coalesce(due, 7) AS told, max_by(c.n, c.batch) AS n, max_by(c.c, c.batch) AS c FROM c JOIN e USING (kind, hour) WHERE c.batch <= coalesce(due, 7) GROUP BY ALL),
o AS (SELECT batch, hour, click_id, 1 AS n_rows, cents, 'late' AS record, kind FROM l WHERE late
UNION ALL SELECT told, hour, -1, n, c, CASE WHEN due IS NULL THEN 'final' ELSE 'emit' END, kind FROM t
UNION ALL SELECT batch, hour, -1, old_n, old_c, 'retract', kind FROM c JOIN e USING (kind, hour) WHERE batch > due
UNION ALL SELECT batch, hour, -1, n, c, 'replace', kind FROM c JOIN e USING (kind, hour) WHERE batch > due)
SELECT batch::BIGINT AS batch, hour::BIGINT AS hour, click_id::BIGINT AS click_id, n_rows::BIGINT AS n_rows, cents::BIGINT AS cents, record, kind FROM o
"""
