"""The named queries over a folder of tables, and their DuckDB SQL."""

from __future__ import annotations

from ..functions import DROPPED, ENTITIES, FUNCTION_WORDS
from ..operators import briefing, capture, check, compress, digest, graph, index, knowledge, props, quotes, ranking, segment, sketches, temporal
from ..sources import table
from ..streaming import activity_stream
from ..streaming.bursts import error_bursts
from ..streaming.windows import client_sessions, sliding_activity

WHAT = {
    "page_markdown": (capture.page_markdown, ["pages"]),
    "thread_markdown": (capture.thread_markdown, ["conversations"]),
    "qa_pairs": (capture.qa_pairs, ["conversations"]),
    "echoed_turns": (check.echoed_turns, ["conversations"]),
    "strip_function_words": (compress.strip_function_words, ["documents"]),
    "compression_stats": (compress.compression_stats, ["documents"]),
    "found_words": (segment.found_words, ["documents"]),
    "word_pieces": (segment.word_pieces, ["documents"]),
    "said_verbatim": (check.said_verbatim, ["benchmark", "documents"]),
    "said_overlap": (check.said_overlap, ["benchmark", "documents"]),
    "evidence": (check.evidence, ["benchmark", "documents"]),
    "check_report": (check.check_report, ["benchmark", "documents"]),
    "near_quotes": (quotes.near_quotes, ["benchmark", "documents"]),
    "said_nearly": (quotes.said_nearly, ["benchmark", "documents"]),
    "source_digest": (digest.source_digest, ["documents"]),
    "dedupe_exact": (digest.dedupe_exact, ["documents"]),
    "near_duplicates": (digest.near_duplicates, ["documents"]),
    "near_duplicate_members": (digest.near_duplicate_members, ["documents"]),
    "search_ranked": (digest.search_ranked, ["benchmark", "documents"]),
    "search_indexed": (index.search_indexed, ["benchmark", "documents"]),
    "search_top": (digest.search_top, ["documents"]),
    "digest_markdown": (digest.digest_markdown, ["documents"]),
    "activity_track": (digest.activity_track, ["events"]),
    "activity_baseline": (temporal.activity_baseline, ["clicks"]),
    "last_of_another_kind": (temporal.last_of_another_kind, ["clicks"]),
    "errors_before_purchases": (temporal.errors_before_purchases, ["clicks"]),
    "recent_activity": (temporal.recent_activity, ["clicks"]),
    "prop_keys": (props.prop_keys, ["clicks"]),
    "item_demand": (props.item_demand, ["clicks"]),
    "sketched_activity": (sketches.sketched_activity, ["clicks"]),
    "sliding_activity": (sliding_activity, ["clicks"]),
    "client_sessions": (client_sessions, ["clicks"]),
    "error_bursts": (error_bursts, ["clicks"]),
    "briefing": (briefing.briefing, ["documents"]),
    "links_mermaid": (graph.links_mermaid, ["pages"]),
    "link_authorities": (ranking.authorities, ["pages"]),
    "page_communities": (ranking.communities, ["pages"]),
    "hierarchy_mermaid": (graph.hierarchy_mermaid, ["region", "nation"]),
    "fragments": (knowledge.fragments, ["documents"]),
    "fragment_keywords": (knowledge.fragment_keywords, ["documents"]),
    "fragment_links": (knowledge.fragment_links, ["documents"]),
    "fragment_link_counts": (knowledge.fragment_link_counts, ["documents"]),
}


def queries() -> dict:
    found = {name: (lambda spark, folder, f=f, names=names: f(*[table(spark, folder, t) for t in names])) for name, (f, names) in WHAT.items()}
    return found | {"activity_stream": lambda spark, folder: activity_stream(spark, f"{folder}/events.parquet")}


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _shingles(words: str) -> str:
    return f"CASE WHEN len({words}) >= 5 THEN list_distinct(list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i + 4], ' '))) ELSE [] END"


def _html() -> str:
    x = "html"
    for tag in DROPPED:
        x = rf"regexp_replace({x}, '<{tag}\b.*?</{tag}>', '', 'gs')"
    x = f"regexp_replace({x}, '<!--.*?-->', '', 'gs')"
    x = rf"""regexp_replace({x}, '<div class="(?:ad|comments?|comment-section)">.*?</div>', '', 'gs')"""
    x = rf"regexp_replace({x}, '<h1>(.*?)</h1>', chr(10) || '# \1' || chr(10), 'gs')"
    x = f"regexp_replace({x}, '<li[^>]*>', chr(10) || '- ', 'g')"
    x = f"regexp_replace({x}, '<br[^>]*>|<p[^>]*>|</p>', chr(10), 'g')"
    x = f"regexp_replace(replace({x}, '<b>', ''), '<[^>]*>', '', 'g')"
    for name, char in ENTITIES:
        x = f"replace({x}, '{name}', '{char}')"
    return rf"regexp_replace(regexp_replace({x}, '\n[ \n]*', chr(10), 'g'), '^\n|\n$', '', 'g')"


TOKENS = r"regexp_extract_all(lower(text), '\p{L}+')"
LEXICON = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in FUNCTION_WORDS.items()) + " ELSE []::VARCHAR[] END"
CONTENT = "list_filter({}, lambda w: NOT list_contains(" + LEXICON + ", w))"
STOP = _list(sorted({w for v in FUNCTION_WORDS.values() for w in v}))
SHARED = f"""c AS (SELECT item_id, {_shingles("w")} AS s FROM (SELECT item_id, {TOKENS} AS w FROM benchmark)),
ce AS (SELECT item_id, len(s) AS n_claim, unnest(s) AS shingle FROM c),
de AS (SELECT doc_id, source, unnest({_shingles("w")}) AS shingle FROM (SELECT doc_id, source, {TOKENS} AS w FROM documents)),
sh AS (SELECT item_id, doc_id, source, n_claim, count(*) AS n_shared FROM de JOIN ce USING (shingle) GROUP BY ALL)"""
TOP = f"""t AS (SELECT source, doc_id, len(list_filter({TOKENS}, lambda w: w = 'the'))::BIGINT AS tf FROM documents),
top AS (SELECT source, doc_id, tf, row_number() OVER (PARTITION BY source ORDER BY tf DESC, doc_id NULLS FIRST) AS rank FROM t WHERE tf > 0 QUALIFY rank <= 3)"""
FRAGMENTS = r"f AS (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM documents WHERE n_chars < 200)"
TURNS = """c AS (SELECT coalesce(kind, 'none') AS kind, epoch_us(ts) AS us, epoch_us(coalesce(arrived_at, ts)) AS came FROM clicks {}),
t AS (SELECT *, (came - (SELECT min(came) FROM c)) * 4 // (SELECT max(came) - min(came) + 1 FROM c) AS turn FROM c), w AS (SELECT k AS turn, (SELECT max(us // 1000) - 43200000 FROM t WHERE turn < k) AS w FROM range(4) r(k))"""
EDGES = """e AS MATERIALIZED (SELECT DISTINCT page_id, target FROM (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)">', 1)) AS target FROM pages WHERE page_id IS NOT NULL))"""
#: Claims and texts that share four words in a row, each pair aligned as a whole; a cell is errors * 2^20 less the start, the best one errors * 2^40 and the end * 2^20 besides.
QUOTES = r"""c AS (SELECT row_number() OVER () AS ask, item_id, list_transform(regexp_extract_all(text, '\p{L}+'), lambda x: lower(x)) AS w FROM benchmark WHERE text IS NOT NULL),
d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, source, text, list_transform(regexp_extract_all(text, '\p{L}+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
p AS MATERIALIZED (SELECT DISTINCT ask, id FROM (SELECT ask, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM c WHERE len(w) >= 4)
     JOIN (SELECT id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM d WHERE len(w) >= 4) USING (g)),
x AS (SELECT item_id, doc_id, source, text, len(c.w) AS n_words, list_reduce(list_prepend(list_append(list_transform(range(0, len(c.w) + 1), lambda i: i * 1048576 + 1048575), len(c.w) * 1099511627776 + 1048575),
      list_transform(d.w, lambda y: list_transform(c.w, lambda z: (z <> y)::BIGINT))), lambda s, e, j:
      list_transform([list_transform(range(0, len(s) - 1), lambda i: CASE WHEN i = 0 THEN 1048576 - j ELSE least(s[i] + e[i] * 1048576, s[i + 1] + 1048576) END)], lambda t:
        list_transform([list_transform(range(1, len(t) + 1), lambda i: list_min(list_transform(t[1:i], lambda v, k: v + (i - k) * 1048576)))], lambda u:
          list_append(u, least(s[-1], (u[-1] >> 20) * 1099511627776 + (j - 1) * 1048576 + (u[-1] & 1048575))))[1])[1])[-1] AS b FROM p JOIN c USING (ask) JOIN d USING (id)),
q AS (SELECT item_id, doc_id, source, n_words, b >> 40 AS errors, 1048575 - (b & 1048575) AS first_word, (b >> 20) & 1048575 AS upto, regexp_extract_all(text, '\P{L}*\p{L}+') AS chunks FROM x WHERE b >> 40 <= (n_words - 4) // 5)"""
TIMED = "timed AS (SELECT click_id, client_id, coalesce(kind, 'none') AS kind, epoch_us(ts) AS us FROM clicks)"
KEYWORDS = (
    FRAGMENTS
    + ", fw AS (SELECT doc_id, unnest("
    + CONTENT.format(r"regexp_extract_all(lower(clean), '\p{L}+')")
    + ") AS word FROM f), kw AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, word) AS rank, word, count(*) AS n FROM fw GROUP BY doc_id, word QUALIFY rank <= 5)"
)


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    return found | {"search_indexed": found["search_ranked"], "link_authorities": _authorities()}


def _authorities() -> str:
    steps = [EDGES, "h0 AS MATERIALIZED (SELECT DISTINCT page_id, 1.0::DOUBLE AS v FROM e)"]
    for k in range(1, ranking.ROUNDS + 1):
        for new, old, key, by in (("a", f"h{k - 1}", "target", "page_id"), ("h", f"a{k}", "page_id", "target")):
            steps.append(f"{new}{k}s AS MATERIALIZED (SELECT {key}, sum(v) AS v FROM e JOIN {old} USING ({by}) GROUP BY {key}), {new}{k} AS MATERIALIZED (SELECT {key}, v / (SELECT max(v) FROM {new}{k}s) AS v FROM {new}{k}s)")
    return f"WITH {', '.join(steps)} SELECT target, count(*) AS n_pages, round(any_value(v), 6) AS authority FROM e JOIN a{ranking.ROUNDS} USING (target) GROUP BY target"


def _oracle_sql() -> dict[str, str]:
    return {
        "page_markdown": rf"SELECT page_id, url, replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&amp;', '&') AS title, {_html()} AS markdown FROM pages",
        "thread_markdown": "SELECT conv_id, count(*) AS n_turns, string_agg('**' || coalesce(role, 'unknown') || '**: ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn NULLS LAST, '**' || coalesce(role, 'unknown') || '**: ' || coalesce(text, '')) AS markdown FROM conversations GROUP BY conv_id",
        "qa_pairs": "SELECT conv_id, turn, text AS question, answer FROM (SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST)) WHERE role = 'user'",
        "strip_function_words": f"SELECT doc_id, lang, array_to_string({CONTENT.format(TOKENS)}, ' ') AS compressed FROM documents",
        "compression_stats": f"SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS chars_before, sum(length(x))::BIGINT AS chars_after, round(sum(length(x)) / nullif(sum(length(text)), 0), 6) AS ratio FROM (SELECT lang, text, array_to_string({CONTENT.format(TOKENS)}, ' ') AS x FROM documents) GROUP BY lang",
        "near_quotes": f"""WITH {QUOTES} SELECT item_id, doc_id, source, n_words, errors, first_word, upto - first_word AS n_quoted,
(list_sum(list_transform(chunks[1:first_word + 1], lambda x: length(x))) - length(regexp_extract(chunks[first_word + 1], '\\p{{L}}+')))::BIGINT AS first_char, list_sum(list_transform(chunks[1:upto], lambda x: length(x)))::BIGINT AS end_char FROM q""",
        "said_nearly": f"WITH {QUOTES} SELECT item_id, source, count(*) AS n_docs, count(*) FILTER (errors > 0) AS n_changed, min(errors) AS fewest_errors FROM q GROUP BY item_id, source",
        "found_words": r"""WITH r AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}{1,256}')) AS run FROM documents) GROUP BY run),
p AS (SELECT n, '^' || run || '$' AS run FROM r), l AS (SELECT n, run, unnest(range(1, length(run) + 1)) AS i FROM p),
g AS MATERIALIZED (SELECT word, length(word) AS k, sum(n)::BIGINT AS n FROM (SELECT n, run[i:i + k - 1] AS word FROM l, range(1, 6) t(k) WHERE i + k <= length(run) + 1) GROUP BY word),
h AS (SELECT word, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS f FROM (SELECT word[1:k - 1] AS word, n FROM g WHERE k > 1) WHERE word NOT LIKE '%^%' AND word NOT LIKE '%$%' GROUP BY word),
b AS (SELECT word, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS f FROM (SELECT word[2:] AS word, n FROM g WHERE k > 1) WHERE word NOT LIKE '%^%' AND word NOT LIKE '%$%' GROUP BY word),
i AS (SELECT * FROM g WHERE word NOT LIKE '%^%' AND word NOT LIKE '%$%' AND k <= 4), c AS (SELECT word, n, word[1:s] AS a, word[s + 1:] AS b FROM i, range(1, 4) t(s) WHERE s < k AND k > 1 AND n >= 4),
t AS (SELECT c.word, round(min(ln(c.n * (SELECT sum(n) FROM i WHERE k = 1)::DOUBLE / (x.n::DOUBLE * y.n))), 6) AS cohesion FROM c JOIN i x ON x.word = c.a JOIN i y ON y.word = c.b GROUP BY c.word)
SELECT word, n, cohesion, least(h.f, b.f) AS freedom FROM i JOIN t USING (word) JOIN h USING (word) JOIN b USING (word) WHERE cohesion >= 1.5 AND least(h.f, b.f) >= 0.7""",
        "said_verbatim": "SELECT item_id, source, count(*) AS n_docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id, source",
        "said_overlap": f"WITH {SHARED} SELECT item_id, source, max(n_shared) AS best_shared FROM sh GROUP BY item_id, source",
        "evidence": f"WITH {SHARED} SELECT item_id, doc_id, n_shared, round(n_shared / n_claim, 6) AS coverage FROM sh",
        "check_report": f"""WITH {SHARED}, g AS (SELECT item_id, count(*) AS n_docs, count(DISTINCT source) AS n_sources, max(round(n_shared / n_claim, 6)) AS best_coverage FROM sh GROUP BY item_id),
w AS (SELECT DISTINCT item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT b.item_id, coalesce(n_docs, 0)::BIGINT AS n_docs, coalesce(n_sources, 0)::BIGINT AS n_sources, coalesce(best_coverage, 0.0::DOUBLE) AS best_coverage,
CASE WHEN w.item_id IS NOT NULL THEN 'verbatim' WHEN n_docs > 0 THEN 'partial' ELSE 'none_found' END AS support FROM benchmark b LEFT JOIN g USING (item_id) LEFT JOIN w USING (item_id)""",
        "source_digest": "SELECT source, lang, grouping(source, lang)::BIGINT AS level, count(*) AS n_docs, count(DISTINCT text) AS n_distinct, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)",
        "dedupe_exact": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS FIRST, source NULLS FIRST) = 1",
        "near_duplicates": f"""WITH s AS (SELECT doc_id, list_sort({_shingles("w")}) AS s FROM (SELECT doc_id, {TOKENS} AS w FROM documents)),
r AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s), e AS (SELECT id, n, unnest(s) AS h FROM r),
p AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM e x JOIN e y ON x.h = y.h AND x.id < y.id GROUP BY ALL)
SELECT a, b, round(shared / (na + nb - shared), 6) AS jaccard FROM p WHERE shared / (na + nb - shared) >= 0.75""",
        "near_duplicate_members": f"""WITH s AS (SELECT doc_id, list_sort({_shingles("w")}) AS s FROM (SELECT doc_id, {TOKENS} AS w FROM documents))
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM s WHERE len(s) > 0""",
        "search_top": f"WITH {TOP} SELECT * FROM top",
        "digest_markdown": f"""WITH {TOP}, l AS (SELECT source, string_agg('- document ' || coalesce(doc_id::VARCHAR, 'none') || ': ' || tf, chr(10) ORDER BY rank) AS lines FROM top GROUP BY source)
SELECT d.source, '## ' || coalesce(d.source, 'unknown') || chr(10) || chr(10) || count(*) || ' documents, ' || coalesce(sum(length(text)), 0) || ' characters' || chr(10) || chr(10) || 'Most `the`:' || chr(10) || coalesce(any_value(lines), '- none') AS markdown FROM documents d LEFT JOIN l ON d.source IS NOT DISTINCT FROM l.source GROUP BY d.source""",
        "activity_track": """WITH n AS (SELECT ts::DATE AS d, event_type, count(*) AS n FROM events GROUP BY ALL), f AS (SELECT event_type, min(d) AS first FROM n GROUP BY ALL)
SELECT strftime(n.d, '%Y-%m-%d') AS day, n.event_type, n.n, CASE WHEN n.d > f.first THEN n.n - coalesce(b.n, 0) END AS delta
FROM n JOIN f ON n.event_type IS NOT DISTINCT FROM f.event_type LEFT JOIN n b ON b.event_type IS NOT DISTINCT FROM n.event_type AND b.d = n.d - 1""",
        "activity_baseline": """WITH n AS (SELECT kind, ts::DATE AS d, count(*) AS n FROM clicks WHERE ts IS NOT NULL GROUP BY ALL),
c AS (SELECT kind, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM n GROUP BY kind),
f AS (SELECT c.kind, c.d, coalesce(n.n, 0) AS n FROM c LEFT JOIN n ON n.kind IS NOT DISTINCT FROM c.kind AND n.d = c.d),
g AS (SELECT kind, d, n, count(*) OVER w AS c, (sum(n) OVER w)::BIGINT AS s, (sum(n * n) OVER w)::BIGINT AS q, lag(n) OVER (PARTITION BY kind ORDER BY d) AS n_before FROM f
      WINDOW w AS (PARTITION BY kind ORDER BY d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT strftime(d, '%Y-%m-%d') AS day, kind, n, n_before, c AS n_days, round(s / nullif(c, 0), 6) AS mean, CASE WHEN c * q - s * s > 0 THEN round((n * c - s) / sqrt((c * q - s * s)::DOUBLE), 6) END AS deviation FROM g""",
        "sliding_activity": f"""WITH {TURNS.format("WHERE ts IS NOT NULL")}, x AS (SELECT turn, kind, us // 7200000000 * 2 - 2 * k AS start_hour FROM t, range(3) r(k))
SELECT start_hour, kind, count(*) AS n FROM x JOIN w USING (turn) WHERE (start_hour + 6) * 3600000 > coalesce(w, 0) AND (start_hour + 6) * 3600000 <= (SELECT max(us // 1000) - 43200000 FROM t) GROUP BY ALL""",
        "error_bursts": """WITH e AS (SELECT client_id, epoch_us(ts) // 60000000 AS m FROM clicks WHERE kind = 'error' AND client_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT *, m - lag(m) OVER (PARTITION BY client_id ORDER BY m) > 120 AS new FROM e), g AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY client_id ORDER BY m) AS g FROM b)
SELECT client_id, min(m) AS first_minute, max(m) AS last_minute, count(*) AS n FROM g GROUP BY client_id, g
HAVING count(*) >= 3 AND max(m) + 120 < (SELECT (max(epoch_us(ts)) // 1000 - 345600000) // 60000 FROM clicks WHERE kind = 'error' AND client_id IS NOT NULL)""",
        "prop_keys": r"""WITH j AS (SELECT CASE WHEN json_valid(props) THEN props END AS p FROM clicks WHERE props IS NOT NULL),
t AS (SELECT regexp_replace(x.fullkey, '\[\d+\]', '[]', 'g') AS path, CASE x.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, x.atom ->> '$' AS atom FROM j, json_tree(j.p) x)
SELECT path, kind, count(*) AS n, count(DISTINCT CASE WHEN kind = 'number' THEN (atom::DOUBLE)::VARCHAR WHEN kind = 'string' THEN atom END) AS n_different, min(CASE WHEN kind = 'number' THEN atom::DOUBLE END) AS low, max(CASE WHEN kind = 'number' THEN atom::DOUBLE END) AS high FROM t GROUP BY ALL
UNION ALL SELECT NULL, CASE WHEN props IS NULL THEN 'missing' ELSE 'bad' END, count(*), 0, NULL, NULL FROM clicks WHERE props IS NULL OR NOT json_valid(props) GROUP BY ALL""",
        "item_demand": """WITH i AS (SELECT row, i -> 'sku' AS sku, i -> 'qty' AS qty FROM (SELECT row, unnest(CASE WHEN json_type(p, '$.items') = 'ARRAY' THEN json_extract(p, '$.items[*]') ELSE [] END) AS i FROM (SELECT row_number() OVER () AS row, CASE WHEN json_valid(props) THEN props END AS p FROM clicks)))
SELECT sku::BIGINT AS sku, count(DISTINCT row) AS n_clicks, sum(coalesce(CASE WHEN json_type(qty) IN ('UBIGINT', 'BIGINT') THEN qty::BIGINT END, 0))::BIGINT AS quantity FROM i WHERE json_type(sku) IN ('UBIGINT', 'BIGINT') GROUP BY 1""",
        "sketched_activity": """WITH k AS (SELECT coalesce(kind, 'none') AS kind, client_id, ts::DATE AS day FROM clicks WHERE ts IS NOT NULL)
SELECT kind, count(*) AS n, count(DISTINCT day) AS n_days, count(DISTINCT client_id) AS n_clients, true AS clients_within, count(DISTINCT day) AS n_medians_within FROM k GROUP BY kind""",
        "page_communities": f"""WITH RECURSIVE {EDGES}, t AS MATERIALIZED (SELECT page_id, target FROM e WHERE target IN (SELECT target FROM e GROUP BY target HAVING count(*) BETWEEN 2 AND 4)),
n AS MATERIALIZED (SELECT DISTINCT x.page_id AS a, y.page_id AS b FROM t x JOIN t y USING (target)), p AS MATERIALIZED (SELECT DISTINCT page_id FROM pages WHERE page_id IS NOT NULL),
r AS (SELECT page_id, page_id AS reach FROM p UNION SELECT r.page_id, n.b FROM r JOIN n ON r.reach = n.a), c AS (SELECT page_id, min(reach) AS community FROM r GROUP BY page_id)
SELECT page_id, community, count(*) OVER (PARTITION BY community) AS n_pages FROM c""",
        "last_of_another_kind": f"""WITH {TIMED}, e AS (SELECT *, row_number() OVER (ORDER BY us, click_id NULLS FIRST, kind) AS rn FROM timed WHERE client_id IS NOT NULL AND us IS NOT NULL),
w AS (SELECT e.*, k.kind AS wanted FROM e JOIN (SELECT DISTINCT kind FROM e) k ON k.kind <> e.kind),
p AS (SELECT w.rn, max_by({{'id': b.click_id, 'kind': b.kind, 'us': b.us}}, b.rn) AS x FROM w ASOF JOIN e b ON b.client_id = w.client_id AND b.kind = w.wanted AND b.rn < w.rn GROUP BY w.rn)
SELECT click_id, kind, x.id AS other_id, x.kind AS other_kind, us - x.us AS gap_us FROM e LEFT JOIN p USING (rn) UNION ALL SELECT click_id, kind, NULL, NULL, NULL FROM timed WHERE client_id IS NULL OR us IS NULL""",
        "errors_before_purchases": f"""WITH {TIMED} SELECT p.click_id AS purchase_id, e.click_id AS error_id, p.us - e.us AS gap_us FROM timed p JOIN timed e ON p.client_id = e.client_id AND e.us BETWEEN p.us - 3600000000 AND p.us AND p.kind = 'purchase' AND e.kind = 'error'""",
        "recent_activity": f"""WITH {TIMED}, w AS (SELECT click_id, count(*) OVER (PARTITION BY client_id, kind ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n_same,
count(*) OVER (PARTITION BY client_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n_all FROM timed WHERE client_id IS NOT NULL AND us IS NOT NULL)
SELECT click_id, n_same, n_all - n_same AS n_other FROM w UNION ALL SELECT click_id, 0, 0 FROM timed WHERE client_id IS NULL OR us IS NULL""",
        "links_mermaid": """SELECT page_id, array_to_string(list_concat(['graph LR' || chr(10) || '  p["' || coalesce(url, 'unknown') || '"]'], list_transform(regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)">', 1), lambda t, i: '  p --> n' || (i - 1) || '["' || t || '"]')), chr(10)) AS mermaid FROM pages""",
        "hierarchy_mermaid": """SELECT r_regionkey, 'graph TD' || chr(10) || '  r["' || coalesce(r_name, 'unknown') || '"]' || coalesce(chr(10) || string_agg('  r --> n' || n_nationkey || '["' || coalesce(n_name, 'unknown') || '"]', chr(10) ORDER BY n_nationkey, n_name NULLS FIRST), '') AS mermaid FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
        "fragments": f"WITH {FRAGMENTS} SELECT * FROM f",
        "fragment_keywords": f"WITH {KEYWORDS} SELECT * FROM kw",
        "fragment_links": f"""WITH {KEYWORDS}, ks AS (SELECT doc_id, list_sort(list(word)) AS words FROM kw WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1),
c AS (SELECT doc_id, len(words) AS n, min(doc_id) OVER (PARTITION BY words) AS rep FROM ks), r AS (SELECT doc_id, word FROM kw WHERE doc_id IN (SELECT rep FROM c))
SELECT a.doc_id, b.doc_id AS linked_doc, count(*) AS n_shared, false AS same_set FROM r a JOIN r b ON a.word = b.word AND a.doc_id > b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) > 1
UNION ALL SELECT doc_id, rep, n, true FROM c WHERE doc_id <> rep""",
        "fragment_link_counts": f"""WITH {KEYWORDS}, ks AS (SELECT doc_id, list_sort(list(word)) AS words FROM kw WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY words) AS class_id, count(*) OVER (PARTITION BY words) AS class_size FROM ks),
l AS (SELECT a.doc_id, b.doc_id AS other FROM kw a JOIN kw b ON a.word = b.word AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) > 1)
SELECT c.doc_id, class_id, class_size, count(other) AS n_links FROM c LEFT JOIN l ON l.doc_id = c.doc_id GROUP BY ALL""",
        "echoed_turns": f"""WITH t AS MATERIALIZED (SELECT conv_id, turn, role, row_number() OVER () AS id, {TOKENS} AS w FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL), e AS (SELECT id, conv_id, turn, role, unnest({_shingles("w")}) AS s FROM t),
m AS (SELECT x.id, x.s FROM e x JOIN e y ON x.conv_id = y.conv_id AND x.s = y.s AND y.turn < x.turn AND x.role <> y.role GROUP BY ALL)
SELECT conv_id, turn, role, (SELECT count(*) FROM e WHERE e.id = t.id) AS n_said, (SELECT count(*) FROM m WHERE m.id = t.id) AS n_echoed FROM t""",
        "search_ranked": f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {TOKENS} AS w FROM documents), n AS (SELECT count(*) AS n, avg(coalesce(len(w), 0)) AS mean FROM d),
q AS (SELECT item_id, unnest(list_distinct(list_filter({TOKENS}, lambda w: NOT list_contains({STOP}, w)))) AS word FROM benchmark),
e AS (SELECT id, doc_id, len(w) AS length, unnest(w) AS word FROM d), tf AS (SELECT id, doc_id, length, word, count(*) AS tf FROM e WHERE word IN (SELECT word FROM q) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
s AS (SELECT item_id, id, doc_id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / n.mean))), 6) AS score FROM tf JOIN df USING (word) JOIN q USING (word), n GROUP BY item_id, id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM s QUALIFY rank <= 5""",
        "activity_stream": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    }
