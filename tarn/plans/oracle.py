"""DuckDB SQL that says the same as the suite's plans, written on its own: nothing of the plans'
functions is imported, so a wrong range, fold, pattern or constant on one side shows."""

from __future__ import annotations

# Token characters, what the fold maps to their lower case, and the hash's constants.
TOKEN = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{4FF}\x{590}-\x{6FF}\x{900}-\x{DFF}\x{1F00}-\x{1FFF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
SMALL = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþαβγδεζηθικλμνξοπρστυφχψωабвгдежзийклмнопрстуфхцчшщъыьэюя"
PAIRED = [chr(c) for c in range(0x100, 0x24F, 2) if c not in (0x1C4, 0x1C6, 0x1C8, 0x1CA, 0x1CC)]  # the next code point is the small one
FNV_OFFSET, FNV_PRIME = 1469598103934665603, 1099511628211

# Patterns of markup: an element of the dropped kinds whole, any tag, a comment.
_DROPPED = "|".join(
    rf"</?{name}(?:[ \t\n](?:[^>]*[^/>])?|/[^>]*[^/>])?(?:\z|>(?:\z|[\s\S]*?(?:\z|</{name}(?:[ \t\n/][^>]*)?(?:\z|>))))"
    for name in ("script", "style", "noscript", "template", "svg", "head", "nav", "footer", "header", "aside")
)
_ANY = rf"{_DROPPED}|<[^>]*(?:\z|>)"
_COMMENTED = rf"(?i)<!--[\s\S]*?(?:\z|-->)|({_ANY})"
_MARKED_BY = "\ufffe"

# Inline robots files for two hosts of the test data and one that isn't there.
ROBOTS_BODIES = [
    ("https://www.lumenquarry.example", "# all\nUser-agent: *\nDisallow: /tag/\nAllow: /tag/vumolatuga\nDisallow:\n\nUser-agent: otherbot\nDisallow: /\n"),
    ("https://docs.ragolikile.invalid", "User-Agent: Tarn-Bot\nDisallow: /node # nodes\nAllow: /node\nDisallow: /notes/\nUser-agent: *\nDisallow: /wiki"),
    ("https://nowhere.example", "Disallow: /before\nUser-agent: x\nUser-agent: *\nALLOW : /a\ndisallow:/b?c\nSitemap: /s\n"),
]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tokens(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), {_q(CAPITALS + ''.join(PAIRED))}, {_q(SMALL + ''.join(chr(ord(c) + 1) for c in PAIRED))}), '{TOKEN}')"


_LATEST = """latest AS (
  SELECT DISTINCT ON (coalesce(d.url, ''), d.seq) d.* REPLACE (coalesce(d.url, '') AS url)
  FROM docs d JOIN (SELECT coalesce(url, '') AS u, max(seq) AS s FROM docs GROUP BY 1) m ON coalesce(d.url, '') = m.u AND d.seq = m.s)"""
_DOCS_POSTINGS = f"""{_LATEST},
tokens AS (
  SELECT doc_id, unnest({_tokens('title')}) AS term, 3 AS weight FROM latest
  UNION ALL SELECT doc_id, unnest({_tokens('snippet')}), 1 FROM latest
  UNION ALL SELECT doc_id, unnest({_tokens('content')}), 1 FROM latest),
postings_ AS (SELECT term, doc_id, CAST(sum(weight) AS BIGINT) AS tf FROM tokens GROUP BY 1, 2),
lengths AS (
  SELECT d.doc_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS dl
  FROM (SELECT DISTINCT doc_id FROM latest) d LEFT JOIN postings_ p ON d.doc_id = p.doc_id GROUP BY 1)"""
_CORPUS_POSTINGS = f"""tokens AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents),
postings_ AS (SELECT term, doc_id, count(*) AS tf FROM tokens GROUP BY 1, 2),
lengths AS (
  SELECT d.doc_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS dl
  FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN postings_ p ON d.doc_id = p.doc_id GROUP BY 1)"""


def _scores(terms: list[str], k1: float = 1.2, b: float = 0.75) -> str:
    listed = ", ".join(map(_q, sorted(set(terms))))
    return f"""corpus AS (SELECT count(*) AS ndocs, sum(dl)::DOUBLE / count(*) AS avgdl FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM postings_ WHERE term IN ({listed}) GROUP BY 1),
scores AS (
  SELECT p.doc_id, sum(ln(1::DOUBLE + (ndocs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
    * (tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))) ORDER BY p.term) AS score
  FROM postings_ p JOIN dfs USING (term) JOIN lengths l ON p.doc_id = l.doc_id, corpus WHERE avgdl > 0 GROUP BY 1)"""


def _top(postings: str, terms: list[str], k: int = 10, k1: float = 1.2, b: float = 0.75, where: str = "TRUE") -> str:
    return f"""WITH {postings}, {_scores(terms, k1, b)}
SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 6) AS score
FROM scores WHERE {where} ORDER BY score DESC, doc_id LIMIT {k}"""


_COLLAPSE = "trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def _collapse(x: str) -> str:
    return _COLLAPSE.format(x)


_TITLE = _collapse("regexp_extract(html, '(?i)<title[^>]*>([\\s\\S]*?)</title>', 1)")
_META = """list_filter(regexp_extract_all(html, '(?i)<meta[^>]*>'), lambda m: regexp_matches(m, '(?i)name=("description"|''description'')') AND regexp_matches(m, '(?i)content='))[1]"""
_DESCRIPTION = "coalesce(" + _collapse(f"regexp_extract({_META}, '(?is)content=\"([^\"]*)\"', 1)") + ", '')"
_MARKED = f"regexp_replace(regexp_replace(html, {_q(_COMMENTED)}, '\\1', 'g'), {_q('(?i)(?:' + _ANY + ')')}, '{_MARKED_BY}', 'g')"
_SPACED = f"regexp_replace({_MARKED}, ' ?{_MARKED_BY}+', ' ', 'g')"
_TEXT = _collapse(f"regexp_replace({_SPACED}, {_q(' ([[:punct:]])')}, '\\1', 'g')")
_SOURCE = "CASE WHEN contains(regexp_extract(url, '^[\\s\\S]*?://([\\s\\S]*)$', 1), '.onion') THEN 'onion' ELSE 'clearweb' END"
_LINKS = f"""anchors AS (SELECT fetch_id, url, regexp_extract_all(html, '(?i)<a ([^>]*)>', 1) AS bodies FROM fetched
  WHERE html IS NOT NULL AND (starts_with(url, 'http://') OR starts_with(url, 'https://'))),
raw AS (SELECT fetch_id, url, list_filter(list_transform(bodies, lambda x: regexp_extract(' ' || x, '(?is)^.*?href="([^"]*)"', 1)), lambda x: x <> '') AS hrefs FROM anchors),
resolved AS (SELECT fetch_id, url, list_filter(list_transform(hrefs, lambda x: CASE
    WHEN starts_with(x, 'http://') OR starts_with(x, 'https://') THEN x
    WHEN starts_with(x, '//') THEN split_part(url, '://', 1) || ':' || x
    WHEN contains(x, ':') THEN NULL
    WHEN starts_with(x, '/') THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || x
    ELSE regexp_extract(url, '^(https?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*(/(?:[^?#]*/)?)', 1), ''), '/') || x END),
  lambda x: x IS NOT NULL) AS links FROM raw),
links AS (SELECT fetch_id, url, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS link_at FROM resolved)"""
_DOMAIN = "CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?:[\\s\\S]*?://)?([^/?#]*)', 1) ELSE url END"
_ORIGIN = (
    "CASE WHEN regexp_extract(url, '^([\\s\\S]*?)://([^/?#]+)', 1) <> '' THEN regexp_extract(url, '^([\\s\\S]*?)://([^/?#]+)', 1) || '://' || "
    "translate(regexp_extract(url, '^([\\s\\S]*?)://([^/?#]+)', 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
)
_PATH = "coalesce(nullif(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*(/[^?#]*)', 1), ''), '/')"
_OFFERS = """offers AS (SELECT url, seq, min(coalesce(depth, 0)) AS depth,
    min(CASE WHEN coalesce(priority, -1) = -1 THEN coalesce(depth, 0) ELSE priority END) AS priority
  FROM frontier f WHERE url IS NOT NULL AND seq = (SELECT min(seq) FROM frontier g WHERE g.url = f.url) GROUP BY url, seq)"""
_BODIES = "bodies(origin, body) AS (VALUES " + ", ".join(f"({_q(o)}, {_q(b)})" for o, b in ROBOTS_BODIES) + ")"
_RULES = rf"""{_BODIES},
file_lines AS (SELECT origin, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM bodies),
clean AS (SELECT origin, n, trim(regexp_extract(line, '^([^#]*)', 1), E' \t\r\n') AS line FROM file_lines),
keyed AS (SELECT origin, n, lower(trim(regexp_extract(line, '^([^:]*)', 1))) AS key, trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) AS value FROM clean WHERE line <> ''),
agents AS (SELECT *, CASE WHEN key = 'user-agent' THEN lower(value) = '*' OR contains('tarn-bot/0.1', lower(value)) OR contains(lower(value), 'tarn-bot/0.1') END AS m FROM keyed),
bound AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY origin ORDER BY n ROWS UNBOUNDED PRECEDING) AS binds FROM agents),
rules AS (SELECT origin, CAST(row_number() OVER (PARTITION BY origin ORDER BY n) AS INTEGER) AS rule_no, key = 'allow' AS allow, value AS path
  FROM bound WHERE binds AND key IN ('allow', 'disallow') AND value <> '')"""


def oracle_sql() -> dict[str, str]:
    many, report = "the index of the archive and a mirror".split(), "reading the report".split()
    return {
        "tokenize_documents": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
        "query_terms_of_titles": f"SELECT seq, coalesce(array_to_string(list_sort(list_distinct({_tokens('title')})), ' '), '') AS terms FROM docs",
        "term_frequencies": f"WITH {_CORPUS_POSTINGS} SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM postings_ GROUP BY 1",
        "postings_weighted": f"WITH {_DOCS_POSTINGS} SELECT term, doc_id, tf FROM postings_",
        "doc_lengths": f"WITH {_DOCS_POSTINGS} SELECT doc_id, dl FROM lengths",
        "corpus_stats": f"""WITH {_DOCS_POSTINGS}
SELECT count(*) AS ndocs, CAST(sum(dl) AS BIGINT) AS total_terms, round(sum(dl)::DOUBLE / count(*), 6) AS avgdl, (SELECT count(DISTINCT term) FROM postings_) AS nterms FROM lengths""",
        "term_stats": f"WITH {_DOCS_POSTINGS} SELECT term, count(*) AS df FROM postings_ GROUP BY 1",
        "postings_lookup": f"WITH {_DOCS_POSTINGS} SELECT doc_id, tf FROM postings_ WHERE term = 'mirror'",
        "bm25_top10": _top(_CORPUS_POSTINGS, ["the", "of", "and"]),
        "bm25_many_terms": _top(_CORPUS_POSTINGS, many, 100),
        "bm25_k1_zero": _top(_CORPUS_POSTINGS, ["mirror", "archive"], 50, 0.0, 0.0),
        "bm25_all_scores": f"WITH {_DOCS_POSTINGS}, {_scores(['mirror', 'crawler', 'spiegel'])} SELECT doc_id, round(score, 6) AS score FROM scores",
        "bm25_titled": f"""SELECT rank, h.doc_id, url, title, snippet, source, score FROM ({_top(_DOCS_POSTINGS, report, 20)}) h
JOIN (WITH {_LATEST} SELECT * FROM latest) d ON h.doc_id = d.doc_id""",
        "bm25_in_language": _top(_CORPUS_POSTINGS, ["der", "archiv"], 20, where="doc_id IN (SELECT doc_id FROM documents WHERE starts_with(lower(lang), 'de'))"),
        "page_titles": f"SELECT fetch_id, {_TITLE} AS title FROM fetched",
        "page_descriptions": f"SELECT fetch_id, {_DESCRIPTION} AS description FROM fetched WHERE html IS NOT NULL",
        "page_text": f"SELECT fetch_id, {_TEXT} AS text FROM fetched",
        "page_documents": f"""SELECT url, CASE WHEN {_TITLE} = '' THEN url ELSE {_TITLE} END AS title, {_DESCRIPTION} AS snippet, {_TEXT} AS content,
{_SOURCE} AS source, CAST(0 AS INTEGER) AS depth FROM fetched WHERE url IS NOT NULL AND html IS NOT NULL""",
        "page_links": f"WITH {_LINKS} SELECT fetch_id, CAST(link_at AS BIGINT) AS link_no, link FROM links",
        "link_in_degree": f"WITH {_LINKS} SELECT link, count(DISTINCT url) AS n FROM links GROUP BY 1",
        "link_out_degree": f"WITH {_LINKS} SELECT url, count(*) AS n, count(DISTINCT link) AS n_distinct FROM links GROUP BY 1",
        "crawl_reachable": f"""WITH RECURSIVE {_LINKS},
edges AS (SELECT DISTINCT url AS src, link AS dst FROM links),
walk(url, depth) AS (
  SELECT DISTINCT url, 0 FROM fetched WHERE url IS NOT NULL
  UNION SELECT dst, depth + 1 FROM walk JOIN edges ON walk.url = src WHERE depth < 2)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1""",
        "upsert_last_wins": """WITH v AS (SELECT coalesce(url, '') AS url, min(seq) AS f, max(seq) AS s FROM docs GROUP BY 1)
SELECT DISTINCT row_number() OVER (ORDER BY f, v.url) AS doc_id, v.url, s AS seq, (SELECT any_value(title) FROM docs d WHERE d.seq = s AND coalesce(d.url, '') = v.url) AS title FROM v""",
        "delete_documents": f"WITH {_DOCS_POSTINGS} SELECT term, count(*) AS df FROM postings_ WHERE doc_id NOT IN (SELECT doc_id FROM latest WHERE source = 'onion') GROUP BY 1",
        "frontier_first_offers": f"WITH {_OFFERS} SELECT * FROM offers",
        "frontier_unseen": f"WITH {_OFFERS} SELECT url, seq FROM offers WHERE url NOT IN (SELECT url FROM fetched WHERE url IS NOT NULL)",
        "frontier_admitted": f"WITH {_OFFERS} SELECT url, seq, depth, priority FROM offers ORDER BY seq LIMIT 64",
        "frontier_order": f"WITH {_OFFERS} SELECT seq, row_number() OVER (ORDER BY priority, seq) AS position FROM offers",
        "frontier_schedule": f"WITH {_OFFERS} SELECT seq, {_DOMAIN} AS domain, (row_number() OVER (PARTITION BY {_DOMAIN} ORDER BY priority, seq) - 1) * 100 AS wait_ms FROM offers",
        "robots_parse": f"WITH {_RULES} SELECT origin, rule_no, allow, path FROM rules",
        "robots_allowed": f"""WITH {_RULES}, u AS (SELECT DISTINCT url FROM frontier WHERE url IS NOT NULL),
p AS (SELECT url, {_ORIGIN} AS origin, {_PATH} AS path FROM u),
best AS (SELECT p.url, arg_max(r.allow, strlen(r.path) * 2 + CASE WHEN r.allow THEN 1 ELSE 0 END) AS allow
  FROM p JOIN rules r ON p.origin = r.origin AND starts_with(p.path, r.path) GROUP BY 1)
SELECT p.url, origin, path, coalesce(allow, TRUE) AS allowed FROM p LEFT JOIN best USING (url)""",
        "url_parts": f"""SELECT DISTINCT url, {_DOMAIN} AS domain, {_ORIGIN} AS origin, {_PATH} AS path, contains(url, 'robots.txt') AS robots, {_SOURCE} AS source
FROM frontier WHERE url IS NOT NULL""",
        "normalized_urls": """SELECT DISTINCT seq, CASE WHEN trim(url) = '' THEN '' WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url ELSE 'http://' || url END AS whole,
CASE WHEN url = '' THEN '' ELSE 'http://' || regexp_replace(url, '^https?://', '') END AS bare FROM docs WHERE url IS NOT NULL""",
        "search_envelope": f"""WITH h AS ({_top(_DOCS_POSTINGS, ["mirror"], 20)}), d AS (WITH {_LATEST} SELECT * FROM latest)
SELECT 'mirror' AS query, count(*) AS count, string_agg(url, chr(10) ORDER BY rank) AS urls FROM h JOIN d ON h.doc_id = d.doc_id""",
        "event_props": "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), -1::DOUBLE) AS k, 'absent' AS none FROM events",
        "escaped_titles": """SELECT DISTINCT seq, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS title FROM docs""",
        "decoded_queries": "SELECT DISTINCT url, regexp_extract(url, '(?:^|[?&])id=([^&#]*)', 1) AS id, url_decode(regexp_extract(url, '(?:^|[?&])id=([^&#]*)', 1)) AS decoded FROM frontier WHERE url LIKE '%?%'",
        "base64url_titles": "SELECT DISTINCT seq, translate(rtrim(base64(encode(title)), '='), '+/', '-_') AS coded, title AS back FROM docs WHERE title IS NOT NULL",
        "isolation_tokens": f"""WITH u AS (SELECT DISTINCT url, {_DOMAIN} AS domain FROM docs WHERE url IS NOT NULL),
h AS (SELECT url, list_reduce(list_prepend({FNV_OFFSET}::HUGEINT, list_transform(regexp_extract_all(hex(encode(domain)), '..'), lambda b: CAST('0x' || b AS HUGEINT))),
  lambda acc, b: xor(acc, b) * {FNV_PRIME}::HUGEINT % 18446744073709551616::HUGEINT) AS h FROM u)
SELECT url, 's-' || lpad(lower(to_hex(CAST(h AS UBIGINT))), 16, '0') AS token FROM h""",
        "bloom_geometry": """SELECT source, n, CAST(ceil(-n * ln(0.01::DOUBLE) / (ln(2::DOUBLE) * ln(2::DOUBLE))) AS BIGINT) AS bits,
greatest(1, CAST(round(ceil(-n * ln(0.01::DOUBLE) / (ln(2::DOUBLE) * ln(2::DOUBLE))) / n * ln(2::DOUBLE)) AS BIGINT)) AS hashes
FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)""",
        "activity_recent": """SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS told_at FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)""",
        "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "backoff_schedule": "SELECT a AS attempt, CAST(least(8000::DOUBLE, 250::DOUBLE * pow(2, a)) AS BIGINT) AS ms FROM range(8) t(a)",
        "proxy_list": "SELECT * FROM (VALUES ('a.example', 9050), ('b.example', 9150), ('127.0.0.1', 9050), ('e:1', 2)) t(host, port)",
        "fetch_log_stats": """WITH l AS (SELECT DISTINCT fetch_id, url, ok, fetched_at FROM fetched),
a AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetch_id) - 1 AS attempt, contains(url, '.onion') AS onion FROM l)
SELECT count(*) AS requests, coalesce(count(*) FILTER (onion), 0) AS onion_requests, count(*) FILTER (onion AND NOT ok) AS onion_failures,
count(*) FILTER (attempt > 0) AS retries, count(*) FILTER (NOT ok) AS failures FROM a""",
        "tokenize_bytes": f"SELECT doc_id, CAST(len({_tokens("text || chr(65533) || 'Az'")}) AS BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL",
        "index_upserted": f"""WITH {_DOCS_POSTINGS},
v AS (SELECT coalesce(url, '') AS url, min(seq) AS f FROM docs GROUP BY 1),
l AS (SELECT latest.url, max(dl) AS dl FROM latest JOIN lengths ON latest.doc_id = lengths.doc_id GROUP BY 1)
SELECT row_number() OVER (ORDER BY f, v.url) AS doc_id, v.url, dl FROM v JOIN l ON v.url = l.url""",
        "index_replaced": f"""WITH {_DOCS_POSTINGS} SELECT 'cleared' AS step, CAST(0 AS BIGINT) AS ndocs, CAST(0 AS BIGINT) AS total_terms
UNION ALL SELECT 'replaced', count(*), CAST(sum(dl) AS BIGINT) FROM lengths""",
        "document_lookup": f"WITH {_LATEST} SELECT doc_id, url, title, content FROM latest WHERE doc_id = (SELECT max(doc_id) FROM latest)",
        "scan_documents": f"WITH {_LATEST} SELECT doc_id, url, title, snippet, source, depth FROM latest",
        "bm25_guards": "SELECT 'no terms' AS asked, CAST(0 AS BIGINT) AS hits UNION ALL SELECT 'unknown term', 0 UNION ALL SELECT 'no documents', 0 UNION ALL SELECT 'k of 0', 0",
        "store_round_trip": f"WITH {_DOCS_POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM postings_ GROUP BY 1",
        "stored_numbers": f"""WITH {_DOCS_POSTINGS} SELECT CAST(count(*) AS BIGINT) AS ndocs, CAST(sum(dl) AS BIGINT) AS total_terms, max(latest.doc_id) + 1 AS next_id
FROM lengths JOIN latest ON lengths.doc_id = latest.doc_id""",
        "sealed_round_trip": f"WITH {_LATEST} SELECT doc_id, url, title, content, depth FROM latest",
        "snapshot_round_trip": f"WITH {_LATEST} SELECT url, coalesce(title, '') AS title, coalesce(content, '') AS content, CASE WHEN source = 'onion' THEN 'onion' ELSE 'clearweb' END AS source, CAST(coalesce(depth, 0) AS BIGINT) AS depth FROM latest",
        "json_edited": """SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"type":' || CAST(to_json(event_type) AS VARCHAR) || ',"half":' ||
CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN CAST(CAST(json_extract(props, '$.k') AS BIGINT) // 2 AS VARCHAR) ELSE CAST(CAST(json_extract(props, '$.k') AS BIGINT) / 2.0::DOUBLE AS VARCHAR) END || '}' AS text FROM events""",
        "json_escaped": r"""SELECT DISTINCT seq, CAST(to_json(title) AS VARCHAR) AS text FROM docs WHERE title IS NOT NULL""",
        "stub_pages": "SELECT DISTINCT url, true AS ok, 'Sample page of ' || coalesce(nullif(regexp_extract(url, '^(?:[\\s\\S]*?://)?([^/]*)', 1), ''), 'unknown') AS title, CAST(3 AS BIGINT) AS n_links FROM fetched WHERE url IS NOT NULL",
        "transient_errors": """SELECT DISTINCT fetch_id, error, coalesce(contains(lower(error), 'could not connect') OR contains(lower(error), 'could not resolve proxy') OR contains(lower(error), 'timed out')
OR contains(lower(error), 'send error') OR contains(lower(error), 'receive error') OR contains(lower(error), 'proxy error') OR contains(lower(error), 'http/2 error'), false) AS transient FROM fetched""",
        "table_source": """WITH n AS (SELECT url, max(fetch_id) AS f FROM fetched WHERE url IS NOT NULL GROUP BY 1), a AS (SELECT DISTINCT fetched.* FROM fetched JOIN n ON fetched.url = n.url AND fetch_id = f),
u AS (SELECT DISTINCT url FROM docs WHERE url IS NOT NULL)
SELECT u.url, coalesce(ok, false) AS ok, CASE WHEN a.url IS NULL THEN 'not found' ELSE coalesce(error, '') END AS error, CAST(coalesce(length(html), 0) AS BIGINT) AS chars FROM u LEFT JOIN a ON u.url = a.url""",
        "crawl_counts": f"""WITH n AS (SELECT url, max(fetch_id) AS f FROM fetched WHERE url IS NOT NULL GROUP BY 1),
a AS (SELECT DISTINCT fetched.* FROM fetched JOIN n ON fetched.url = n.url AND fetch_id = f), {_LINKS.replace("FROM fetched", "FROM a")},
next AS (SELECT DISTINCT link FROM links JOIN a ON links.fetch_id = a.fetch_id WHERE a.ok AND link NOT IN (SELECT url FROM n))
SELECT CAST(0 AS INTEGER) AS level, CASE WHEN ok THEN 'indexed' ELSE 'failed' END AS kind, count(*) AS n FROM a GROUP BY 1, 2
UNION ALL SELECT 1, 'failed', count(*) FROM next HAVING count(*) > 0""",
        "crawl_documents": f"""WITH n AS (SELECT url AS u, max(fetch_id) AS f FROM fetched WHERE url IS NOT NULL GROUP BY 1)
SELECT DISTINCT url, CASE WHEN {_TITLE} = '' THEN url ELSE {_TITLE} END AS title, {_SOURCE} AS source, CAST(0 AS INTEGER) AS depth
FROM fetched JOIN n ON url = u AND fetch_id = f WHERE ok AND html IS NOT NULL""",
        "robots_cache": f"""WITH {_RULES}, o AS (SELECT DISTINCT {_ORIGIN} AS origin FROM frontier WHERE url IS NOT NULL)
SELECT count(*) AS n_origins, count(*) FILTER (origin IN (SELECT origin FROM rules)) AS n_with_rules FROM o WHERE origin <> ''""",
        "robots_to_load": f"""SELECT DISTINCT origin, origin || '/robots.txt' AS robots_url FROM (SELECT {_ORIGIN} AS origin FROM frontier WHERE url IS NOT NULL)
WHERE origin <> '' AND origin NOT IN (SELECT {_ORIGIN} FROM docs WHERE url IS NOT NULL)""",
        "bloom_probe": """SELECT count(*) AS held, count(*) AS held_maybe, (SELECT count(DISTINCT url) FROM frontier WHERE url IS NOT NULL) AS offered, true AS few_wrong, CAST(0 AS BIGINT) AS after_clear
FROM (SELECT DISTINCT url FROM fetched WHERE url IS NOT NULL)""",
        "proxy_turns": """WITH r AS (SELECT DISTINCT seq FROM docs), n AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS turn FROM r)
SELECT seq, CASE WHEN turn % 2 = 0 THEN 'a.example:9050' ELSE 'c.example:9150' END AS endpoint FROM n""",
        "retry_limits": "SELECT DISTINCT url, CASE WHEN contains(url, '.onion') THEN 2 ELSE greatest(coalesce(depth, 0) - 1, 0) END AS retries FROM frontier WHERE url IS NOT NULL",
        "onion_urls": "SELECT contains(url, '.onion') AS onion, count(*) AS n FROM frontier WHERE url IS NOT NULL GROUP BY 1",
        "status_numbers": f"""WITH {_DOCS_POSTINGS} SELECT count(*) AS documents, (SELECT count(DISTINCT term) FROM postings_) AS terms, round(sum(dl)::DOUBLE / count(*), 6) AS average_doc_length,
CAST(0 AS INTEGER) AS crawled_pages, CAST(0 AS INTEGER) AS pending_crawls, false AS crawler_running, 'stub' AS fetcher FROM lengths""",
        "dashboard_sources": f"WITH {_LATEST} SELECT source, count(*) AS n FROM latest GROUP BY 1",
        "search_api": f"""WITH h AS ({_top(_DOCS_POSTINGS, ["mirror"], 20)}), d AS (WITH {_LATEST} SELECT * FROM latest)
SELECT CAST(200 AS INTEGER) AS code, 'mirror' AS query, CAST(rank AS BIGINT) AS at, url, coalesce(title, '') AS title FROM h JOIN d ON h.doc_id = d.doc_id""",
        "api_errors": """SELECT * FROM (VALUES ('missing q', 400, 'missing q'), ('bad json', 400, 'invalid JSON'), ('large body', 413, 'body too large'), ('missing url', 400, 'missing url'), ('nowhere', 404, 'not found')) t(asked, code, error)""",
        "search_page": f"""WITH h AS ({_top(_DOCS_POSTINGS, ["mirror"], 20)}), d AS (WITH {_LATEST} SELECT * FROM latest)
SELECT rank, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS url FROM h JOIN d ON h.doc_id = d.doc_id""",
    }
