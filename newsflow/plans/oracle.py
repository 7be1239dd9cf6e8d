"""DuckDB SQL twins of the registered queries (the correctness oracle).

Built from shared CTE fragments so every binding rule and every operator
is written once in SQL. Tables ``documents events labels pages`` are the
pre-registered parquet views.
"""

from __future__ import annotations

from html.entities import html5

SQL: dict[str, str] = {}

D = "CAST({} AS DOUBLE)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ----------------------------------------------------------------- bindings
TOKEN = r"'[\p{L}\p{N}_]+'"
SENTS = r"list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda s: trim(s)), lambda s: s <> '')"
SUMMARY = f"""sents AS (SELECT doc_id, unnest({SENTS}) AS sentence, CAST(generate_subscripts({SENTS}, 1) AS INTEGER) AS pos
          FROM documents),
stoks AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(sentence), {TOKEN})) AS token FROM sents),
sc AS (SELECT doc_id, token, count(*) AS c FROM stoks GROUP BY doc_id, token),
sn AS (SELECT doc_id, count(*) AS n FROM stoks GROUP BY doc_id),
ssc AS (SELECT t.doc_id, t.pos, round(avg(CAST(sc.c AS DOUBLE) / CAST(sn.n AS DOUBLE)), 9) AS score
       FROM stoks t JOIN sc ON sc.doc_id = t.doc_id AND sc.token = t.token JOIN sn ON sn.doc_id = t.doc_id
       GROUP BY t.doc_id, t.pos),
sbest AS (SELECT * FROM ssc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos ASC) <= 3),
ssum AS (SELECT b.doc_id, string_agg(s.sentence, ' ' ORDER BY b.pos) AS summary
         FROM sbest b JOIN sents s ON s.doc_id = b.doc_id AND s.pos = b.pos GROUP BY b.doc_id)"""


def articles_cte(summary: str = "NULL", source: str = "documents") -> str:
    return f"""articles_b AS (
  SELECT md5('doc:' || CAST(doc_id AS VARCHAR)) AS url_hash,
         'https://' || source || '.example.com/' || lang || '/' || CAST(doc_id AS VARCHAR) AS url,
         ({SENTS})[1] AS title, source,
         [lang, source] AS tags,
         CAST({summary} AS VARCHAR) AS summary,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((doc_id * 37) % 1009 AS BIGINT)) AS indexed_at
  FROM {source})"""


ARTICLES = articles_cte()
ARTICLES_SUM = SUMMARY + ",\n" + articles_cte("summary", "documents LEFT JOIN ssum USING (doc_id)")

RAW_EVENTS = """hev AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id,
         md5('doc:' || json_extract_string(props, '$.k')) AS url_hash,
         CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'dislike'
                         WHEN 'view' THEN 'read' WHEN 'click' THEN 'readmore'
                         ELSE event_type END AS event
  FROM events)"""

EVENTS = RAW_EVENTS + """,
dev AS (
  SELECT event_id, ts, user_id, url_hash, event,
         CAST(CASE WHEN event = 'like' THEN 1 WHEN event = 'dislike' THEN -1
                   WHEN event IN ('read', 'readmore') THEN 1 END AS BIGINT) AS delta,
         CASE WHEN event = 'like' THEN true WHEN event = 'dislike' THEN false END AS liked
  FROM hev WHERE event IN ('like', 'dislike', 'read', 'readmore'))"""


def utc_cte(name: str = "utc", where: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT user_id, tag, CAST(sum(delta) AS BIGINT) AS ct FROM (
    SELECT d.user_id, unnest(a.tags) AS tag, d.delta
    FROM dev d JOIN articles_b a ON d.url_hash = a.url_hash
    WHERE a.tags IS NOT NULL AND ({where}))
  GROUP BY user_id, tag)"""


GT = """gt AS (
  SELECT CAST(coalesce(sum(delta), 0) AS BIGINT) AS totalsum FROM dev
  WHERE url_hash IN (SELECT url_hash FROM articles_b WHERE tags IS NOT NULL))"""

CAT = """cat AS (
  SELECT DISTINCT unnest(tags) AS tag FROM articles_b
  WHERE tags IS NOT NULL AND url_hash IN (SELECT url_hash FROM dev))"""

LIKED = """lk AS (
  SELECT user_id, url_hash, liked FROM dev WHERE liked IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, url_hash ORDER BY ts DESC, event_id DESC) = 1)"""

INTEREST = """intr AS (
  SELECT user_id, tag, ct, total,
         CASE WHEN total <> 0 AND totalsum <> 0 THEN
           (CAST(ct AS DOUBLE) / CAST(total AS DOUBLE)) * (CAST(total AS DOUBLE) / CAST(totalsum AS DOUBLE))
           / CAST(0.2 AS DOUBLE) END AS interest
  FROM (SELECT u.user_id, u.tag, u.ct,
               CAST(sum(u.ct) OVER (PARTITION BY u.user_id) AS BIGINT) AS total, g.totalsum
        FROM utc u CROSS JOIN gt g WHERE u.tag IN (SELECT tag FROM cat)))"""

TOPTAGS = """tt AS (
  SELECT user_id, tag, interest,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY interest DESC, tag ASC) AS INTEGER) AS tag_rank
  FROM intr WHERE interest IS NOT NULL
  QUALIFY tag_rank <= 3)"""

def bm25_ctes(query_tags_sql: str, k: int = 30) -> str:
    """qtok/fd/st/post/dft/sc/hits CTEs over articles_b for the query tags."""
    return f"""fd AS (
  SELECT url_hash, flatten(list_transform(tags, lambda t: regexp_extract_all(lower(t), {TOKEN}))) AS toks
  FROM articles_b WHERE tags IS NOT NULL),
fd2 AS (SELECT * FROM fd WHERE len(toks) > 0),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, CAST(sum(len(toks)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avgdl FROM fd2),
qtok AS (SELECT DISTINCT tag, unnest(list_distinct(regexp_extract_all(lower(tag), {TOKEN}))) AS token
         FROM ({query_tags_sql})),
post AS (
  SELECT url_hash, token, dl, count(*) AS f FROM (
    SELECT url_hash, len(toks) AS dl, unnest(toks) AS token FROM fd2)
  WHERE token IN (SELECT token FROM qtok) GROUP BY url_hash, token, dl),
dft AS (SELECT token, count(*) AS df FROM post GROUP BY token),
sc AS (
  SELECT q.tag, p.url_hash,
         round(sum(ln(1.0::DOUBLE + (st.n_docs - dft.df + 0.5::DOUBLE) / (dft.df + 0.5::DOUBLE))
                   * (p.f / (p.f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / st.avgdl)))), 9) AS score
  FROM qtok q JOIN post p ON q.token = p.token JOIN dft ON dft.token = p.token CROSS JOIN st
  GROUP BY q.tag, p.url_hash),
hits AS (
  SELECT s.tag, s.url_hash, s.score, a.title, a.tags, a.indexed_at,
         CAST(row_number() OVER (PARTITION BY s.tag ORDER BY s.score DESC, a.indexed_at DESC NULLS LAST, s.url_hash ASC) AS INTEGER) AS pos
  FROM sc s JOIN articles_b a ON s.url_hash = a.url_hash
  QUALIFY pos <= {k})"""


LATEST = """lat AS (
  SELECT CAST(row_number() OVER (ORDER BY indexed_at DESC, url_hash ASC) AS INTEGER) AS pos,
         url_hash AS key, title, coalesce(tags, []) AS tags
  FROM articles_b WHERE indexed_at IS NOT NULL
  ORDER BY indexed_at DESC, url_hash ASC LIMIT 20)"""


def _rec_sql() -> str:
    return (with_(ARTICLES, EVENTS, utc_cte(), GT, CAT, INTEREST, TOPTAGS,
                  bm25_ctes("SELECT DISTINCT tag FROM tt"), LATEST,
                  """users AS (SELECT DISTINCT user_id FROM hev)""",
                  """rec AS (
  SELECT t.user_id, t.tag_rank, h.pos, t.tag, h.url_hash AS key, h.title,
         array_to_string(coalesce(h.tags, []), ',') AS tags
  FROM tt t JOIN hits h ON t.tag = h.tag
  UNION ALL
  SELECT u.user_id, 0 AS tag_rank, l.pos, CAST(NULL AS VARCHAR) AS tag, l.key, l.title,
         array_to_string(l.tags, ',') AS tags
  FROM users u CROSS JOIN lat l
  WHERE u.user_id NOT IN (SELECT user_id FROM tt))"""))


SQL["history_events"] = with_(ARTICLES, EVENTS) + "SELECT * FROM dev"
SQL["user_tag_counts"] = with_(ARTICLES, EVENTS, utc_cte()) + "SELECT * FROM utc"
SQL["global_total"] = with_(ARTICLES, EVENTS, GT) + "SELECT * FROM gt"
SQL["tag_catalog"] = with_(ARTICLES, EVENTS, CAT) + "SELECT * FROM cat"
SQL["liked_state"] = with_(ARTICLES, EVENTS, LIKED) + "SELECT * FROM lk"
SQL["counter_apply"] = with_(
    ARTICLES, EVENTS,
    utc_cte("old", "d.ts < TIMESTAMP '2024-01-15 00:00:00'"),
    utc_cte("new", "d.ts >= TIMESTAMP '2024-01-15 00:00:00'")) + """
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.tag, n.tag) AS tag,
       CAST(coalesce(o.ct, 0) + coalesce(n.ct, 0) AS BIGINT) AS ct
FROM old o FULL OUTER JOIN new n ON o.user_id = n.user_id AND o.tag = n.tag"""
SQL["interest"] = with_(ARTICLES, EVENTS, utc_cte(), GT, CAT, INTEREST) + "SELECT * FROM intr"
SQL["top_tags"] = with_(ARTICLES, EVENTS, utc_cte(), GT, CAT, INTEREST, TOPTAGS) + "SELECT * FROM tt"
SQL["tag_match_top30"] = (with_(ARTICLES, EVENTS, CAT, bm25_ctes("SELECT tag FROM cat"))
                          + "SELECT tag, pos, url_hash, score FROM hits")
SQL["recommend"] = _rec_sql() + "SELECT * FROM rec"
SQL["recommend_unread"] = _rec_sql() + """
SELECT * FROM rec r WHERE NOT EXISTS (
  SELECT 1 FROM dev d WHERE d.event IN ('read', 'readmore')
    AND d.user_id = r.user_id AND d.url_hash = r.key)"""
SQL["trending"] = with_(ARTICLES, LATEST) + """
SELECT pos, key, title, array_to_string(tags, ',') AS tags FROM lat"""
SQL["summary_view"] = with_(ARTICLES_SUM, EVENTS, LIKED) + """
SELECT r.user_id, a.title, a.url_hash AS key, a.summary AS text, a.url AS source,
       array_to_string(coalesce(a.tags, []), ',') AS tags, coalesce(l.liked, false) AS liked
FROM (SELECT DISTINCT user_id, url_hash FROM hev) r
JOIN articles_b a ON a.url_hash = r.url_hash
LEFT JOIN lk l ON l.user_id = r.user_id AND l.url_hash = r.url_hash"""
SQL["scan_limit"] = with_(ARTICLES) + """
SELECT url_hash, title FROM articles_b ORDER BY url_hash LIMIT 10"""


# ---------------------------------------------------------------- URLs, pages
SA = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)(.*)$'"
AUTH_RE = r"'^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)'"
PATH_RE = r"'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)'"
ABS_RE = r"'^[A-Za-z][A-Za-z0-9+.\-]*:'"
TEST_DOMAINS = ["example.org", "ththan.example.net", "ample.com"]
LINK_PATHS = ["/d", "/t", "/%c3"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_pct(s: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({s}, '([!-~]+|[^!-~]+)', 1), "
            f"lambda t: CASE WHEN regexp_matches(t, '^[!-~]') THEN t ELSE url_encode(t) END), '')")


def s_trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[\\t\\n\\r]', '', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def s_canon(x: str) -> str:
    u = f"regexp_replace({s_trimmed(x)}, '(?s)[?#].*$', '')"
    p = f"regexp_extract({u}, {SA}, 3)"
    full = (f"CASE WHEN regexp_matches({u}, {SA}) THEN lower(regexp_extract({u}, {SA}, 1)) || '://' || "
            f"lower(regexp_extract({u}, {SA}, 2)) || CASE WHEN {p} = '' THEN '/' ELSE {p} END ELSE {u} END")
    return s_pct(full)


def s_auth(x: str) -> str:
    return f"lower(regexp_extract({x}, {AUTH_RE}, 1))"


def s_path(x: str) -> str:
    return f"regexp_extract({x}, {PATH_RE}, 1)"


def s_in_domain(x: str, domains) -> str:
    h = s_auth(x)
    ors = " OR ".join([f"{h} IN ({', '.join(q(d) for d in domains)})"]
                      + [f"ends_with({h}, {q('.' + d)})" for d in domains])
    return f"coalesce({h} <> '' AND ({ors}), false)"


def s_has_path(x: str, prefixes) -> str:
    p = f"lower({s_path(x)})"
    return "coalesce(" + " OR ".join(f"starts_with({p}, {q(pre)})" for pre in prefixes) + ", false)"


def s_has_ext(x: str, exts) -> str:
    p = f"lower({s_path(x)})"
    return "coalesce(" + " OR ".join(f"ends_with({p}, {q(e)})" for e in exts) + ", false)"


def _duck_map(pairs) -> str:
    return "MAP {" + ", ".join(f"{k}: {q(v)}" for k, v in pairs) + "}"


NAMED_MAP = _duck_map((q(k), v) for k, v in sorted(html5.items()))
OLD_MAP = _duck_map((n, bytes([n]).decode("cp1252")) for n in range(128, 160) if n not in (129, 141, 143, 144, 157))


def s_unescape(x: str, attribute: bool = False) -> str:
    digits = "regexp_extract(p, '^&#[xX]?0*([0-9A-Fa-f]*);?$', 1)"
    n = (f"(CASE WHEN length({digits}) > 7 THEN -1 WHEN {digits} = '' THEN 0 WHEN regexp_matches(p, '^&#[xX]') "
         f"THEN CAST('0x' || {digits} AS INTEGER) ELSE TRY_CAST({digits} AS INTEGER) END)")
    numeric = (f"CASE WHEN starts_with(p, '&#') THEN coalesce({OLD_MAP}[{n}], CASE WHEN {n} > 0 AND {n} <= 1114111 "
               f"AND NOT {n} BETWEEN 55296 AND 57343 THEN chr({n}) END, chr(65533)) END")
    named = f"{NAMED_MAP}[substring(p, 2)]"
    if attribute:
        named = f"CASE WHEN ends_with(p, ';') THEN {named} END"
    pieces = f"regexp_extract_all({x}, '(&(?:#[xX][0-9A-Fa-f]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);?|&|[^&]+)', 1)"
    return (f"(CASE WHEN contains({x}, '&') THEN array_to_string(list_transform({pieces}, lambda p: "
            f"CASE WHEN starts_with(p, '&') THEN coalesce({numeric}, {named}, p) ELSE p END), '') ELSE {x} END)")


ANCHOR_RE = """'(?i)<a([\\s/](?:[^"''>]+|"[^"]*"|''[^'']*'')*)>'"""
BASE_RE = """'(?i)<base([\\s/](?:[^"''>]+|"[^"]*"|''[^'']*'')*)>'"""
ATTRIBUTE_RE = """'[^\\s"''>/=]+(?:\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s"''>]+))?'"""
HREF_NAME_RE = "'(?i)^href(\\s*=\\s*|$)'"
TITLE_RE = r"'(?is)<title(?:[ \t\n\r\f][^>]*)?>(.*?)</title[ \t\n\r\f]*>'"
COMMENT_RE = r"'(?s)<!--.*?-->'"
SCRIPT_RE = r"'(?is)<script(?:[ \t\n\r\f][^>]*)?>.*?</script[ \t\n\r\f]*>'"
STYLE_RE = r"'(?is)<style(?:[ \t\n\r\f][^>]*)?>.*?</style[ \t\n\r\f]*>'"
P_OPEN_RE = r"'(?i)<p(?:[ \t\n\r\f][^>]*)?>'"
P_END_RE = r"'(?is)</(?:p|article|div|section|body|main|td|li)[ \t\n\r\f]*>.*$'"
NON_WORD_RE = r"'[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85]'"


def s_stripped(h: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace({h}, {COMMENT_RE}, '', 'g'), "
            f"{SCRIPT_RE}, '', 'g'), {STYLE_RE}, '', 'g')")


def s_has_title(h: str) -> str:
    return f"coalesce(regexp_matches({s_stripped(h)}, {TITLE_RE}), false)"


def s_title(h: str) -> str:
    return f"CASE WHEN {s_has_title(h)} THEN {s_unescape(f'regexp_extract({s_stripped(h)}, {TITLE_RE}, 1)')} END"


def s_paragraphs(h: str, sep: str = "") -> str:
    piece = s_unescape(f"regexp_replace(regexp_replace(para, {P_END_RE}, ''), '<[^>]*>', '', 'g')")
    return (f"array_to_string(list_transform(string_split_regex({s_stripped(h)}, {P_OPEN_RE})[2:], "
            f"lambda para: {piece}), {q(sep)})")


def s_hrefs(h: str, element_re: str = ANCHOR_RE) -> str:
    each = f"regexp_extract_all(attrs, {ATTRIBUTE_RE})"
    first = f"list_filter({each}, lambda a: regexp_matches(a, {HREF_NAME_RE}))[1]"
    value = f"regexp_replace({first}, {HREF_NAME_RE}, '')"
    value = f"CASE WHEN regexp_matches({value}, '^[\"'']') THEN {value}[2:-2] ELSE {value} END"
    found = f"list_transform(regexp_extract_all({s_stripped(h)}, {element_re}, 1), lambda attrs: {value})"
    return f"list_filter({found}, lambda x: x IS NOT NULL)"


def s_clean(x: str) -> str:
    return f"regexp_replace({x}, {NON_WORD_RE}, '', 'g')"


def s_dots(path: str) -> str:
    segs = f"string_split({path}, '/')"
    red = (f"list_reduce({segs}[2:], lambda acc, s: CASE WHEN s = '..' THEN "
           f"(CASE WHEN len(acc) > 0 THEN acc[1:len(acc) - 1] ELSE acc END) "
           f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    fixed = f"CASE WHEN {segs}[-1] IN ('.', '..') THEN list_append({red}, '') ELSE {red} END"
    return f"'/' || array_to_string({fixed}, '/')"


def s_resolve(b: str, href: str) -> str:
    h = s_trimmed(href)
    nofrag = f"regexp_replace({b}, '#.*$', '')"
    scheme = f"regexp_extract({b}, {SA}, 1)"
    auth = f"regexp_extract({b}, {SA}, 2)"
    bpath = f"regexp_extract(regexp_extract({b}, {SA}, 3), '^([^?#]*)', 1)"
    origin = f"({scheme} || '://' || {auth})"
    bdir0 = f"regexp_extract({bpath}, '^(.*/)', 1)"
    bdir = f"(CASE WHEN {bdir0} = '' THEN '/' ELSE {bdir0} END)"
    joined = (f"(CASE WHEN regexp_matches({h}, {ABS_RE}) THEN {h} "
              f"WHEN starts_with({h}, '//') THEN {scheme} || ':' || {h} "
              f"WHEN starts_with({h}, '/') THEN {origin} || {h} "
              f"WHEN {h} = '' THEN {nofrag} "
              f"WHEN starts_with({h}, '?') THEN {origin} || {bpath} || {h} "
              f"WHEN starts_with({h}, '#') THEN {nofrag} || {h} "
              f"ELSE {origin} || {bdir} || {h} END)")
    return joined


def s_fix_dots(j: str) -> str:
    rest = f"regexp_extract({j}, {SA}, 3)"
    jpath = f"regexp_extract({rest}, '^([^?#]*)', 1)"
    jtail = f"regexp_extract({rest}, '(?s)^[^?#]*(.*)$', 1)"
    fixed = (f"regexp_extract({j}, {SA}, 1) || '://' || regexp_extract({j}, {SA}, 2) || "
             f"(CASE WHEN starts_with({jpath}, '/') THEN {s_dots(jpath)} ELSE {jpath} END) || {jtail}")
    return f"CASE WHEN regexp_matches({j}, {SA}) THEN {fixed} ELSE {j} END"


PAGES = f"""pg AS (
  SELECT page_id, url, html, {s_canon('url')} AS canonical_url FROM pages),
pgc AS (SELECT *, md5(canonical_url) AS url_hash FROM pg)"""

PARSED = PAGES + f""",
parsed AS (
  SELECT page_id, url_hash, canonical_url AS url, {s_title('html')} AS title,
         {s_clean(s_paragraphs('html'))} AS text, 'unknown' AS source,
         CAST(NULL AS VARCHAR) AS published_date
  FROM pgc WHERE {s_has_title('html')})"""

LINKS = f"""lraw AS (
  SELECT page_id, base, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS link_pos
  FROM (SELECT page_id, CASE WHEN regexp_matches(own, {SA}) THEN own ELSE url END AS base, {s_hrefs('html')} AS hs
        FROM (SELECT *, {s_fix_dots('own0')} AS own FROM (SELECT *, {s_resolve('url', 'based')} AS own0
              FROM (SELECT *, {s_unescape('based0', attribute=True)} AS based FROM (
                    SELECT *, {s_hrefs('html', BASE_RE)}[1] AS based0 FROM pages)))))),
lhref AS (SELECT page_id, base, link_pos, {s_unescape('href', attribute=True)} AS href FROM lraw),
lres AS (SELECT page_id, link_pos, {s_resolve('base', 'href')} AS joined FROM lhref),
lcand AS (SELECT page_id, link_pos, {s_canon(s_fix_dots('joined'))} AS link FROM lres)"""

OUTLINKS = LINKS + f""",
olinks AS (
  SELECT DISTINCT page_id, link FROM lcand
  WHERE {s_in_domain('link', TEST_DOMAINS)} AND {s_has_path('link', LINK_PATHS)})"""


def s_suffixes(host: str) -> str:
    parts = f"string_split({host}, '.')"
    return f"list_transform(range(1, len({parts}) + 1), lambda i: array_to_string({parts}[i:], '.'))"


SQL["pages_canonical"] = with_(PAGES) + "SELECT page_id, url, canonical_url, md5(canonical_url) AS url_hash FROM pg"
SQL["domain_filter"] = with_(PAGES) + f"SELECT page_id, canonical_url FROM pg WHERE {s_in_domain('canonical_url', TEST_DOMAINS)}"
SQL["path_filter"] = with_(PAGES) + f"SELECT page_id, canonical_url FROM pg WHERE {s_has_path('canonical_url', ['/en/', '/de/'])}"
SQL["extension_filter"] = with_(PAGES) + f"SELECT page_id, canonical_url FROM pg WHERE {s_has_ext('canonical_url', ['.html'])}"
SQL["allowlist_save"] = with_(PAGES) + f"""
SELECT page_id, canonical_url FROM pg
WHERE {s_auth('canonical_url')} <> ''
  AND len(list_intersect({s_suffixes(s_auth('canonical_url'))}, [{', '.join(q(d) for d in TEST_DOMAINS)}])) > 0"""
SQL["outlinks"] = with_(OUTLINKS) + "SELECT * FROM olinks"
SQL["outlinks_based"] = with_("""based_pages AS (
  SELECT page_id, url, CASE WHEN page_id % 3 = 1 THEN '<base href="/t/' || CAST(page_id AS VARCHAR) || '/x/">' || html ELSE html END AS html
  FROM pages)""", OUTLINKS.replace("FROM pages", "FROM based_pages")) + "SELECT * FROM olinks"
SQL["outlink_counts"] = with_(OUTLINKS) + "SELECT page_id, count(DISTINCT link) AS n_links FROM olinks GROUP BY page_id"
SQL["page_parse"] = with_(PARSED) + "SELECT * FROM parsed"
SQL["clean_text"] = f"SELECT doc_id, {s_clean('text')} AS text_clean FROM documents"
SQL["payload"] = with_(PARSED) + "SELECT url_hash, CAST(json_object('inputs', substring(text, 1, 2200)) AS VARCHAR) AS body FROM parsed"
CRAWL = f"""crawl AS (
  SELECT page_id, url, html,
         {s_has_title('html')} AS ok,
         {s_title('html')} AS title,
         regexp_replace(url, '^http://', 'https://') AS real_url
  FROM pages)"""
SQL["quarantine_split"] = with_(CRAWL) + """
SELECT page_id, 'good' AS part, CASE WHEN page_id % 11 = 5 THEN 404 ELSE 200 END AS status_code, title, CAST(NULL AS VARCHAR) AS err FROM crawl WHERE ok
UNION ALL
SELECT page_id, 'quarantine', CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), 'title not found' FROM crawl WHERE NOT ok"""
SQL["content_store"] = with_(CRAWL, f"""cs AS (
  SELECT page_id, {s_canon('coalesce(real_url, url)')} AS furl, html FROM crawl
  WHERE ok AND {s_canon('url')} NOT IN (SELECT {s_canon('url')} FROM pages WHERE page_id IN (0, 1, 2)))""") + f"""
SELECT md5(furl) AS url_hash, arg_max(furl, page_id) AS url, arg_max(html, page_id) AS html FROM cs
WHERE {s_auth('furl')} <> ''
  AND len(list_intersect({s_suffixes(s_auth('furl'))}, [{', '.join(q(d) for d in TEST_DOMAINS)}])) > 0
GROUP BY md5(furl)"""
SQL["url_dedup"] = with_(LINKS) + """
SELECT md5(link) AS url_hash, page_id, link_pos, link FROM lcand
QUALIFY row_number() OVER (PARTITION BY md5(link) ORDER BY page_id, link_pos) = 1"""


# ---------------------------------------------------------------- article assembly
DOCH = "md5('doc:' || CAST(doc_id AS VARCHAR))"
TASKS = f"""tasks AS (
  SELECT string_split('results/' || task || '/' || md5({DOCH} || ':' || task) || '.out', '/')[-1] AS output_location,
         {DOCH} AS url_hash, task
  FROM documents CROSS JOIN (VALUES ('classification'), ('summary')) v(task))"""
CRES = f"""cres AS (
  SELECT t.output_location, {DOCH} AS url_hash,
         ['quality:' || CAST(quality AS VARCHAR), 'toxic:' || CAST(toxic AS VARCHAR)] AS tags,
         TIMESTAMP '2024-02-01 00:00:00' + to_minutes(CAST((doc_id * 7) % 1000 AS BIGINT)) AS arrived_at
  FROM labels l JOIN tasks t ON t.url_hash = {DOCH} AND t.task = 'classification')"""
SRES = SUMMARY + f""",
sres AS (
  SELECT t.output_location, {DOCH} AS url_hash, summary,
         TIMESTAMP '2024-02-01 00:00:00' + to_minutes(CAST((doc_id * 11) % 1000 AS BIGINT)) AS arrived_at
  FROM ssum d JOIN tasks t ON t.url_hash = {DOCH} AND t.task = 'summary')"""

SQL["inference_tasks"] = with_(TASKS) + "SELECT * FROM tasks"
SQL["extract_tags"] = with_(TASKS, CRES) + "SELECT output_location, array_to_string(tags, ',') AS tags FROM cres"
SQL["result_to_article"] = with_(ARTICLES, TASKS, CRES) + """
SELECT c.url_hash, a.title, 'classification' AS task, array_to_string(c.tags, ',') AS tags
FROM cres c JOIN articles_b a ON a.url_hash = c.url_hash"""
SQL["metadata_merge"] = with_(ARTICLES, TASKS, CRES, SRES) + """
SELECT a.url_hash, a.title, array_to_string(c.tags, ',') AS tags, s.summary,
       greatest(c.arrived_at, s.arrived_at) AS indexed_at
FROM articles_b a LEFT JOIN cres c ON c.url_hash = a.url_hash LEFT JOIN sres s ON s.url_hash = a.url_hash"""
SQL["upsert_replace"] = with_(ARTICLES_SUM) + f"""
SELECT a.url_hash, a.title,
       CASE WHEN a.url_hash IN (SELECT {DOCH} FROM labels) THEN NULL ELSE array_to_string(a.tags, ',') END AS tags,
       CASE WHEN a.url_hash IN (SELECT {DOCH} FROM labels) THEN NULL ELSE a.summary END AS summary
FROM articles_b a"""
SQL["upsert_merge"] = with_(ARTICLES_SUM, TASKS, CRES) + """
SELECT a.url_hash, a.title, array_to_string(coalesce(c.tags, a.tags), ',') AS tags, a.summary
FROM articles_b a LEFT JOIN cres c ON c.url_hash = a.url_hash"""


SQL["upsert_replace_bucketed"] = SQL["upsert_replace"]
SQL["upsert_merge_bucketed"] = SQL["upsert_merge"]


# ---------------------------------------------------------------- graph
GRAPH = PAGES + ",\n" + OUTLINKS + f""",
npg AS (SELECT count(*) AS n FROM pg),
eid AS (SELECT s.canonical_url AS src, unnest([(s.page_id * 3 + 1) % npg.n, (s.page_id * 5 + 2) % npg.n]) AS dst_id
        FROM pg s CROSS JOIN npg),
edges_b AS (SELECT e.src, d.canonical_url AS dst FROM eid e JOIN pg d ON d.page_id = e.dst_id
            UNION ALL SELECT p.canonical_url, o.link FROM olinks o JOIN pg p ON p.page_id = o.page_id),
seeds_b AS (SELECT regexp_extract(canonical_url, '^[a-z][a-z0-9+.\\-]*://[^/]*/([^/]*)', 1) AS tag,
                   canonical_url AS url, CAST(page_id AS INTEGER) AS seed_pos
            FROM pg WHERE page_id IN (0, 1, 2))"""

BFS = """links_b AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges_b),
s0 AS (SELECT url, min(seed_pos) AS seed_pos FROM seeds_b GROUP BY url),
walk(url, seed_pos, depth) AS (
  SELECT url, seed_pos, 0 FROM s0
  UNION
  SELECT e.dst, w.seed_pos, w.depth + 1 FROM walk w JOIN links_b e ON e.src = w.url
  WHERE w.depth < (SELECT n FROM npg)),
best AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url),
firsts AS (SELECT w.url, min(w.seed_pos) AS seed_pos, b.depth FROM walk w
           JOIN best b ON w.url = b.url AND w.depth = b.depth GROUP BY w.url, b.depth),
visits AS (
  SELECT md5(f.url) AS url_hash, f.url, s.tag, f.seed_pos, CAST(f.depth AS INTEGER) AS depth
  FROM firsts f JOIN (SELECT DISTINCT seed_pos, tag FROM seeds_b) s ON s.seed_pos = f.seed_pos
  QUALIFY row_number() OVER (ORDER BY f.depth, f.seed_pos, md5(f.url)) <= 500)"""

SQL["frontier"] = "WITH RECURSIVE " + GRAPH + ",\n" + BFS + "\nSELECT * FROM visits"
SQL["frontier_tags"] = "WITH RECURSIVE " + GRAPH + ",\n" + BFS + "\nSELECT url, tag FROM visits"


def _levels_sql(depth: int) -> str:
    """The first levels, one CTE each; a level's redirect targets are barred from the next."""
    out = ["""bar AS (SELECT src, dst FROM al2 WHERE src <> dst),
lv0 AS (SELECT url, seed_pos FROM (SELECT url, min(seed_pos) AS seed_pos FROM seeds_b GROUP BY url)),
seen0 AS (SELECT url FROM lv0 UNION SELECT dst FROM bar WHERE src IN (SELECT url FROM lv0))"""]
    for j in range(1, depth + 1):
        out.append(f"""lv{j} AS (SELECT e.dst AS url, min(l.seed_pos) AS seed_pos FROM lv{j - 1} l JOIN edges_b e ON e.src = l.url
  WHERE e.dst NOT IN (SELECT url FROM seen{j - 1}) GROUP BY e.dst),
seen{j} AS (SELECT url FROM seen{j - 1} UNION SELECT url FROM lv{j} UNION SELECT dst FROM bar WHERE src IN (SELECT url FROM lv{j}))""")
    rows = " UNION ALL ".join(f"SELECT url, seed_pos, {j} AS depth FROM lv{j}" for j in range(depth + 1))
    return ",\n".join(out) + f""",
walked AS ({rows})
SELECT md5(w.url) AS url_hash, w.url, s.tag, w.seed_pos, CAST(w.depth AS INTEGER) AS depth
FROM walked w JOIN (SELECT DISTINCT seed_pos, tag FROM seeds_b) s ON s.seed_pos = w.seed_pos"""


SQL["frontier_redirects"] = with_(GRAPH, CRAWL, f"""al2 AS (
  SELECT DISTINCT {s_canon('url')} AS src, {s_canon('real_url')} AS dst FROM crawl WHERE ok AND real_url IS NOT NULL)""")[:-1] + ",\n" + _levels_sql(3)
# to the walk's end: every step carries the new level ('v') and all that is barred by then ('b')
WALK = """bar AS MATERIALIZED (SELECT src, dst FROM al2 WHERE src <> dst),
links_b AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges_b),
walk(kind, url, seed_pos, depth) AS (
  SELECT 'v', url, min(seed_pos), 0 FROM seeds_b GROUP BY url
  UNION ALL
  (WITH nb AS (SELECT url FROM walk UNION SELECT b.dst FROM bar b JOIN walk w ON b.src = w.url WHERE w.kind = 'v'),
   nv AS (SELECT e.dst AS url, min(w.seed_pos) AS seed_pos, min(w.depth) + 1 AS depth
          FROM walk w JOIN links_b e ON e.src = w.url LEFT JOIN nb ON nb.url = e.dst
          WHERE w.kind = 'v' AND nb.url IS NULL GROUP BY e.dst)
   SELECT 'v', url, seed_pos, depth FROM nv
   UNION ALL
   SELECT 'b', url, NULL, NULL FROM nb WHERE EXISTS (SELECT 1 FROM nv)))
SELECT md5(w.url) AS url_hash, w.url, s.tag, w.seed_pos, CAST(w.depth AS INTEGER) AS depth
FROM walk w JOIN (SELECT DISTINCT seed_pos, tag FROM seeds_b) s ON s.seed_pos = w.seed_pos
WHERE w.kind = 'v'"""
SQL["frontier_redirects_whole"] = SQL["frontier_redirects"].replace("WITH ", "WITH RECURSIVE ", 1).replace(_levels_sql(3), WALK)
SQL["redirect_alias"] = with_(CRAWL, f"""al AS (
  SELECT {s_canon('url')} AS url FROM crawl WHERE ok
  UNION SELECT {s_canon('real_url')} FROM crawl WHERE ok AND real_url IS NOT NULL)""") + \
    "SELECT md5(url) AS url_hash, url FROM al"
SQL["seen_anti"] = with_(GRAPH, CRAWL, f"""cs AS (
  SELECT page_id, {s_canon('coalesce(real_url, url)')} AS furl FROM crawl
  WHERE ok AND {s_canon('url')} NOT IN (SELECT url FROM seeds_b)),
stored AS (SELECT DISTINCT md5(furl) AS url_hash FROM cs
  WHERE {s_auth('furl')} <> ''
    AND len(list_intersect({s_suffixes(s_auth('furl'))}, [{', '.join(q(d) for d in TEST_DOMAINS)}])) > 0)""") + """
SELECT DISTINCT md5(dst) AS url_hash, dst AS url FROM edges_b
WHERE md5(dst) NOT IN (SELECT url_hash FROM stored)"""

SQL["seen_runs"] = SQL["seen_anti"]


# ---------------------------------------------------------------- text jobs
from ..functions.text import STOP_WORDS  # noqa: E402

STOP = "[" + ", ".join(q(w) for w in STOP_WORDS) + "]"

SQL["keywords_tfidf"] = f"""WITH
toks AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), {TOKEN}), lambda w: NOT list_contains({STOP}, w)) AS tk
         FROM documents),
grams AS (SELECT doc_id, unnest(list_concat(tk, CASE WHEN len(tk) >= 2
            THEN list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]) ELSE [] END)) AS gram FROM toks),
tf AS (SELECT doc_id, gram, count(*) AS tf FROM grams GROUP BY doc_id, gram),
dfq AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
nd AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs FROM documents),
sc AS (SELECT tf.doc_id, tf.gram, tf.tf, dfq.df, round(tf.tf * ln((nd.n_docs + 1) / (dfq.df + 1)), 9) AS score
       FROM tf JOIN dfq ON tf.gram = dfq.gram CROSS JOIN nd)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, gram ASC) AS INTEGER) AS rank,
       gram, tf, df, score
FROM sc QUALIFY rank <= 10"""



def _mmr_sql(candidates: int = 20, top_n: int = 10, diversity: float = 0.7) -> str:
    """The greedy rounds, one CTE each, over the TF-IDF candidates."""
    base = SQL["keywords_tfidf"].replace("rank <= 10", f"rank <= {candidates}")
    alike = ("CAST(len(list_intersect(list_distinct(string_split(h, ' ')), list_distinct(string_split(c.gram, ' ')))) AS DOUBLE) / "
             "len(list_distinct(list_concat(string_split(h, ' '), string_split(c.gram, ' '))))")
    value = (f"round(CAST({1 - diversity!r} AS DOUBLE) * (CASE WHEN t.top > 0 THEN c.score / t.top ELSE 0.0 END) - CAST({diversity!r} AS DOUBLE) * "
             f"coalesce(list_max(list_transform(p.chosen, lambda h: {alike})), 0.0), 12)")
    out = [f"cand AS ({base})", "top AS (SELECT doc_id, max(score) AS top FROM cand GROUP BY doc_id)",
           "p0 AS (SELECT DISTINCT doc_id, []::VARCHAR[] AS chosen FROM cand)"]
    for j in range(1, top_n + 1):
        out.append(f"""p{j} AS (SELECT c.doc_id, list_append(p.chosen, c.gram) AS chosen
  FROM cand c JOIN p{j - 1} p ON p.doc_id = c.doc_id JOIN top t ON t.doc_id = c.doc_id
  WHERE NOT list_contains(p.chosen, c.gram)
  QUALIFY row_number() OVER (PARTITION BY c.doc_id ORDER BY {value} DESC, c.rank ASC) = 1)""")
    rows = " UNION ALL ".join(f"SELECT doc_id, CAST({j} AS INTEGER) AS rank, chosen[{j}] AS gram FROM p{j}" for j in range(1, top_n + 1))
    return with_(*out) + f"SELECT r.doc_id, r.rank, r.gram, c.score FROM ({rows}) r JOIN cand c ON c.doc_id = r.doc_id AND c.gram = r.gram"


SQL["keywords_mmr"] = _mmr_sql()


def _maxsum_sql(candidates: int = 20, top_n: int = 10) -> str:
    """Every choice, as a subset (bit mask, first rank highest) of the first
    half of the candidates with one of the second; similarities in millionths."""
    base = SQL["keywords_tfidf"].replace("rank <= 10", f"rank <= {candidates}")
    h, every = candidates // 2, 1 << candidates
    across = " + ".join(f"((a.mask >> {h - i}) & 1) * b.x{i}" for i in range(1, h + 1))
    return with_(
        f"cand AS MATERIALIZED (SELECT *, list_distinct(string_split(gram, ' ')) AS toks FROM ({base}))",
        "n AS (SELECT doc_id, count(*) AS n FROM cand GROUP BY doc_id)",
        """sim AS MATERIALIZED (SELECT * FROM (SELECT x.doc_id, x.rank AS i, y.rank AS j,
             CAST((2000000 * len(list_intersect(x.toks, y.toks)) + len(list_distinct(list_concat(x.toks, y.toks))))
                  // (2 * len(list_distinct(list_concat(x.toks, y.toks)))) AS BIGINT) AS s
           FROM cand x JOIN cand y ON y.doc_id = x.doc_id AND y.rank > x.rank) WHERE s > 0)""",
        f"masks AS (SELECT CAST(unnest(range({1 << h})) AS BIGINT) AS mask)",
        f"places AS (SELECT mask, i FROM masks, (SELECT unnest(range(1, {h + 1})) AS i) WHERE (mask >> ({h} - i)) & 1 = 1)",
        # a place that a short list lacks is in no mask
        f"""halves AS (SELECT n.doc_id, p.part, m.mask, bit_count(m.mask) AS size FROM n CROSS JOIN (VALUES (0), (1)) p(part) CROSS JOIN masks m
           WHERE n.n >= {top_n} AND (m.mask & ((1 << greatest(0, least({h}, {h} - (n.n - p.part * {h})))) - 1)) = 0)""",
        f"""inside AS (SELECT s.doc_id, (s.i - 1) // {h} AS part, a.mask, CAST(sum(s.s) AS BIGINT) AS own
           FROM sim s JOIN places a ON a.i = (s.i - 1) % {h} + 1 JOIN places b ON b.i = (s.j - 1) % {h} + 1 AND b.mask = a.mask
           WHERE (s.i - 1) // {h} = (s.j - 1) // {h} GROUP BY ALL)""",
        f"""beyond AS (SELECT s.doc_id, b.mask, {", ".join(f"CAST(coalesce(sum(s.s) FILTER (s.i = {i}), 0) AS BIGINT) AS x{i}" for i in range(1, h + 1))}
           FROM sim s JOIN places b ON b.i = s.j - {h} WHERE s.i <= {h} GROUP BY ALL)""",
        # of subsets that cost the same whatever is chosen in the other half the first one is enough
        f"""meets AS (SELECT doc_id, bit_or(1 << ({h} - i)) AS bits FROM sim WHERE i <= {h} AND j > {h} GROUP BY doc_id)""",
        """lefts AS (SELECT v.doc_id, max(v.mask) AS mask, v.size, coalesce(o.own, 0) AS own FROM halves v
           LEFT JOIN inside o ON o.doc_id = v.doc_id AND o.part = v.part AND o.mask = v.mask
           LEFT JOIN meets m ON m.doc_id = v.doc_id
           WHERE v.part = 0 GROUP BY v.doc_id, v.size, coalesce(o.own, 0), v.mask & coalesce(m.bits, 0))""",
        f"""rights AS (SELECT doc_id, max(mask) AS mask, size, own, {", ".join(f"x{i}" for i in range(1, h + 1))} FROM (
             SELECT v.doc_id, v.mask, v.size, coalesce(o.own, 0) AS own, {", ".join(f"coalesce(x.x{i}, 0) AS x{i}" for i in range(1, h + 1))}
             FROM halves v LEFT JOIN inside o ON o.doc_id = v.doc_id AND o.part = v.part AND o.mask = v.mask
             LEFT JOIN beyond x ON x.doc_id = v.doc_id AND x.mask = v.mask WHERE v.part = 1) GROUP BY ALL)""",
        f"""choices AS (SELECT a.doc_id, min((a.own + b.own + {across}) * {every} + ({every - 1} - (a.mask * {1 << h} + b.mask))) AS best
           FROM lefts a JOIN rights b ON b.doc_id = a.doc_id AND b.size = {top_n} - a.size GROUP BY a.doc_id)""",
        f"""picked AS (SELECT c.*, n.n, x.best // {every} AS total, {every - 1} - x.best % {every} AS mask
           FROM cand c JOIN n USING (doc_id) LEFT JOIN choices x USING (doc_id))""",
        "alone AS (SELECT doc_id, sum(s) AS total FROM sim GROUP BY doc_id)") + f"""
SELECT p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY p.rank) AS INTEGER) AS rank, p.gram, p.score,
       CAST(CASE WHEN p.n <= {top_n} THEN coalesce(a.total, 0) ELSE p.total END AS DOUBLE) / 1000000 AS alike
FROM picked p LEFT JOIN alone a ON a.doc_id = p.doc_id
WHERE p.n <= {top_n} OR CAST(p.mask >> ({candidates} - p.rank) AS BIGINT) & 1 = 1"""


SQL["keywords_maxsum"] = _maxsum_sql()
SQL["summarize"] = with_(SUMMARY) + """
SELECT b.doc_id, b.pos, s.sentence, b.score FROM sbest b JOIN sents s ON s.doc_id = b.doc_id AND s.pos = b.pos"""

SQL["classify_nb"] = f"""WITH
lab AS (SELECT d.doc_id, l.quality AS class, d.text FROM documents d JOIN labels l ON l.doc_id = d.doc_id
        WHERE d.doc_id % 5 <> 0),
cnt AS (SELECT token, class, count(*) AS cnt FROM (
          SELECT class, unnest(regexp_extract_all(lower(text), {TOKEN})) AS token FROM lab) GROUP BY token, class),
voc AS (SELECT DISTINCT token FROM cnt),
v AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM voc),
ct AS (SELECT class, sum(cnt) AS class_tokens FROM cnt GROUP BY class),
nall AS (SELECT count(*) AS n_all FROM lab),
cls AS (SELECT c.class, ln(c.n_c / nall.n_all) AS log_prior,
               ln(CAST(coalesce(ct.class_tokens, 0) AS DOUBLE) + 1.0::DOUBLE * v.v) AS log_norm
        FROM (SELECT class, count(*) AS n_c FROM lab GROUP BY class) c LEFT JOIN ct ON ct.class = c.class
        CROSS JOIN nall CROSS JOIN v),
pairs AS (SELECT token, class, ln(cnt + 1.0::DOUBLE) - ln(1.0::DOUBLE) AS w FROM cnt),
tf AS (SELECT doc_id, token, count(*) AS f FROM (
         SELECT doc_id, unnest(regexp_extract_all(lower(text), {TOKEN})) AS token FROM documents) GROUP BY doc_id, token),
known AS (SELECT doc_id, sum(f) AS n_known FROM tf WHERE token IN (SELECT token FROM voc) GROUP BY doc_id),
part AS (SELECT tf.doc_id, p.class, sum(tf.f * p.w) AS seen FROM tf JOIN pairs p ON p.token = tf.token
         GROUP BY tf.doc_id, p.class),
sc AS (SELECT d.doc_id, c.class,
              round(c.log_prior + CAST(coalesce(k.n_known, 0) AS DOUBLE) * (ln(1.0::DOUBLE) - c.log_norm)
                    + coalesce(p.seen, 0.0::DOUBLE), 6) AS score
       FROM documents d LEFT JOIN known k ON k.doc_id = d.doc_id CROSS JOIN cls c
       LEFT JOIN part p ON p.doc_id = d.doc_id AND p.class = c.class)
SELECT doc_id, class AS pred, score FROM sc
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class ASC) = 1"""

NB_ALL = SQL["classify_nb"][:SQL["classify_nb"].index("SELECT doc_id, class AS pred, score FROM sc")]
SQL["classify_scores"] = NB_ALL + """SELECT doc_id,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class ASC) AS INTEGER) AS rank,
       CAST(class AS VARCHAR) AS label,
       round(exp(score - max(score) OVER (PARTITION BY doc_id)) / sum(exp(score - top)) OVER (PARTITION BY doc_id), 6) AS score
FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM sc)"""


def _reweighted_sql(k: int = 3) -> str:
    """The rounds of the choice, one CTE each: a token's probability is
    squared once for each chosen sentence that has it."""
    out = [f"""rs AS (SELECT doc_id, unnest({SENTS}) AS sentence, CAST(generate_subscripts({SENTS}, 1) AS INTEGER) AS pos FROM documents)""",
           f"""rt AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(sentence), {TOKEN})) AS token FROM rs)""",
           """rp0 AS MATERIALIZED (SELECT doc_id, token, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY doc_id) AS p
             FROM rt GROUP BY doc_id, token)"""]
    chosen = ["SELECT NULL::BIGINT AS doc_id, NULL::INTEGER AS pos, NULL::DOUBLE AS score WHERE false"]
    for j in range(1, k + 1):
        before = " UNION ALL ".join(chosen)
        out.append(f"""rc{j} AS MATERIALIZED (SELECT t.doc_id, t.pos, round(avg(p.p), 9) AS score
             FROM rt t JOIN rp{j - 1} p ON p.doc_id = t.doc_id AND p.token = t.token
             WHERE (t.doc_id, t.pos) NOT IN (SELECT doc_id, pos FROM ({before})) GROUP BY t.doc_id, t.pos
             QUALIFY row_number() OVER (PARTITION BY t.doc_id ORDER BY round(avg(p.p), 9) DESC, t.pos) = 1)""")
        chosen.append(f"SELECT doc_id, pos, score FROM rc{j}")
        out.append(f"""rp{j} AS MATERIALIZED (SELECT p.doc_id, p.token, CASE WHEN c.token IS NULL THEN p.p ELSE p.p * p.p END AS p
             FROM rp{j - 1} p LEFT JOIN (SELECT DISTINCT t.doc_id, t.token FROM rt t JOIN rc{j} c ON c.doc_id = t.doc_id AND c.pos = t.pos) c
             ON c.doc_id = p.doc_id AND c.token = p.token)""")
    return with_(*out) + f"""
SELECT c.doc_id, c.pos, s.sentence, c.score FROM ({" UNION ALL ".join(chosen[1:])}) c JOIN rs s ON s.doc_id = c.doc_id AND s.pos = c.pos"""


SQL["score_labels"] = SQL["classify_nb"].replace(f"unnest(regexp_extract_all(lower(text), {TOKEN})) AS token FROM documents",
                                                f"unnest(regexp_extract_all(lower(substring(text, 1, 2200)), {TOKEN})) AS token FROM documents")
SQL["summarize_reweighted"] = _reweighted_sql()
SQL["score_batches"] = with_(PARSED) + """
SELECT url_hash, CAST(length(substring(text, 1, 2200)) AS BIGINT) AS n_chars,
       CASE WHEN length(substring(text, 1, 2200)) >= 1000 THEN 'long' ELSE 'short' END AS label
FROM parsed"""


# ---------------------------------------------------------------- streams (same answers as the batch twins)
SQL["stream_history_counts"] = SQL["user_tag_counts"]
SQL["stream_liked_state"] = SQL["liked_state"]
SQL["stream_page_parse"] = with_(PARSED) + """
SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY page_id DESC) = 1"""
SQL["stream_quarantine"] = f"""WITH damaged AS (
  SELECT page_id, {s_canon('url')} AS url,
         CASE WHEN page_id % 7 = 3 THEN regexp_replace(html, {TITLE_RE}, '', 'g') ELSE html END AS html FROM pages)
SELECT page_id, md5(url) AS url_hash, url, 'title not found' AS err,
       'parse_pages: no <title> element in ' || length(html) || ' characters' AS trace
FROM damaged WHERE NOT {s_has_title('html')}"""
PAGE_KEYWORDS = SQL["keywords_tfidf"].replace("doc_id", "url_hash").replace("FROM documents", "FROM newest")
SQL["page_to_article"] = with_(PARSED, "newest AS (SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY page_id DESC) = 1)",
                               f"kw AS ({PAGE_KEYWORDS})",
                               "kws AS (SELECT url_hash, string_agg(gram, ',' ORDER BY rank) AS keywords FROM kw GROUP BY url_hash)") + """
SELECT n.url_hash, n.url, n.title, n.source, n.published_date, k.keywords,
       CAST(json_object('inputs', substring(n.text, 1, 2200)) AS VARCHAR) AS body,
       md5(n.url_hash || ':classification') || '.out' AS classification_location,
       md5(n.url_hash || ':summary') || '.out' AS summary_location
FROM newest n LEFT JOIN kws k ON k.url_hash = n.url_hash"""
SQL["stream_result_merge"] = SQL["metadata_merge"]
SQL["stream_html_files"] = SQL["stream_page_parse"]
SQL["stream_result_files"] = SQL["extract_tags"]
SQL["stream_results_early"] = SQL["metadata_merge"]
SQL["stream_url_dedup"] = with_(LINKS) + "SELECT DISTINCT md5(link) AS url_hash, link AS url FROM lcand"
SQL["stream_url_seen"] = SQL["stream_url_dedup"]
