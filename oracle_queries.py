"""The registered queries in DuckDB SQL, written from the rules and not from
the Spark plans.  Fragments are Python functions over SQL text."""
from __future__ import annotations

PARAMETERS = {
    "sites": [
        ("blog", "Blog", "blog.tionsh.example.net"), ("plain", "Plain", "thther.example.org"),
        ("large", "Large", "blog.tionsh.example.com"),
    ],
    "doc_sources": ["src0", "src1", "src2", "src3", "src4"],
    "links_per_source": 5,
    "stored_lang": "en",
    # What texts end with and images are called, so that each rule has rows that it takes and rows that it leaves.
    "endings": ["", "Follow us on the site", "news of the day", "READ MORE", "we follow the river", "Privacy Policy", "shared thisway"],
    "images": ["/img/Large-story.JPG", "/icon.png", "/banner-600.webp", "/x", "/news/800.jpeg", "/logo-article.png", "/thumb"],
    "event_keys": ["user_id", "event_type"],
    "event_lag_s": 20_000,
    "event_delay_s": 9_000,
    "search": {
        "long_query": "tion%ing o",
        "sources": ["src1", "src2", "src3"], "quality_min": 0.7, "query": "th%r",
        "date_from": "2024-01-01 01:00:00", "date_to": "2024-01-01 12:00:00", "limit": 20, "offset": 5,
    },
    "as_of": "2024-01-02 12:00:00",
    "recent_n": 20,
    "history_longest": 10,
    "history_keep": 5,
    "recovery_s": 86_400 * 3,
    "breaker_threshold": 2,
    "admission_limit": 2,
    "admission_window_s": 86_400,
    "tfidf_threshold": 0.2,
    "cosine_threshold": 0.35,
    # Frequent words of the test texts.
    "stop_words": ["the", "of", "and", "to", "in", "is", "it", "that", "for", "on", "with", "as", "are", "this", "by", "be",
                   "de", "la", "le", "les", "des", "et", "un", "que", "der", "die", "und", "ist", "das", "el", "los", "en"],
}
P = PARAMETERS
EPOCH = 1704067200

SITE_NAMES = "'inc42', 'entrackr', 'moneycontrol', 'startupnews'"
AGENCY_WORDS = "'source', 'image', 'reuters', 'pti', 'ians', 'et'"
BOILERPLATE = (
    "share this|follow us|subscribe|advertisement|related articles|trending now|also read|read more|"
    "terms of service|privacy policy|copyright"
)
KEYWORDS = ["raises", "funding", "million", "billion", "startup", "company", "announced"]
SPACE = (
    r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
TITLE = "split_part(text, chr(10), 1)"


def squeeze(x):
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def clean(x):
    return f"trim(replace({squeeze(x)}, '&nbsp;', ' '))"


def normalize(x):
    """Word by word: delete listed words, then phrases, links and addresses."""
    runs = rf"regexp_extract_all({squeeze(f'lower({x})')}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
    kept = f"array_to_string(list_filter({runs}, lambda w: w NOT IN ({SITE_NAMES}, {AGENCY_WORDS})), '')"
    for pattern in (r"\b(read more|also read|continue reading)\b", "https?://[^ ]+", "[^ ]+@[^ ]+"):
        kept = f"regexp_replace({kept}, '{pattern}', '', 'g')"
    return f"trim({kept})"


def words(x):
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda w: w <> '')"


def path(url):
    return f"regexp_replace(regexp_extract({url}, '{PARTS}', 3), ';[^/]*$', '')"


def host(url):
    return f"regexp_extract({url}, '{PARTS}', 2)"


def fingerprint(title, content, url, length=2000):
    body = f"substr({content}, 1, {length})" if length else content
    return (f"sha256('T:' || {normalize(title)} || '|C:' || {normalize(body)} "
            f"|| '|U:' || {path(url)})")


def quality(title="''", content="''", description="''", author="''", date="''", image="''"):
    rules = [
        (f"length({title}) > 0", 0.2), (f"length({title}) > 10", 0.1), (f"length({content}) > 100", 0.3),
        (f"length({content}) > 500", 0.2), (f"length({content}) > 1000", 0.1), (f"{description} <> ''", 0.1),
        (f"{author} <> ''", 0.05), (f"{date} <> ''", 0.05), (f"{image} <> ''", 0.1),
    ]
    total = "0::DOUBLE"
    for rule, weight in rules:
        total = f"({total} + CASE WHEN {rule} THEN {weight}::DOUBLE ELSE 0::DOUBLE END)"
    return f"least({total}, 1::DOUBLE)"


def confidence(q):
    return f"least({q} * 1.2::DOUBLE, 1::DOUBLE)"


def tier(q, missing):
    return (f"CASE WHEN {q} IS NULL THEN {missing} WHEN {q} >= 0.8::DOUBLE THEN 'excellent' "
            f"WHEN {q} >= 0.6::DOUBLE THEN 'good' WHEN {q} >= 0.4::DOUBLE THEN 'fair' ELSE 'poor' END")


def leading(x, n=300):
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


URL = "'https://' || source || '.example/' || doc_id"
DOC_ARTICLES = f"""
articles_base AS (
  SELECT doc_id, lang, source, {URL} AS url, {TITLE} AS title, text AS content,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at
  FROM documents),
articles AS (
  SELECT doc_id, lang, 'art_{EPOCH}_' || substr(md5(url), 1, 8) AS news_id, source, url, title, content,
         '' AS description, '' AS author, strftime(created_at, '%Y-%m-%d') AS published_date, '' AS image_url,
         {leading('content')} AS ai_summary,
         CASE WHEN title <> content THEN {quality('title', 'content')} END AS quality_score,
         ['json_ld', 'microdata', 'opengraph', 'html_semantic', 'html_heuristic', NULL][doc_id % 6 + 1] AS extraction_strategy,
         created_at
  FROM articles_base)"""

DECODE = "{x}"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "),
                     ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    DECODE = f"replace({DECODE}, '{_name}', '{_char}')"


def decode(x):
    return DECODE.replace("{x}", x)


LEAVES = f"list_transform(regexp_extract_all(html, '(?i)<p(?:\\s[^>]*)?>([^<]*)</p\\s*>', 1), lambda p: {clean(decode('p'))})"
PAGE_TITLE = clean(decode("regexp_extract(html, '(?i)<title(?:\\s[^>]*)?>([^<]*)</title\\s*>', 1)"))
LEAF_TEXT = (
    f"array_to_string(list_filter({LEAVES}, lambda p: length(p) > 30 "
    f"AND NOT regexp_matches(lower(p), '{BOILERPLATE}')), chr(10) || chr(10))"
)
WHOLE = (f"list_transform(regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p\\s*>', 1), "
         f"lambda p: {clean(decode("regexp_replace(p, '<[^>]*>', '', 'g')"))})")
FIRST_TEXT = f"array_to_string(list_filter({WHOLE}, lambda p: length(p) > 50)[1:10], chr(10) || chr(10))"
QUICK = f"""
quick_base AS (SELECT page_id, url, {host('url')} AS host, {PAGE_TITLE} AS title, {LEAF_TEXT} AS content,
                      {FIRST_TEXT} AS first_text FROM pages),
quick AS (SELECT *, {quality('title', 'content')} AS quality_score FROM quick_base)"""

ANCHOR = r'<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>'
LINKS = f"""
raw_links AS (
  SELECT page_id, url AS page_url, unnest(range(len(regexp_extract_all(html, '{ANCHOR}', 1)))) AS pos,
         unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS href,
         unnest(regexp_extract_all(html, '{ANCHOR}', 2)) AS label FROM pages),
links AS (
  SELECT page_id, pos::INTEGER AS pos, {clean('label')} AS title,
         CASE WHEN href LIKE '/%' THEN regexp_extract(page_url, '^[a-z]+://[^/?#]*') || href ELSE href END AS url
  FROM raw_links WHERE {clean('label')} <> '' AND href <> '')"""

KEYED = f"""
keyed_base AS (SELECT doc_id, lang, text, 'https://' || lang || '.example/' || md5(substr(text, 1, 20)) AS url FROM documents),
keyed AS (SELECT doc_id, lang, url, md5({normalize(TITLE)}) AS title_hash,
                 {fingerprint(TITLE, 'text', 'url', None)} AS content_fingerprint FROM keyed_base)"""

# Row by row in order, carrying the keys of everything kept so far.
GREEDY = KEYED + """,
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM keyed),
walk AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS doc_id, NULL::VARCHAR AS reason, NULL::DOUBLE AS similarity, NULL::BIGINT AS matched,
         []::VARCHAR[] AS urls, []::VARCHAR[] AS titles, []::VARCHAR[] AS prints, []::BIGINT[] AS ids
  UNION ALL
  SELECT r.n, r.doc_id,
    CASE WHEN list_contains(w.urls, r.url) THEN 'exact_url_match'
         WHEN list_contains(w.titles, r.title_hash) THEN 'title_hash_match'
         WHEN list_contains(w.prints, r.content_fingerprint) THEN 'content_fingerprint_match' END AS reason,
    CASE WHEN list_contains(w.urls, r.url) THEN 1.0::DOUBLE
         WHEN list_contains(w.titles, r.title_hash) THEN 0.95::DOUBLE
         WHEN list_contains(w.prints, r.content_fingerprint) THEN 0.90::DOUBLE ELSE 0::DOUBLE END,
    w.ids[coalesce(list_position(w.urls, r.url), list_position(w.titles, r.title_hash),
                   list_position(w.prints, r.content_fingerprint))],
    CASE WHEN NOT hit THEN list_append(w.urls, r.url) ELSE w.urls END,
    CASE WHEN NOT hit THEN list_append(w.titles, r.title_hash) ELSE w.titles END,
    CASE WHEN NOT hit THEN list_append(w.prints, r.content_fingerprint) ELSE w.prints END,
    CASE WHEN NOT hit THEN list_append(w.ids, r.doc_id) ELSE w.ids END
  FROM walk w JOIN numbered r ON r.n = w.n + 1,
       LATERAL (SELECT list_contains(w.urls, r.url) OR list_contains(w.titles, r.title_hash)
                       OR list_contains(w.prints, r.content_fingerprint) AS hit))"""

RUNS = """
runs AS (SELECT 'run_' || lpad(event_id::VARCHAR, 12, '0') AS run_id, user_id AS articles_found, user_id AS new_articles,
                CAST(json_extract(props, '$.k') AS BIGINT) AS duplicates, (event_type = 'error')::BIGINT AS errors,
                value AS runtime_seconds, ts AS created_at FROM events)"""
LOG = """
log AS (SELECT user_id::VARCHAR AS source, ts, event_id, event_type <> 'error' AS ok,
               CAST(json_extract(props, '$.k') AS INTEGER) % 3 AS n_articles FROM events)"""

# Summary: the first ten sentences with score and length.
_KEYWORD_SCORE = "".join(
    f" + CASE WHEN contains(lower(s), '{k}') THEN 0.3::DOUBLE ELSE 0::DOUBLE END" for k in KEYWORDS
)
_N = f"len({words('s')})"
_SCORE = (
    f"((10 - i) * 0.1::DOUBLE + CASE WHEN {_N} BETWEEN 10 AND 30 THEN 0.5::DOUBLE "
    f"WHEN {_N} BETWEEN 5 AND 50 THEN 0.2::DOUBLE ELSE 0::DOUBLE END{_KEYWORD_SCORE})"
)
SENTENCES = f"""
split AS (SELECT doc_id, string_split(text, '. ')[1:10] AS ss FROM documents),
single AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM split),
scored AS (SELECT doc_id, s, i, {_N} AS n, {_SCORE} AS score FROM single)"""

MICRO_TEXT = "text"
LATE = f"""WITH arrivals AS (
  SELECT *, (epoch_us(ts) // 1000000 + event_id * 7919 % {P['event_lag_s']}) * 10000000 + event_id AS arrived FROM events),
marked AS (SELECT *, coalesce(epoch_us(ts) < max(epoch_us(ts)) OVER (ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  - {P['event_delay_s'] * 1_000_000}, false) AS late FROM arrivals)"""


def _vectors():
    n = normalize("title || ' ' || content")
    stop = ", ".join(f"'{w}'" for w in P["stop_words"])
    return DOC_ARTICLES + rf""",
sim AS (SELECT doc_id, source, created_at, {n} AS t FROM articles),
toks AS (SELECT doc_id, source, list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({stop})) AS w FROM sim),
g AS (
  SELECT doc_id, source, unnest(w) AS term FROM toks
  UNION ALL SELECT doc_id, source, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM toks
  UNION ALL SELECT doc_id, source, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) FROM toks),
tf AS (SELECT source, doc_id, term, count(*) AS tf FROM g GROUP BY ALL),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
voc AS (
  SELECT source, term, df, n FROM (
    SELECT source, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL) JOIN n USING (source)
  WHERE df <= 0.95::DOUBLE * n),
raw AS (SELECT source, doc_id, term, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN voc USING (source, term)),
vec AS (SELECT source, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw),
newest AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, doc_id DESC) AS r,
                  least(count(*) OVER (PARTITION BY source), 100) AS c FROM sim),
stored AS (SELECT source, doc_id AS matched FROM newest WHERE r <= 100 AND r > c - 50)"""


def statements() -> dict[str, str]:
    s = P["search"]
    search_where = (
        f"source IN ({', '.join(repr(x) for x in s['sources'])}) AND quality_score >= {s['quality_min']}::DOUBLE "
        f"AND created_at >= TIMESTAMP '{s['date_from']}' AND created_at <= TIMESTAMP '{s['date_to']}' "
        f"AND (title ILIKE '%{s['query']}%' OR content ILIKE '%{s['query']}%')"
    )
    A = f"WITH {DOC_ARTICLES} "
    Q = f"WITH {QUICK} "
    site_values = ", ".join(f"('{n}', '{h}')" for _, n, h in P["sites"])
    doc_sources = ", ".join(f"'{x}'" for x in P["doc_sources"])
    since = f"(CAST(TIMESTAMP '{P['as_of']}' AS DATE) - 1)::TIMESTAMP"
    img_score = (
        "greatest(0::DOUBLE, 0::DOUBLE"
        " + CASE WHEN regexp_matches({u}, 'large|big|1024|800|600') THEN 0.3::DOUBLE ELSE 0::DOUBLE END"
        " + CASE WHEN regexp_matches({u}, 'article|content|story|news') THEN 0.4::DOUBLE ELSE 0::DOUBLE END"
        " + CASE WHEN regexp_matches({u}, 'icon|logo|ad|banner|thumb') THEN -0.5::DOUBLE ELSE 0::DOUBLE END"
        " + CASE WHEN regexp_matches({u}, '\\.jpg|\\.jpeg|\\.png|\\.webp') THEN 0.2::DOUBLE ELSE 0::DOUBLE END)"
    )
    prompt = (
        "chr(10) || 'Write a professional news summary in exactly 55-60 words. Focus on key facts, main players, "
        "and significance.' || chr(10) || chr(10) || 'Title: ' || {t} || chr(10) || 'Content: ' || {c} || chr(10) || chr(10) "
        "|| 'Requirements:' || chr(10) || '- Exactly 55-60 words' || chr(10) || '- Professional journalistic tone' || chr(10) "
        "|| '- Include key numbers/amounts if mentioned' || chr(10) || '- Focus on WHO, WHAT, HOW MUCH, WHY important' "
        "|| chr(10) || chr(10) || 'Summary:' || chr(10)"
    ).format(t=TITLE, c="substr(text, 1, 3000)")
    fold_rate = (
        "list_reduce(list_prepend(1::DOUBLE, list(CASE WHEN n_articles > 0 THEN -1::DOUBLE ELSE -2::DOUBLE END ORDER BY ts, event_id)"
        "), lambda r, x: CASE WHEN x = -1 THEN r * 0.9::DOUBLE + 0.1::DOUBLE ELSE r * 0.95::DOUBLE END)"
    )
    success = f"""WITH {LOG},
        rates AS (SELECT source, {fold_rate} AS rate FROM log WHERE ok GROUP BY source)
        SELECT source, round(coalesce(rate, 1), 6) AS success_rate
        FROM (SELECT DISTINCT source FROM log) LEFT JOIN rates USING (source)"""
    latest = """SELECT 'exec_' || user_id AS execution_id, arg_max(event_type, (ts, event_id)) AS status,
        arg_max(props, (ts, event_id)) AS details, max(ts) AS updated_at FROM events GROUP BY user_id"""
    # Admissions and breaker: one step per row of a source, all sources at once.
    limit, window = P["admission_limit"], P["admission_window_s"]
    admission = f"""WITH RECURSIVE numbered AS (
          SELECT user_id::VARCHAR AS client_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        walk AS (
          SELECT client_id, event_id, ts, n, true AS admitted, [ts] AS held FROM numbered WHERE n = 1
          UNION ALL
          SELECT r.client_id, r.event_id, r.ts, r.n,
            len(list_filter(w.held, lambda h: epoch_us(r.ts) - epoch_us(h) < {window * 1_000_000})) < {limit} AS admitted,
            CASE WHEN len(list_filter(w.held, lambda h: epoch_us(r.ts) - epoch_us(h) < {window * 1_000_000})) < {limit}
                 THEN list_append(list_filter(w.held, lambda h: epoch_us(r.ts) - epoch_us(h) < {window * 1_000_000}), r.ts)
                 ELSE list_filter(w.held, lambda h: epoch_us(r.ts) - epoch_us(h) < {window * 1_000_000}) END
          FROM walk w JOIN numbered r ON r.client_id = w.client_id AND r.n = w.n + 1)"""
    wait = int(P["recovery_s"] * 1_000_000)
    skip = f"(w.state = 'OPEN' AND epoch_us(r.ts) - epoch_us(w.last_fail) <= {wait})"
    breaker = f"""WITH RECURSIVE {LOG},
        numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS n FROM log),
        walk AS (
          SELECT source, ts, event_id, 0::BIGINT AS n, '' AS action, 'CLOSED' AS state, 0 AS failure_count, NULL::TIMESTAMP AS last_fail
          FROM numbered WHERE n = 1
          UNION ALL
          SELECT r.source, r.ts, r.event_id, r.n, CASE WHEN {skip} THEN 'skip' ELSE 'try' END,
            CASE WHEN {skip} THEN w.state WHEN r.ok THEN 'CLOSED' WHEN w.failure_count + 1 >= {P['breaker_threshold']} THEN 'OPEN'
                 WHEN w.state = 'OPEN' THEN 'HALF_OPEN' ELSE w.state END,
            CASE WHEN {skip} THEN w.failure_count WHEN r.ok THEN 0 ELSE w.failure_count + 1 END,
            CASE WHEN NOT {skip} AND NOT r.ok THEN r.ts ELSE w.last_fail END
          FROM walk w JOIN numbered r ON r.source = w.source AND r.n = w.n + 1)
        SELECT source, ts, event_id, action, state, failure_count FROM walk WHERE n > 0"""
    longest, keep = P["history_longest"], P["history_keep"]
    extractions = Q[:-1] + """, ex AS (SELECT page_id, host, quality_score,
        CASE WHEN quality_score < 0.3::DOUBLE THEN 'fallback' ELSE 'html_semantic' END AS strategy FROM quick)"""
    verdicts = f"WITH RECURSIVE {GREEDY} "

    out = {
        "page_scan": "SELECT page_id, url, length(html) AS n_chars FROM pages",
        "page_sources": f"""SELECT page_id, {host('url')} AS host, r.source FROM pages
            LEFT JOIN (VALUES {site_values}) r(source, host) ON {host('url')} = r.host""",
        "source_lookup": f"""SELECT DISTINCT source AS key, upper(source) AS source, 'https://' || source || '.example' AS base_url
            FROM documents WHERE source IN ({doc_sources})""",
        "invalid_source_names": f"""SELECT lang, string_agg(source, ',' ORDER BY source) AS invalid_sources
            FROM (SELECT DISTINCT lang, source FROM documents) WHERE source NOT IN ({doc_sources}) GROUP BY lang""",
        "anchor_links": f"WITH {LINKS} SELECT * FROM links",
        "capped_links": f"""WITH {LINKS} SELECT {host('url')} AS source, title, url, page_id * 100000 + pos AS pos FROM links
            QUALIFY row_number() OVER (PARTITION BY {host('url')} ORDER BY page_id, pos, url) <= {P['links_per_source']}""",
        "seen_state": f"{A} SELECT url, {fingerprint('title', 'content', 'url', None)} AS content_fingerprint FROM articles",
        "unseen_pages": f"""SELECT page_id, url FROM pages WHERE url NOT IN (
            SELECT url FROM pages WHERE {host('url')} LIKE 'blog.%')""",
        "fallback_rows": f"{A} SELECT title, quality_score FROM articles",
        "articles_union": f"""WITH {DOC_ARTICLES}, {QUICK} SELECT url, title, quality_score FROM articles
            UNION ALL SELECT url, title, quality_score FROM quick""",
        "json_round_trip": f"""{A} SELECT news_id, source, url, title, md5(content) AS content_md5, quality_score, extraction_strategy,
            published_date FROM articles""",
        "export_metadata": f"{A} SELECT count(*) AS total_articles, " + ", ".join(
            f"""count(*) FILTER (WHERE {tier('quality_score', "'poor'")} = '{t}') AS {t}""" for t in ("excellent", "good", "fair", "poor"))
            + f""", {len(P['doc_sources'])}::INTEGER AS n_sources,
            (SELECT string_agg(source || '=' || n, ',' ORDER BY source || '=' || n) FROM (
              SELECT coalesce(source, 'Unknown') AS source, count(*)::VARCHAR AS n FROM documents GROUP BY 1)) AS breakdown FROM articles""",
        "failure_streaks": """WITH e AS (SELECT user_id::VARCHAR AS source, ts, event_type <> 'error' AS ok, event_id FROM events),
            c AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY source ORDER BY ts, event_id) AS wins FROM e)
            SELECT source, count(*) AS n_failures, min(ts) AS started_at, max(ts) AS ended_at FROM c WHERE NOT ok GROUP BY source, wins""",
        "csv_export_rows": f"""{A} SELECT news_id, source, url, title, ai_summary, published_date, quality_score, created_at
            FROM articles ORDER BY created_at DESC, news_id""",
        "insertable_articles": f"""WITH {KEYED}, st AS (SELECT * FROM keyed WHERE lang = '{P['stored_lang']}')
            SELECT doc_id, 'art_{EPOCH}_' || substr(md5(doc_id::VARCHAR), 1, 8) AS news_id, url FROM keyed
            WHERE lang <> '{P['stored_lang']}' AND url NOT IN (SELECT url FROM st)
              AND content_fingerprint NOT IN (SELECT content_fingerprint FROM st)
            QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1""",
        "stored_metric_rows": f"""{Q} SELECT url, 'html_semantic' AS strategy, quality_score,
            {confidence('quality_score')} AS confidence_score, length(content)::INTEGER AS content_length,
            CASE WHEN content = '' THEN '["no content"]' ELSE '[]' END AS errors, TIMESTAMP '2024-01-01' AS created_at FROM quick""",
        "clean_text": f"SELECT doc_id, {clean('text')} AS text FROM documents",
        "normalize_text": f"SELECT doc_id, {normalize('text')} AS text FROM documents",
        "key_phrases": f"""WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents)
            SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(w)), lambda i: length(w[i]) > 3 AND length(w[i+1]) > 3)[1:10],
              lambda i: w[i] || ' ' || w[i+1]), ' ') AS phrases FROM w""",
        "content_fingerprint": f"{A} SELECT doc_id, {fingerprint('title', 'content', 'url')} AS content_fingerprint FROM articles",
        "title_hash": f"SELECT doc_id, md5({normalize(TITLE)}) AS title_hash FROM documents",
        "article_id": f"SELECT page_id, 'art_{EPOCH}_' || substr(md5(url), 1, 8) AS news_id FROM pages",
        "url_parts": f"""SELECT page_id, lower(regexp_extract(url, '{PARTS}', 1)) AS scheme, {host('url')} AS host,
            {path('url')} AS path FROM pages""",
        "looks_like_date": """SELECT o_orderkey, o_orderpriority[1] IN ('1', '2', '3') AS dated FROM orders""",
        "date_part": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events",
        "boilerplate": f"""SELECT conv_id, turn, regexp_matches(lower(text || ' ' || {P['endings']}[(conv_id + turn) % {len(P['endings'])} + 1]), '{BOILERPLATE}') AS is_boilerplate
            FROM conversations""",
        "image_scores": f"""SELECT page_id, {img_score.format(u="u")} AS score
            FROM (SELECT page_id, lower(url || {P['images']}[page_id % {len(P['images'])} + 1]) AS u FROM pages)""",
        "best_images": f"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]*')) AS root,
              regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages),
            c AS (SELECT page_id, root, unnest(hs) || '.jpg' AS src, unnest(range(len(hs))) AS i FROM h),
            k AS (SELECT page_id, src, i, {img_score.format(u="(CASE WHEN src LIKE '/%' THEN root || lower(src) ELSE lower(src) END)")} AS sc FROM c),
            b AS (SELECT page_id, arg_min(src, (-sc, i)) AS src FROM k WHERE sc > 0 GROUP BY page_id)
            SELECT page_id, coalesce(b.src, '') AS image_url FROM pages LEFT JOIN b USING (page_id)""",
        "article_quality": f"SELECT doc_id, {quality(TITLE, 'text', 'lang', 'source')} AS quality_score FROM documents",
        "confidence": f"SELECT doc_id, {confidence(quality(TITLE, 'text'))} AS confidence FROM documents",
        "quality_tier": f"""{A} SELECT doc_id, {tier('quality_score', 'NULL')} AS tier, {tier('quality_score', "'poor'")} AS tier_or_poor
            FROM articles""",
        "similarity_text": f"SELECT doc_id, {normalize(TITLE + chr(32) + '|| chr(32) || substr(text, 1, 1000)')} AS text FROM documents",
        "text_prefixes": "SELECT doc_id, length(text)::INTEGER AS n_chars, "
            + ", ".join(f"md5(substr(text, 1, {n})) AS first_{n}" for n in (300, 1000, 2000, 3000)) + " FROM documents",
        "summary_length": f"SELECT doc_id, len({words('text')})::INTEGER AS n_words, len({words('text')}) BETWEEN 50 AND 65 AS in_range FROM documents",
        "title_or_link": f"""SELECT doc_id, CASE WHEN contains(text, chr(10)) AND {TITLE} <> '' THEN {TITLE} ELSE source END AS title FROM documents""",
        "summary_prompt": f"SELECT doc_id, {prompt} AS prompt FROM documents",
        "leaf_paragraphs": f"SELECT page_id, {LEAF_TEXT} AS content FROM pages",
        "fallback_extraction": f"SELECT page_id, {PAGE_TITLE} AS title, {FIRST_TEXT} AS content FROM pages",
        "opengraph_fields": f"""SELECT doc_id AS page_id, {TITLE} AS title, '' AS description,
            '/img/' || doc_id || '.jpg' AS image_url FROM documents""",
        "json_ld_articles": f"""SELECT doc_id AS page_id, md5({clean(TITLE)}) AS title_md5, md5({clean('text')}) AS content_md5,
            source AS author, '2024-01-02' AS published_date,
            {quality(clean(TITLE), clean('text'), author="'x'", date="'x'")} AS quality_score, 'json_ld' AS extraction_strategy FROM documents""",
        "microdata_articles": f"""WITH q AS (SELECT doc_id, source, text, {quality(TITLE, 'text', author="'x'")} AS q FROM documents)
            SELECT doc_id AS page_id, CASE WHEN q < 0.3::DOUBLE THEN md5('') ELSE md5({TITLE}) END AS title_md5,
              CASE WHEN q < 0.3::DOUBLE THEN md5('') ELSE md5(text) END AS content_md5,
              CASE WHEN q < 0.3::DOUBLE THEN '' ELSE source END AS author, CASE WHEN q < 0.3::DOUBLE THEN 0 ELSE q END AS quality_score,
              CASE WHEN q < 0.3::DOUBLE THEN 'fallback' ELSE 'microdata' END AS extraction_strategy FROM q""",
        "strategy_choice": f"""WITH {QUICK}, k AS (SELECT page_id, {quality("''", 'content')} AS q1, {quality('title', 'content')} AS q2,
              {quality('title', 'first_text')} AS qf FROM quick)
            SELECT page_id, CASE WHEN greatest(q1, q2) < 0.3::DOUBLE THEN 'fallback' WHEN q2 > q1 THEN 'html_semantic' ELSE 'opengraph' END AS strategy,
              CASE WHEN greatest(q1, q2) < 0.3::DOUBLE THEN qf ELSE greatest(q1, q2) END AS quality_score FROM k""",
        "host_quality": f"""{Q} SELECT host, count(*) AS n_articles, round(avg(quality_score), 6) AS avg_quality, sum(length(content))::BIGINT AS n_chars
            FROM quick WHERE quality_score >= 0.3::DOUBLE GROUP BY host""",
        "quality_gate": f"{Q} SELECT page_id, quality_score FROM quick WHERE quality_score >= 0.3::DOUBLE",
        "export_threshold": f"{A} SELECT doc_id, quality_score FROM articles WHERE coalesce(quality_score, 0) >= 0.7::DOUBLE",
        "article_search": f"""{A} SELECT title, ai_summary AS summary, url AS redirect_url, source, image_url, created_at AS published_date, news_id
            FROM articles WHERE {search_where} ORDER BY created_at DESC, news_id LIMIT {s['limit']} OFFSET {s['offset']}""",
        "indexed_article_search": f"""{A} SELECT title, ai_summary AS summary, url AS redirect_url, source, image_url, created_at AS published_date, news_id
            FROM articles WHERE {search_where.replace(s['query'], s['long_query'])} ORDER BY created_at DESC, news_id LIMIT {s['limit']} OFFSET {s['offset']}""",
        "search_page_info": f"""{A} SELECT {s['limit']} AS "limit", {s['offset']} AS "offset", count(*) AS total,
            {s['limit'] + s['offset']} < count(*) AS has_more,
            CASE WHEN {s['limit'] + s['offset']} < count(*) THEN {s['limit'] + s['offset']} END AS next_offset FROM articles WHERE {search_where}""",
        "next_search_page": f"""{A} SELECT news_id, created_at AS published_date FROM articles
            WHERE source IN ({', '.join(repr(x) for x in s['sources'])}) AND created_at <= TIMESTAMP '{s['date_to']}'
            ORDER BY created_at DESC, news_id LIMIT {s['limit']}""",
        "dedupe_verdicts": f"""{verdicts} SELECT doc_id, reason IS NOT NULL AS is_duplicate, reason, similarity,
            CASE WHEN reason IS NOT NULL THEN matched END AS matched FROM walk WHERE n > 0""",
        "duplicate_counts": f"{verdicts} SELECT reason, count(*) AS n FROM walk WHERE reason IS NOT NULL GROUP BY reason",
        "comparison_rows": f"""{A} SELECT source, doc_id, recency::INTEGER AS recency FROM (
              SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, doc_id DESC) AS recency,
                     least(count(*) OVER (PARTITION BY source), 100) AS c FROM articles)
            WHERE recency <= 100 AND recency > c - 50""",
        "cosine_stored_match": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r,
              least(count(*) OVER (PARTITION BY label), 100) AS c FROM embeddings),
            s AS (SELECT vec_id AS matched, label, r, embedding::DOUBLE[] AS v FROM r WHERE r <= 100 AND r > c - 50),
            p AS (SELECT e.vec_id, e.label, s.matched, s.r, list_cosine_similarity(e.embedding::DOUBLE[], s.v) AS sim
                  FROM embeddings e JOIN s ON e.label = s.label AND e.vec_id <> s.matched)
            SELECT vec_id, label, arg_min(matched, r) AS matched, round(arg_min(sim, r), 6) AS similarity
            FROM p WHERE sim > {P['cosine_threshold']}::DOUBLE GROUP BY vec_id, label""",
        "cosine_earlier_match": f"""WITH p AS (
              SELECT a.vec_id, b.vec_id AS matched, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
              FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id)
            SELECT vec_id, arg_max(matched, (sim, -matched)) AS matched, round(max(sim), 6) AS similarity, count(*) AS n_matches
            FROM p WHERE sim > {P['cosine_threshold']}::DOUBLE GROUP BY vec_id""",
        "cosine_dedupe": f"""WITH RECURSIVE e AS (
              SELECT vec_id, embedding::DOUBLE[] AS v, embedding::VARCHAR AS copy, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings),
            p AS (SELECT a.n, b.vec_id AS matched, a.copy = b.copy AS same, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON b.n < a.n
              WHERE a.copy = b.copy OR list_cosine_similarity(a.v, b.v) > {P['cosine_threshold']}::DOUBLE),
            q AS (SELECT n, list({{'matched': matched, 'same': same, 'sim': sim}} ORDER BY same DESC, sim DESC, matched) AS hits FROM p GROUP BY n),
            walk AS (
              SELECT 0::BIGINT AS n, 0::BIGINT AS vec_id, []::BIGINT[] AS kept, NULL::STRUCT(matched BIGINT, same BOOLEAN, sim DOUBLE) AS hit
              UNION ALL
              SELECT e.n, e.vec_id,
                CASE WHEN len(list_filter(coalesce(q.hits, []), lambda h: list_contains(w.kept, h.matched))) > 0 THEN w.kept ELSE list_append(w.kept, e.vec_id) END,
                list_filter(coalesce(q.hits, []), lambda h: list_contains(w.kept, h.matched))[1]
              FROM walk w JOIN e ON e.n = w.n + 1 LEFT JOIN q ON q.n = e.n)
            SELECT vec_id, hit IS NOT NULL AS is_duplicate, CASE WHEN hit.same THEN 'same_vector' WHEN hit IS NOT NULL THEN 'cosine_similarity' END AS reason,
              CASE WHEN hit IS NULL THEN 0 WHEN hit.same THEN 1 ELSE round(hit.sim, 6) END AS similarity, hit.matched AS matched FROM walk WHERE n > 0""",
        "tfidf_stored_match": f"""WITH {_vectors()},
            dots AS (SELECT a.doc_id, s.matched, sum(a.weight * b.weight) AS sim
                     FROM vec a JOIN vec b ON a.source = b.source AND a.term = b.term
                     JOIN stored s ON s.source = b.source AND s.matched = b.doc_id
                     WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, s.matched)
            SELECT doc_id, arg_max(matched, (sim, -matched)) AS matched, round(max(sim), 6) AS similarity
            FROM dots GROUP BY doc_id HAVING max(sim) > {P['tfidf_threshold']}::DOUBLE""",
        "tfidf_dedupe": f"""WITH RECURSIVE {_vectors()}, {KEYED},
            near AS (SELECT a.doc_id, b.doc_id AS matched, sum(a.weight * b.weight) AS sim
              FROM vec a JOIN vec b ON a.source = b.source AND a.term = b.term AND b.doc_id < a.doc_id
              GROUP BY a.doc_id, b.doc_id HAVING sum(a.weight * b.weight) > 0.85::DOUBLE),
            hit AS (
              SELECT a.doc_id, b.doc_id AS matched, 1 AS kind, 1::DOUBLE AS sim FROM keyed a JOIN keyed b ON a.url = b.url AND b.doc_id < a.doc_id
              UNION ALL SELECT a.doc_id, b.doc_id, 2, 0.95::DOUBLE FROM keyed a JOIN keyed b ON a.title_hash = b.title_hash AND b.doc_id < a.doc_id
              UNION ALL SELECT a.doc_id, b.doc_id, 3, 0.9::DOUBLE FROM keyed a JOIN keyed b ON a.content_fingerprint = b.content_fingerprint AND b.doc_id < a.doc_id
              UNION ALL SELECT doc_id, matched, 4, sim FROM near),
            q AS (SELECT doc_id, list({{'matched': matched, 'kind': kind, 'sim': sim}} ORDER BY kind, sim DESC, matched) AS hits FROM hit GROUP BY doc_id),
            e AS MATERIALIZED (SELECT doc_id, coalesce(hits, []) AS hits, row_number() OVER (ORDER BY doc_id) AS n FROM keyed LEFT JOIN q USING (doc_id)),
            walk AS (
              SELECT 0::BIGINT AS n, 0::BIGINT AS doc_id, []::BIGINT[] AS kept, NULL::STRUCT(matched BIGINT, kind INTEGER, sim DOUBLE) AS hit
              UNION ALL
              SELECT e.n, e.doc_id,
                CASE WHEN len(list_filter(e.hits, lambda h: list_contains(w.kept, h.matched))) > 0 THEN w.kept ELSE list_append(w.kept, e.doc_id) END,
                list_filter(e.hits, lambda h: list_contains(w.kept, h.matched))[1]
              FROM walk w JOIN e ON e.n = w.n + 1)
            SELECT doc_id, hit IS NOT NULL AS is_duplicate,
              ['exact_url_match', 'title_hash_match', 'content_fingerprint_match', 'tfidf_similarity'][hit.kind] AS reason,
              CASE WHEN hit IS NULL THEN 0 ELSE round(hit.sim, 6) END AS similarity, hit.matched AS matched FROM walk WHERE n > 0""",
        "total_articles": "SELECT count(*) AS total_articles FROM documents",
        "recent_articles": f"{A} SELECT count(*) AS articles_last_24h FROM articles WHERE created_at >= {since}",
        "source_performance": f"{A} SELECT source, count(*) AS n_articles, coalesce(round(avg(quality_score), 3), 0) AS avg_quality FROM articles GROUP BY source",
        "strategy_performance": f"""{A} SELECT extraction_strategy AS strategy, count(*) AS n_articles, coalesce(round(avg(quality_score), 3), 0) AS avg_quality
            FROM articles WHERE extraction_strategy IS NOT NULL GROUP BY 1""",
        "quality_distribution": f"{A} SELECT {tier('quality_score', 'NULL')} AS tier, count(*) AS n_articles FROM articles WHERE quality_score IS NOT NULL GROUP BY 1",
        "quality_columns": f"{A} SELECT " + ", ".join(
            f"""count(*) FILTER (WHERE {tier('quality_score', "'poor'")} = '{t}') AS {t}""" for t in ("excellent", "good", "fair", "poor")) + " FROM articles",
        "source_share": "SELECT source, count(*) AS n_articles, round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 6) AS share_pct FROM documents GROUP BY source",
        "source_columns": "SELECT " + ", ".join(f"count(*) FILTER (WHERE source = '{x}') AS {x}" for x in P["doc_sources"]) + " FROM documents",
        "strategy_share": f"""{A} SELECT * FROM (SELECT extraction_strategy AS strategy, count(*) AS n_articles,
            round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 6) AS share_pct FROM articles GROUP BY 1) WHERE strategy IS NOT NULL""",
        "quality_stats": f"{A} SELECT round(avg(quality_score), 6) AS avg_quality, max(quality_score) AS max_quality, min(quality_score) AS min_quality FROM articles",
        "length_stats": "SELECT round(avg(length(text)), 6) AS avg_length, sum(length(text))::BIGINT AS total_length FROM documents",
        "sample_article": f"""{A} SELECT substr(title, 1, 80) || '...' AS title, source, quality_score, extraction_strategy AS strategy
            FROM articles ORDER BY created_at DESC, news_id LIMIT 1""",
        "strategy_means": f"{extractions} SELECT host, strategy, round(avg(quality_score), 6) AS mean_quality, count(*) AS n_pages FROM ex GROUP BY ALL",
        "run_rate": f"WITH {RUNS} SELECT run_id, round(articles_found / nullif(runtime_seconds, 0) * 60, 6) AS articles_per_minute FROM runs",
        "run_totals": """SELECT count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS articles_found,
            count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS new_articles,
            count(*) FILTER (WHERE event_type = 'view') AS duplicates, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events""",
        "recent_runs": f"""WITH {RUNS} SELECT run_id, articles_found, new_articles, duplicates, round(runtime_seconds, 1) AS runtime, created_at
            FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 10""",
        "mean_run_time": f"""WITH {RUNS} SELECT round(avg(coalesce(runtime_seconds, 0)), 6) AS mean_runtime FROM (
            SELECT * FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 100)""",
        "latest_status": f"SELECT *, CAST(json_extract(details, '$.k') AS INTEGER) AS k FROM ({latest})",
        "dashboard": f"""WITH {DOC_ARTICLES}, {RUNS}
            SELECT 'total_articles' AS part, '' AS name, count(*) AS n, NULL::DOUBLE AS value FROM articles
            UNION ALL SELECT 'articles_last_24h', '', count(*) FILTER (WHERE created_at >= {since}), NULL FROM articles
            UNION ALL SELECT 'source_performance', source, count(*), coalesce(round(avg(quality_score), 3), 0) FROM articles GROUP BY source
            UNION ALL SELECT 'extraction_strategies', extraction_strategy, count(*), coalesce(round(avg(quality_score), 3), 0)
              FROM articles WHERE extraction_strategy IS NOT NULL GROUP BY extraction_strategy
            UNION ALL SELECT 'quality_distribution', {tier('quality_score', 'NULL')}, count(*), NULL FROM articles WHERE quality_score IS NOT NULL GROUP BY 2
            UNION ALL SELECT 'recent_runs', run_id, articles_found, round(runtime_seconds, 1) FROM (
              SELECT * FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 10)""",
        "newest_articles": f"""{A} SELECT source, doc_id, title, created_at,
              row_number() OVER (PARTITION BY source ORDER BY created_at DESC, doc_id DESC)::INTEGER AS recency FROM articles
            QUALIFY recency <= {P['recent_n']}""",
        "success_rate": success,
        "breaker_states": breaker,
        "trimmed_strategy_means": f"""{extractions}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) AS r,
              count(*) OVER (PARTITION BY host) AS n FROM ex)
            SELECT host, strategy, round(avg(quality_score), 6) AS mean_quality, count(*) AS n_pages FROM r
            WHERE r <= CASE WHEN n <= {longest} THEN n ELSE {keep} + (n - {longest} - 1) % {longest - keep + 1} END GROUP BY ALL""",
        "admissions": f"{admission} SELECT client_id, event_id, ts, admitted FROM walk",
        "trailing_requests": f"""SELECT DISTINCT user_id::VARCHAR AS client_id, ts, count(*) OVER (PARTITION BY user_id, ts) AS n_requests,
            count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {window * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS n_trailing FROM events""",
        "sentences": "SELECT doc_id, len(string_split(text, '. '))::INTEGER AS n_sentences, string_split(text, '. ')[1] AS first_sentence FROM documents",
        "sentence_scores": f"""WITH {SENTENCES} SELECT doc_id, string_agg(i || ':' || round(score, 6)::VARCHAR || ':' || n, ' ' ORDER BY score DESC, i) AS ranked
            FROM scored GROUP BY doc_id""",
        "extractive_summary": f"""WITH RECURSIVE {SENTENCES},
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS k FROM scored),
            pick AS (
              SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS total, []::VARCHAR[] AS picked FROM (SELECT DISTINCT doc_id FROM scored)
              UNION ALL
              SELECT p.doc_id, r.k, CASE WHEN p.total < 55 AND p.total + r.n <= 65 THEN p.total + r.n ELSE p.total END,
                CASE WHEN p.total < 55 AND p.total + r.n <= 65 THEN list_append(p.picked, r.s) ELSE p.picked END
              FROM pick p JOIN r ON r.doc_id = p.doc_id AND r.k = p.k + 1)
            SELECT doc_id, array_to_string(arg_max(picked, k), ' ') AS summary FROM pick GROUP BY doc_id""",
        "leading_text": f"SELECT doc_id, {leading('text')} AS summary FROM documents",
        "stream_distinct_events": "SELECT event_id, user_id, event_type, ts FROM events",
        "stream_admissions": f"{admission} SELECT client_id, event_id, ts, admitted, false AS late FROM walk",
        "stream_source_health": success,
        "stream_latest_status": latest,
        "stream_first_events": f"""{LATE} SELECT event_id, user_id, event_type, ts FROM marked WHERE NOT late
            QUALIFY row_number() OVER (PARTITION BY {', '.join(P['event_keys'])} ORDER BY arrived) = 1""",
        "stream_late_events": f"{LATE} SELECT event_id, user_id, event_type, ts FROM marked WHERE late",
    }
    for column in ("url", "title_hash", "content_fingerprint"):
        name = {"url": "first_per_url", "title_hash": "first_per_title", "content_fingerprint": "first_per_fingerprint"}[column]
        out[name] = f"WITH {KEYED} SELECT min(doc_id) AS doc_id, {column} FROM keyed GROUP BY {column}"
    return out
