"""Views, reports, corpus passes, aggregations and set operators over the crawl tables."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.url import normalized, normalized_by_steps
from .analyzers import SIZE_TEXT

_SEVERITY = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END"
_TEXTS = {200: "OK", 201: "Created", 204: "No Content", 301: "Moved Permanently", 302: "Found", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 410: "Gone", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable"}
_STATUS_TEXT = f"CASE {' '.join(f"WHEN status_code = {k} THEN '{v}'" for k, v in _TEXTS.items())} WHEN status_code BETWEEN 200 AND 299 THEN 'Success' WHEN status_code BETWEEN 300 AND 399 THEN 'Redirect' WHEN status_code BETWEEN 400 AND 499 THEN 'Client Error' WHEN status_code >= 500 THEN 'Server Error' ELSE 'Unknown' END"
#: Extensions that a crawl leaves out by default.
EXTENSIONS = "pdf doc docx xls xlsx ppt pptx zip rar tar gz 7z mp3 mp4 avi mov wmv flv jpg jpeg png gif bmp ico svg webp css js woff woff2 ttf eot".split()


#: Digits only, or 32 bytes and more of which over nine in ten are hexadecimal digits or dashes.
_IS_ID = "(RX({0}, '^[0-9]+$') OR (BLEN({0}) >= 32 AND 10 * CHARS(GALL({0}; '[^0-9a-fA-F-]'; '')) > 9 * BLEN({0})))"
#: What an error says if another try may help.
_RETRYABLE = ("connection reset", "connection refused", "no such host", "eof", "broken pipe")


def _missing(column: str, *extra: str) -> str:
    return f"SELECT url, coalesce(status_code, 0) AS status_code, CASE WHEN meta_robots LIKE '%noindex%' THEN 'Non-Indexable' ELSE 'Indexable' END AS indexability{''.join(f', {x}' for x in extra)} FROM {{wide}} WHERE is_internal AND ({column} IS NULL OR {column} = '')"


def _duplicates(column: str, shown: str = "") -> str:
    return f"SELECT {shown or column} AS value, count(*) AS n, JOINED(url; chr(10); url) AS urls FROM {{wide}} WHERE is_internal AND {column} <> '' GROUP BY {column} HAVING count(*) > 1"


def _looked_up(form: Callable[[str, str], str]) -> str:
    """Links by the normal forms of their targets, each distinct target normalised once."""
    return f"SELECT l.id AS link_id, u.id AS url_id FROM {{links}} l JOIN ({form('SELECT DISTINCT to_url FROM {links}', 'to_url')}) t ON t.to_url = l.to_url JOIN {{urls}} u ON u.normalized_url = t.normalized_url"


REPORTS = {
    # scans and look-ups
    "S03_all_urls": "SELECT * FROM {urls}",
    "S04_all_links": "SELECT * FROM {links}",
    "S05_all_resources": "SELECT * FROM {resources}",
    "S06_all_issues": "SELECT * FROM {issues}",
    "S07_redirect_chains": "SELECT c.id, s.id AS start_id, c.start_url, t.id AS final_id, c.final_url, c.length, c.has_loop FROM {redirect_chains} c LEFT JOIN {urls} s ON s.url = c.start_url LEFT JOIN {urls} t ON t.url = c.final_url",
    "S08_lookup_urls": _looked_up(normalized),
    "S08_lookup_address": "SELECT l.id AS link_id, u.id AS url_id FROM {links} l JOIN {urls} u ON u.url = l.to_url",
    "S09_features_of": "SELECT u.id, h.title, h.word_count FROM {urls} u LEFT JOIN {html_features} h ON h.url_id = u.id",
    "S10_latest_fetch": "SELECT * FROM {latest_fetch}",
    "S11_inlinks_outlinks": "SELECT to_url_id AS url_id, 'in' AS direction, id AS link_id FROM {links} WHERE to_url_id IS NOT NULL UNION ALL SELECT from_url_id AS url_id, 'out' AS direction, id AS link_id FROM {links}",
    "S12_inlinks_with_source": "SELECT l.to_url_id, u.url AS from_url, l.anchor_text FROM {links} l JOIN {urls} u ON u.id = l.from_url_id WHERE l.to_url_id IS NOT NULL",
    "S13_issues_of_url": "SELECT u.url, i.issue_code, i.severity, i.category FROM {urls} u JOIN {issues} i ON i.url_id = u.id",
    "S14_pending": "SELECT id, url, depth FROM {urls} WHERE crawl_status = 'pending' AND is_internal ORDER BY depth, id LIMIT 5",
    # upserts
    "K02_update_status": "SELECT u.id, CASE WHEN f.url_id IS NOT NULL THEN 'crawled' ELSE u.crawl_status END AS crawl_status FROM {urls} u LEFT JOIN {latest_fetch} f ON f.url_id = u.id",
    "K07_upsert_resources": "SELECT url, min(id) AS first_id, max_by(status_code, id) AS status_code, max_by(size, id) AS size, min_by(alt, id) AS alt FROM {resources} GROUP BY url",
    "K08_page_resources": "SELECT DISTINCT url_id, resource_id FROM (SELECT * FROM {page_resources} UNION ALL SELECT * FROM {page_resources}) x",
    # views and joins
    "J01_internal_pages": "SELECT u.id, u.url, f.status_code, f.content_type, h.title, h.word_count, coalesce(i.n, 0) AS inlinks, coalesce(o.n, 0) AS outlinks FROM {urls} u LEFT JOIN {fetches} f ON f.url_id = u.id LEFT JOIN {html_features} h ON h.url_id = u.id LEFT JOIN (SELECT to_url_id, count(*) AS n FROM {links} GROUP BY to_url_id) i ON i.to_url_id = u.id LEFT JOIN (SELECT from_url_id, count(*) AS n FROM {links} GROUP BY from_url_id) o ON o.from_url_id = u.id WHERE u.is_internal",
    "J02_external_links": "SELECT u.url AS from_url, l.to_url, l.anchor_text, l.rel FROM {links} l JOIN {urls} u ON u.id = l.from_url_id WHERE NOT l.is_internal",
    "J03_orphans": "SELECT u.id, u.url FROM {urls} u WHERE u.is_internal AND u.crawl_status = 'crawled' AND NOT EXISTS (SELECT 1 FROM {links} l WHERE l.to_url_id = u.id AND l.is_internal AND l.from_url_id <> u.id)",
    "J04_page_resources": "SELECT u.url AS page_url, r.url AS resource_url, r.resource_type, r.status_code, r.size FROM {resources} r JOIN {page_resources} p ON p.resource_id = r.id JOIN {urls} u ON u.id = p.url_id",
    "J05_duplicate_members": "SELECT u.url, h.title, g.n FROM {html_features} h JOIN {urls} u ON u.id = h.url_id JOIN (SELECT title, count(*) AS n FROM {html_features} WHERE title <> '' GROUP BY title HAVING count(*) > 1) g ON g.title = h.title",
    "J06_broken_links": "SELECT s.url AS from_url, l.to_url, l.anchor_text, f.status_code FROM {links} l JOIN {urls} t ON t.id = l.to_url_id JOIN {latest_fetch} f ON f.url_id = l.to_url_id LEFT JOIN {urls} s ON s.id = l.from_url_id WHERE f.status_code >= 400",
    "first_inlink": "SELECT to_url_id, min_by(from_url_id, id) AS from_url_id, min_by(anchor_text, id) AS anchor_text FROM {links} WHERE to_url_id IS NOT NULL GROUP BY to_url_id",
    "J07_client_error_first_inlink": "SELECT u.url, f.status_code, coalesce(s.url, '') AS source, coalesce(i.anchor_text, '') AS anchor FROM {urls} u JOIN {latest_fetch} f ON f.url_id = u.id AND f.status_code BETWEEN 400 AND 499 LEFT JOIN {first_inlink} i ON i.to_url_id = u.id LEFT JOIN {urls} s ON s.id = i.from_url_id",
    "J08_canonical_hops": "SELECT a.url, a.canonical AS hop1, b.canonical AS hop2 FROM {wide} a LEFT JOIN {wide} b ON b.url = a.canonical WHERE a.canonical <> ''",
    "J09_hreflang_reciprocity": "SELECT * FROM {hreflang_missing_returns}",
    "J10_sitemap_vs_crawl": "SELECT count_if(in_sitemap AND in_crawl) AS both_, count_if(in_sitemap AND NOT in_crawl) AS sitemap_only, count_if(in_crawl AND NOT in_sitemap) AS crawl_only FROM {sitemaps}",
    "J11_graph_edges": "SELECT l.id, l.from_url_id, l.to_url_id FROM {links} l WHERE EXISTS (SELECT 1 FROM {urls} n WHERE n.id = l.from_url_id AND n.is_internal) AND (l.to_url_id IS NULL OR EXISTS (SELECT 1 FROM {urls} n WHERE n.id = l.to_url_id AND n.is_internal))",
    "J12_segment_overlap": "SELECT common, only_a, only_b, CASE WHEN common + only_a + only_b = 0 THEN 0 ELSE 100.0e0 * common / (common + only_a + only_b) END AS overlap FROM (SELECT count_if(a AND b) AS common, count_if(a AND NOT b) AS only_a, count_if(b AND NOT a) AS only_b FROM (SELECT depth <= 2 AS a, in_sitemap AS b FROM {urls}) x) y",
    "J13_issue_urls": "SELECT u.url, i.issue_code, i.severity FROM {issues} i LEFT JOIN {urls} u ON u.id = i.url_id",
    "J14_url_detail": "SELECT w.url, w.status_code, w.title, coalesce(i.n, 0) AS inlinks, coalesce(o.n, 0) AS outlinks, coalesce(r.n, 0) AS images FROM {wide} w LEFT JOIN (SELECT to_url_id, count(*) AS n FROM {links} GROUP BY to_url_id) i ON i.to_url_id = w.url_id LEFT JOIN (SELECT from_url_id, count(*) AS n FROM {links} GROUP BY from_url_id) o ON o.from_url_id = w.url_id LEFT JOIN (SELECT url_id, count(*) AS n FROM {images} GROUP BY url_id) r ON r.url_id = w.url_id",
    # the record's lists as rows: what links to the page, what it links to, what it shows
    "J14_url_detail_lists": "SELECT l.to_url_id AS url_id, 'inlink' AS kind, u.url AS item, l.anchor_text AS text FROM {links} l JOIN {urls} u ON u.id = l.from_url_id WHERE l.to_url_id IS NOT NULL UNION ALL SELECT from_url_id, 'outlink', to_url, anchor_text FROM {links} UNION ALL SELECT url_id, 'image', url, alt FROM {images}",
    # aggregations
    "G01_response_codes": "SELECT f.status_code, count(*) AS n, JOINED(u.url; ', '; u.url) AS urls FROM {fetches} f JOIN {urls} u ON u.id = f.url_id GROUP BY f.status_code",
    "G02_issue_summary": f"SELECT issue_code, severity, {_SEVERITY} AS severity_rank, count(*) AS n FROM {{issues}} GROUP BY issue_code, severity ORDER BY severity_rank, n DESC",
    "G03_duplicate_titles": "SELECT h.title, count(*) AS n, JOINED(u.url; ' | '; u.url) AS urls FROM {html_features} h JOIN {urls} u ON u.id = h.url_id WHERE h.title <> '' GROUP BY h.title HAVING count(*) > 1",
    "G04_duplicate_meta": "SELECT h.meta_description, count(*) AS n, JOINED(u.url; ' | '; u.url) AS urls FROM {html_features} h JOIN {urls} u ON u.id = h.url_id WHERE h.meta_description <> '' GROUP BY h.meta_description HAVING count(*) > 1",
    "G05_crawl_stats": "SELECT count(*) AS total, count_if(crawl_status = 'crawled') AS crawled, count_if(crawl_status = 'pending') AS pending, count_if(crawl_status = 'failed') AS failed, count_if(is_internal) AS internal, count_if(NOT is_internal) AS external_, count_if(in_sitemap) AS in_sitemap, max(depth) AS max_depth FROM {urls}",
    "G05_status_histogram": "SELECT status_code, count(*) AS n FROM {fetches} GROUP BY status_code",
    "G06_issues_by_category": "SELECT category, severity, count(*) AS n FROM {issues} GROUP BY category, severity",
    "G07_analysis_summary": "SELECT count(*) AS total, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low, count_if(issue_code = 'missing_title') AS missing_titles, count_if(issue_code = 'missing_meta_description') AS missing_meta, count_if(issue_code = 'missing_h1') AS missing_h1, count_if(issue_code = 'thin_content') AS thin, count_if(issue_code = 'client_error') AS client_errors, count_if(issue_code = 'server_error') AS server_errors, count_if(issue_code = 'broken_link') AS broken_links, count_if(issue_code = 'missing_alt') AS missing_alt FROM {issues}",
    "G07_by_category": "SELECT category, count(*) AS n FROM {issues} GROUP BY category",
    "G09_duplicate_groups": "SELECT md5(title) AS title_hash, JOINED(cast(url_id AS TEXT); ','; cast(url_id AS TEXT)) AS ids FROM {html_features} WHERE title <> '' GROUP BY md5(title) HAVING count(*) > 1",
    "G10_link_counts": "SELECT to_url_id, count(*) AS inlinks, count_if(is_follow) AS follow_inlinks FROM {links} GROUP BY to_url_id",
    "G29_frontier_stats": "SELECT depth, count(*) AS n, count_if(crawl_status = 'pending') AS queued, count_if(crawl_status = 'crawled') AS visited, count(*) - count(DISTINCT normalized_url) AS duplicates, count(DISTINCT normalized_url) AS added FROM {urls} GROUP BY depth",
    "G30_cache_stats": "SELECT count(*) AS entries, sum(size) AS bytes, min(r.id) AS oldest, max(r.id) AS newest, sum(coalesce(p.hits, 0)) AS hits FROM {resources} r LEFT JOIN (SELECT resource_id, count(*) AS hits FROM {page_resources} GROUP BY resource_id) p ON p.resource_id = r.id",
    "G31_error_rate": "SELECT url_id, cast(count_if(status_code >= 400) AS double) / count(*) AS error_rate FROM {fetches} GROUP BY url_id",
    # exact order statistics over the distinct times and their counts: the window sees no more rows than there are milliseconds
    "G28_benchmark_stats": "SELECT min(v) AS lo, max(v) AS hi, cast(sum(v * c) AS double) / max(n) AS mean, min(CASE WHEN upto > floor(n / 2) THEN v END) AS median, min(CASE WHEN upto > floor(n * 0.95e0) THEN v END) AS p95, min(CASE WHEN upto > floor(n * 0.99e0) THEN v END) AS p99, (SELECT stddev_samp(response_time_ms) FROM {latest_fetch}) AS stddev, 1000.0e0 * max(n) / sum(v * c) AS ops_per_sec FROM (SELECT v, c, cast(sum(c) OVER (ORDER BY v) AS bigint) AS upto, cast(sum(c) OVER () AS bigint) AS n FROM (SELECT response_time_ms AS v, count(*) AS c FROM {latest_fetch} GROUP BY response_time_ms) d) x",
    # windows, sorts, limits, sets
    "W01_occurrences": "SELECT url_id, cast(row_number() OVER (PARTITION BY title ORDER BY url_id) AS bigint) AS occurrence_index, count(*) OVER (PARTITION BY title) AS occurrences FROM {html_features} WHERE title <> ''",
    "W03_first_inlink": "SELECT * FROM {first_inlink}",
    "W04_percent": "SELECT status_code, n, 100.0e0 * n / sum(n) OVER () AS percent FROM (SELECT status_code, count(*) AS n FROM {latest_fetch} GROUP BY status_code) x",
    # bytes of all newer entries: within blocks of 4096 ids, and of the blocks after
    "W05_lru_eviction": "SELECT r.id, sum(r.size) OVER (PARTITION BY floor(r.id / 4096) ORDER BY r.id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + b.after > 5000000 AS evicted FROM {resources} r JOIN (SELECT k, sum(bytes) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - bytes AS after FROM (SELECT floor(id / 4096) AS k, sum(size) AS bytes FROM {resources} GROUP BY floor(id / 4096)) s) b ON b.k = floor(r.id / 4096)",
    "W06_politeness": "SELECT id, host, cast((row_number() OVER (PARTITION BY host ORDER BY depth, id) - 1) * 1000 AS bigint) AS start_ms FROM {urls}",
    "O02_lexicographic": "SELECT id, url, status_code FROM (SELECT u.id, u.url, f.status_code FROM {urls} u LEFT JOIN {latest_fetch} f ON f.url_id = u.id) x ORDER BY cast(status_code AS TEXT) DESC, id",
    "O03_top_nodes": "SELECT u.url, count(l.id) AS inlinks FROM {urls} u JOIN {links} l ON l.to_url_id = u.id GROUP BY u.url ORDER BY inlinks DESC, u.url LIMIT 10",
    # the next items of a queue: retries at the front, then first in first out by level, or last in first out
    "Z02_next_breadth_first": "SELECT id, depth FROM {urls} WHERE crawl_status IN ('pending', 'failed') ORDER BY CASE crawl_status WHEN 'failed' THEN 0 ELSE 1 END, depth, id LIMIT 20",
    "Z02_next_depth_first": "SELECT id, depth FROM {urls} WHERE crawl_status IN ('pending', 'failed') ORDER BY CASE crawl_status WHEN 'failed' THEN 0 ELSE 1 END, depth DESC, id DESC LIMIT 20",
    # what a resumed crawl starts from
    "Z10_queue_table": "SELECT id AS url_id, depth AS priority, CASE crawl_status WHEN 'failed' THEN 1 ELSE 0 END AS retry_count, CASE crawl_status WHEN 'failed' THEN 'retry' ELSE 'queued' END AS status FROM {urls} WHERE crawl_status IN ('pending', 'failed')",
    "O05_max_nodes": "SELECT id, url FROM {urls} WHERE is_internal ORDER BY id LIMIT 100",
    "O08_latest_checkpoints": "SELECT host, id FROM (SELECT host, id, row_number() OVER (PARTITION BY host ORDER BY id DESC) AS rn FROM {urls}) x WHERE rn <= 5",
    "U03_url_sets": "SELECT 'common' AS part, host FROM (SELECT host FROM {urls} WHERE in_sitemap INTERSECT SELECT host FROM {urls} WHERE depth < 3) a UNION ALL SELECT 'only_sitemap', host FROM (SELECT host FROM {urls} WHERE in_sitemap EXCEPT SELECT host FROM {urls} WHERE depth < 3) b UNION ALL SELECT 'only_near', host FROM (SELECT host FROM {urls} WHERE depth < 3 EXCEPT SELECT host FROM {urls} WHERE in_sitemap) c",
    "U04_sitemap_minus_crawl": "SELECT url FROM {sitemap_urls} EXCEPT SELECT url FROM {urls}",
    "U04_crawl_minus_sitemap": "SELECT url FROM {urls} EXCEPT SELECT url FROM {sitemap_urls}",
    "U02_dedupe": "SELECT min(id) AS id, normalized_url FROM {urls} GROUP BY normalized_url",
    # reports
    "R01_all_redirects": "SELECT u.url, f.status_code, CASE WHEN f.status_code IN (302, 307) THEN 'Temporary' ELSE 'Permanent' END AS type FROM {urls} u JOIN {latest_fetch} f ON f.url_id = u.id WHERE f.status_code BETWEEN 300 AND 399",
    "R02_redirect_chains": "SELECT * FROM {redirect_chains} WHERE length > 1",
    "R03_client_errors": "SELECT * FROM {J07_client_error_first_inlink}",
    "R04_server_errors": "SELECT u.url, f.status_code, coalesce(s.url, '') AS source FROM {urls} u JOIN {latest_fetch} f ON f.url_id = u.id AND f.status_code >= 500 LEFT JOIN {first_inlink} i ON i.to_url_id = u.id LEFT JOIN {urls} s ON s.id = i.from_url_id",
    "R05_canonical_errors": "SELECT url, canonical, error FROM (SELECT a.url, a.canonical, CASE WHEN a.canonical = '' THEN 'Missing' WHEN b.canonical <> '' AND b.canonical <> a.canonical THEN 'Canonical chain' WHEN b.url IS NULL THEN 'Not crawled' WHEN b.status_code >= 400 THEN 'Error page' ELSE '' END AS error FROM {wide} a LEFT JOIN {wide} b ON b.url = a.canonical AND a.canonical <> '' WHERE a.has_html AND a.is_internal) x WHERE error <> ''",
    "R06_missing_titles": _missing("title"), "R07_missing_meta": _missing("meta_description", "title"), "R08_missing_h1": _missing("h1_first", "title"),
    "R09_duplicate_titles": _duplicates("title"), "R10_duplicate_meta": _duplicates("meta_description"), "R11_duplicate_content": _duplicates("content_hash", "substr(content_hash, 1, 16) || '...'"),
    "R12_missing_alt": "SELECT url, count(*) AS n, JOINED(found_on; ' | '; found_on) AS pages FROM {images} WHERE alt = '' GROUP BY url",
    "R13_orphan_urls": "SELECT u.id, u.url, CASE WHEN u.in_sitemap THEN 'Sitemap' ELSE 'Unknown' END AS source FROM {urls} u WHERE u.is_internal AND u.depth <> 0 AND NOT EXISTS (SELECT 1 FROM {links} l WHERE l.to_url_id = u.id AND l.is_internal)",
    "R14_non_indexable": "SELECT d.url, d.reason FROM {directives} d JOIN {urls} u ON u.id = d.url_id WHERE u.is_internal AND d.noindex",
    "R15_no_internal_inlinks": "SELECT u.id, u.url, coalesce(i.external_, 0) AS external_inlinks FROM {urls} u LEFT JOIN (SELECT to_url_id, count_if(is_internal) AS internal, count_if(NOT is_internal) AS external_ FROM {links} GROUP BY to_url_id) i ON i.to_url_id = u.id WHERE u.is_internal AND u.depth <> 0 AND coalesce(i.internal, 0) = 0",
    "R16_broken_links": "SELECT * FROM {J06_broken_links}",
    "R17_all_issues": "SELECT * FROM {J13_issue_urls}",
    "overview": "SELECT count(*) AS total, count_if(is_internal) AS internal, count_if(status_code BETWEEN 200 AND 299) AS ok, count_if(status_code BETWEEN 300 AND 399) AS redirects, count_if(status_code BETWEEN 400 AND 499) AS client_errors, count_if(status_code >= 500) AS server_errors, count_if(has_html AND title = '') AS no_title, count_if(has_html AND meta_description = '') AS no_meta, count_if(has_html AND h1_count = 0) AS no_h1 FROM {wide}",
    "R18_seo_overview": "SELECT metric, value, CASE WHEN metric IN ('total', 'internal', 'ok') OR value = 0 THEN 'Good' WHEN value <= 5 THEN 'Warning' ELSE 'Error' END AS status FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value FROM {{overview}}" for m in ("total", "internal", "ok", "redirects", "client_errors", "server_errors", "no_title", "no_meta", "no_h1")) + ") x",
    "R19_crawl_summary": " UNION ALL ".join(f"SELECT '{m}' AS metric, cast({m} AS bigint) AS value FROM {{G05_crawl_stats}}" for m in ("total", "crawled", "pending", "failed", "internal", "external_", "in_sitemap", "max_depth")),
    # passes
    "P01_canonical_chains": "SELECT a.url_id, a.url, c.url AS third FROM {wide} a JOIN {wide} b ON b.url = a.canonical AND b.url_id <> a.url_id JOIN {wide} c ON c.url = b.canonical AND c.url_id <> b.url_id",
    "canonical_loops": "SELECT a.url_id, b.url_id AS other_id FROM {wide} a JOIN {wide} b ON b.url = a.canonical AND b.canonical = a.url AND a.url_id < b.url_id",
    "P02_orphan_issues": "SELECT id AS url_id, 'orphan_page' AS issue_code FROM {R13_orphan_urls}",
    "P03_hreflang_issues": "SELECT 0 AS url_id, 'hreflang_missing_return' AS issue_code, url, href FROM {hreflang_missing_returns}",
    "P04_sitemap_orphans": "SELECT url, 'sitemap_orphan' AS issue_code FROM {sitemaps} WHERE in_sitemap AND NOT in_crawl",
    "P05_finalised_issues": " UNION ALL ".join(f"SELECT url_id, issue_code FROM {{{x}_issues}}" for x in ("duplicate_title", "duplicate_meta_description", "duplicate_h1", "duplicate_content", "duplicate_url")) + " UNION ALL SELECT cast(url_id AS bigint), issue_code FROM {P03_hreflang_issues}",
}

#: Reports whose text DuckDB reads in another form.
BY_STEPS = {"S08_lookup_urls": _looked_up(normalized_by_steps)}

_METRICS = "count(*) AS n, cast(sum(coalesce(response_time_ms, 0)) AS double) / count(*) AS avg_response_ms, cast(sum(coalesce(word_count, 0)) AS double) / count(*) AS avg_words, cast(sum(depth) AS double) / count(*) AS avg_depth, count_if(coalesce(is_indexable, false)) AS indexable, count_if(status_code BETWEEN 200 AND 299) AS ok, count_if(status_code BETWEEN 300 AND 399) AS redirects, count_if(status_code BETWEEN 400 AND 499) AS client_errors, count_if(status_code >= 500) AS server_errors"
_KEYS = {
    "G12_by_content_type": "CASE WHEN coalesce(content_type, '') = '' THEN 'unknown' ELSE trim(regexp_extract(content_type, '^([^;]*)', 1)) END",
    "G13_by_status": "CASE WHEN status_code BETWEEN 200 AND 299 THEN '2xx' WHEN status_code BETWEEN 300 AND 399 THEN '3xx' WHEN status_code BETWEEN 400 AND 499 THEN '4xx' WHEN status_code BETWEEN 500 AND 599 THEN '5xx' ELSE 'not_fetched' END",
    "G14_by_indexability": "CASE WHEN is_indexable THEN 'indexable' ELSE 'non_indexable' END",
    "G15_by_template": "CASE WHEN path IN ('', '/') THEN '/' ELSE '/' || GLUED(MAPPED(PARTS(trim(BOTH '/' FROM path), '/'), p -> (CASE WHEN " + _IS_ID.format("p") + " THEN chr(123) || 'id' || chr(125) ELSE p END)), '/') END",
    "G16_by_depth": "cast(depth AS TEXT)",
    "G17_by_folder": "CASE WHEN RX(path, '^/[^/]+/') THEN regexp_extract(path, '^(/[^/]+)', 1) WHEN path LIKE '%.%' OR path IN ('', '/') THEN '/' ELSE path END",
    "G19_by_rule": "CASE WHEN RX(url, '/blog|blog[.]') THEN 'Blog' WHEN RX(url, '[?]page=') THEN 'Paged' WHEN RX(url, '[.]html') THEN 'Documents' ELSE 'Other' END",
}
SEGMENTS = {k: f"SELECT {expr} AS segment, {_METRICS} FROM {{wide}} WHERE is_internal GROUP BY {expr}" for k, expr in _KEYS.items()}
SEGMENTS["G18_by_host"] = f"SELECT host AS segment, {_METRICS} FROM {{wide}} GROUP BY host"
#: One pass: a page counts once for each kind of segment.
SEGMENTS["G20_all_segments"] = "SELECT CASE k " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(_KEYS, 1)) + " END AS kind, ITEM(segments, k) AS segment, count(*) AS n FROM (SELECT segments, EACH(SEQ(1, " + str(len(_KEYS)) + ")) AS k FROM (SELECT PAIR(" + ", ".join(_KEYS.values()) + ") AS segments FROM {wide} WHERE is_internal) s) e GROUP BY k, ITEM(segments, k)"

#: Non-empty segments of internal paths.
_SEGMENTS = "SELECT id, depth, path, KEPT(PARTS(path, '/'), p -> (p <> '')) AS segments FROM {urls} WHERE is_internal"
GRAPH = {
    "prefixes": f"SELECT x.id, x.depth, x.k, x.k = SIZE(x.segments) AND x.path NOT LIKE '%/' AS is_page, '/' || GLUED(FIRST_OF(x.segments, 1, x.k), '/') AS prefix FROM (SELECT id, depth, path, segments, EACH(SEQ(1, SIZE(segments))) AS k FROM ({_SEGMENTS}) s WHERE SIZE(segments) > 0) x",
    # a path's last part is a page; a path that ends in a slash is a folder and attaches no page
    "T01_path_tree": "SELECT prefix AS full_path, cast(max(k) AS bigint) AS level, count(*) AS url_count, count_if(is_page) AS pages, count_if(NOT is_page) = 0 AS only_pages FROM {prefixes} WHERE prefix <> '' GROUP BY prefix",
    "T02_flatten": "SELECT full_path, level, url_count FROM {T01_path_tree} ORDER BY full_path",
    "G21_depth_distribution": "SELECT d.depth, coalesce(c.n, 0) AS n, CASE WHEN d.total = 0 THEN 0.0e0 ELSE 100.0e0 * coalesce(c.n, 0) / d.total END AS percent FROM (SELECT total, EACH(SEQ(0, top)) AS depth FROM (SELECT coalesce(max(depth), 0) AS top, count(*) AS total FROM {urls} WHERE is_internal) m) d LEFT JOIN (SELECT depth, count(*) AS n FROM {urls} WHERE is_internal GROUP BY depth) c ON c.depth = d.depth",
    "G22_status_distribution": f"SELECT status_code, {_STATUS_TEXT} AS text, n, 100.0e0 * n / sum(n) OVER () AS percent FROM (SELECT status_code, count(*) AS n FROM {{fetches}} GROUP BY status_code) x",
    "G24_folder_stats": "SELECT p.prefix, count(*) AS n, cast(sum(p.depth) AS double) / count(*) AS avg_depth, count_if(f.status_code BETWEEN 200 AND 299) AS ok, count_if(f.status_code >= 400) AS errors, count_if(f.status_code BETWEEN 300 AND 399) AS redirects FROM {prefixes} p LEFT JOIN {latest_fetch} f ON f.url_id = p.id WHERE p.prefix <> '' GROUP BY p.prefix",
    "N01_nodes": "SELECT w.url_id, w.url, w.depth, w.status_code, w.content_type, coalesce(w.is_indexable, false) AS is_indexable, w.is_internal, coalesce(i.n, 0) AS in_links, coalesce(o.n, 0) AS out_links FROM {wide} w LEFT JOIN (SELECT to_url_id, count(*) AS n FROM {links} GROUP BY to_url_id) i ON i.to_url_id = w.url_id LEFT JOIN (SELECT from_url_id, count(*) AS n FROM {links} GROUP BY from_url_id) o ON o.from_url_id = w.url_id WHERE w.is_internal AND (w.status_code IS NULL OR w.status_code BETWEEN 0 AND 599)",
    # each option holds only where the page has what it asks about
    "F07_graph_filter": "SELECT url_id, url FROM {N01_nodes} WHERE depth <= 2 AND in_links >= 1 AND (status_code IS NULL OR status_code BETWEEN 200 AND 399) AND (content_type IS NULL OR content_type LIKE '%html%') AND is_indexable",
    "F08_tree_filter": "SELECT p.prefix, count(*) AS n FROM {prefixes} p LEFT JOIN {latest_fetch} f ON f.url_id = p.id WHERE p.k <= 2 AND (f.status_code IS NULL OR f.status_code BETWEEN 200 AND 299) GROUP BY p.prefix",
    "node_ids": "SELECT id FROM {urls} WHERE is_internal",
    "G27_edges": "SELECT l.from_url_id AS source, l.to_url_id AS target, count(*) AS weight, min_by(l.anchor_text, l.id) AS label FROM {links} l WHERE l.to_url_id IN (SELECT id FROM {node_ids}) AND l.from_url_id IN (SELECT id FROM {node_ids}) GROUP BY l.from_url_id, l.to_url_id",
    "G25_density": "SELECT n, e, CASE WHEN n > 1 THEN cast(e AS double) / (cast(n AS double) * (n - 1)) ELSE 0 END AS density, CASE WHEN n > 0 THEN 2.0e0 * e / n ELSE 0 END AS avg_degree FROM (SELECT count(*) AS n, (SELECT count(*) FROM {G27_edges}) AS e FROM {N01_nodes}) a",
    "G26_node_stats": "SELECT count(*) AS n, count_if(is_internal) AS internal, count_if(NOT is_internal) AS external_, count_if(in_links = 0) AS orphans, count_if(out_links = 0) AS dead_ends, avg(in_links) AS avg_in, max(in_links) AS max_in, avg(out_links) AS avg_out, max(out_links) AS max_out FROM {N01_nodes}",
}

_FIRST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
SCALARS = {
    "X04_host": f"SELECT id, lower({_FIRST}) AS host FROM {{urls}}",
    "X05_domain": f"SELECT id, CASE WHEN GALL(lower({_FIRST}); ':[0-9]+$'; '') LIKE '%.%' THEN regexp_extract(GALL(lower({_FIRST}); ':[0-9]+$'; ''), '([^.]*[.][^.]*)$', 1) ELSE GALL(lower({_FIRST}); ':[0-9]+$'; '') END AS domain FROM {{urls}}",
    "X06_is_absolute": "SELECT id, RX(to_url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AS is_absolute FROM {links}",
    "X07_same_host": "SELECT l.id, coalesce(lower(regexp_extract(l.to_url, '^[a-z]+://([^/?#]+)', 1)) = lower(u.host), false) AS same_host, coalesce(regexp_extract(lower(regexp_extract(l.to_url, '^[a-z]+://([^/?#:]+)', 1)), '([^.]*[.]?[^.]*)$', 1) = regexp_extract(lower(regexp_extract(u.host, '^([^:]+)', 1)), '([^.]*[.]?[^.]*)$', 1), false) AS same_domain FROM {links} l JOIN {urls} u ON u.id = l.from_url_id",
    "X08_robots_path": "SELECT id, coalesce(UNESCAPED(replace(path, '+', '%2B')), path) || CASE WHEN url LIKE '%?%' THEN '?' || regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) ELSE '' END AS robots_path FROM {urls}",
    "X09_content_type": "SELECT id, trim(regexp_extract(content_type, '^([^;]*)', 1)) AS content_type FROM {fetches}",
    "X12_sanitised_id": "SELECT id, translate(lower(url), ' /.-', '____') AS safe FROM {urls}",
    "X13_id_segment": "SELECT id, segment, {0} AS is_id FROM (SELECT id, EACH(KEPT(PARTS(path, '/'), p -> (p <> ''))) AS segment FROM {urls}) x".replace("{0}", _IS_ID.format("segment")),
    "X14_label_group": "SELECT id, CASE WHEN last = '' THEN CASE WHEN path IN ('', '/') THEN '/' ELSE path END WHEN BLEN(last) > 25 THEN substr(last, 1, 22) || '...' ELSE last END AS label, CASE WHEN path IN ('', '/') THEN 'root' WHEN last = '' THEN 'other' ELSE regexp_extract(path, '^/*([^/]+)', 1) END AS grp FROM (SELECT id, path, regexp_extract(path, '([^/]+)/*$', 1) AS last FROM {urls}) x",
    "X15_node_colour": "SELECT url_id, CASE WHEN in_links > 0 THEN 5.0e0 + 5.0e0 * log10(in_links + 1) ELSE 5.0e0 END AS size, CASE WHEN status_code BETWEEN 200 AND 299 THEN '#00C853' WHEN status_code BETWEEN 300 AND 399 THEN '#FFD600' WHEN status_code BETWEEN 400 AND 499 THEN '#FF5722' WHEN status_code >= 500 THEN '#F44336' ELSE '#9E9E9E' END AS colour FROM {N01_nodes}",
    "X16_status_text": f"SELECT id, {_STATUS_TEXT} AS text FROM {{fetches}}",
    "X18_word_count": "SELECT doc_id, cast(SIZE(KEPT(PARTS(GALL(text; '[ \t\n\x0b\f\r\x85\xa0]+'; ' '), ' '), w -> (w <> ''))) AS bigint) AS n_words FROM {documents}",
    "X19_strip_tags": "SELECT page_id, trim(GALL(GALL(GALL(GALL(html; '<script[^>]*>(.|[\r\n])*?</script>'; ''); '<style[^>]*>(.|[\r\n])*?</style>'; ''); '<[^>]+>'; ' '); '[ \t\n\f\r]+'; ' ')) AS text FROM {site_text}".replace("{site_text}", "(SELECT url_id AS page_id, html FROM {page_html}) p"),
    "X20_truncate": "SELECT doc_id, CASE WHEN CHARS(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END AS graph_cut, substr(text, 1, 50) AS parser_cut, CASE WHEN CHARS(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS shown_cut FROM {documents}",
    "X21_file_name": "SELECT id, substr(translate(url, chr(92) || '/?*[]:', '_______'), 1, 31) AS sheet, lower(translate(url, chr(92) || '/:*?\"<>| ', '__________')) AS file FROM {urls}",
    "X22_backoff": "SELECT id, cast(1000 * power(2, id % 5 + 1) AS bigint) AS delay_ms FROM {urls}",
    "X10_size_text": f"SELECT id, {SIZE_TEXT.format('size')} AS small, {SIZE_TEXT.format('(size * 97 + 256)')} AS large FROM {{resources}}",
    "X23_error_category": f"SELECT id, said, CASE WHEN said = '' THEN '' WHEN said LIKE '%timeout%' OR said LIKE '%deadline exceeded%' THEN 'timeout' WHEN said LIKE '%no such host%' THEN 'DNS error' WHEN said LIKE 'dial %' THEN 'connection failed' WHEN said LIKE '%tls:%' OR said LIKE '%certificate%' THEN 'TLS error' ELSE 'other' END AS category, said LIKE '%timeout%' OR said LIKE '%deadline exceeded%' OR RX(said, '{'|'.join(_RETRYABLE)}') AS retryable, CASE id % 5 WHEN 0 THEN 'TLS 1.0' WHEN 1 THEN 'TLS 1.1' WHEN 2 THEN 'TLS 1.2' WHEN 3 THEN 'TLS 1.3' ELSE 'Unknown (0x0305)' END AS tls FROM (SELECT id, CASE id % 8 WHEN 0 THEN 'net/http: timeout awaiting headers' WHEN 1 THEN 'lookup x: no such host' WHEN 2 THEN 'dial tcp: connection refused' WHEN 3 THEN 'tls: bad certificate' WHEN 4 THEN 'unexpected eof' WHEN 5 THEN 'read: connection reset by peer' WHEN 6 THEN 'stopped' ELSE '' END AS said FROM {{urls}}) x",
    # soft limit 3,000,000 and hard limit 4,500,000 bytes; 16 workers, 2 at least
    "X24_pressure": "SELECT id, level, CASE level WHEN 'none' THEN 16 WHEN 'low' THEN 12 WHEN 'medium' THEN 8 WHEN 'high' THEN 4 ELSE 2 END AS workers FROM (SELECT id, CASE WHEN bytes / 4500000.0e0 >= 0.95e0 THEN 'critical' WHEN bytes / 3000000.0e0 >= 1 THEN 'high' WHEN bytes / 3000000.0e0 >= 0.8e0 THEN 'medium' WHEN bytes / 3000000.0e0 >= 0.6e0 THEN 'low' ELSE 'none' END AS level FROM (SELECT id, size * 20 AS bytes FROM {resources}) r) x",
    "X01_normalize": "SELECT id, url, normalized_url FROM {urls}",
    "X06_resolve": "SELECT l.id, CASE WHEN RX(ref, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN ref WHEN ref LIKE '//%' THEN regexp_extract(base, '^([a-z]+:)', 1) || ref WHEN ref LIKE '/%' THEN regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) || ref WHEN ref LIKE '?%' THEN regexp_extract(base, '^([^?#]*)', 1) || ref ELSE regexp_extract(base, '^([^#]*)', 1) || ref END AS resolved FROM (SELECT id, CASE id % 5 WHEN 0 THEN '/a/b' WHEN 1 THEN '//other.example/x' WHEN 2 THEN '?q=1' WHEN 3 THEN '#top' ELSE to_url END AS ref, 'https://h' || cast(from_url_id AS TEXT) || '.example/p/q?z=1#f' AS base FROM {links}) l",
    # percent done, rate over the time from the first fetch to the last, and seconds left at that rate
    "X25_progress": "SELECT total, done, percent, rate, CASE WHEN rate = 0 OR done >= total THEN 0.0e0 ELSE (total - done) / rate END AS eta_s FROM (SELECT total, done, CASE WHEN total = 0 THEN 0.0e0 ELSE 100.0e0 * done / total END AS percent, CASE WHEN secs > 0 THEN done / secs ELSE 0.0e0 END AS rate FROM (SELECT count(*) AS total, count_if(crawl_status <> 'pending') AS done, (SELECT (UNIX(cast(max(fetched_at) AS timestamp)) - UNIX(cast(min(fetched_at) AS timestamp))) / 1000000.0e0 FROM {fetches}) AS secs FROM {urls}) u) x",
    "F03_text_search": "SELECT url_id, url, title FROM {wide} WHERE lower(coalesce(title, '') || ' ' || url) LIKE '%the%'",
    "F05_include_exclude": "SELECT id, url FROM {urls} WHERE NOT RX(url, '[?]utm_') AND (RX(url, '/[a-z]') OR RX(url, '^https'))",
    "F06_extensions": f"SELECT id, url FROM {{urls}} WHERE lower(regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)) NOT IN ({', '.join(map(repr, EXTENSIONS))})",
    # what an open tab shows: kinds of content, links and pages
    "F09_quick_filters": "SELECT u.id AS url_id, CASE WHEN f.content_type LIKE '%html%' THEN 'HTML' WHEN f.content_type LIKE '%javascript%' THEN 'JavaScript' WHEN f.content_type LIKE '%css%' THEN 'CSS' WHEN f.content_type LIKE 'image/%' THEN 'Images' WHEN f.content_type LIKE '%pdf%' THEN 'PDF' ELSE 'Other' END AS kind, CASE WHEN coalesce(h.meta_keywords, '') = '' THEN 'Missing' ELSE 'Present' END AS keywords, CASE WHEN d.noindex THEN 'Noindex' ELSE 'Index' END AS indexed, CASE WHEN d.nofollow THEN 'Nofollow' ELSE 'Follow' END AS followed FROM {urls} u LEFT JOIN {latest_fetch} f ON f.url_id = u.id LEFT JOIN {html_features} h ON h.url_id = u.id LEFT JOIN {directives} d ON d.url_id = u.id",
    "F09_link_filters": "SELECT id, CASE WHEN is_internal THEN 'Internal' ELSE 'External' END AS place, CASE WHEN is_follow THEN 'Follow' ELSE 'Nofollow' END AS followed FROM {links}",
    "F10_response_classes": "SELECT id, status_code BETWEEN 200 AND 299 AS ok, status_code BETWEEN 300 AND 399 AS redirect, status_code BETWEEN 400 AND 499 AS client_error, status_code >= 500 AS server_error, content_type LIKE 'text/html%' OR content_type LIKE 'application/xhtml%' AS is_html FROM {fetches}",
    # a hop is followed if the policy says so: none, to the same host, any
    "redirect_policy": "SELECT id, RX(start_url, '^https?://') AND false AS no_follow, regexp_extract(start_url, '^https?://([^/?#]+)', 1) = regexp_extract(final_url, '^https?://([^/?#]+)', 1) AS follow_same, true AS follow FROM {redirect_chains}",
    "item_readiness": "SELECT id, host FROM {W06_politeness} WHERE start_ms <= 2000",
    "U05_microdata_types": "SELECT url_id, type, min(position) AS first_position FROM {structured_items} WHERE format = 'Microdata' GROUP BY url_id, type",
    "Q01_search_text": "SELECT page_id, cast((CHARS(lower(html)) - CHARS(replace(lower(html), 'the', ''))) / 3 AS bigint) AS matches FROM {pages}",
    "Q02_search_contains": "SELECT page_id, html LIKE '%<nav%' AS has_match FROM {pages}",
    "Q03_search_regex": "SELECT page_id, cast(CHARS(GALL(html; '<a [^>]*>'; '##')) - CHARS(GALL(html; '<a [^>]*>'; '#')) AS bigint) AS matches FROM {pages}",
    "Q08_extract_regex": "SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS value FROM {pages}",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS hour_, event_type, count(*) AS n, count_if(event_type = 'error') AS errors FROM {events} GROUP BY date_trunc('hour', ts), event_type",
}
