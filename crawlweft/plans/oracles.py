"""Statements for DuckDB written on their own, from the rules and not from the Spark plans: tests and the driver hold one against the other."""

from __future__ import annotations

from ..functions.speed import AUDITS
from ..operators.analyzers import CODES, COLUMNS, SHOWN

_ROLES = "('alert','alertdialog','application','article','banner','button','checkbox','complementary','contentinfo','dialog','document','feed','figure','form','grid','gridcell','group','heading','img','link','list','listbox','listitem','main','menu','menubar','menuitem','navigation','none','note','option','presentation','progressbar','radio','region','row','rowgroup','scrollbar','search','searchbox','separator','slider','spinbutton','status','switch','tab','table','tablist','tabpanel','textbox','timer','toolbar','tooltip','tree','treegrid','treeitem')"


def _size(b: str) -> str:
    """%.1f of an exact binary quotient, ties to even, by round_even on decimals."""
    return f"CASE WHEN {b} < 1024 THEN format('{{}} B', {b}) WHEN {b} < 1048576 THEN format('{{}} KB', cast(round_even(cast({b} AS decimal(30,10)) / 1024, 1) AS decimal(20,1))) ELSE format('{{}} MB', cast(round_even(cast({b} AS decimal(30,10)) / 1048576, 1) AS decimal(20,1))) END"


def _repeats(table: str, column: str, keys: str) -> str:
    return f"(CASE WHEN {column} <> '' THEN (SELECT count(*) FROM {{{table}}} again WHERE again.{column} = {keys}.{column}) END)"


def _ents(text: str) -> str:
    """Text with the entities decoded that the test pages use."""
    for entity, c in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{c}')"
    return text


#: The issues, an arm for each analyzer's rows: what a row of a plan says: plan -> (column of the page, {issue code: predicate}).
_RULES = {
    "page_state": ("url_id", {
        "client_error": "status_code BETWEEN 400 AND 499", "server_error": "status_code >= 500", "slow_response": "response_time_ms > 500", "missing_title": "title = ''", "title_too_long": "strlen(title) > 60", "title_too_short": "strlen(title) BETWEEN 1 AND 29",
        "missing_meta_description": "meta_description = ''", "meta_description_too_long": "strlen(meta_description) > 155", "meta_description_too_short": "strlen(meta_description) BETWEEN 1 AND 69", "missing_h1": "h1_count = 0", "multiple_h1": "h1_count > 1",
        "thin_content": "word_count > 0 AND word_count < 200", "missing_canonical": "canonical = ''", "noindex": "noindex", "canonical_noindex_conflict": "noindex AND canonical <> '' AND canonical <> url", "url_too_long": "strlen(url) > 115"}),
    "redirect_chain": ("url_id", {"redirect_loop": "has_loop", "redirect_chain": "length > 2"}),
    "images": ("url_id", {"missing_alt": "alt = ''", "broken_image": "status_code >= 400", "large_image": "size > 102400"}),
    "links_summary": ("url_id", {"no_internal_links": "internal = 0 AND is_internal AND total > 0"}),
    "links_detail": ("from_url_id", {"redirect_link": "target_status BETWEEN 300 AND 399", "broken_link": "target_status >= 400"}),
    "hreflang": ("url_id", {"hreflang_missing_self": "count_ > 0 AND NOT has_self_ref", "hreflang_invalid_code": "invalid_codes > 0"}),
    "javascript": ("url_id", {"broken_script": "status_code >= 400", "render_blocking_script": "NOT is_async AND NOT is_defer"}),
    "amp": ("amp_url_id", {"amp_canonical_mismatch": "NOT canonical_match"}),
    "structured_items": ("url_id", {"structured_data_error": "n_errors > 0"}),
    "sitemaps": ("url_id", {"sitemap_invalid_lastmod": "in_sitemap AND NOT lastmod_valid"}),
    "mobile": ("url_id", {"mobile_missing_viewport": "NOT has_viewport", "mobile_fixed_width": "fixed_width", "mobile_zoom_disabled": "zoom_disabled"}),
    "accessibility": ("url_id", {"a11y_missing_alt": "images_without_alt > 0", "a11y_missing_form_labels": "unlabelled > 0", "a11y_missing_lang": "NOT has_lang"}),
    "pagespeed_result": ("url_id", {"pagespeed_poor_lcp": "lcp_ms >= 4000", "pagespeed_needs_improvement_lcp": "lcp_ms >= 2500 AND lcp_ms < 4000", "pagespeed_poor_cls": "cls >= 0.25", "pagespeed_needs_improvement_cls": "cls >= 0.1 AND cls < 0.25", "pagespeed_poor_inp": "inp_ms >= 500"}),
}


def _arm(plan: str) -> str:
    at, rules = _RULES[plan]
    return " UNION ALL ".join(f"SELECT {at} AS url_id, '{code}' AS issue_code FROM {{{plan}}} WHERE {when}" for code, when in rules.items())


def _said(k: int) -> str:
    return f"CASE issue_code {' '.join(f"WHEN '{code}' THEN '{v[k]}'" for code, v in CODES.items())} END"


def _walked(edges: str) -> str:
    """(start, place, n, looped, hops) of the last step of every walk over edges (source, target, hop), one after the other."""
    return f"""(WITH RECURSIVE edges AS ({edges}), walk AS (SELECT source AS start, target AS place, 1 AS n, [source] AS seen, [hop] AS hops FROM edges
        UNION ALL SELECT w.start, e.target, n + 1, list_append(seen, w.place), list_append(hops, e.hop) FROM walk w JOIN edges e ON e.source = w.place WHERE NOT list_contains(w.seen, w.place))
        SELECT start, place, n, list_contains(seen, place) AS looped, hops FROM walk QUALIFY row_number() OVER (PARTITION BY start ORDER BY n DESC) = 1)"""


DUCK = {
    "issues": f"SELECT url_id, issue_code, {_said(0)} AS issue_type, {_said(1)} AS severity, {_said(2)} AS category FROM (" + " UNION ALL ".join(map(_arm, _RULES)) + " UNION ALL SELECT url_id, 'a11y_heading_skip' FROM (SELECT url_id, unnest(generate_series(1, heading_skips)) AS k FROM {accessibility}) h) i",
    "latest_fetch": "SELECT id, url_id, status_code, content_type, response_time_ms, fetched_at, x_robots FROM {fetches} QUALIFY row_number() OVER (PARTITION BY url_id ORDER BY fetched_at DESC, id DESC) = 1",
    "response_codes": """SELECT u.id AS url_id, u.url, f.status_code, f.response_time_ms, concat(f.response_time_ms, 'ms') AS response_time, if(f.status_code // 100 = 3, coalesce(c.final_url, ''), '') AS redirect_url,
        CASE f.status_code // 100 WHEN 2 THEN 'Success' WHEN 3 THEN 'Redirect' WHEN 4 THEN 'Client Error' ELSE if(f.status_code >= 500, 'Server Error', 'Unknown') END AS status,
        CASE f.status_code WHEN 301 THEN 'Permanent' WHEN 308 THEN 'Permanent' WHEN 302 THEN 'Temporary' WHEN 307 THEN 'Temporary' WHEN 303 THEN 'See Other' ELSE if(f.status_code // 100 = 3, format('Redirect ({})', f.status_code), '') END AS redirect_type, c.length AS chain_length
        FROM {urls} u JOIN {latest_fetch} f ON f.url_id = u.id LEFT JOIN {redirect_chains} c ON c.start_url = u.url
        UNION ALL SELECT u.id, u.url, NULL, NULL, NULL, NULL, NULL, NULL, c.length FROM {urls} u LEFT JOIN {redirect_chains} c ON c.start_url = u.url WHERE u.id NOT IN (SELECT url_id FROM {fetches})""",
    "page_titles": f"""SELECT u.id AS url_id, u.url, h.title, coalesce(octet_length(encode(h.title)), 0) AS length, coalesce(octet_length(encode(h.title)) * 17 // 2, 0) AS pixel_width, md5(h.title) AS title_hash, coalesce(h.h1_first = h.title AND length(h.title) > 0, false) AS same_as_h1,
        CASE WHEN h.url_id IS NULL THEN 'No HTML' WHEN octet_length(encode(h.title)) = 0 THEN 'Missing' WHEN octet_length(encode(h.title)) >= 61 THEN 'Too Long' WHEN octet_length(encode(h.title)) <= 29 THEN 'Too Short' ELSE 'OK' END AS status, {_repeats("html_features", "title", "h")} AS occurrences
        FROM {{urls}} u LEFT JOIN {{html_features}} h ON h.url_id = u.id""",
    "meta_description": f"""SELECT u.id AS url_id, u.url, h.meta_description, coalesce(octet_length(encode(h.meta_description)), 0) AS length, coalesce(octet_length(encode(h.meta_description)), 0) * 6 AS pixel_width,
        CASE WHEN h.url_id IS NULL THEN 'No HTML' WHEN octet_length(encode(h.meta_description)) = 0 THEN 'Missing' WHEN octet_length(encode(h.meta_description)) >= 156 THEN 'Too Long' WHEN octet_length(encode(h.meta_description)) <= 69 THEN 'Too Short' ELSE 'OK' END AS status, {_repeats("html_features", "meta_description", "h")} AS occurrences
        FROM {{urls}} u LEFT JOIN {{html_features}} h ON h.url_id = u.id""",
    "h1": f"""SELECT u.id AS url_id, u.url, h.h1_first AS h1, h.h1_count AS count_, coalesce(octet_length(encode(h.h1_first)), 0) AS length,
        CASE WHEN h.url_id IS NULL THEN 'No HTML' WHEN h.h1_count = 0 THEN 'Missing' WHEN h.h1_count >= 2 THEN 'Multiple' WHEN octet_length(encode(h.h1_first)) >= 71 THEN 'Too Long' ELSE 'OK' END AS status, {_repeats("html_features", "h1_first", "h")} AS occurrences
        FROM {{urls}} u LEFT JOIN {{html_features}} h ON h.url_id = u.id""",
    "content": f"""SELECT u.id AS url_id, u.url, h.word_count, h.content_hash, if(h.url_id IS NULL, 'No HTML', if(h.word_count = 0, 'Empty', if(h.word_count <= 199, 'Thin', 'OK'))) AS status, {_repeats("html_features", "content_hash", "h")} AS occurrences FROM {{urls}} u LEFT JOIN {{html_features}} h ON h.url_id = u.id""",
    "images": f"""SELECT r.id AS resource_id, u.id AS url_id, r.url, r.status_code, r.alt, r.size, {_size("r.size")} AS size_text, if(least(r.width, r.height) > 0, format('{{}}x{{}}', r.width, r.height), '') AS dimensions, u.url AS found_on
        FROM {{urls}} u, {{page_resources}} p, {{resources}} r WHERE p.url_id = u.id AND p.resource_id = r.id AND r.resource_type = 'image'""",
    "canonicals": """SELECT u.id AS url_id, u.url, h.canonical, coalesce(h.canonical IN (u.url, u.normalized_url) AND h.canonical <> '', false) AS is_self, t.id AS canonical_url_id, f.status_code AS canonical_status_code,
        CASE WHEN h.url_id IS NULL THEN 'No HTML' WHEN h.canonical = '' THEN 'Missing' WHEN h.canonical IN (u.url, u.normalized_url) THEN 'Self-Referencing' WHEN NOT th.is_indexable THEN 'Non-Indexable Target' ELSE 'Canonicalised' END AS status
        FROM {urls} u LEFT JOIN {html_features} h ON h.url_id = u.id LEFT JOIN {urls} t ON t.url = nullif(h.canonical, '') LEFT JOIN {latest_fetch} f ON f.url_id = t.id LEFT JOIN {html_features} th ON th.url_id = t.id""",
    "directives": """SELECT url_id, url, canonical, meta_robots, x_robots, noindex, nofollow, noarchive, nosnippet, if(noindex, 'Non-Indexable', 'Indexable') AS indexability, if(noindex, array_to_string(list_filter([CASE WHEN noindex THEN 'noindex' END, CASE WHEN nofollow THEN 'nofollow' END], lambda x: x IS NOT NULL), ', '), '') AS reason FROM (
        SELECT u.id AS url_id, u.url, h.canonical, h.meta_robots, f.x_robots, coalesce(contains(lower(h.meta_robots), 'noindex') OR lower(h.meta_robots) = 'none', false) OR coalesce(contains(lower(f.x_robots), 'noindex'), false) AS noindex,
        coalesce(contains(lower(h.meta_robots), 'nofollow') OR lower(h.meta_robots) = 'none', false) OR coalesce(contains(lower(f.x_robots), 'nofollow'), false) AS nofollow, coalesce(contains(lower(h.meta_robots), 'noarchive'), false) AS noarchive, coalesce(contains(lower(h.meta_robots), 'nosnippet'), false) AS nosnippet
        FROM {urls} u LEFT JOIN {html_features} h ON h.url_id = u.id LEFT JOIN {latest_fetch} f ON f.url_id = u.id) d""",
    "links_summary": """SELECT u.id AS url_id, u.url, u.is_internal, (SELECT count(*) FROM {links} l WHERE l.from_url_id = u.id) AS total, (SELECT count(*) FROM {links} l WHERE l.from_url_id = u.id AND l.is_internal) AS internal, (SELECT count(*) FROM {links} l WHERE l.from_url_id = u.id AND NOT l.is_internal) AS external_,
        (SELECT count(*) FROM {links} l WHERE l.from_url_id = u.id AND l.is_follow) AS follow_, (SELECT count(*) FROM {links} l WHERE l.from_url_id = u.id AND NOT l.is_follow) AS nofollow FROM {urls} u""",
    "links_detail": """SELECT l.id AS link_id, l.from_url_id, u.url AS from_url, l.to_url, l.anchor_text, l.rel, l.is_internal, l.is_follow, f.status_code AS target_status, ifnull(f.status_code::varchar, 'Unknown') AS status, if(l.is_internal, 'Internal', 'External') AS type FROM {links} l JOIN {urls} u ON u.id = l.from_url_id LEFT JOIN {latest_fetch} f ON f.url_id = l.to_url_id""",
    "hreflang_rows": """SELECT url_id, url, hreflang, href, href = url AS is_self, valid, if(valid, 'OK', 'Invalid Code') AS status FROM (SELECT *, hreflang = 'x-default' OR (len(string_split(hreflang, '-')) = 1 AND strlen(hreflang) IN (2, 3)) OR (len(string_split(hreflang, '-')) = 2 AND strlen(split_part(hreflang, '-', 1)) IN (2, 3) AND strlen(split_part(hreflang, '-', 2)) = 2) AS valid FROM {hreflangs}) x""",
    "url_flags": """SELECT id AS url_id, url, normalized_url, strlen(url) AS length, if(trim(plain, '/') = '', 0, len(string_split(trim(plain, '/'), '/'))) AS path_depth, len(list_distinct(list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''), lambda p: split_part(p, '=', 1)))) AS params, false AS invalid,
        regexp_matches(plain, '[[:upper:]]|\\p{Lu}') AS uppercase, contains(plain, '_') AS underscores, strlen(url) <> length(url) AS non_ascii, contains(url, ' ') OR contains(url, '%20') AS spaces, contains(concat(plain, '?', query), '//') AS double_slash
        FROM (SELECT *, url_decode(path) AS plain, split_part(if(contains(url, '?'), substr(url, strpos(url, '?') + 1), ''), '#', 1) AS query FROM {urls}) q""",
    "url_health": """SELECT url_id, url, length, path_depth, params, uppercase, underscores, non_ascii, spaces, double_slash, count(*) OVER (PARTITION BY normalized_url) AS occurrences, if(text = '', 'OK', 'Issues Found') AS status, text AS issues_text
        FROM (SELECT *, array_to_string(list_filter([CASE WHEN uppercase THEN 'Uppercase' END, CASE WHEN underscores THEN 'Underscores' END, CASE WHEN non_ascii THEN 'Non-ASCII' END, CASE WHEN spaces THEN 'Spaces' END, CASE WHEN double_slash THEN 'Double Slash' END, CASE WHEN length > 115 THEN 'Too Long' END], lambda x: x IS NOT NULL), ', ') AS text FROM {url_flags}) t""",
    "amp_links": """SELECT url_id, url, contains(html, '<html amp') OR contains(html, '<html ⚡') OR (contains(html, '<html lang="') AND contains(html, '⚡')) AS is_amp_page, if(found, split_part(split_part(near, 'href="', 2), '"', 1), '') AS amp_url, found AS has_amp FROM (
        SELECT *, spot > 0 AND contains(near, 'href="') AND contains(substr(near, strpos(near, 'href="') + 6), '"') AS found FROM (SELECT *, array_slice(html, greatest(spot - 200, 1), spot + 49) AS near FROM (SELECT *, if(contains(html, 'rel="amphtml"'), strpos(html, 'rel="amphtml"'), strpos(html, 'rel=''amphtml''')) AS spot FROM {page_html}) a) b) c""",
    "mobile": """SELECT url_id, url, has_viewport, viewport_content, fixed_width, zoom_disabled, has_media_queries, has_fluid_layout, is_responsive, true AS touch_friendly, problems, problems = 0 AS mobile_friendly, CASE WHEN problems >= 3 THEN 'Not Mobile Friendly' WHEN problems >= 1 THEN 'Needs Work' ELSE 'Mobile Friendly' END AS status FROM (
        SELECT *, has_viewport::int * 0 + (NOT has_viewport)::int + fixed_width::int + zoom_disabled::int + (NOT is_responsive)::int AS problems FROM (
        SELECT *, v <> '' AS has_viewport, v AS viewport_content, regexp_matches(v, '(?i)width=\\d') AND NOT contains(lower(v), 'device-width') AS fixed_width, regexp_matches(v, '(?i)user-scalable=(no|0)|maximum-scale=1') AS zoom_disabled, contains(html, '@media') AS has_media_queries, contains(html, 'max-width') OR regexp_matches(html, 'width:\\s*\\d+%') AS has_fluid_layout,
        contains(html, '@media') OR contains(html, 'max-width') OR regexp_matches(html, 'width:\\s*\\d+%') OR len(list_filter(['container-fluid', 'col-xs', 'col-sm', 'col-md', 'col-lg', 'grid', 'flex', 'responsive', 'mobile'], lambda c: contains(html, c))) > 0 AS is_responsive
        FROM (SELECT url_id, url, html, coalesce(nullif(regexp_extract(html, '<meta[^>]*name=["'']viewport["''][^>]*content=["'']([^"'']+)["''][^>]*>', 1), ''), regexp_extract(html, '<meta[^>]*content=["'']([^"'']+)["''][^>]*name=["'']viewport["''][^>]*>', 1)) AS v FROM {page_html}) a) b) c""",
    "accessibility": f"""SELECT url_id, url, images_without_alt, inputs, unlabelled, has_lang, has_skip_link, heading_skips, aria_issues, if(inputs = 0, 'N/A', if(unlabelled = 0, 'OK', format('{{}} missing', unlabelled))) AS form_labels_status, if(heading_skips = 0, 'OK', format('{{}} skips', heading_skips)) AS heading_status,
        images_without_alt + unlabelled + heading_skips + aria_issues + (NOT has_lang)::int AS total_issues, greatest(100 - images_without_alt * 5 - unlabelled * 10 - heading_skips * 5 - aria_issues * 5 - if(has_lang, 0, 10), 0) AS score FROM (
        SELECT *, greatest(inputs - labels, 0) AS unlabelled, (SELECT count(*) FROM (SELECT unnest(levels) AS b, unnest(list_concat([9], levels)[:-2]) AS a) s WHERE b > a + 1) + if(len(levels) > 0 AND levels[1] <> 1, 1, 0) AS heading_skips FROM (
        SELECT url_id, url, len(list_filter(regexp_extract_all(html, '<img[^>]*>'), lambda i: NOT contains(i, 'alt='))) AS images_without_alt, len(regexp_extract_all(html, '<input[^>]*type=["'']?(?:text|email|password|tel|number|search|url|date|time)["'']?[^>]*>')) + len(string_split(html, '<textarea')) - 1 + len(string_split(html, '<select')) - 1 AS inputs,
        len(string_split(html, '<label')) + len(string_split(html, 'aria-label=')) + len(string_split(html, 'aria-labelledby=')) - 3 AS labels, list_transform(regexp_extract_all(html, '<h([1-6])[^>]*>', 1), lambda h: h::int) AS levels, len(list_filter(regexp_extract_all(html, 'role=["'']([^"'']+)["'']', 1), lambda r: lower(r) NOT IN {_ROLES})) AS aria_issues,
        regexp_matches(html, '<html[^>]*lang=["''][^"'']+["'']') AS has_lang, regexp_matches(html, 'skip-to-content|skip-link|skip to content|skip to main') OR regexp_matches(html, '<a[^>]*href=["'']#(main|content|maincontent)["'']') AS has_skip_link FROM {{page_html}}) a) b""",
    # blocks and item types; nested graphs are listed to one level, which is all that the tables hold
    "structured_items": """SELECT url_id, position, type, format, valid, n_errors, n_warnings FROM (
        SELECT url_id, k - 1 AS position, CASE WHEN NOT good THEN 'Unknown (parse error)' ELSE coalesce(nullif(array_to_string(list_filter(list_concat(
            list_concat(if(json_type(b, '$."@type"') = 'VARCHAR', [b ->> '$."@type"'], []), if(json_type(b, '$."@type"') = 'ARRAY', json_extract_string(b, '$."@type"[*]'), [])),
            list_concat(if(json_type(b, '$."@graph"') = 'ARRAY', json_extract_string(b, '$."@graph"[*]."@type"'), []), if(json_type(b) = 'ARRAY', json_extract_string(b, '$[*]."@type"'), []))), lambda t: t IS NOT NULL), ', '), ''), 'Unknown') END AS type, 'JSON-LD' AS format,
        good AND NOT (kind = 'BreadcrumbList' AND NOT json_exists(b, '$.itemListElement')) AND NOT (kind = 'FAQPage' AND NOT json_exists(b, '$.mainEntity')) AS valid,
        if(NOT good OR (kind = 'BreadcrumbList' AND NOT json_exists(b, '$.itemListElement')) OR (kind = 'FAQPage' AND NOT json_exists(b, '$.mainEntity')), 1, 0) AS n_errors,
        CASE WHEN kind IN ('Article', 'NewsArticle', 'BlogPosting') THEN 3 - json_exists(b, '$.headline')::int - json_exists(b, '$.author')::int - json_exists(b, '$.datePublished')::int WHEN kind = 'Product' THEN 2 - json_exists(b, '$.name')::int - json_exists(b, '$.offers')::int
            WHEN kind IN ('LocalBusiness', 'Organization') THEN 1 - json_exists(b, '$.name')::int WHEN kind = 'WebSite' THEN 2 - json_exists(b, '$.name')::int - json_exists(b, '$.url')::int ELSE 0 END AS n_warnings
        FROM (SELECT *, CASE WHEN json_type(b, '$."@type"') = 'VARCHAR' THEN b ->> '$."@type"' END AS kind FROM (SELECT url_id, k, json_valid(raw) AS good, if(json_valid(raw), raw, '{}') AS b FROM (SELECT url_id, unnest(blocks) AS raw, unnest(generate_series(1, len(blocks))) AS k FROM (
            SELECT url_id, list_transform(regexp_extract_all(html, '<script[^>]*type=["'']application/ld\\+json["''][^>]*>([\\s\\S]*?)</script>', 1), lambda x: trim(x)) AS blocks FROM {page_html}) x) y) z0) z
        UNION ALL SELECT url_id, n + k - 1 AS position, type, 'Microdata' AS format, true AS valid, 0 AS n_errors, 0 AS n_warnings FROM (SELECT url_id, n, unnest(types) AS type, unnest(generate_series(1, len(types))) AS k FROM (
            SELECT url_id, len(regexp_extract_all(html, 'application/ld\\+json')) AS n, list_transform(list_filter(list_transform(ts, lambda t, i: struct_pack(t := t, i := i)), lambda s: list_position(ts, s.t) = s.i), lambda s: s.t) AS types FROM (
            SELECT url_id, html, list_transform(regexp_extract_all(html, 'itemtype=["'']([^"'']+)["'']', 1), lambda t: if(contains(t, 'schema.org/'), string_split(t, '/')[-1], t)) AS ts FROM {page_html} WHERE contains(html, 'itemscope') AND contains(html, 'itemtype')) q) r) s) i""",

    "A02_redirect_walks": "SELECT start AS start_url, place AS final_url, n::int AS length, looped AS has_loop, array_to_string(hops[1:10], ' > ') AS hops FROM " + _walked("""SELECT url AS source, CASE WHEN location LIKE '/%' THEN regexp_extract(url, '^https?://[^/?#]*') || location WHEN location LIKE '?%' THEN regexp_extract(url, '^[^?#]*') || location ELSE location END AS target,
        concat_ws(' ', status_code, url, location) AS hop FROM {locations} WHERE location <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY status_code, location) = 1""") + " x",
    "P01_canonical_walks": "SELECT start AS url, hops[1] AS canonical, place AS final, n::bigint AS length, looped AS has_loop, if(looped OR n > 2, 'canonical_chain', NULL) AS issue_code, if(looped, 'error', if(n > 2, 'warning', NULL)) AS issue_type, if(looped, 'high', if(n > 2, 'medium', NULL)) AS severity, if(looped, 'Canonical chain contains a loop', if(n > 2, 'Canonical chain detected (length: ' || n || ')', NULL)) AS message FROM " + _walked("SELECT u.url AS source, min(h.canonical) AS target, min(h.canonical) AS hop FROM {urls} u JOIN {html_features} h ON h.url_id = u.id WHERE h.canonical <> '' AND h.canonical <> u.url GROUP BY u.url") + " x",
    "K01_upsert_urls": """SELECT id, url, normalized_url, depth, crawl_status, '2024-01-0' || day AS first_seen, '2024-01-0' || last_day AS last_seen FROM (SELECT *, max(day) OVER (PARTITION BY normalized_url) AS last_day, row_number() OVER (PARTITION BY normalized_url ORDER BY day, id) AS nth
        FROM (SELECT id, url, normalized_url, depth, crawl_status, 1 AS day FROM {urls} WHERE id % 2 = 0 UNION ALL SELECT id, url, normalized_url, depth + 1, crawl_status, 2 FROM {urls} WHERE id % 3 = 0) a) b WHERE nth = 1""",
    "K03_append_fetches": """SELECT id, url_id, status_code, '{' || array_to_string(list_filter([CASE WHEN content_type <> '' THEN '"Content-Type":["' || content_type || '"]' END, CASE WHEN x_robots <> '' THEN '"X-Robots-Tag":["' || x_robots || '"]' END], lambda e: e IS NOT NULL), ',') || '}' AS headers_json FROM {fetches}""",
    "K04_upsert_features": "SELECT url_id, if(url_id % 3 = 0, title || ' (new)', title) AS title, if(url_id % 3 = 0, NULL, word_count) AS word_count, is_indexable FROM {html_features} UNION ALL SELECT id, 'first', 1, NULL FROM {urls} WHERE id % 20 = 19",
    "K05_append_links": "SELECT v AS version, id, from_url_id, to_url FROM {links} JOIN (SELECT unnest([1, 2, 3])::bigint AS v) x ON from_url_id % 3 < v",
    "K06_append_issues": "SELECT url_id, issue_code, count(*) AS n FROM {issues} GROUP BY ALL",
    "K09_sessions": "SELECT host AS id, min(url) AS start_url, if(bool_or(crawl_status = 'pending'), 'running', 'completed') AS status, count(*) FILTER (crawl_status = 'crawled') AS crawled_urls, count(*) FILTER (crawl_status = 'failed') AS failed_urls, '2024-01-02' AS last_checkpoint, if(bool_or(crawl_status = 'pending'), NULL, '2024-01-03') AS completed_at FROM {urls} GROUP BY host",
    "F05_url_rules": r"""SELECT id, url FROM {urls} WHERE depth <= 3 AND NOT regexp_matches(url, '[?]utm_|/t1') AND regexp_matches(url, '/[a-z]+[-/]|[.]html$') AND NOT regexp_matches(split_part(split_part(url, '#', 1), '?', 1), '(?i)[^/]/.*\.(pdf|docx?|xlsx?|pptx?|zip|rar|tar|gz|7z|mp3|mp4|avi|mov|wmv|flv|jpe?g|png|gif|bmp|ico|svg|webp|css|js|woff2?|ttf|eot)$')
        AND len(string_split(if(contains(split_part(url, '#', 1), '?'), substr(split_part(url, '#', 1), strpos(url, '?') + 1), ''), '&')) <= 3""",
    "S14_pending_list": "SELECT id, url, depth FROM {urls} WHERE crawl_status = 'pending' AND id % 10 <> 9 ORDER BY depth, id LIMIT 100",
    "F07_graph_nodes": "SELECT * FROM (SELECT w.url_id, w.url, w.depth, w.status_code, (SELECT count(*) FROM {links} l WHERE l.to_url_id = w.url_id) AS in_links FROM {wide} w WHERE w.is_internal AND w.depth <= 2 AND w.is_indexable AND (w.status_code IS NULL OR (w.status_code BETWEEN 200 AND 399 AND w.content_type LIKE 'text/html%'))) x WHERE in_links >= 2 ORDER BY url_id LIMIT 1000",
    "O05_first_nodes": "SELECT w.url_id, w.url, w.depth, w.status_code, (SELECT count(*) FROM {links} l WHERE l.to_url_id = w.url_id) AS in_links FROM {wide} w WHERE w.is_internal AND coalesce(w.status_code, 0) <= 599 ORDER BY w.url_id LIMIT 1000",
    "F07_graph_edges": "SELECT l.from_url_id AS source, l.to_url_id AS target, count(*) AS weight FROM {links} l JOIN {urls} a ON a.id = l.from_url_id JOIN {urls} b ON b.id = l.to_url_id WHERE a.is_internal AND b.is_internal AND a.depth <= 2 AND b.depth <= 2 GROUP BY ALL",
    "tree_status": "SELECT p.prefix AS full_path, max(p.k)::bigint AS level, coalesce(arg_max(f.status_code, p.id) FILTER (p.is_page AND f.status_code IS NOT NULL), 0) AS status_code FROM {prefixes} p LEFT JOIN {latest_fetch} f ON f.url_id = p.id WHERE p.prefix <> '' GROUP BY p.prefix",
    "F08_tree_by_status": "SELECT * FROM {tree_status} WHERE status_code // 100 = 2",
    "F08_tree_by_depth": "SELECT * FROM {tree_status} WHERE level = 2",
    "G19_user_segments": r"""SELECT r.id, r.name AS segment, count(w.url_id) AS n, coalesce(sum(w.response_time_ms), 0)::double / greatest(count(w.url_id), 1) AS avg_response_ms, coalesce(sum(w.word_count), 0)::double / greatest(count(w.url_id), 1) AS avg_words, coalesce(sum(w.depth), 0)::double / greatest(count(w.url_id), 1) AS avg_depth,
        count(*) FILTER (w.is_indexable) AS indexable, count(*) FILTER (w.status_code // 100 = 2) AS ok, count(*) FILTER (w.status_code // 100 = 3) AS redirects, count(*) FILTER (w.status_code // 100 = 4) AS client_errors
        FROM (VALUES ('custom_blog___news', 'Blog / news'), ('custom_paged', 'Paged'), ('custom_no_such_page', 'No such page'), ('custom_documents', 'Documents'), ('custom_other', 'Other')) r(id, name)
        LEFT JOIN (SELECT *, if(regexp_matches(url, '/blog|blog\.'), 'Blog / news', if(contains(url, '?page='), 'Paged', if(contains(url, '.html'), 'Documents', 'Other'))) AS name FROM {wide} WHERE is_internal) w ON w.name = r.name GROUP BY r.id, r.name""",
    "S23_sitemap_seeds": "SELECT url, min('https://root.example/s' || id || '.xml') AS sitemap, 2 AS depth FROM {urls} WHERE id % 7 <> 3 GROUP BY url",
    "S23_list_seeds": "SELECT arg_min(to_url, id) AS url, normalized_url FROM {listed} GROUP BY normalized_url",
    "N02_bfs_subgraph": "SELECT * FROM (WITH RECURSIVE walk(id, d) AS (SELECT 0::bigint, 0 UNION SELECT e.target, d + 1 FROM walk JOIN {G27_edges} e ON e.source = walk.id WHERE d < 3) SELECT w.id, min(w.d) AS d, any_value(u.url) AS url FROM walk w JOIN {urls} u ON u.id = w.id GROUP BY w.id) r",
    "Z01_crawl_levels": "SELECT * FROM (WITH RECURSIVE walk(id, d) AS (SELECT id, 0 FROM {urls} WHERE depth = 0 UNION SELECT l.to_url_id, d + 1 FROM walk JOIN {links} l ON l.from_url_id = walk.id WHERE d < 4 AND l.to_url_id IS NOT NULL) SELECT id, min(d) AS depth FROM walk GROUP BY id ORDER BY min(d), id LIMIT 120) r",
    "Z06_token_bucket": """SELECT unnest(ids) AS id, unnest((list_reduce(steps, lambda s, x: struct_pack(t := x.t, tokens := least(s.tokens + 0.5 * (x.t - s.t), 3.0) - if(least(s.tokens + 0.5 * (x.t - s.t), 3.0) >= 1, 1.0, 0.0), flags := list_append(s.flags, least(s.tokens + 0.5 * (x.t - s.t), 3.0) >= 1)))).flags) AS allowed FROM (
        SELECT list(id ORDER BY t, id) AS ids, list_concat([struct_pack(t := min(t), tokens := 3.0::double, flags := []::boolean[])], list(struct_pack(t := t, tokens := 0.0::double, flags := []::boolean[]) ORDER BY t, id)) AS steps FROM (
        SELECT f.id, u.host, floor(epoch(f.fetched_at))::double AS t FROM {fetches} f JOIN {urls} u ON u.id = f.url_id) x GROUP BY host) y""",
    "Z05_adaptive_rate": """SELECT worker, unnest(ts) AS t, unnest((list_reduce(steps, lambda s, x: struct_pack(t := x.t, ok := s.ok + x.ok, errors := s.errors + x.errors, pending := x.pending, slow := x.slow,
            changed := if(x.slow > 5 OR s.changed IS NULL OR x.t - s.changed >= 5, x.t, s.changed),
            rates := list_append(s.rates, CASE WHEN x.slow > 5 THEN greatest(s.rates[-1] * 0.7, 0.5) WHEN s.changed IS NOT NULL AND x.t - s.changed < 5 THEN s.rates[-1]
                WHEN (s.errors + x.errors) / (s.ok + x.ok + s.errors + x.errors) > 0.1 OR x.pending > 1000 THEN greatest(s.rates[-1] * 0.7, 0.5) WHEN (s.errors + x.errors) / (s.ok + x.ok + s.errors + x.errors) < 0.05 AND x.pending < 500 THEN least(s.rates[-1] * 1.1, 50.0) ELSE s.rates[-1] END))).rates)[2:]) AS rate FROM (
        SELECT worker, list(t ORDER BY t) AS ts, list_concat([struct_pack(t := min(t), ok := 0::double, errors := 0::double, pending := 0::double, slow := 0::double, changed := NULL::double, rates := [25.0]::double[])], list(struct_pack(t := t, ok := ok, errors := errors, pending := pending, slow := slow, changed := NULL::double, rates := []::double[]) ORDER BY t)) AS steps FROM (
        SELECT url_id % 8 AS worker, floor(epoch(fetched_at) / 3600)::double AS t, count(*) FILTER (status_code < 400)::double AS ok, count(*) FILTER (status_code >= 400)::double AS errors, sum(response_time_ms)::double / 10 AS pending, max(response_time_ms)::double / 300 AS slow FROM {fetches} GROUP BY ALL) x GROUP BY worker) y""",
    "D01_parsed_pages": r"""SELECT page_id, trim(ents(regexp_extract(html, '<title>([^<]*)</title>', 1))) AS title, regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) AS language, trim(ents(regexp_extract(html, '<h1>([^<]*)</h1>', 1))) AS h1, len(regexp_extract_all(html, '<h1>')) AS h1_count,
        len(list_filter(regexp_extract_all(bare, '<a [^>]*href="([^"]*)"', 1), lambda h: NOT regexp_matches(h, '^(#|javascript:|mailto:|tel:|$)'))) AS links, len(regexp_extract_all(html, '<script[^>]* src=')) AS scripts, len(list_filter(string_split(regexp_replace(regexp_replace(bare, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda w: w <> '')) AS word_count
        FROM (SELECT *, regexp_replace(regexp_replace(html, '<script[^>]*>[\s\S]*?</script>|<style[^>]*>[\s\S]*?</style>', ' ', 'g'), '<!--[\s\S]*?-->', '', 'g') AS bare FROM {site_pages}) p""",
    "D06_bounded_pages": "SELECT p.page_id, p.title[1:12] AS title, least(p.links, 3) AS links, (SELECT coalesce(string_agg(l.anchor_text[1:4], '|' ORDER BY l.position), '') FROM {D04_parsed_links} l WHERE l.page_id = p.page_id AND l.position < 3) AS anchors FROM {D01_parsed_pages} p",
    "K12_issue_export": """SELECT url_id AS "URL ID", issue_code AS "Issue Code", issue_type AS "Type", severity AS "Severity", category AS "Category", array_to_string(list_transform(string_split(issue_code, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS "Message" FROM {issues}""",
    "K10_shown_titles": """SELECT url AS "Address", title AS "Title", length AS "Length", pixel_width AS "Pixel Width", status AS "Status", occurrences AS "Occurrences" FROM {page_titles}""",
    **{f"K10_shown_{a}": "SELECT " + ", ".join(f'{key} AS "{title}"' for title, key in columns.items()) + f" FROM {{{SHOWN.get(a, a)}}}" for a, columns in COLUMNS.items()},
    "pagespeed_shown": """SELECT *, printf('%.1fs', lcp_ms / 1000) AS lcp, printf('%.0fms', inp_ms) AS inp, printf('%g', cls) AS cls_text, printf('%.1fs', fcp_ms / 1000) AS fcp, printf('%.0fms', ttfb_ms) AS ttfb FROM {pagespeed_result}""",
    "hreflang_shown": "SELECT *, if(is_self, '', if(EXISTS (SELECT 1 FROM {hreflangs} b WHERE b.url = h.href AND b.href = h.url), 'Yes', if(h.href IN (SELECT url FROM {urls}), 'No', 'Unknown'))) AS return_link FROM {hreflang_rows} h",
    "F09_quick_filters": "SELECT w.url_id, if(contains(content_type, 'html'), 'HTML', if(contains(content_type, 'pdf'), 'PDF', 'Other')) AS kind, if(w.url_id % 20 = 19 OR w.url_id % 6 = 0, 'Missing', 'Present') AS keywords, if(noindex, 'Noindex', 'Index') AS indexed, if(nofollow, 'Nofollow', 'Follow') AS followed FROM {wide} w JOIN {directives} d ON d.url_id = w.url_id",
    "S20_psi_metrics": """SELECT url_id, error, if(error = '', trunc(coalesce(at('$.lighthouseResult.categories.performance.score')::double, 0) * 100)::int, NULL) AS score, """.replace("at(", "json_extract(body, ") + ", ".join(f"if(error = '', coalesce(json_extract(body, '$.lighthouseResult.audits.\"{audit}\".numericValue')::double, 0), NULL) AS {name}" for name, audit in AUDITS.items())
        + " FROM (SELECT url_id, if(json_valid(body), body, '{{}}') AS body, if(status_code <> 200, 'API returned status ' || status_code, if(url_id % 9 IN (4, 6, 7), 'Failed to parse response', '')) AS error FROM {psi_answers}) a".replace("{{}}", "null"),
    "D15_pagespeed_table": "SELECT a.url_id, a.url, m.score, m.lcp_ms, m.cls, m.inp_ms, m.fcp_ms, m.ttfb_ms FROM {psi_answers} a JOIN {S20_psi_metrics} m ON m.url_id = a.url_id WHERE m.error = ''",
    "D14_header_maps": "SELECT id, (content_type <> '')::bigint + (x_robots <> '')::bigint AS n_headers, x_robots, '' AS other_case, content_type FROM {fetches}",
    "J14_url_detail_headers": "SELECT url_id, unnest(['Content-Type', 'X-Robots-Tag']) AS name, unnest([content_type, x_robots]) AS value FROM {latest_fetch} WHERE content_type <> '' AND x_robots <> '' UNION ALL SELECT url_id, 'Content-Type', content_type FROM {latest_fetch} WHERE content_type <> '' AND x_robots = '' UNION ALL SELECT url_id, 'X-Robots-Tag', x_robots FROM {latest_fetch} WHERE content_type = '' AND x_robots <> ''",
    "K17_cells": "SELECT " + ", ".join(f"cast({c} AS varchar) AS {c}" for c in ("url_id", "url", "score", "status")) + ", " + ", ".join(f"printf('%.2f', {c}) AS {c}" for c in ("lcp_ms", "cls", "inp_ms", "fcp_ms", "ttfb_ms")) + " FROM {pagespeed_result}",
    "D04_parsed_links": r"""SELECT page_id, k - 1 AS position, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE href END AS to_url, trim(regexp_replace(ents(regexp_replace(text, '<[^>]*>', '', 'g')), '\s+', ' ', 'g')) AS anchor_text, false AS nofollow FROM (
        SELECT page_id, url, unnest(hrefs) AS href, unnest(texts) AS text, unnest(generate_series(1, len(hrefs))) AS k FROM (
        SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"#][^"]*)"[^>]*>([\s\S]*?)</a>', 1) AS hrefs, regexp_extract_all(html, '<a [^>]*href="([^"#][^"]*)"[^>]*>([\s\S]*?)</a>', 2) AS texts FROM {site_pages}) x) y""",
    "D05_parsed_images": """SELECT url_id, k - 1 AS position, base || src AS src, alt FROM (SELECT id AS url_id, if(path = '', bare || '/', regexp_extract(bare, '^(.*/)', 1)) AS base, unnest(['a.png', 'b.png', 'c.png']) AS src, unnest(['', 'b', '']) AS alt, unnest([1, 2, 3]) AS k FROM (SELECT id, path, regexp_replace(url, '[?#].*', '') AS bare FROM {urls} WHERE id % 3 = 0) u) x""",
    "S17_robots_rules": "SELECT host, agent, kind, rule FROM {robots_patterns}",
    "robots_patterns": r"""SELECT l.host, a.value AS agent, l.key AS kind, l.value AS rule, '^' || replace(regexp_replace(regexp_escape(regexp_replace(l.value, '\$$', '')), '\\\*', '.*', 'g'), '\-', '\-') || if(l.value LIKE '%$', '$', '') AS pattern FROM {robots_lines} l JOIN {robots_lines} a ON a.host = l.host AND a.grp = l.grp AND a.key = 'user-agent' WHERE l.key IN ('allow', 'disallow')""",
    "robots_lines": r"""SELECT host, k, key, CASE key WHEN 'user-agent' THEN lower(value) ELSE value END AS value, sum(fresh::int) OVER (PARTITION BY host ORDER BY k) AS grp FROM (SELECT *, key = 'user-agent' AND coalesce(lag(key) OVER (PARTITION BY host ORDER BY k), '') <> 'user-agent' AS fresh FROM (
        SELECT host, k, lower(trim(split_part(line, ':', 1))) AS key, trim(substr(line, strpos(line, ':') + 1)) AS value FROM (SELECT host, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS k FROM (SELECT host, string_split(body, chr(10)) AS ls FROM {robots_files}) b) c WHERE line LIKE '%:%' AND line NOT LIKE '#%') d) e""",
    "S17_robots_sources": """SELECT r.host, max(if(d.key = 'crawl-delay', d.value, NULL)::double) AS delay, coalesce(string_agg(if(d.key = 'sitemap', d.value, NULL), ' '), '') AS sitemaps FROM {robots_files} r LEFT JOIN {robots_lines} d ON d.host = r.host GROUP BY r.host""",
    "D07_robots_allowed": r"""SELECT id, path, coalesce(max(if(kind = 'allow', strlen(rule), NULL)), 0) >= coalesce(max(if(kind = 'disallow', strlen(rule), NULL)), 0) AS allowed FROM (
        SELECT p.id, p.robots_path AS path, r.kind, r.rule FROM {X08_robots_path} p JOIN {urls} u ON u.id = p.id LEFT JOIN (SELECT * FROM {robots_patterns} s WHERE rule <> '' AND agent = (SELECT CASE WHEN count(*) FILTER (b.agent = 'goodbot') > 0 THEN 'goodbot' WHEN count(*) FILTER (b.agent = 'good') > 0 THEN 'good' ELSE '*' END FROM {robots_patterns} b WHERE b.host = s.host)) r
        ON r.host = u.host AND regexp_matches(if(p.robots_path = '', '/', p.robots_path), r.pattern)) x GROUP BY id, path""",
    "D08_meta_robots": r"""SELECT url_id, list_contains(t, 'noindex') OR list_contains(t, 'none') AS noindex, list_contains(t, 'nofollow') OR list_contains(t, 'none') AS nofollow, list_contains(t, 'noarchive') AS noarchive, list_contains(t, 'nosnippet') AS nosnippet, list_contains(t, 'noimageindex') AS noimageindex, list_contains(t, 'notranslate') AS notranslate,
        coalesce(try_cast(list_filter(t, lambda x: regexp_matches(x, '^max-snippet:-?\d+$'))[-1][13:] AS int), -1) AS max_snippet, coalesce(list_filter(t, lambda x: x LIKE 'max-image-preview:%')[-1][19:], '') AS max_image_preview, coalesce(try_cast(list_filter(t, lambda x: regexp_matches(x, '^max-video-preview:-?\d+$'))[-1][19:] AS int), -1) AS max_video_preview
        FROM (SELECT url_id, list_transform(string_split(lower(content), ','), lambda x: trim(x)) AS t FROM {robots_values}) v""",
    # by the five kinds of headers that the table holds
    "D09_x_robots": """SELECT url_id, CASE url_id % 5 WHEN 4 THEN NULL ELSE true END AS noindex, CASE url_id % 5 WHEN 0 THEN true WHEN 3 THEN true WHEN 4 THEN NULL ELSE false END AS nofollow, CASE url_id % 5 WHEN 2 THEN true WHEN 4 THEN NULL ELSE false END AS noarchive, CASE url_id % 5 WHEN 2 THEN 3 WHEN 4 THEN NULL ELSE -1 END AS max_snippet FROM {html_features}""",
    "S16_sitemap_entries": """SELECT 'https://' || u.host || '/sitemap.xml' AS url, 'sitemap' AS kind, '' AS error, s.url AS loc, s.lastmod, '' AS changefreq, if(s.url_id % 2 = 0, s.priority, NULL) AS priority FROM {sitemap_urls} s JOIN {urls} u ON u.id = s.url_id
        UNION ALL SELECT 'https://index.example/s' || id, if(id % 3 = 1, 'sitemap_index', 'error'), CASE id % 3 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN '' ELSE 'Unknown sitemap format' END, if(id % 3 = 1, 'https://a.example/1.xml', NULL), if(id % 3 = 1, '', NULL), if(id % 3 = 1, '', NULL), NULL FROM {urls} WHERE id < 6""",
    "page_plain": r"""SELECT p.url_id, p.url, p.html, trim(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>[\s\S]*?</script>|<style[^>]*>[\s\S]*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM {page_html} p""",
    "search_lists": r"""SELECT p.url_id, p.url, p.html, text, list_transform(generate_series(1, (length(text) - length(replace(lower(text), 'the', ''))) // 3), lambda i: 'the') AS s1, CASE WHEN contains(lower(html), '<img') THEN ['<IMG'] ELSE [] END AS s2, regexp_extract_all(html, '(?i)<a href="#[^"]*"') AS s3, regexp_extract_all(title, '[A-Z][a-z]+ing') AS s4, regexp_extract_all(html, 'id=["'']two["'']') AS s5,
        regexp_extract_all(html, 'class=["''][^"'']*\bdeep\b[^"'']*["'']') AS s6, regexp_extract_all(html, '<img[^>]*>') AS s7, list_transform(generate_series(1, length(p.url) - length(replace(lower(p.url), 'q', ''))), lambda i: 'q') AS s8, CASE WHEN contains(lower(meta_description), 'shared') THEN ['shared'] ELSE [] END AS s9
        FROM {page_plain} p LEFT JOIN (SELECT url_id AS k, coalesce(title, '') AS title, meta_description FROM {html_features}) h ON h.k = p.url_id""",
    "Q07_search_rows": "SELECT url_id, rule_id, len(m) AS match_count, if(length(m[1]) > 100, m[1][1:100] || '...', m[1]) AS first_match FROM (SELECT url_id, unnest(['s1', 's2', 's3', 's4', 's5', 's6', 's7', 's8', 's9']) AS rule_id, unnest([s1, s2, s3, coalesce(s4, []), s5, s6, s7, s8, s9]) AS m FROM {search_lists}) x WHERE len(m) > 0",
    "custom_search": """SELECT url_id, url, len(s1) + len(s2) + len(s3) + coalesce(len(s4), 0) + len(s5) + len(s6) + len(s7) + len(s8) + len(s9) AS total_matches, 'the' AS rule_name, len(s1) AS match_count, s1[1] AS first_match, CASE WHEN len(s1) > 0 THEN if(spot > 51, '...', '') || substr(text, greatest(spot - 50, 1), spot + 52 - greatest(spot - 50, 1) + 1) || if(spot + 52 < length(text), '...', '') END AS context FROM (SELECT *, strpos(lower(text), 'the') AS spot FROM {search_lists}) x""",
    "extraction_lists": r"""SELECT url_id, url, list_filter(list_transform(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1), lambda v: trim(v)), lambda v: v <> '') AS e1, regexp_extract_all(html, '<h4[^>]*>') AS e2, if(url_id % 5 = 0, ['deep'], []) AS e3, if(url_id % 5 = 0, ['two'], []) AS e4, if(url_id % 3 = 0, ['b', ''], []) AS e5, list_transform(regexp_extract_all(html, '<h2[^>]*>([^<]*)</h2>', 1), lambda v: trim(v)) AS e6,
        regexp_extract_all(html, '<img[^>]*src="([^"]*)"', 1) AS e7, if(url_id % 5 = 0, ['deep'], []) AS e8, if(url_id % 5 = 0, ['<h4 class="deep">deep</h4>'], []) AS e9, CASE url_id % 8 WHEN 3 THEN ['n'] WHEN 4 THEN ['p'] ELSE [] END AS e10, if(url_id % 8 = 4, ['9.5'], []) AS e11, if(url_id % 8 = 4, ['a', 'b'], []) AS e12 FROM {page_html}""",
    "Q12_extraction_rows": "SELECT url_id, rule_id, len(v) AS extracted_count, coalesce(if(length(v[1]) > 100, v[1][1:100] || '...', v[1]), '') AS first_value, array_to_string(v, ' | ') AS all_values FROM (SELECT url_id, unnest(['e1', 'e2', 'e3', 'e4', 'e5', 'e6', 'e7', 'e8', 'e9', 'e10', 'e11', 'e12']) AS rule_id, unnest([e1, e2, e3, e4, e5, e6, e7, e8, e9, e10, e11, e12]) AS v FROM {extraction_lists}) x",
    "custom_extraction": "SELECT url_id, url, len(e1) + len(e2) + len(e3) + len(e4) + len(e5) + len(e6) + len(e7) + len(e8) + len(e9) + len(e10) + len(e11) + len(e12) AS total_extractions, 'h1' AS rule_name, len(e1) AS extracted_count, coalesce(if(length(e1[1]) > 100, e1[1][1:100] || '...', e1[1]), '') AS first_value, array_to_string(e1, ' | ') AS all_values FROM {extraction_lists}",
    "X13_id_segment": "SELECT id, segment, regexp_full_match(segment, '[0-9]+') OR (strlen(segment) >= 32 AND len(regexp_extract_all(segment, '[0-9a-fA-F-]')) > 0.9 * strlen(segment)) AS is_id FROM (SELECT id, unnest(list_filter(string_split(path, '/'), lambda p: p <> '')) AS segment FROM {urls}) x",
    "X18_word_count": r"SELECT doc_id, len(regexp_extract_all(text, '[^\s\x0b\x{85}\x{a0}]+')) AS n_words FROM {documents}",
    "X19_strip_tags": "SELECT url_id AS page_id, text FROM {page_plain}",
    "G21_depth_distribution": "SELECT d.depth::int AS depth, count(u.id) AS n, coalesce(100.0 * count(u.id) / nullif((SELECT count(*) FROM {urls} WHERE is_internal), 0), 0)::double AS percent FROM (SELECT unnest(generate_series(0, coalesce((SELECT max(depth) FROM {urls} WHERE is_internal), 0))) AS depth) d LEFT JOIN {urls} u ON u.depth = d.depth AND u.is_internal GROUP BY d.depth",
    "G28_benchmark_stats": "SELECT min(v) AS lo, max(v) AS hi, avg(v) AS mean, list(v ORDER BY v)[1 + count(*) // 2] AS median, list(v ORDER BY v)[1 + floor(count(*) * 0.95)::int] AS p95, list(v ORDER BY v)[1 + floor(count(*) * 0.99)::int] AS p99, stddev_samp(v) AS stddev, 1000.0 * count(*) / sum(v) AS ops_per_sec FROM (SELECT response_time_ms AS v FROM {latest_fetch}) x",
    "X25_progress": "SELECT n AS total, done, if(n = 0, 0, 100 * done / n)::double AS percent, if(took > 0, done / took, 0)::double AS rate, if(took > 0 AND done > 0 AND done < n, (n - done) * took / done, 0)::double AS eta_s FROM (SELECT count(*) AS n, sum((crawl_status <> 'pending')::int)::bigint AS done, (SELECT date_diff('microsecond', min(fetched_at), max(fetched_at)) / 1e6 FROM {fetches}) AS took FROM {urls}) x",
    "W05_lru_eviction": "SELECT id, sum(size) OVER (ORDER BY id DESC ROWS UNBOUNDED PRECEDING) > 5000000 AS evicted FROM {resources}",
    "G20_all_segments": " UNION ALL ".join(f"SELECT '{k}' AS kind, segment, n FROM {{{k}}}" for k in ("G12_by_content_type", "G13_by_status", "G14_by_indexability", "G15_by_template", "G16_by_depth", "G17_by_folder", "G19_by_rule")),
}

for _name, _text in list(DUCK.items()):
    while (_at := _text.find("ents(")) >= 0:
        _depth, _end = 1, _at + 5
        while _depth:
            _depth += {"(": 1, ")": -1}.get(_text[_end], 0)
            _end += 1
        _text = _text[:_at] + _ents(_text[_at + 5 : _end - 1]) + _text[_end:]
    DUCK[_name] = _text
