"""Per-page analyzers, their issues and their named filters, as plans over the crawl tables.

Lengths are bytes. A missing fetch or feature row gives the zero values that the filters default to.
"""

from __future__ import annotations

#: Thresholds (fixed values): title 30/60 bytes and 580 px at 8.5, description 70/155 and 920 px at 6, h1 70, url 115, thin 200 words, resource 102400 bytes, slow 500 ms, chain 2 hops.

#: The roles that a page may use.
ROLES = "alert alertdialog application article banner button checkbox complementary contentinfo dialog document feed figure form grid gridcell group heading img link list listbox listitem main menu menubar menuitem navigation none note option presentation progressbar radio region row rowgroup scrollbar search searchbox separator slider spinbutton status switch tab table tablist tabpanel textbox timer toolbar tooltip tree treegrid treeitem".split()
#: A language of two or three bytes and at most a region of two, or x-default.
VALID_CODE = "coalesce(hreflang = 'x-default' OR (SIZE(PARTS(hreflang, '-')) <= 2 AND BLEN(ITEM(PARTS(hreflang, '-'), 1)) BETWEEN 2 AND 3 AND (SIZE(PARTS(hreflang, '-')) = 1 OR BLEN(ITEM(PARTS(hreflang, '-'), SIZE(PARTS(hreflang, '-')))) = 2)), false)"
#: No date, or one of a day or of a second with its zone.
LASTMOD_VALID = """lastmod IS NULL OR lastmod = '' OR RX(lastmod, '^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2}))?$') AND try_cast(substr(lastmod, 1, 10) AS date) IS NOT NULL"""
_TENTHS = "cast(floor({{0}} * 10 / {0}) + CASE WHEN {{0}} * 10 % {0} > {0} / 2 OR ({{0}} * 10 % {0} = {0} / 2 AND floor({{0}} * 10 / {0}) % 2 = 1) THEN 1 ELSE 0 END AS bigint)"
_TENTHS_TEXT = "cast(cast(floor(" + _TENTHS + " / 10) AS bigint) AS TEXT) || '.' || cast(" + _TENTHS + " % 10 AS TEXT)"
#: Bytes as B, KB or MB with one decimal, ties to even.
SIZE_TEXT = f"CASE WHEN {{0}} < 1024 THEN cast({{0}} AS TEXT) || ' B' WHEN {{0}} < 1048576 THEN {_TENTHS_TEXT.format(1024)} || ' KB' ELSE {_TENTHS_TEXT.format(1048576)} || ' MB' END"


def _amp(rows: str) -> str:
    """rows (a table or a SELECT in parentheses) and the first href within 200 characters before and 50 after the mark of an AMP version."""
    near = "substr(html, greatest(at - 200, 1), least(at, 201) + 49)"
    return f"""SELECT *, CASE WHEN at > 0 THEN regexp_extract({near}, 'href="([^"]*)"', 1) ELSE '' END AS amp_url, at > 0 AND RX({near}, 'href="[^"]*"') AS has_amp
        FROM (SELECT *, html LIKE '%<html amp%' OR html LIKE '%<html ⚡%' OR (html LIKE '%<html lang="%' AND html LIKE '%⚡%') AS is_amp_page,
        cast(CASE WHEN html LIKE '%rel="amphtml"%' THEN FOUND(html, 'rel="amphtml"') ELSE FOUND(html, 'rel=' || chr(39) || 'amphtml' || chr(39)) END AS int) AS at FROM {rows} h) amp1"""


def _mobile(rows: str) -> str:
    """rows and what their html says to small screens."""
    percent = "width:[ \t\n\f\r]*[0-9]+%"
    return f"""SELECT *, CASE WHEN has_viewport THEN 0 ELSE 1 END + CASE WHEN fixed_width THEN 1 ELSE 0 END + CASE WHEN zoom_disabled THEN 1 ELSE 0 END + CASE WHEN is_responsive THEN 0 ELSE 1 END AS problems FROM (
        SELECT *, viewport_content <> '' AS has_viewport, RX(lower(viewport_content), 'width=[0-9]') AND lower(viewport_content) NOT LIKE '%device-width%' AS fixed_width, lower(viewport_content) LIKE '%user-scalable=no%' OR lower(viewport_content) LIKE '%user-scalable=0%' OR lower(viewport_content) LIKE '%maximum-scale=1%' AS zoom_disabled,
        html LIKE '%@media%' AS has_media_queries, html LIKE '%max-width%' OR RX(html, '{percent}') AS has_fluid_layout, RX(html, '@media|max-width|container-fluid|col-xs|col-sm|col-md|col-lg|grid|flex|responsive|mobile|{percent}') AS is_responsive, true AS touch_friendly FROM (
        SELECT *, CASE WHEN named <> '' THEN named ELSE regexp_extract(html, '<meta[^>]*content=["'']([^"'']+)["''][^>]*name=["'']viewport["''][^>]*>', 1) END AS viewport_content FROM (
        SELECT *, regexp_extract(html, '<meta[^>]*name=["'']viewport["''][^>]*content=["'']([^"'']+)["''][^>]*>', 1) AS named FROM {rows} h) mob1) mob2) mob3"""


def _accessibility(rows: str) -> str:
    """rows and counts over the tags of their html."""
    return f"""SELECT *, cast(SIZE(KEPT(imgs, i -> (i NOT LIKE '%alt=%'))) AS bigint) AS images_without_alt, cast(SIZE(boxes) + SIZE(areas) AS bigint) AS inputs, cast(greatest(SIZE(boxes) + SIZE(areas) - SIZE(labels), 0) AS bigint) AS unlabelled,
        cast(SIZE(KEPT(levels, (h, i) -> (i > FIRST_INDEX AND h > ITEM(levels, cast(i + BEFORE AS int)) + 1))) + CASE WHEN SIZE(levels) > 0 AND ITEM(levels, 1) <> 1 THEN 1 ELSE 0 END AS bigint) AS heading_skips, cast(SIZE(KEPT(roles, r -> (r NOT IN ({', '.join(map(repr, ROLES))})))) AS bigint) AS aria_issues FROM (
        SELECT *, ALL_OF(html, '<img[^>]*>', 0) AS imgs, ALL_OF(html, '<input[^>]*type=["'']?(text|email|password|tel|number|search|url|date|time)["'']?[^>]*>', 0) AS boxes, ALL_OF(html, '<textarea|<select', 0) AS areas, ALL_OF(html, '<label|aria-label=|aria-labelledby=', 0) AS labels,
        MAPPED(ALL_OF(html, '<h([1-6])[^>]*>', 1), h -> (cast(h AS int))) AS levels, MAPPED(ALL_OF(html, 'role=["'']([^"'']+)["'']', 1), r -> (lower(r))) AS roles, RX(html, '<html[^>]*lang=["''][^"'']+["'']') AS has_lang, RX(html, 'skip-to-content|skip-link|skip to content|skip to main|<a[^>]*href=["'']#(main|content|maincontent)["'']') AS has_skip_link FROM {rows} h) acc1"""


ANALYZERS = {
    # an aggregate, so that each task sends one fetch of a URL
    "latest_fetch": """SELECT newest.id AS id, url_id, newest.status_code AS status_code, newest.content_type AS content_type, newest.response_time_ms AS response_time_ms, newest.fetched_at AS fetched_at, newest.x_robots AS x_robots
        FROM (SELECT url_id, max_by(struct(id, status_code, content_type, response_time_ms, fetched_at, x_robots), struct(fetched_at, id)) AS newest FROM {fetches} GROUP BY url_id) f""",
    "wide": """SELECT u.id AS url_id, u.url, u.normalized_url, u.host, u.path, u.depth, u.is_internal, u.in_sitemap, f.status_code, f.content_type, f.response_time_ms, f.x_robots, h.url_id IS NOT NULL AS has_html, h.title, h.meta_description, h.meta_robots, h.canonical, h.h1_count, h.h1_first, h.h2_count, h.h2_first, h.content_hash, h.word_count, h.is_indexable
        FROM {urls} u LEFT JOIN {latest_fetch} f ON f.url_id = u.id LEFT JOIN {html_features} h ON h.url_id = u.id""",
    "response_codes": """SELECT w.url_id, w.url, w.status_code, w.response_time_ms, cast(w.response_time_ms AS TEXT) || 'ms' AS response_time, CASE WHEN status_code IS NULL THEN NULL WHEN status_code BETWEEN 300 AND 399 THEN coalesce(c.final_url, '') ELSE '' END AS redirect_url,
        CASE WHEN status_code IS NULL THEN NULL WHEN status_code BETWEEN 200 AND 299 THEN 'Success' WHEN status_code BETWEEN 300 AND 399 THEN 'Redirect' WHEN status_code BETWEEN 400 AND 499 THEN 'Client Error' WHEN status_code >= 500 THEN 'Server Error' ELSE 'Unknown' END AS status,
        CASE WHEN status_code IS NULL THEN NULL WHEN status_code IN (301, 308) THEN 'Permanent' WHEN status_code IN (302, 307) THEN 'Temporary' WHEN status_code = 303 THEN 'See Other' WHEN status_code BETWEEN 300 AND 399 THEN 'Redirect (' || cast(status_code AS TEXT) || ')' ELSE '' END AS redirect_type,
        c.length AS chain_length FROM {wide} w LEFT JOIN {redirect_chains} c ON c.start_url = w.url""",
    "redirect_chain": "SELECT s.id AS url_id, c.start_url, c.final_url, c.length, c.has_loop FROM {redirect_chains} c LEFT JOIN {urls} s ON s.url = c.start_url",
    "page_titles": """SELECT url_id, url, title, cast(BLEN(coalesce(title, '')) AS bigint) AS length, cast(floor(BLEN(coalesce(title, '')) * 8.5) AS bigint) AS pixel_width, md5(title) AS title_hash, coalesce(h1_first <> '' AND h1_first = title, false) AS same_as_h1,
        CASE WHEN NOT has_html THEN 'No HTML' WHEN title = '' THEN 'Missing' WHEN BLEN(title) > 60 THEN 'Too Long' WHEN BLEN(title) < 30 THEN 'Too Short' ELSE 'OK' END AS status,
        o.n AS occurrences FROM {wide} w LEFT JOIN (SELECT title AS v, count(*) AS n FROM {html_features} WHERE title <> '' GROUP BY title) o ON o.v = w.title""",
    "meta_description": """SELECT url_id, url, meta_description, cast(BLEN(coalesce(meta_description, '')) AS bigint) AS length, cast(BLEN(coalesce(meta_description, '')) * 6 AS bigint) AS pixel_width,
        CASE WHEN NOT has_html THEN 'No HTML' WHEN meta_description = '' THEN 'Missing' WHEN BLEN(meta_description) > 155 THEN 'Too Long' WHEN BLEN(meta_description) < 70 THEN 'Too Short' ELSE 'OK' END AS status,
        o.n AS occurrences FROM {wide} w LEFT JOIN (SELECT meta_description AS v, count(*) AS n FROM {html_features} WHERE meta_description <> '' GROUP BY meta_description) o ON o.v = w.meta_description""",
    "h1": """SELECT url_id, url, h1_first AS h1, h1_count AS count_, cast(BLEN(coalesce(h1_first, '')) AS bigint) AS length, CASE WHEN NOT has_html THEN 'No HTML' WHEN h1_count = 0 THEN 'Missing' WHEN h1_count > 1 THEN 'Multiple' WHEN BLEN(h1_first) > 70 THEN 'Too Long' ELSE 'OK' END AS status,
        o.n AS occurrences FROM {wide} w LEFT JOIN (SELECT h1_first AS v, count(*) AS n FROM {html_features} WHERE h1_first <> '' GROUP BY h1_first) o ON o.v = w.h1_first""",
    "h2": "SELECT url_id, url, h2_first AS h2, h2_count AS count_, CASE WHEN NOT has_html THEN 'No HTML' WHEN h2_count = 0 THEN 'Missing' ELSE 'OK' END AS status FROM {wide}",
    "content": """SELECT url_id, url, word_count, content_hash, CASE WHEN NOT has_html THEN 'No HTML' WHEN word_count = 0 THEN 'Empty' WHEN word_count < 200 THEN 'Thin' ELSE 'OK' END AS status,
        o.n AS occurrences FROM {wide} w LEFT JOIN (SELECT content_hash AS v, count(*) AS n FROM {html_features} WHERE content_hash <> '' GROUP BY content_hash) o ON o.v = w.content_hash""",
    "images": f"""SELECT r.id AS resource_id, u.id AS url_id, r.url, r.status_code, r.alt, r.size, {SIZE_TEXT.format("r.size")} AS size_text, CASE WHEN r.width > 0 AND r.height > 0 THEN cast(r.width AS TEXT) || 'x' || cast(r.height AS TEXT) ELSE '' END AS dimensions, u.url AS found_on
        FROM {{resources}} r JOIN {{page_resources}} p ON p.resource_id = r.id JOIN {{urls}} u ON u.id = p.url_id WHERE r.resource_type = 'image'""",
    "canonicals": """SELECT w.url_id, w.url, w.canonical, coalesce(w.canonical <> '' AND (w.canonical = w.url OR w.canonical = w.normalized_url), false) AS is_self, t.url_id AS canonical_url_id, t.status_code AS canonical_status_code,
        CASE WHEN NOT w.has_html THEN 'No HTML' WHEN w.canonical = '' THEN 'Missing' WHEN w.canonical = w.url OR w.canonical = w.normalized_url THEN 'Self-Referencing' WHEN t.is_indexable = false THEN 'Non-Indexable Target' ELSE 'Canonicalised' END AS status
        FROM {wide} w LEFT JOIN {wide} t ON t.url = w.canonical AND w.canonical <> ''""",
    "directives": """SELECT *, CASE WHEN noindex THEN 'Non-Indexable' ELSE 'Indexable' END AS indexability, CASE WHEN noindex AND nofollow THEN 'noindex, nofollow' WHEN noindex THEN 'noindex' ELSE '' END AS reason FROM (
        SELECT url_id, url, canonical, meta_robots, x_robots, meta LIKE '%noindex%' OR meta = 'none' OR header LIKE '%noindex%' AS noindex, meta LIKE '%nofollow%' OR meta = 'none' OR header LIKE '%nofollow%' AS nofollow, meta LIKE '%noarchive%' AS noarchive, meta LIKE '%nosnippet%' AS nosnippet
        FROM (SELECT *, lower(coalesce(meta_robots, '')) AS meta, lower(coalesce(x_robots, '')) AS header FROM {wide}) m) d""",
    "links_summary": """SELECT w.url_id, w.url, w.is_internal, count(l.id) AS total, count_if(l.is_internal) AS internal, count_if(NOT l.is_internal) AS external_, count_if(l.is_follow) AS follow_, count_if(NOT l.is_follow) AS nofollow FROM {wide} w LEFT JOIN {links} l ON l.from_url_id = w.url_id GROUP BY w.url_id, w.url, w.is_internal""",
    "links_detail": """SELECT l.id AS link_id, l.from_url_id, u.url AS from_url, l.to_url, l.anchor_text, l.rel, l.is_internal, l.is_follow, f.status_code AS target_status, coalesce(cast(f.status_code AS TEXT), 'Unknown') AS status, CASE WHEN l.is_internal THEN 'Internal' ELSE 'External' END AS type
        FROM {links} l JOIN {urls} u ON u.id = l.from_url_id LEFT JOIN {latest_fetch} f ON f.url_id = l.to_url_id WHERE l.to_url_id IS NOT NULL
        UNION ALL SELECT l.id AS link_id, l.from_url_id, u.url AS from_url, l.to_url, l.anchor_text, l.rel, l.is_internal, l.is_follow, cast(NULL AS int) AS target_status, 'Unknown' AS status, CASE WHEN l.is_internal THEN 'Internal' ELSE 'External' END AS type
        FROM {links} l JOIN {urls} u ON u.id = l.from_url_id WHERE l.to_url_id IS NULL""",
    "hreflang_rows": f"""SELECT url_id, url, hreflang, href, href = url AS is_self, {VALID_CODE} AS valid, CASE WHEN {VALID_CODE} THEN 'OK' ELSE 'Invalid Code' END AS status FROM {{hreflangs}}""",
    "hreflang_missing_returns": """SELECT a.url_id, a.url, a.href FROM {hreflang_rows} a JOIN {urls} t ON t.url = a.href WHERE NOT a.is_self AND NOT EXISTS (SELECT 1 FROM {hreflangs} b WHERE b.url = a.href AND b.href = a.url)""",
    "hreflang": """SELECT u.url_id, u.url, count(h.hreflang) AS count_, count_if(h.is_self) > 0 AS has_self_ref, count_if(h.hreflang = 'x-default') > 0 AS has_x_default, count_if(NOT h.valid) AS invalid_codes, CASE WHEN count(h.hreflang) = 0 THEN 'No Hreflang' ELSE 'Has Hreflang' END AS status,
        max(CASE WHEN m.url_id IS NOT NULL THEN 1 ELSE 0 END) = 1 AS missing_return FROM {wide} u LEFT JOIN {hreflang_rows} h ON h.url_id = u.url_id LEFT JOIN (SELECT DISTINCT url_id FROM {hreflang_missing_returns}) m ON m.url_id = u.url_id GROUP BY u.url_id, u.url""",
    "url_parts": """SELECT *, UNESCAPED(replace(path, '+', '%2B')) AS plain, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query FROM {urls}""",
    "url_flags": """SELECT id AS url_id, url, normalized_url, cast(BLEN(url) AS bigint) AS length, cast(CASE WHEN replace(plain, '/', '') = '' AND trim(BOTH '/' FROM plain) = '' THEN 0 ELSE CHARS(trim(BOTH '/' FROM plain)) - CHARS(replace(trim(BOTH '/' FROM plain), '/', '')) + 1 END AS bigint) AS path_depth,
        cast(SIZE(DISTINCT_OF(MAPPED(KEPT(PARTS(query, '&'), p -> (p <> '' AND p NOT LIKE '%;%')), p -> (UNESCAPED(replace(regexp_extract(p, '^([^=]*)', 1), '+', '%20')))))) AS bigint) AS params, plain IS NULL AS invalid,
        coalesce(RX(plain, UPPER_CLASS), false) AS uppercase, coalesce(plain LIKE '%!_%' ESCAPE '!', false) AS underscores, RX(url, '[^ -~]') AS non_ascii, url LIKE '% %' OR url LIKE '%!%20%' ESCAPE '!' AS spaces, coalesce(plain || '?' || query LIKE '%//%', false) AS double_slash FROM {url_parts}""",
    "url_health": """SELECT f.url_id, f.url, f.length, f.path_depth, f.params, f.uppercase, f.underscores, f.non_ascii, f.spaces, f.double_slash, coalesce(g.n, 1) AS occurrences,
        CASE WHEN invalid THEN 'Invalid URL' WHEN uppercase OR underscores OR non_ascii OR spaces OR double_slash OR length > 115 THEN 'Issues Found' ELSE 'OK' END AS status,
        substr(CASE WHEN uppercase THEN ', Uppercase' ELSE '' END || CASE WHEN underscores THEN ', Underscores' ELSE '' END || CASE WHEN non_ascii THEN ', Non-ASCII' ELSE '' END || CASE WHEN spaces THEN ', Spaces' ELSE '' END || CASE WHEN double_slash THEN ', Double Slash' ELSE '' END || CASE WHEN length > 115 THEN ', Too Long' ELSE '' END, 3) AS issues_text
        FROM {url_flags} f LEFT JOIN (SELECT normalized_url, count(*) AS n FROM {urls} GROUP BY normalized_url HAVING count(*) > 1) g ON g.normalized_url = f.normalized_url""",
    "javascript": """SELECT r.id AS resource_id, u.id AS url_id, r.url, r.status_code, r.size, CASE WHEN r.is_async THEN 'Yes' ELSE 'No' END AS async_, CASE WHEN r.is_defer THEN 'Yes' ELSE 'No' END AS defer_, r.is_async, r.is_defer, CASE WHEN r.mime_type = '' THEN 'application/javascript' ELSE r.mime_type END AS type, u.url AS found_on,
        regexp_extract(r.url, '^https?://([^/?:]+)', 1) <> regexp_extract(u.url, '^https?://([^/?:]+)', 1) AS is_external FROM {resources} r JOIN {page_resources} p ON p.resource_id = r.id JOIN {urls} u ON u.id = p.url_id WHERE r.resource_type = 'script'""",
    "amp_links": f"SELECT url_id, url, is_amp_page, amp_url, has_amp FROM ({_amp('{page_html}')}) h",
    "amp": """SELECT a.url_id, a.url, a.is_amp_page, a.amp_url, a.has_amp, t.status_code AS amp_status_code, CASE WHEN t.url_id IS NULL THEN 'Unknown' ELSE coalesce(cast(t.status_code AS TEXT), 'Unknown') END AS amp_status, CASE WHEN t.has_html THEN t.canonical = a.url END AS canonical_match, t.url_id AS amp_url_id
        FROM {amp_links} a LEFT JOIN {wide} t ON t.url = a.amp_url AND a.has_amp""",
    "microdata": """SELECT p.url_id, p.url, coalesce(s.n, 0) AS schema_count, coalesce(s.type, '') AS type, coalesce(s.format, '') AS format, coalesce(s.valid, true) AS valid, coalesce(s.has_json_ld, false) AS has_json_ld, coalesce(s.has_microdata, false) AS has_microdata, coalesce(s.errors, 0) AS errors, coalesce(s.warnings, 0) AS warnings
        FROM {page_html} p LEFT JOIN (SELECT url_id, count(*) AS n, min_by(type, position) AS type, min_by(format, position) AS format, min_by(valid, position) AS valid, count_if(format = 'JSON-LD') > 0 AS has_json_ld, count_if(format = 'Microdata') > 0 AS has_microdata, cast(sum(n_errors) AS bigint) AS errors, cast(sum(n_warnings) AS bigint) AS warnings FROM {structured_items} GROUP BY url_id) s ON s.url_id = p.url_id""",
    "sitemaps": f"""SELECT u.id AS url_id, coalesce(s.url, u.url) AS url, s.url IS NOT NULL AS in_sitemap, u.id IS NOT NULL AS in_crawl, s.lastmod, s.changefreq, s.priority,
        {LASTMOD_VALID.replace("lastmod", "s.lastmod")} AS lastmod_valid FROM {{urls}} u FULL OUTER JOIN {{sitemap_urls}} s ON s.url_id = u.id""",
    "mobile": f"""SELECT url_id, url, has_viewport, viewport_content, fixed_width, zoom_disabled, has_media_queries, has_fluid_layout, is_responsive, touch_friendly, problems, problems = 0 AS mobile_friendly,
        CASE WHEN problems = 0 THEN 'Mobile Friendly' WHEN problems <= 2 THEN 'Needs Work' ELSE 'Not Mobile Friendly' END AS status FROM ({_mobile('{page_html}')}) m""",
    "accessibility": f"""SELECT url_id, url, images_without_alt, inputs, unlabelled, has_lang, has_skip_link, heading_skips, aria_issues, CASE WHEN inputs = 0 THEN 'N/A' WHEN unlabelled = 0 THEN 'OK' ELSE cast(unlabelled AS TEXT) || ' missing' END AS form_labels_status, CASE WHEN heading_skips = 0 THEN 'OK' ELSE cast(heading_skips AS TEXT) || ' skips' END AS heading_status,
        images_without_alt + unlabelled + heading_skips + aria_issues + CASE WHEN has_lang THEN 0 ELSE 1 END AS total_issues, greatest(0, 100 - 5 * images_without_alt - 10 * unlabelled - 5 * heading_skips - 5 * aria_issues - CASE WHEN has_lang THEN 0 ELSE 10 END) AS score FROM ({_accessibility('{page_html}')}) a""",
    # all that is looked for in a page's text, in one pass
    "page_texts": f"SELECT * FROM ({_accessibility(f'({_mobile(f"({_amp('{page_html}')})")})')}) p",
    # with the columns that only displays have
    "pagespeed_shown": """SELECT *, format_number(lcp_ms / 1000, '0.0') || 's' AS lcp, format_number(inp_ms, '0') || 'ms' AS inp, CASE WHEN cls = 0 THEN '0' ELSE regexp_replace(cast(cast(cls AS decimal(30, 17)) AS string), '[.]?0+$', '') END AS cls_text, format_number(fcp_ms / 1000, '0.0') || 's' AS fcp, format_number(ttfb_ms, '0') || 'ms' AS ttfb FROM {pagespeed_result}""",
    "sitemaps_shown": "SELECT *, CASE WHEN in_sitemap THEN 'sitemap_entry' ELSE '' END AS type, CASE WHEN in_sitemap AND in_crawl THEN 'OK' WHEN in_sitemap THEN 'Orphan' ELSE 'Not In Sitemap' END AS status FROM {sitemaps}",
    "hreflang_shown": "SELECT h.*, CASE WHEN h.is_self THEN '' WHEN b.url IS NOT NULL THEN 'Yes' WHEN t.url IS NOT NULL THEN 'No' ELSE 'Unknown' END AS return_link FROM {hreflang_rows} h LEFT JOIN (SELECT DISTINCT url, href FROM {hreflangs}) b ON b.url = h.href AND b.href = h.url LEFT JOIN (SELECT DISTINCT url FROM {urls}) t ON t.url = h.href",
    "pagespeed_result": """SELECT url_id, url, score, lcp_ms, cls, inp_ms, fcp_ms, ttfb_ms, CASE WHEN score >= 90 THEN 'Good' WHEN score >= 50 THEN 'Needs Improvement' ELSE 'Poor' END AS status FROM {pagespeed}""",
}

#: Filter id -> predicate on the analyzer's rows; a null predicate counts as the flag after it.
FILTERS = {
    "response_codes": {"success": ("status_code BETWEEN 200 AND 299", False), "redirect": ("status_code BETWEEN 300 AND 399", False), "client_error": ("status_code BETWEEN 400 AND 499", False), "server_error": ("status_code BETWEEN 500 AND 599", False), "redirect_chain": ("chain_length > 1", False), "slow": ("response_time_ms > 500", False)},
    "page_titles": {"missing": ("title = ''", True), "duplicate": ("occurrences > 1", False), "too_long": ("length > 60", False), "too_short": ("length > 0 AND length < 30", False), "same_as_h1": ("same_as_h1", False), "pixel_truncated": ("pixel_width > 580", False)},
    "meta_description": {"missing": ("meta_description = ''", True), "duplicate": ("occurrences > 1", False), "too_long": ("length > 155", False), "too_short": ("length > 0 AND length < 70", False), "pixel_truncated": ("pixel_width > 920", False)},
    "h1": {"missing": ("count_ = 0", True), "duplicate": ("occurrences > 1", False), "multiple": ("count_ > 1", False), "too_long": ("length > 70", False)},
    "h2": {"missing": ("count_ = 0", True), "multiple": ("count_ > 0", False)},
    "content": {"thin": ("word_count > 0 AND word_count < 200", False), "duplicate": ("occurrences > 1", False), "empty": ("word_count = 0", True)},
    "images": {"missing_alt": ("alt = ''", True), "over_100kb": ("size > 102400", False), "broken": ("status_code >= 400", False), "missing_alt_large": ("alt = '' AND size > 102400", False)},
    "canonicals": {"missing": ("canonical = ''", True), "self": ("is_self", False), "canonicalised": ("canonical <> '' AND NOT is_self", False), "non_indexable": ("status = 'Non-Indexable Target'", False), "broken": ("canonical_status_code >= 400", False)},
    "directives": {"indexable": ("NOT noindex", True), "noindex": ("noindex", False), "nofollow": ("nofollow", False), "non_indexable": ("indexability = 'Non-Indexable'", False)},
    "links_detail": {"internal": ("is_internal", False), "external": ("NOT is_internal", True), "follow": ("is_follow", True), "nofollow": ("NOT is_follow", False), "broken": ("target_status >= 400", False), "redirect": ("target_status BETWEEN 300 AND 399", False)},
    "hreflang": {"contains": ("count_ > 0", False), "missing_return": ("missing_return", False), "missing_self": ("count_ > 0 AND NOT has_self_ref", False), "invalid_code": ("invalid_codes > 0", False)},
    "url_health": {"over_115": ("length > 115", False), "uppercase": ("uppercase", False), "underscores": ("underscores", False), "duplicate": ("occurrences > 1", False), "parameters": ("params > 0", False), "non_ascii": ("non_ascii", False)},
    "javascript": {"async": ("is_async", False), "defer": ("is_defer", False), "render_blocking": ("NOT is_async AND NOT is_defer", True), "broken": ("status_code >= 400", False), "large": ("size > 102400", False), "external": ("is_external", False)},
    "amp": {"has_amp": ("has_amp", False), "no_amp": ("NOT has_amp", True), "amp_broken": ("has_amp AND amp_status_code >= 400", False), "canonical_mismatch": ("has_amp AND NOT canonical_match", False)},
    "microdata": {"has_sd": ("has_microdata OR has_json_ld", False), "json_ld": ("has_json_ld", False), "microdata": ("has_microdata", False), "errors": ("NOT valid", False), "warnings": ("warnings > 0", False)},
    "sitemaps": {"sitemap_only": ("in_sitemap AND NOT in_crawl", False), "crawl_only": ("in_crawl AND NOT in_sitemap", False), "both": ("in_crawl AND in_sitemap", False), "sitemap_error": ("NOT lastmod_valid", False)},
    "pagespeed_result": {"good": ("score >= 90", False), "needs_improvement": ("score BETWEEN 50 AND 89", False), "poor": ("score < 50", False), "lcp_poor": ("lcp_ms > 4000", False), "cls_poor": ("cls > 0.25", False)},
    "mobile": {"missing_viewport": ("NOT has_viewport", True), "not_responsive": ("NOT is_responsive", True), "fixed_width": ("fixed_width", False), "mobile_friendly": ("mobile_friendly", False)},
    "custom_search": {"has_matches": ("total_matches > 0", False), "no_matches": ("total_matches = 0", True)},
    "custom_extraction": {"has_extraction": ("total_extractions > 0", False), "no_extraction": ("total_extractions = 0", True)},
    "accessibility": {"missing_alt": ("images_without_alt > 0", False), "form_issues": ("form_labels_status NOT IN ('OK', 'N/A')", False), "heading_issues": ("heading_status <> 'OK'", False), "has_issues": ("total_issues > 0", False)},
}


#: Analyzers whose displays have columns of their own.
SHOWN = {"pagespeed_result": "pagespeed_shown", "sitemaps": "sitemaps_shown", "hreflang_rows": "hreflang_shown"}
#: Display title -> column, in order, by analyzer.
COLUMNS = {
    "response_codes": {"Address": "url", "Status Code": "status_code", "Status": "status", "Redirect URL": "redirect_url", "Redirect Type": "redirect_type", "Chain Length": "chain_length", "Response Time": "response_time"},
    "page_titles": {"Address": "url", "Title": "title", "Length": "length", "Pixel Width": "pixel_width", "Status": "status", "Occurrences": "occurrences"},
    "meta_description": {"Address": "url", "Meta Description": "meta_description", "Length": "length", "Pixel Width": "pixel_width", "Status": "status", "Occurrences": "occurrences"},
    "h1": {"Address": "url", "H1": "h1", "Length": "length", "H1 Count": "count_", "Status": "status", "Occurrences": "occurrences"},
    "h2": {"Address": "url", "H2": "h2", "H2 Count": "count_", "Status": "status"},
    "content": {"Address": "url", "Word Count": "word_count", "Content Hash": "content_hash", "Status": "status", "Duplicates": "occurrences"},
    "images": {"Image URL": "url", "Status": "status_code", "Alt Text": "alt", "Size": "size_text", "Found On": "found_on", "Dimensions": "dimensions"},
    "canonicals": {"Address": "url", "Canonical": "canonical", "Status": "status", "Canonical Status": "canonical_status_code", "Self-Ref": "is_self"},
    "directives": {"Address": "url", "Meta Robots": "meta_robots", "X-Robots-Tag": "x_robots", "Indexability": "indexability", "Reason": "reason"},
    "links_detail": {"From": "from_url", "To": "to_url", "Anchor Text": "anchor_text", "Rel": "rel", "Status": "status", "Type": "type"},
    "hreflang_rows": {"Address": "url", "Hreflang": "hreflang", "Href": "href", "Status": "status", "Return Link": "return_link"},
    "url_health": {"Address": "url", "Length": "length", "Path Depth": "path_depth", "Parameters": "params", "Status": "status", "Issues": "issues_text"},
    "javascript": {"Script URL": "url", "Status": "status_code", "Size": "size", "Async": "async_", "Defer": "defer_", "Type": "type", "Found On": "found_on"},
    "amp": {"Address": "url", "AMP URL": "amp_url", "Has AMP": "has_amp", "AMP Status": "amp_status", "Canonical Match": "canonical_match"},
    "microdata": {"Address": "url", "Schema Type": "type", "Format": "format", "Valid": "valid", "Errors": "errors", "Warnings": "warnings"},
    "sitemaps": {"URL": "url", "Type": "type", "Status": "status", "In Sitemap": "in_sitemap", "In Crawl": "in_crawl", "Last Modified": "lastmod"},
    "pagespeed_result": {"Address": "url", "Score": "score", "LCP": "lcp", "INP": "inp", "CLS": "cls_text", "FCP": "fcp", "TTFB": "ttfb", "Status": "status"},
    "mobile": {"Address": "url", "Viewport": "has_viewport", "Viewport Content": "viewport_content", "Responsive": "is_responsive", "Touch Friendly": "touch_friendly", "Status": "status"},
    "accessibility": {"Address": "url", "Images w/o Alt": "images_without_alt", "Form Labels": "form_labels_status", "Heading Structure": "heading_status", "ARIA Issues": "aria_issues", "Score": "score"},
    "custom_search": {"Address": "url", "Search Rule": "rule_name", "Matches": "match_count", "First Match": "first_match", "Context": "context"},
    "custom_extraction": {"Address": "url", "Extraction Rule": "rule_name", "Count": "extracted_count", "First Value": "first_value", "All Values": "all_values"},
}


def filter_plan(analyzer: str, predicate: str, default: bool) -> str:
    return f"SELECT * FROM {{{analyzer}}} WHERE coalesce({predicate}, {str(default).lower()})"


def filtered(analyzer: str, name: str) -> str:
    """The analyzer's rows that the named filter keeps; an unknown name keeps all."""
    if name not in FILTERS.get(analyzer, {}):
        return f"SELECT * FROM {{{analyzer}}}"
    return filter_plan(analyzer, *FILTERS[analyzer][name])


FILTER_PLANS = {f"{a}__{f}": filtered(a, f) for a, filters in FILTERS.items() for f in filters}

#: Issue code -> type, severity, category.
CODES = {
    **dict.fromkeys(("client_error",), ("error", "high", "response")), **dict.fromkeys(("server_error", "redirect_loop"), ("error", "critical", "response")), "slow_response": ("warning", "medium", "performance"), "redirect_chain": ("warning", "medium", "response"),
    "missing_title": ("error", "high", "title"), "title_too_long": ("warning", "medium", "title"), "title_too_short": ("warning", "low", "title"),
    "missing_meta_description": ("warning", "medium", "meta"), "meta_description_too_long": ("warning", "low", "meta"), "meta_description_too_short": ("warning", "low", "meta"),
    "missing_h1": ("warning", "medium", "headings"), "multiple_h1": ("warning", "low", "headings"), "thin_content": ("warning", "medium", "content"), "missing_canonical": ("warning", "low", "canonicals"),
    "noindex": ("notice", "low", "directives"), "canonical_noindex_conflict": ("warning", "medium", "directives"), "url_too_long": ("warning", "low", "url"),
    "missing_alt": ("warning", "medium", "images"), "broken_image": ("error", "high", "images"), "large_image": ("warning", "low", "images"),
    "no_internal_links": ("warning", "medium", "links"), "redirect_link": ("warning", "low", "links"), "broken_link": ("error", "high", "links"),
    "hreflang_missing_self": ("warning", "medium", "hreflang"), "hreflang_invalid_code": ("error", "high", "hreflang"), "broken_script": ("error", "high", "javascript"), "render_blocking_script": ("warning", "low", "javascript"),
    "amp_canonical_mismatch": ("error", "high", "amp"), "structured_data_error": ("error", "medium", "structured_data"), "sitemap_invalid_lastmod": ("warning", "low", "sitemaps"),
    "mobile_missing_viewport": ("error", "high", "mobile"), "mobile_fixed_width": ("warning", "medium", "mobile"), "mobile_zoom_disabled": ("warning", "medium", "mobile"),
    "a11y_missing_alt": ("warning", "medium", "accessibility"), "a11y_missing_form_labels": ("warning", "medium", "accessibility"), "a11y_heading_skip": ("warning", "low", "accessibility"), "a11y_missing_lang": ("warning", "medium", "accessibility"),
    "pagespeed_poor_lcp": ("error", "high", "pagespeed"), "pagespeed_needs_improvement_lcp": ("warning", "medium", "pagespeed"), "pagespeed_poor_cls": ("error", "high", "pagespeed"), "pagespeed_needs_improvement_cls": ("warning", "medium", "pagespeed"), "pagespeed_poor_inp": ("error", "high", "pagespeed"),
}
#: Per-page issues, and those of groups of pages with one value.
ISSUE_PLANS = {
    "page_state": """SELECT *, lower(coalesce(meta_robots, '')) LIKE '%noindex%' OR lower(coalesce(meta_robots, '')) = 'none' OR lower(coalesce(x_robots, '')) LIKE '%noindex%' AS noindex FROM {wide}""",
    **{
        f"{code}_issues": f"SELECT a.url_id, '{code}' AS issue_code, g.n AS group_size, substr(md5(a.{col}), 1, 8) AS hash8 FROM {{{a}}} a JOIN (SELECT {col} AS v, count(*) AS n FROM {{{a}}} WHERE {col} <> '' GROUP BY {col} HAVING count(*) > 1) g ON g.v = a.{col}"
        for code, a, col in (("duplicate_title", "page_titles", "title"), ("duplicate_meta_description", "meta_description", "meta_description"), ("duplicate_h1", "h1", "h1"), ("duplicate_content", "content", "content_hash"))
    },
    "duplicate_url_issues": "SELECT u.id AS url_id, 'duplicate_url' AS issue_code, g.n AS group_size, substr(md5(u.normalized_url), 1, 8) AS hash8 FROM {urls} u JOIN (SELECT normalized_url, count(*) AS n FROM {urls} GROUP BY normalized_url HAVING count(*) > 1) g ON g.normalized_url = u.normalized_url",
}
