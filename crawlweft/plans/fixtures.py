"""Crawl tables derived from the test tables by arithmetic that every SQL engine evaluates alike."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.url import normalized, normalized_by_steps


def _urls(form: Callable[[str], str]) -> str:
    return f"""SELECT page_id AS id, url, normalized_url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
        CASE WHEN page_id = 0 THEN NULL ELSE cast(floor(page_id / 7) AS bigint) END AS discovered_from,
        CASE WHEN page_id = 0 THEN 0 WHEN page_id < 6 THEN 1 WHEN page_id < 40 THEN 2 ELSE 3 END AS depth,
        CASE WHEN page_id % 25 = 24 THEN 'failed' WHEN page_id % 25 = 23 THEN 'pending' ELSE 'crawled' END AS crawl_status,
        page_id % 10 <> 9 AS is_internal, page_id % 3 = 0 AS in_sitemap FROM ({form("SELECT page_id, url FROM {site_pages}")}) p"""


FIXTURES = {
    "n_pages": "SELECT count(*) AS n FROM {pages}",
    # addresses that the given ones lack: upper case, underscores, spaces, doubled slashes, long ones, other scripts, repeated parameters, the neighbour's page under another fragment
    "site_pages": """SELECT p.page_id, p.html, p.before_id, p.after_id, p.back_id, CASE p.page_id % 40 WHEN 11 THEN p.bare || '/Some_Path/With%20Space' WHEN 12 THEN p.bare || '//x/é' WHEN 13 THEN p.bare || '/' || repeat('long-segment-', 10) WHEN 14 THEN p.bare || '/list?b=2&a=1&b=3&next=//y' WHEN 16 THEN q.bare || '#again' WHEN 15 THEN p.bare ELSE p.url END AS url
        FROM {numbered_pages} p JOIN {numbered_pages} q ON q.page_id = p.before_id""",
    # the neighbours' ids are columns, so that every look-up of a neighbour is a join on equal ids
    "numbered_pages": "SELECT page_id, url, html, regexp_replace(url, '[?#].*', '') AS bare, (page_id + n - 1) % n AS before_id, (page_id + 1) % n AS after_id, (page_id * 3 + 1) % n AS other_id, (page_id + n - 9) % n AS back_id, n FROM (SELECT *, (SELECT n FROM {n_pages}) AS n FROM {pages}) p",
    "urls": _urls(normalized),
    "fetches": """SELECT event_id AS id, user_id AS url_id, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'signup' THEN 301 WHEN 'purchase' THEN 404 WHEN 'error' THEN 500 END AS status_code,
        CASE event_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/pdf' ELSE '' END AS content_type,
        cast(floor(value * 10) AS bigint) AS response_time_ms, ts AS fetched_at, CASE WHEN event_id % 13 = 0 THEN 'noindex' ELSE '' END AS x_robots
        FROM {events} WHERE user_id IN (SELECT page_id FROM {pages})""",
    "html_features": """SELECT p.page_id AS url_id, CASE WHEN p.page_id % 31 = 3 THEN '' ELSE regexp_extract(p.html, '<title>([^<]*)</title>', 1) || CASE WHEN p.page_id % 23 = 7 THEN ' and a long tail of words that goes on beyond the width of a result' ELSE '' END END AS title,
        CASE WHEN p.page_id % 9 = 0 THEN '' WHEN p.page_id % 11 = 0 THEN 'A shared description of several pages' ELSE substr(d.text, 1, cast(1 + (p.page_id * 37) % 220 AS int)) END AS meta_description, CASE WHEN p.page_id % 6 = 0 THEN '' ELSE 'alpha, beta ' || cast(p.page_id AS TEXT) END AS meta_keywords,
        CASE p.page_id % 8 WHEN 0 THEN 'noindex,nofollow' WHEN 1 THEN 'index,follow' WHEN 2 THEN 'NONE' ELSE '' END AS meta_robots,
        CASE WHEN p.page_id % 30 IN (6, 7, 21) THEN q.url WHEN p.page_id % 30 = 22 THEN r.url WHEN p.page_id % 5 = 0 THEN '' WHEN p.page_id % 5 = 3 THEN q.url WHEN p.page_id % 5 = 4 THEN 'https://elsewhere.example/' || cast(p.page_id AS TEXT) ELSE p.url END AS canonical,
        cast(p.page_id % 4 AS int) AS h1_count, CASE WHEN p.page_id % 4 = 0 THEN '' ELSE regexp_extract(p.html, '<h1>([^<]*)</h1>', 1) || CASE WHEN p.page_id % 23 = 9 THEN ' followed by more words than a heading of a page should ever have in it' ELSE '' END END AS h1_first,
        cast(p.page_id % 3 AS int) AS h2_count, CASE WHEN p.page_id % 3 = 0 THEN '' ELSE 'Section ' || cast(p.page_id % 7 AS TEXT) END AS h2_first,
        CASE WHEN p.page_id % 20 = 7 THEN md5('the same text') ELSE md5(d.text) END AS content_hash, cast(CHARS(d.text) % 500 AS int) AS word_count, p.page_id % 8 NOT IN (0, 2) AS is_indexable
        FROM {site_pages} p JOIN {documents} d ON d.doc_id = p.page_id JOIN {site_pages} q ON q.page_id = p.after_id JOIN {site_pages} r ON r.page_id = p.before_id WHERE p.page_id % 20 <> 19""",
    "candidates": """SELECT page_id, k, CASE WHEN k = 4 THEN NULL WHEN k = 3 AND page_id % 34 = 5 THEN page_id WHEN k = 5 THEN (page_id * 7 + 1) % n ELSE (page_id * 7 + k * 13 + 1) % n END AS target
        FROM (SELECT page_id, n, EACH(SEQ(0, 5)) AS k FROM {numbered_pages}) p""",
    "links": """SELECT x.page_id * 6 + x.k AS id, x.page_id AS from_url_id, x.target AS to_url_id, coalesce(t.url, 'https://elsewhere.example/' || cast(x.page_id AS TEXT)) AS to_url, 'link ' || cast(x.k AS TEXT) AS anchor_text,
        x.target IS NOT NULL AS is_internal, (x.page_id + x.k) % 6 <> 0 AS is_follow, CASE WHEN (x.page_id + x.k) % 6 = 0 THEN 'nofollow' ELSE '' END AS rel
        FROM {candidates} x LEFT JOIN {site_pages} t ON t.page_id = x.target WHERE x.target IS NULL OR x.target % 17 <> 5 OR x.target = x.page_id""",
    "resources": """SELECT p.page_id * 3 + k AS id, CASE WHEN k = 0 THEN 'https://img.example/' WHEN k = 1 THEN 'https://' || regexp_extract(p.url, '^https?://([^/?#]+)', 1) || '/js/' ELSE 'https://cdn.example/js/' END || cast(p.page_id % 90 AS TEXT) AS url,
        CASE WHEN k = 0 THEN 'image' ELSE 'script' END AS resource_type, cast(CASE WHEN (p.page_id + k) % 11 = 3 THEN 404 ELSE 200 END AS int) AS status_code, (p.page_id * 7919 + k * 104729) % 260000 AS size,
        CASE WHEN k = 0 AND p.page_id % 4 <> 1 THEN 'picture ' || cast(p.page_id AS TEXT) ELSE '' END AS alt, cast(CASE WHEN p.page_id % 5 = 0 THEN 0 ELSE 640 END AS int) AS width, cast(480 AS int) AS height,
        p.page_id % 3 = 0 AS is_async, p.page_id % 4 = 0 AS is_defer, CASE WHEN p.page_id % 2 = 0 THEN '' ELSE 'module' END AS mime_type
        FROM (SELECT page_id, url, EACH(SEQ(0, 2)) AS k FROM {pages}) p""",
    "page_resources": "SELECT id AS resource_id, cast(floor(id / 3) AS bigint) AS url_id FROM {resources} UNION ALL SELECT id AS resource_id, cast(floor(id / 3) AS bigint) + 1 AS url_id FROM {resources} WHERE id % 12 = 0",
    "redirect_chains": """SELECT id, url AS start_url, CASE WHEN id % 14 = 0 THEN url ELSE 'https://elsewhere.example/end' END AS final_url, cast(1 + id % 4 AS int) AS length, id % 14 = 0 AS has_loop FROM {urls} WHERE id % 7 = 0""",
    # where pages say they have moved to: up to nine steps on, half of them in rings, one to itself, some by relative addresses
    "locations": """SELECT page_id AS url_id, url, cast(CASE WHEN location = '' THEN 200 WHEN page_id % 2 = 0 THEN 301 ELSE 302 END AS int) AS status_code, location FROM (
        SELECT p.page_id, p.url, CASE WHEN p.page_id % 48 = 34 THEN p.url WHEN p.page_id % 12 = 9 THEN CASE WHEN p.page_id % 24 < 12 THEN r.url ELSE '' END WHEN p.page_id % 12 = 10 THEN '/moved/here?x=1' WHEN p.page_id % 12 = 11 THEN '?again=1' ELSE q.url END AS location
        FROM {site_pages} p JOIN {site_pages} q ON q.page_id = p.after_id JOIN {site_pages} r ON r.page_id = p.back_id) m""",
    "sitemap_urls": """SELECT id AS url_id, url, CASE id % 5 WHEN 0 THEN '2024-01-15' WHEN 1 THEN '2024-01-15T10:00:00Z' WHEN 2 THEN 'yesterday' WHEN 3 THEN '2024-13-45' ELSE '' END AS lastmod, 'weekly' AS changefreq, cast(id % 10 AS double) / 10 AS priority FROM {urls} WHERE in_sitemap
        UNION ALL SELECT NULL, 'https://elsewhere.example/s' || cast(id AS TEXT), '', 'daily', 0.5 FROM {urls} WHERE id % 50 = 1""",
    "hreflangs": """SELECT u.id AS url_id, u.url, CASE u.k WHEN 0 THEN 'en' WHEN 1 THEN 'de-AT' WHEN 2 THEN 'x-default' WHEN 3 THEN 'e' ELSE 'en-GBR' END AS hreflang, CASE u.k WHEN 0 THEN u.url WHEN 1 THEN t.url ELSE 'https://elsewhere.example/x' END AS href
        FROM (SELECT id, url, EACH(SEQ(0, 4)) AS k, (CASE WHEN id % 2 = 0 THEN id + 1 ELSE id - 1 END + CASE WHEN id % 10 = 4 THEN 2 ELSE 0 END) % (SELECT n FROM {n_pages}) AS partner FROM {urls}) u JOIN {urls} t ON t.id = u.partner WHERE (u.id + u.k) % 6 < 3""",
    # markup that the given pages lack: viewports, images, forms, headings, roles, AMP, microdata, JSON-LD, robots, style, classes
    "page_html": """SELECT u.id AS url_id, u.url, CASE u.id % 9 WHEN 1 THEN replace(p.html, '<html ', '<html amp ') WHEN 2 THEN replace(p.html, ' lang=', ' data-lang=') WHEN 4 THEN replace(replace(replace(replace(p.html, '<h1>', '<p>'), '</h1>', '</p>'), '<h2>', '<p>'), '</h2>', '</p>') ELSE p.html END
        || CASE u.id % 4 WHEN 0 THEN '<meta name="viewport" content="width=device-width, initial-scale=1">' WHEN 1 THEN '<meta name="viewport" content="width=320, user-scalable=no">' WHEN 2 THEN '<meta content="width=device-width, maximum-scale=1" name="viewport"><div class="container-fluid">' ELSE '' END
        || CASE u.id % 5 WHEN 0 THEN '<style>@media print {p {width: 50%}}</style>' WHEN 1 THEN '<div style="max-width: 9em" class="flex wide">x</div>' ELSE '' END
        || CASE WHEN u.id % 3 = 0 THEN '<img src="a.png"><img src="b.png" alt="b"><img alt="" src="c.png"><input type="text"><input class="x" type="email"><textarea></textarea><label for="x">x</label>' WHEN u.id % 3 = 1 THEN '<a href="#main">skip to main</a><select aria-label="y"></select>' ELSE '' END
        || CASE WHEN u.id % 5 = 0 THEN '<h4 class="deep">deep</h4><h2 id="two">two</h2><div role="banner"></div><div role="nonsense"></div><p role="Main">m</p>' ELSE '' END
        || CASE WHEN u.id % 6 = 0 THEN '<link rel="amphtml" href="https://amp.example/' || cast(u.id AS TEXT) || '">' WHEN u.id % 6 = 4 THEN '<link href="' || t.url || '" rel="amphtml">' ELSE '' END
        || CASE WHEN u.id % 7 = 0 THEN '<div itemscope itemtype="https://schema.org/Product"></div><div itemtype="https://schema.org/Offer"></div><div itemtype="https://schema.org/Product"></div><div itemtype="urn:x:Own"></div>' ELSE '' END
        || CASE u.id % 8 WHEN 0 THEN '<script type="application/ld+json">{"@type": "Article", "headline": "h ' || cast(u.id AS TEXT) || '"}</script>' WHEN 1 THEN '<script type="application/ld+json">{"@type": "BreadcrumbList", "name": [1, 2]}</script><script type="application/ld+json">{"@type": ["Product", "Thing"]}</script>' WHEN 2 THEN '<script type="application/ld+json">{broken</script>' WHEN 3 THEN '<script type="application/ld+json">{"@graph": [{"@type": "WebSite"}, {"@type": "Organization"}]}</script><script type="application/ld+json">{"@type": "WebSite", "name": "n"}</script>' WHEN 4 THEN '<script type="application/ld+json">[{"@type": "FAQPage"}, "x"]</script><script type="application/ld+json">{"@type": "Product", "name": "p", "price": 9.5, "tags": ["a", "b"], "offers": {"seller": "s"}}</script>' ELSE '' END AS html
        FROM {urls} u JOIN {numbered_pages} p ON p.page_id = u.id JOIN {site_pages} t ON t.page_id = p.other_id""",
    "pagespeed": """SELECT id AS url_id, url, cast((id * 37) % 101 AS int) AS score, cast((id * 911) % 6000 AS double) AS lcp_ms, cast((id * 17) % 40 AS double) / 100 AS cls, cast((id * 131) % 700 AS double) AS inp_ms, cast((id * 77) % 3000 AS double) AS fcp_ms, cast((id * 13) % 900 AS double) AS ttfb_ms FROM {urls}""",
    # an index of indexes that lead back to it, and sitemaps of a page each, some of them missing
    "sitemap_tree": """SELECT 'https://root.example/index.xml' AS url, cast(200 AS int) AS status_code, '<sitemapindex>' || JOINED('<sitemap><loc>https://root.example/g' || cast(k AS TEXT) || '.xml</loc></sitemap>'; ''; k) || '</sitemapindex>' AS body FROM (SELECT DISTINCT id % 5 AS k FROM {urls}) g
        UNION ALL SELECT 'https://root.example/g' || cast(id % 5 AS TEXT) || '.xml', 200, '<sitemapindex><sitemap><loc>https://root.example/index.xml</loc></sitemap>' || JOINED('<sitemap><loc>https://root.example/s' || cast(id AS TEXT) || '.xml</loc></sitemap>'; ''; id) || '</sitemapindex>' FROM {urls} GROUP BY id % 5
        UNION ALL SELECT 'https://root.example/s' || cast(id AS TEXT) || '.xml', CASE WHEN id % 7 = 3 THEN 404 ELSE 200 END, '<urlset><url><loc>' || replace(url, '&', '&amp;') || '</loc></url></urlset>' FROM {urls}""",
    # recorded answers of the speed API: whole ones, some that lack audits, broken ones, numbers that are none, other statuses
    "psi_answers": """SELECT id AS url_id, url, cast(CASE WHEN id % 11 = 7 THEN 429 ELSE 200 END AS int) AS status_code, CASE id % 9 WHEN 4 THEN '{"lighthouseResult": {"categories"' WHEN 5 THEN '{}' WHEN 6 THEN '{"lighthouseResult": {"categories": {"performance": {"score": "high"}}, "audits": {}}}' WHEN 7 THEN '[1]'
        ELSE '{"id": "x", "lighthouseResult": {"categories": {"performance": {"score": 0.' || lpad(cast((id * 37) % 100 AS TEXT), 2, '0') || '}}, "audits": {"largest-contentful-paint": {"numericValue": ' || cast((id * 911) % 6000 AS TEXT) || '.5, "displayValue": "x"}, "cumulative-layout-shift": {"numericValue": 0.' || lpad(cast((id * 17) % 40 AS TEXT), 2, '0') || '}, "first-contentful-paint": {"numericValue": ' || cast((id * 77) % 3000 AS TEXT) || '}, "server-response-time": {"numericValue": ' || cast((id * 13) % 900 AS TEXT) || '}'
        || CASE WHEN id % 2 = 0 THEN ', "interaction-to-next-paint": {"numericValue": ' || cast((id * 131) % 700 AS TEXT) || '}' ELSE '' END || '}}}' END AS body FROM {urls}""",
    "robots_files": """SELECT host, CASE n % 4 WHEN 0 THEN replace('User-agent: *|Disallow: /a|Allow: /a/b|Crawl-delay: 2|Sitemap: https://' || host || '/sitemap.xml', '|', chr(10)) WHEN 1 THEN replace('# all|User-Agent: *|Disallow: /|User-agent: goodbot|User-agent: other|Allow: /*.html$|Disallow: /*e', '|', chr(10))
        WHEN 2 THEN replace('User-agent: good|Disallow: /*?|Disallow:|User-agent: *|Allow: /|crawl-delay: 0.5', '|', chr(10)) ELSE '' END AS body FROM (SELECT host, cast(CHARS(host) AS int) AS n FROM {urls} GROUP BY host) h""",
    "robots_values": """SELECT url_id, coalesce(meta_robots, '') || CASE url_id % 6 WHEN 0 THEN ', max-snippet:20, max-image-preview:large' WHEN 1 THEN ',noarchive,  nosnippet ,max-video-preview:-1' WHEN 2 THEN ', NoImageIndex , notranslate, max-snippet:x' WHEN 3 THEN ',all' ELSE '' END AS content,
        CASE url_id % 5 WHEN 0 THEN PAIR('noindex', 'nofollow, noarchive', 'max-snippet:7') WHEN 1 THEN PAIR('goodbot: noindex', 'nofollow') WHEN 2 THEN PAIR('noarchive, max-snippet:3', 'other: none', 'noindex') WHEN 3 THEN PAIR('other: noindex', 'good: none') ELSE PAIR('other: noindex') END AS tags FROM {html_features}""",
    "sitemap_files": """SELECT 'https://' || host || '/sitemap.xml' AS url, cast(200 AS int) AS status_code, '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || JOINED(entry; ''; entry) || '</urlset>' AS body FROM (
        SELECT u.host, '<url><loc> ' || replace(s.url, '&', '&amp;') || '</loc><lastmod>' || s.lastmod || '</lastmod>' || CASE WHEN s.url_id % 2 = 0 THEN '<priority>' || cast(s.priority AS TEXT) || '</priority>' ELSE '' END || '</url>' AS entry FROM {sitemap_urls} s JOIN {urls} u ON u.id = s.url_id) e GROUP BY host
        UNION ALL SELECT 'https://index.example/s' || cast(id AS TEXT), CASE WHEN id % 3 = 0 THEN 404 ELSE 200 END, CASE id % 3 WHEN 1 THEN '<sitemapindex><sitemap><loc>https://a.example/1.xml</loc></sitemap></sitemapindex>' ELSE '<html></html>' END FROM {urls} WHERE id < 6""",
}

#: Fixtures whose text DuckDB reads in another form.
BY_STEPS = {"urls": _urls(normalized_by_steps), "listed": normalized_by_steps("SELECT id, to_url FROM {links}", "to_url")}
