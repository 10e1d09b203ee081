"""URL normalisation as SQL (survey X01-X03), one text for both engines of `crawlweft.plans`.

Fragment, default port, one trailing slash and ignored parameters go; scheme and host are lower-cased; slashes are
collapsed, '.' and '..' resolved on the decoded path; the query is decoded, sorted by key and value and encoded again.

Defined cases: an address that cannot be parsed (a control character, a stray '%' before the query or in the fragment,
a colon in the first segment without a scheme) stands for itself, trimmed. Host names and ports are not validated;
escapes that are not UTF-8 are decoded as each engine does.
"""

from __future__ import annotations

#: Parameters that name a campaign or a referrer, not a page.
IGNORED = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "ref", "source")
_STRAY = "RX(GALL({}; '%[0-9A-Fa-f][0-9A-Fa-f]'; ''), '%')"


def _replaced(sql: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


def _query_escaped(sql: str) -> str:
    return _replaced(f"url_encode({sql})", ("*", "%2A"), ("%7E", "~"), ("%20", "+"))


def _path_escaped(sql: str, *more: tuple[str, str]) -> str:
    kept = [(f"%{ord(c):02X}", c) for c in "$&+,/:;=@"]
    return _replaced(f"url_encode({sql})", ("*", "%2A"), ("%7E", "~"), ("+", "%20"), *kept, *more)


def _steps(column: str) -> list[tuple[str, str]]:
    """(name, expression) one after the other; the last is the normal form."""
    name = "regexp_extract(p, '^([^=]*)', 1)"
    value = f"CASE WHEN p LIKE '%=%' THEN substr(p, CHARS({name}) + 2) ELSE '' END"
    part = lambda sql: f"UNESCAPED(replace({sql}, '+', '%20'))"
    folded = "CASE WHEN x = '.' THEN a WHEN x = '..' THEN CASE WHEN RX(a, '[^/]$') THEN regexp_replace(a, '/[^/]+$', '') ELSE a END ELSE a || '/' || x END"
    return [
        ("n_trim", f"GALL({column}; '^[ \t\n\r]+|[ \t\n\r]+$'; '')"),
        ("n_whole", "regexp_extract(n_trim, '^([^#]*)', 1)"),
        ("n_scheme", "lower(regexp_extract(n_trim, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"),
        ("n_rest", "CASE WHEN n_scheme = '' THEN n_whole ELSE substr(n_whole, CHARS(n_scheme) + 2) END"),
        ("n_tree", "regexp_extract(n_rest, '^([^?]*)', 1)"),
        ("n_query", "CASE WHEN n_rest LIKE '%?%' THEN regexp_extract(n_rest, '[?](.*)$', 1) END"),
        ("n_authority", "regexp_extract(n_tree, '^//([^/]*)', 1)"),
        ("n_has_host", "n_tree LIKE '//%' AND (n_scheme <> '' OR n_tree NOT LIKE '///%')"),
        ("n_opaque", "n_scheme <> '' AND n_tree NOT LIKE '/%'"),
        ("n_refused", f"RX(n_trim, '[\x01-\x1f\x7f]') OR {_STRAY.format('n_tree')} OR {_STRAY.format('substr(n_trim, CHARS(n_whole) + 1)')} OR (n_scheme = '' AND RX(n_tree, '^[^/]*:'))"),
        ("n_path", "CASE WHEN n_has_host THEN substr(n_tree, 3 + CHARS(n_authority)) ELSE n_tree END"),
        ("n_user", "regexp_extract(n_authority, '^(.*@)', 1)"),
        ("n_host", "lower(substr(n_authority, CHARS(n_user) + 1))"),
        ("n_plain", "CASE WHEN NOT n_refused THEN UNESCAPED(replace(n_path, '+', '%2B')) END"),
        ("n_pairs", f"MAPPED(KEPT(PARTS(coalesce(n_query, ''), '&'), p -> (p <> '' AND p NOT LIKE '%;%' AND NOT {_STRAY.format('p')})), p -> (PAIR({part(name)}, {part(value)})))"),
        ("n_site", "CASE WHEN n_scheme = 'http' THEN regexp_replace(n_host, ':80$', '') WHEN n_scheme = 'https' THEN regexp_replace(n_host, ':443$', '') ELSE n_host END"),
        ("n_short", "GALL(CASE WHEN n_plain = '' THEN '/' WHEN n_plain LIKE '_%/' THEN substr(n_plain, 1, CHARS(n_plain) - 1) ELSE n_plain END; '/+'; '/')"),
        ("n_kept", f"KEPT(n_pairs, p -> (lower(ITEM(p, 1)) NOT IN ({', '.join(repr(x) for x in IGNORED)}) AND (ITEM(p, 2) <> '' OR SIZE(KEPT(n_pairs, q -> (ITEM(q, 1) = ITEM(p, 1)))) = 1)))"),
        ("n_folded", f"FOLDED(PARTS(n_short, '/') FROM_EMPTY (a, x) -> ({folded}))"),
        ("n_sorted", f"GLUED(MAPPED(SORTED(n_kept), p -> ({_query_escaped('ITEM(p, 1)')} || CASE WHEN ITEM(p, 2) = '' THEN '' ELSE '=' || {_query_escaped('ITEM(p, 2)')} END)), '&')"),
        ("n_clean", "CASE WHEN n_folded IN ('', '/') THEN '/' ELSE substr(n_folded, 2) END"),
        ("n_written", f"CASE WHEN n_clean = n_plain AND RX(translate(n_path, '[]' || chr(39), '___'), '^[A-Za-z0-9._~!$&()*+,;=:@/%-]*$') THEN n_path ELSE {_path_escaped('n_clean')} END"),
        ("n_shown", f"CASE WHEN RX(n_site, '[^ -~]') THEN {_path_escaped('n_site', ('%5B', '['), ('%5D', ']'))} ELSE n_site END"),
        ("normalized_url", "CASE WHEN coalesce(n_refused, true) THEN n_trim ELSE CASE WHEN n_scheme <> '' THEN n_scheme || ':' ELSE '' END || CASE WHEN n_opaque THEN n_tree WHEN n_has_host THEN '//' || n_user || n_shown || n_written ELSE n_written END"
         " || CASE WHEN n_query = '' THEN '?' WHEN n_sorted <> '' THEN '?' || n_sorted ELSE '' END END"),
    ]


def normalized_by_steps(source: str, column: str = "url", name: str = "normalized_url") -> str:
    """The rows of `source` (a SELECT) with the normal form of `column`, by nested selections, a step each."""
    *steps, (_, last) = _steps(column)
    for k, (step, expression) in enumerate([*steps, (name, last)]):
        source = f"SELECT *, {expression} AS {step} FROM ({source}) n{k}"
    return source


def normalized(source: str, column: str = "url") -> str:
    """The same for Spark. The generator keeps a filter on the normal form (each join on it makes one) above the steps: pushed
    below, it would have every step's text put in place of its name, and grow with each."""
    return f"SELECT * FROM ({normalized_by_steps(source, column, 'n_last')}) s LATERAL VIEW stack(1, n_last) v AS normalized_url"
