"""Analyzers as objects over shared inputs, and one pass that finds the issues of all of them.

An analyzer names the input it reads and gives expressions over that input's rows: columns, filters and issue rules. The rules of
all analyzers, built in or a user's, are put together by input: rules on a page's own rows are one list of cases in one projection;
rules on rows that a page has many of (links, resources, entries in other tables) become counts, which are summed before
they are shuffled and joined to the page. So the stored tables are read once each (those that a link or an AMP address
looks pages up in, twice), however many analyzers there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from .analyzers import CODES, VALID_CODE, filter_plan


@dataclass(frozen=True)
class Rule:
    """An issue where `when` holds, as often as `times` says."""

    when: str
    issue_type: str = "warning"
    severity: str = "medium"
    category: str = "custom"
    times: str = "1"


@dataclass(frozen=True)
class Analyzer:
    """columns, filters (predicate, what null counts as) and issues are SQL over the rows of the input named by `reads`; filters and titles may use the columns."""

    name: str
    reads: str
    columns: Mapping[str, str]
    filters: Mapping[str, tuple[str, bool]] = field(default_factory=dict)
    issues: Mapping[str, Rule] = field(default_factory=dict)
    titles: Mapping[str, str] = field(default_factory=dict)


#: Rows of which a page has many: input -> (column of the page, rows, counts that rules on pages may use).
COUNTED = {
    # links without a known target are spread by their own ids
    "links": ("from_url_id", "SELECT l.*, f.status_code AS target_status FROM {links} l LEFT JOIN {latest_fetch} f ON f.url_id = coalesce(l.to_url_id, l.id) AND l.to_url_id IS NOT NULL", {"links_total": "count(*)", "links_internal": "count_if(is_internal)"}),
    "resources": ("url_id", "SELECT r.*, p.url_id FROM {resources} r JOIN {page_resources} p ON p.resource_id = r.id", {}),
    "hreflangs": ("url_id", f"SELECT *, href = url AS is_self, {VALID_CODE} AS valid FROM {{hreflangs}}", {"hreflangs_total": "count(*)", "hreflangs_self": "count_if(is_self)", "hreflangs_invalid": "count_if(NOT valid)"}),
}
#: The same for rows whose page may be missing: their issues then belong to no page. The third is the page's column they refer to.
LOOSE = {
    "sitemap": ("url_id", "SELECT *, {lastmod_valid} AS lastmod_valid FROM {sitemap_urls}", "url_id"),
    "chains": ("start_url", "SELECT * FROM {redirect_chains}", "url"),
}
#: A row for each page, or for each of its texts, items or measurements.
ROWS = {"pages": "page_facts", "texts": "page_texts", "items": "structured_items", "speed": "pagespeed"}

#: Input -> {issue code: when}. A pair is (when, how often).
RULES = {
    "pages": {
        "client_error": "status_code BETWEEN 400 AND 499", "server_error": "status_code >= 500", "slow_response": "response_time_ms > 500", "missing_title": "title = ''", "title_too_long": "BLEN(title) > 60", "title_too_short": "BLEN(title) BETWEEN 1 AND 29",
        "missing_meta_description": "meta_description = ''", "meta_description_too_long": "BLEN(meta_description) > 155", "meta_description_too_short": "BLEN(meta_description) BETWEEN 1 AND 69", "missing_h1": "h1_count = 0", "multiple_h1": "h1_count > 1",
        "thin_content": "word_count > 0 AND word_count < 200", "missing_canonical": "canonical = ''", "noindex": "noindex", "canonical_noindex_conflict": "noindex AND canonical <> '' AND canonical <> url", "url_too_long": "BLEN(url) > 115",
        "no_internal_links": "links_total > 0 AND links_internal = 0 AND is_internal", "hreflang_missing_self": "hreflangs_total > 0 AND hreflangs_self = 0", "hreflang_invalid_code": "hreflangs_invalid > 0",
    },
    "links": {"redirect_link": "target_status BETWEEN 300 AND 399", "broken_link": "target_status >= 400"},
    "resources": {
        "missing_alt": "resource_type = 'image' AND alt = ''", "broken_image": "resource_type = 'image' AND status_code >= 400", "large_image": "resource_type = 'image' AND size > 102400",
        "broken_script": "resource_type = 'script' AND status_code >= 400", "render_blocking_script": "resource_type = 'script' AND NOT is_async AND NOT is_defer",
    },
    "sitemap": {"sitemap_invalid_lastmod": "NOT lastmod_valid"},
    "chains": {"redirect_loop": "has_loop", "redirect_chain": "length > 2"},
    "texts": {
        "mobile_missing_viewport": "NOT has_viewport", "mobile_fixed_width": "fixed_width", "mobile_zoom_disabled": "zoom_disabled", "a11y_missing_alt": "images_without_alt > 0", "a11y_missing_form_labels": "unlabelled > 0", "a11y_missing_lang": "NOT has_lang", "a11y_heading_skip": ("heading_skips > 0", "heading_skips"),
    },
    "items": {"structured_data_error": "n_errors > 0"},
    "speed": {"pagespeed_poor_lcp": "lcp_ms >= 4000", "pagespeed_needs_improvement_lcp": "lcp_ms >= 2500 AND lcp_ms < 4000", "pagespeed_poor_cls": "cls >= 0.25", "pagespeed_needs_improvement_cls": "cls >= 0.1 AND cls < 0.25", "pagespeed_poor_inp": "inp_ms >= 500"},
}


def _built_in() -> list[tuple[str, str, Rule]]:
    pairs = ((reads, code, x if isinstance(x, tuple) else (x, "1")) for reads, rules in RULES.items() for code, x in rules.items())
    return [(reads, code, Rule(when, *CODES[code], times)) for reads, code, (when, times) in pairs]


def _cases(rules: Mapping[str, tuple[str, str]]) -> str:
    """The issues of a row as a list of (url_id, code, n)."""
    return ", ".join(f"named_struct('url_id', cast(url_id AS bigint), 'code', '{code}', 'n', cast(CASE WHEN {when} THEN {times} ELSE 0 END AS int))" for code, (when, times) in rules.items())


def shared_issues(lastmod_valid: str, analyzers: Iterable[Analyzer] = ()) -> dict[str, str]:
    """The plans page_facts and issues for the built-in rules and those of the given analyzers."""
    rules = [*_built_in(), *((a.reads, code, rule) for a in analyzers for code, rule in _in_full(a).items())]
    by = lambda reads: {code: (r.when, r.times) for x, code, r in rules if x == reads}
    joins, counts = "", {}
    for kind, (key, rows, more) in COUNTED.items():
        sums = more | {f"n_{code}": f"sum(CASE WHEN {when} THEN {times} ELSE 0 END)" for code, (when, times) in by(kind).items()}
        if sums:
            joins += f" LEFT JOIN (SELECT {key} AS of_{kind}, {', '.join(f'{sql} AS {name}' for name, sql in sums.items())} FROM ({rows}) r GROUP BY {key}) {kind}_ ON {kind}_.of_{kind} = w.url_id"
        counts |= {code: (f"n_{code} > 0", f"n_{code}") for code in by(kind)}
    for kind, (key, rows, to) in LOOSE.items():
        sums = {f"n_{code}": f"sum(CASE WHEN {when} THEN {times} ELSE 0 END)" for code, (when, times) in by(kind).items()}
        joins += f" FULL OUTER JOIN (SELECT {key} AS of_{kind}, {', '.join(f'{sql} AS {name}' for name, sql in sums.items())} FROM ({rows.replace('{lastmod_valid}', lastmod_valid)}) r GROUP BY {key}) {kind}_ ON {kind}_.of_{kind} = w.{to}"
        counts |= {code: (f"n_{code} > 0", f"n_{code}") for code in by(kind)}
    lists = [f"SELECT array({_cases(by('pages') | counts)}) AS found FROM {{page_facts}}"]
    # a page that an AMP address leads to should name the page that leads there
    mismatched = "transform(filter(coalesce(t.pages, array()), p -> p.canonical <> x.url), p -> named_struct('url_id', cast(p.id AS bigint), 'code', 'amp_canonical_mismatch', 'n', 1))"
    targets = "SELECT u.url, collect_list(named_struct('id', u.id, 'canonical', h.canonical)) AS pages FROM {urls} u JOIN {html_features} h ON h.url_id = u.id GROUP BY u.url"
    # what is joined are flags, not texts
    lists.append(f"SELECT concat(x.found, {mismatched}) AS found FROM (SELECT url, CASE WHEN has_amp THEN amp_url END AS to_amp, array({_cases(by('texts'))}) AS found FROM {{page_texts}}) x LEFT JOIN ({targets}) t ON t.url = x.to_amp")
    lists += [f"SELECT array({_cases(by(reads))}) AS found FROM {{{ROWS[reads]}}}" for reads in ("items", "speed")]
    said = {code: (r.issue_type, r.severity, r.category) for _, code, r in rules} | {"amp_canonical_mismatch": CODES["amp_canonical_mismatch"]}
    text = lambda k: f"CASE issue_code {' '.join(f"WHEN '{code}' THEN '{v[k]}'" for code, v in said.items())} END"
    one = " UNION ALL ".join(f"SELECT explode(filter(found, x -> x.n > 0)) AS c FROM ({sql}) f" for sql in lists)
    flat = f"SELECT c.url_id, c.code AS issue_code, explode(sequence(1, c.n)) AS k FROM ({one}) e"
    return {
        "page_facts": f"SELECT * FROM {{page_state}} w{joins}",
        "issues": f"SELECT url_id, issue_code, {text(0)} AS issue_type, {text(1)} AS severity, {text(2)} AS category FROM ({flat}) i",
    }


def _in_full(a: Analyzer) -> dict[str, Rule]:
    """The analyzer's rules with its columns' expressions in place of their names."""
    put = lambda sql: re.sub(r"'[^']*'|\b[A-Za-z_]\w*\b(?!\s*\()", lambda m: f"({a.columns[m[0]]})" if m[0] in a.columns else m[0], sql)
    return {code: Rule(put(r.when), r.issue_type, r.severity, r.category, put(r.times)) for code, r in a.issues.items()}


def plans_of(analyzers: Iterable[Analyzer], lastmod_valid: str, known: Iterable[str]) -> dict[str, str]:
    """Plans that the given analyzers add or change: their rows, their filters, and the shared issues."""
    analyzers, taken, codes = list(analyzers), set(known), set(CODES)
    plans: dict[str, str] = {}
    for a in analyzers:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", a.name) or a.name in taken:
            raise ValueError(f"analyzer {a.name!r}: the name is not a plain one or is taken")
        if a.reads not in (*COUNTED, *LOOSE, *ROWS):
            raise ValueError(f"analyzer {a.name!r} reads {a.reads!r}, which is none of {', '.join((*COUNTED, *LOOSE, *ROWS))}")
        if bad := [c for c in a.issues if c in codes or not re.fullmatch(r"[a-z][a-z0-9_]*", c)]:
            raise ValueError(f"analyzer {a.name!r}: issue codes {bad} are not plain ones or are taken")
        if bad := [c for c in a.titles.values() if c not in a.columns]:
            raise ValueError(f"analyzer {a.name!r}: titles name {bad}, which are no columns of it")
        rows = f"SELECT * FROM {{{ROWS[a.reads]}}}" if a.reads in ROWS else (COUNTED | LOOSE)[a.reads][1].replace("{lastmod_valid}", lastmod_valid)
        plans[a.name] = f"SELECT {', '.join(f'{sql} AS {name}' for name, sql in a.columns.items())} FROM ({rows}) r"
        plans |= {f"{a.name}__{f}": filter_plan(a.name, *how) for f, how in a.filters.items()}
        taken.add(a.name)
        codes |= set(a.issues)
    return plans | shared_issues(lastmod_valid, analyzers)
