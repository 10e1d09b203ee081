"""DuckDB statements of the training-data operators that SQL can express, written from their contracts."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bit = "xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: {bit})"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: cast(ascii(x) AS bigint))), lambda c, b: {byte}))"


#: A way of editing: its cost in nine digits, then its letters (J and S: I and R for an assistant); text order is (cost, letters) order.
_NEVER = "'900000000'"


def _way(way: str, cost: str, letters: str) -> str:
    return f"(lpad(cast(cast(substr({way}, 1, 9) AS bigint) + {cost} AS varchar), 9, '0') || substr({way}, 10) || {letters})"


def _edits() -> str:
    gone, cut = "r.fault IN ('blank', 'duplicate')", "CASE WHEN r.fault = 'truncated' THEN 1 ELSE 0 END"
    kept = lambda way, initial, other: f"CASE WHEN {gone} THEN {_NEVER} ELSE {_way(way, f'{cut} + CASE WHEN r.initial = {initial!r} THEN 0 ELSE 2 END', f'CASE WHEN r.initial = {initial!r} THEN {"'K'"} ELSE {other!r} END')} END"
    u = f"least(w.u, {_way('w.e', '2', "'I'")}, {_way('w.s', '2', "'I'")}, {_way('w.a', '2', "'I'")})"
    a = f"least(w.a, {_way('w.u', '2', "'J'")})"
    drop = lambda way: _way(way, "3", "'D'")
    inserted = f"SELECT w.conv, w.pos, w.e, w.s, {u} AS u, {a} AS a FROM ways w"
    to_s = f"CASE WHEN {gone} OR r.initial <> 's' THEN {_NEVER} ELSE {_way('w.e', cut, "'K'")} END"
    return f"""SELECT w.conv, w.pos + 1, {drop('w.e')}, least({drop('w.s')}, {to_s}), least({drop('w.u')}, {kept('least(w.e, w.s, w.a)', 'u', 'R')}), least({drop('w.a')}, {kept('w.u', 'a', 'S')})
        FROM ({inserted}) w JOIN numbered r ON r.conv = w.conv AND r.pos = w.pos + 1"""


_SPACES = r"[\x20\x09-\x0D]"
_REPAIR = rf"""WITH RECURSIVE keyed AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32("coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ')")} % 20 AS kind FROM conversations),
    damaged AS (SELECT conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM keyed WHERE kind <> 0
        UNION ALL SELECT conv, turn, role, text FROM keyed WHERE kind = 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged),
    faulty AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?]{_SPACES}*$') THEN 'truncated' ELSE '' END AS fault FROM ranked),
    numbered AS (SELECT *, row_number() OVER o AS pos, lag(initial) OVER o AS before FROM faulty WINDOW o AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, nth)),
    counted AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM numbered GROUP BY conv),
    ways AS (SELECT DISTINCT conv, cast(0 AS bigint) AS pos, '000000000' AS e, {_NEVER} AS s, {_NEVER} AS u, {_NEVER} AS a FROM keyed UNION ALL {_edits()}),
    ended AS (SELECT w.conv, least(w.e, w.a, {_way('w.u', '2', "'J'")}, {_way('w.s', '4', "'IJ'")}) AS way FROM ways w JOIN counted c ON c.conv = w.conv AND c.n = w.pos),
    tokens AS (SELECT conv, cast(substr(way, 1, 9) AS bigint) AS cost, substr(way, 10) AS letters, regexp_extract_all(substr(way, 10), '[IJ]*[DKRS]') AS edits, regexp_extract(substr(way, 10), '[IJ]*$') AS tail FROM ended),
    lines AS (SELECT t.conv, r.pos, replace(replace(substr(edit, 1, length(edit) - 1), 'I', chr(10) || 'user:'), 'J', chr(10) || 'assistant:') || CASE right(edit, 1) WHEN 'K' THEN chr(10) || r.role || ':' || r.text WHEN 'R' THEN chr(10) || 'user:' || r.text WHEN 'S' THEN chr(10) || 'assistant:' || r.text ELSE '' END AS line
        FROM (SELECT r.*, t.edits[r.pos] AS edit FROM tokens t JOIN numbered r ON r.conv = t.conv) r JOIN tokens t ON t.conv = r.conv
        UNION ALL SELECT conv, 9223372036854775807, replace(replace(tail, 'I', chr(10) || 'user:'), 'J', chr(10) || 'assistant:') FROM tokens),
    texts AS (SELECT conv, substr(string_agg(line, '' ORDER BY pos), 2) AS repaired FROM lines GROUP BY conv)
    SELECT k.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(t.cost, 0) AS cost, coalesce(translate(t.letters, 'JS', 'IR'), '') AS audit, sha256(coalesce(x.repaired, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv, conv_id FROM keyed) k LEFT JOIN counted c ON c.conv = k.conv LEFT JOIN tokens t ON t.conv = k.conv LEFT JOIN texts x ON x.conv = k.conv"""

def _leaf(**changed: str) -> str:
    field = lambda c, v: f"coalesce(cast(strlen(cast({v} AS varchar)) AS varchar) || ':' || cast({v} AS varchar), '-')"
    return f"sha256({' || '.join(field(c, changed.get(c, c)) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))})"


def _tree(name: str, leaves: str) -> str:
    """{name}_up: every node (tree, level, pos, n of its level, h). leaves: a SELECT of (tree, pos, n, h)."""
    return f"{name}_up AS (SELECT tree, 0 AS level, pos, n, h FROM ({leaves}) l UNION ALL SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name}_up WHERE n > 1 GROUP BY tree, level, pos // 2, n)"


def _fold(name: str, starts: str) -> str:
    """{name}_fold: (id, tree, level, pos, n, h, path) from leaves upward. starts: a SELECT of (id, tree, pos, n, h, path)."""
    return f"""{name}_fold AS (SELECT id, tree, 0 AS level, pos, n, h, path FROM ({starts}) s UNION ALL
        SELECT f.id, f.tree, f.level + 1, f.pos // 2, (f.n + 1) // 2, sha256(CASE WHEN o.h IS NULL THEN f.h WHEN o.pos < f.pos THEN o.h || f.h ELSE f.h || o.h END), f.path || coalesce(o.h, '') FROM {name}_fold f
        LEFT JOIN {name}_up o ON o.tree = f.tree AND o.level = f.level AND o.pos = xor(f.pos, 1) WHERE f.n > 1)"""


_MERKLE = f"""WITH RECURSIVE hashed AS (SELECT doc_id, lang, {_leaf()} AS leaf, CASE WHEN {crc32("cast(doc_id AS varchar)")} % 7 = 0 THEN {_leaf(n_chars="(n_chars + 1)")} END AS altered FROM documents),
    leaves AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
    {_tree("low", "SELECT tree, pos, n, leaf AS h FROM leaves")},
    subroots AS (SELECT tree AS pos, h, count(*) OVER () AS n FROM low_up WHERE n = 1), {_tree("top", "SELECT 0 AS tree, pos, n, h FROM subroots")},
    {_fold("low", "SELECT id, tree, pos, n, coalesce(altered, leaf) AS h, '' AS path FROM leaves")},
    {_fold("top", "SELECT f.id, 0 AS tree, s.pos, s.n, f.h, f.path FROM low_fold f JOIN subroots s ON s.pos = f.tree WHERE f.n = 1")}
    SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(f.path) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
    FROM leaves l JOIN top_fold f ON f.id = l.id AND f.n = 1 JOIN subroots s ON s.pos = l.tree CROSS JOIN (SELECT h FROM top_up WHERE n = 1) r"""

ORACLES = {"op12_merkle_manifest": _MERKLE, "op11_conversation_repair": _REPAIR}
