"""DuckDB twin of the packed-field query. It has no look-around, so quoted values are found by one pattern and the rest is cut."""

from __future__ import annotations

_S = r"[\s\x{A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]"
_NUMBER = r"[\(\[]?\d{1,4}[\]\).:]+"
_SEPARATOR = rf"^(?:[-*•·‖|,;&+/→\[\]\(\)]+|->|=>|{_NUMBER}|(?i:and|or|und|oder|et|ou|y|o|e))$"
_AFTER = r"\s\x{A0}\x{2000}-\x{200B}\x{3000},;|\]\)，；、<"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _replaced(x: str, *pairs: tuple[str, str]) -> str:
    for pattern, new in pairs:
        x = f"regexp_replace({x}, {_q(pattern)}, {_q(new)}, 'g')"
    return x


_CUT = _replaced(
    "p", (r"(?i)<br\s*/?>", " "), (r"[<>、，；‖•·→]", " "), (rf"(^|{_S})(?:->|=>)($|{_S})", " "), (r"([^=\s])(https?://)", r"\1 \2"),
    (rf"[,;|]+($|{_S}|[\]\)])", r" \1"), (rf"[,;|]+($|{_S}|[\]\)])", r" \1"), (r"[,;|]+([\w.-]+/)", r" \1"), (rf"(^|{_S})[,;|]+", r"\1 "),
)
_TOKEN = f"CASE WHEN regexp_matches(t, {_q(f'^{_NUMBER}(?:https?://|[a-z])')}) THEN regexp_replace(t, {_q(f'^{_NUMBER}')}, '') ELSE regexp_replace(t, {_q(r'^[\[\(]+([a-z])')}, '\\1') END"
_BARE = f"list_filter(list_transform(list_filter(list_transform(regexp_split_to_array({_CUT}, {_q(_S + '+')}), lambda t: {_TOKEN}), lambda t: t <> '' AND NOT regexp_matches(t, {_q(_SEPARATOR)})), lambda t: CASE WHEN regexp_matches(t, '[\\(\\[]') THEN t ELSE regexp_replace(t, '[\\]\\)]+$', '') END), lambda t: t <> '')"
_PIECES = f"""CASE first WHEN '"' THEN regexp_extract_all(text, {_q(r'"(?:\\"|""|[^"])*(?:"|$)|(?:\\"|[^"])+')}) WHEN '''' THEN regexp_extract_all(text, {_q(rf"'(?:''\w|\\'|[^']|'[^'{_AFTER}])*(?:'|$)|[^']+")}) ELSE [text] END"""
# in SQL chr(34) and chr(39) are the quotes, chr(92) is the backslash before an escaped one
_INSIDE = "replace(replace(replace(regexp_replace(p[2:], first || '$', ''), chr(92) || chr(34), chr(34)), chr(92) || chr(39), chr(39)), first || first, first)"
_LITERAL = f"list_filter([{_replaced(_INSIDE, (rf'^{_S}+|{_S}+$', ''))}], lambda v: v <> '')"
SQL = f"""
WITH f AS (SELECT 'eval_row' AS tab, pos AS row_key, source AS text FROM eval_row UNION ALL SELECT 'generated_item', item_id, source_urls FROM generated_item),
q AS (SELECT *, regexp_extract(text, {_q(rf'''(?:^|{_S}|[,;|\[\(<，；、>])(["'])''')}, 1) AS first FROM f WHERE text IS NOT NULL AND lower(trim(text)) NOT IN ('', '-', '--', 'none', 'null', 'nil', 'n/a', 'na', 'nan', 'tbd', 'unknown', '?', '[]', '{{}}', '()')),
p AS (SELECT tab, row_key, first, {_PIECES} AS pieces FROM q),
v AS (SELECT tab, row_key, flatten(list_transform(pieces, lambda p: CASE WHEN first <> '' AND p[1] = first THEN {_LITERAL} ELSE {_BARE} END)) AS v FROM p)
SELECT tab, row_key, CAST(generate_subscripts(v, 1) - 1 AS INT) AS val_pos, unnest(v) AS val FROM v WHERE len(v) >= 2"""
