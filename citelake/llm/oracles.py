"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_REACH = """
    reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
    low AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

ITQ = f"""
    WITH RECURSIVE good AS (
        SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id <> y.id AND len(x.v) = len(y.v)
              WHERE list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.95),
    nodes AS (SELECT vec_id AS id FROM embeddings),
    {_REACH}
    SELECT nodes.id AS vec_id, (SELECT count(*) FROM links WHERE links.a = nodes.id) AS n_links, component_id, nodes.id = component_id AS kept
    FROM nodes JOIN low USING (id)
"""

PARTENUM = f"""
    WITH RECURSIVE words AS (
        SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    nodes AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
    flat AS (SELECT id, unnest(s) AS x FROM nodes),
    met AS (SELECT p.id AS a, q.id AS b, count(*) AS n FROM flat p JOIN flat q ON p.x = q.x AND p.id <> q.id GROUP BY ALL),
    links AS (SELECT a, b FROM met JOIN nodes p ON p.id = a JOIN nodes q ON q.id = b WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
    {_REACH}
    SELECT id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM nodes JOIN low USING (id)
"""

#: For pages whose article has paragraphs, line breaks, a heading and bold text only, as those of the tables.
HTML = r"""
    WITH articles AS (
        SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g') AS x FROM pages),
    decoded AS (SELECT page_id, url, list_transform(string_split_regex(x, '<(?:br|/?p|/?h1)>'), lambda t: regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')) AS l FROM articles),
    folded AS (SELECT page_id, url, array_to_string(list_filter(list_transform(l, lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))), lambda t: t <> ''), chr(10)) AS text FROM decoded)
    SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM folded
"""


# Base spans of op3 and op4 by their contracts' patterns. What the methods add (decoded structures, accepted
# candidates) isn't in SQL: no document of sf0.01 has any, so there `spans` holds the base spans only.


def _matches(kind: str, pattern: str, group: int) -> str:
    """The matches of a pattern, each with its start: the lengths of the pieces and matches before it."""
    whole = f"regexp_extract_all(t, '{pattern}', 0)"
    tested = f"regexp_extract_all(t, '{pattern}', {group})" if group else whole
    start = "CAST(list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0) AS BIGINT)"
    return f"""SELECT id, '{kind}' AS kind, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{'s': {start}, 'm': ms[i], 'g': gs[i]}})) AS x
        FROM (SELECT id, {whole} AS ms, {tested} AS gs, string_split_regex(t, '{pattern}') AS ps FROM texts) WHERE len(ms) > 0"""


def _spans(kinds: tuple, order: str) -> str:
    found = " UNION ALL ".join(f"SELECT id, {k} AS o, kind, x.s AS s, x.s + length(x.m) AS e FROM ({_matches(kind, pattern, group)}) WHERE {good}" for k, (kind, pattern, good, group) in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind, *_ in kinds)
    return f"""
    WITH texts AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), found AS ({found}),
    grouped AS (SELECT id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order}) AS j FROM found GROUP BY id)
    SELECT id AS doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in kinds)}, sha256(coalesce(j, '')) AS base_sha256, coalesce(j, '') AS spans
    FROM texts LEFT JOIN grouped USING (id)
"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
_QUOTE = """["'']?"""
SECRETS = _spans(
    (
        ("assign", rf"({_NAMES}){_QUOTE}\x20*[:=]\x20*{_QUOTE}([A-Za-z0-9+/_.=-]+)", "length(x.g) >= 6", 2),
        ("access", "AKIA[A-Z0-9]{16,}", "true", 0),
        ("hex", "[0-9a-f]{24,}", "true", 0),
    ),
    "s, o",
)
_DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_DIGIT = f"CAST(reverse({_DIGITS})[i] AS INTEGER)"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGIT} ELSE {_DIGIT} * 2 - CASE WHEN {_DIGIT} > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
PII = _spans(
    (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INTEGER) > 255)) = 0", 0),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", 0),
    ),
    "o, s",
)
