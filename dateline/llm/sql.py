"""The SQL that checks phrase mining and conversation prefixes."""

from __future__ import annotations

from dateline.llm import phrases, prefixes


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, byte by byte and bit by bit."""
    return f"""xor(4294967295, list_reduce(
        [4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT),
        lambda acc, b: list_reduce([xor(acc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
            lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


PREFIX_NODES = f"""
    WITH turns AS (
        SELECT conv_id, conv_id - conv_id % {prefixes.GROUP} AS base, turn, length(coalesce(text, '')) AS chars,
            sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS key
        FROM conversations WHERE conv_id IS NOT NULL),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS i FROM turns),
    convs AS (
        SELECT conv_id, base, {crc32_sql("conv_id::VARCHAR")} % {prefixes.SHARED} AS h
        FROM (SELECT DISTINCT conv_id, base FROM turns)),
    rebuilt AS (
        SELECT c.conv_id, p.i, p.key, p.chars FROM convs c JOIN placed p ON p.conv_id = c.base WHERE p.i <= c.h
        UNION ALL
        SELECT c.conv_id, p.i, p.key, p.chars FROM convs c JOIN placed p ON p.conv_id = c.conv_id WHERE p.i > c.h),
    numbered AS (
        SELECT conv_id, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path, chars
        FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
    passed AS (
        SELECT conv_id, depth, sha256(path) AS node, chars FROM numbered
        UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
    linked AS (
        SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS last
        FROM passed WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
    nodes AS (
        SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, min(chars) AS chars,
            count(*) AS n_convs, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (last) AS ends
        FROM linked GROUP BY node),
    children AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
    inside AS (
        SELECT DISTINCT a.node AS top, b.node FROM passed a JOIN passed b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
    sums AS (
        SELECT i.top, count(*) FILTER (c.parent IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
        FROM inside i JOIN nodes n ON n.node = i.node LEFT JOIN children c ON c.parent = i.node GROUP BY i.top)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves,
        s.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
    FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.parent = n.node
    JOIN sums s ON s.top = n.node"""

COLLOCATIONS = f"""
    WITH pieces AS (
        SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM (SELECT coalesce(lang, 'und') AS lang,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
    split AS (
        SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
    windows AS (
        SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
        FROM split, range(1, {phrases.LONGEST + 1}) r(k) WHERE len(ws) >= k),
    f AS (
        SELECT lang, k, phrase, count(*) AS a, sum(count(*)) FILTER (k = 1) OVER (PARTITION BY lang)::BIGINT AS n
        FROM windows GROUP BY lang, k, phrase),
    c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {phrases.LEAST}),
    cuts AS (
        SELECT c.*, j, array_to_string(ws[1:j], ' ') AS one, array_to_string(ws[j + 1:], ' ') AS other
        FROM c, range(1, {phrases.LONGEST}) r(j) WHERE j < k),
    scored AS (
        SELECT t.lang, t.k, t.phrase, t.a, t.n, t.j, x.a AS l, y.a AS r,
            ((1000::HUGEINT * t.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
        FROM cuts t JOIN f x ON x.lang = t.lang AND x.phrase = t.one JOIN f y ON y.lang = t.lang AND y.phrase = t.other),
    lowest AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    parts AS (
        SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
        FROM c, range(2, {phrases.LONGEST}) r(m), range(1, {phrases.LONGEST}) s(i)
        WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
    ranked AS (
        SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
        FROM lowest w LEFT JOIN parts p ON p.lang = w.lang AND p.phrase = w.phrase
        WHERE p.longer IS NULL OR 100 * p.longer < {phrases.INSIDE} * w.a)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {phrases.TOP}"""
