"""DuckDB SQL with the rows of the queries that SQL can express."""

from tessera.llm.queries import MIX_SEED, MIX_WEIGHTS, URL_RULES

_WEIGHT = "CASE source " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in MIX_WEIGHTS.items()) + " ELSE 1.0 END"

#: docs: a table of the documents' columns.
MIX_SQL = f"""
    WITH sizes AS (SELECT source, count(*) AS n, {_WEIGHT} AS weight FROM {{docs}} GROUP BY source),
    rates AS (SELECT source, weight * (SELECT sum(n) / sum(weight) FROM sizes) / n AS rate FROM sizes),
    terms AS (SELECT source, rate, k, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS lf
              FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM rates)),
    cdf AS (SELECT source, k, sum(CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lf) WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
    units AS (SELECT *, CAST('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM {{docs}}),
    counts AS (SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS n_copies FROM units d),
    copies AS (SELECT * EXCLUDE (u, n_copies), CAST(unnest(range(0, n_copies)) AS INTEGER) AS copy_id FROM counts)
    SELECT *, md5('{MIX_SEED}-order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy_id) AS shuffle_key FROM copies"""

JACCARD_SQL = """
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
    -- Equal sets are one node; partners of other sets share a shingle.
    k AS (SELECT doc_id, len(shingles) AS n, CASE WHEN len(shingles) > 0 THEN md5(array_to_string(list_sort(shingles), chr(10))) END AS node, shingles FROM s),
    nodes AS (SELECT node, min(doc_id) AS id, any_value(n) AS n, any_value(shingles) AS shingles FROM k WHERE node IS NOT NULL GROUP BY node),
    copies AS (SELECT node, count(*) AS n_rows FROM k WHERE node IS NOT NULL GROUP BY node),
    e AS (SELECT id, n, unnest(shingles) AS shingle FROM nodes),
    pairs AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common FROM e a JOIN e b ON a.shingle = b.shingle AND a.id <> b.id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (n + m - common)),
    reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
    counts AS (SELECT a, sum(n_rows) AS n_links FROM links JOIN nodes ON links.b = nodes.id JOIN copies ON copies.node = nodes.node GROUP BY a)
    SELECT k.doc_id, k.n AS n_shingles, coalesce(component, k.doc_id) AS component_id, CAST(coalesce(n_rows - 1, 0) + coalesce(n_links, 0) AS BIGINT) AS n_links
    FROM k LEFT JOIN nodes ON k.node = nodes.node LEFT JOIN copies ON k.node = copies.node LEFT JOIN least ON nodes.id = least.a LEFT JOIN counts ON nodes.id = counts.a"""

CHAT_SQL = """
    WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM r),
    own AS (SELECT conv_id, CAST(place // 4096 AS BIGINT) AS segment, place, role, text FROM o),
    -- Later segments begin with the system messages of the first.
    m AS (SELECT * FROM own UNION ALL
          SELECT s.conv_id, l.segment, h.place, h.role, h.text FROM (SELECT DISTINCT conv_id, segment FROM own WHERE segment > 0) l
          JOIN own h ON h.conv_id IS NOT DISTINCT FROM l.conv_id AND h.segment = 0 AND h.role = 'system' JOIN (SELECT DISTINCT conv_id FROM own) s ON s.conv_id IS NOT DISTINCT FROM l.conv_id),
    p AS (SELECT DISTINCT conv_id, role AS participant FROM m WHERE role <> 'system'),
    x AS (SELECT m.conv_id, participant, segment, place, role, text, role = participant AS own,
                 CASE WHEN role = participant THEN '<|im_start|>assistant' || chr(10) WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
                      ELSE '<|im_start|>user name=' || regexp_replace(replace(role, '<|', '< |'), '[\\r\\n]', ' ', 'g') || chr(10) END AS head,
                 replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS body FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
    y AS (SELECT *, row_number() OVER w AS i, sum(length(head) + length(body)) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM x
          WINDOW w AS (PARTITION BY conv_id, participant, segment ORDER BY place))
    SELECT conv_id, participant, segment, count(*) AS n_messages, count(*) FILTER (own) AS n_trained, string_agg(head || body, '' ORDER BY i) AS rendered,
           coalesce(string_agg(CASE WHEN own THEN CAST(CAST(upto - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto AS BIGINT) AS VARCHAR) END, ',' ORDER BY i), '') AS mask_spans
    FROM y GROUP BY conv_id, participant, segment"""

_RULES = sorted(URL_RULES, key=lambda x: -len(x[0]))
_FITS = [(rule, says, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')") for rule, says in _RULES for h, _, p in [rule.partition("/")]]
_GRAMS = "unnest(list_transform(range(1, length(rest) + 2), lambda i: substr('^^^' || rest || '$', i, 4)))"


def _smoothed(k: int, side: str) -> str:
    """The Witten-Bell probability of order k: p_(k - 1) where the context was never seen."""
    lower = f"p{side}{k - 1}"
    return f"CASE WHEN coalesce(h{k}.n{side}, 0) > 0 THEN (coalesce(c{k}.{side}, 0) + h{k}.t{side} * {lower}) / (h{k}.n{side} + h{k}.t{side}) ELSE {lower} END AS p{side}{k}"


_COUNTS = ", ".join(f"c{k} AS (SELECT substr(g, 2, {k}) AS g, sum(a) AS a, sum(r) AS r FROM c{k + 1} GROUP BY 1)" for k in (3, 2, 1))
_CONTEXTS = ", ".join(f"h{k} AS (SELECT substr(g, 1, {k - 1}) AS g, sum(a) AS na, count(*) FILTER (a > 0) AS ta, sum(r) AS nr, count(*) FILTER (r > 0) AS tr FROM c{k} GROUP BY 1)" for k in (2, 3, 4))
_ORDERS = ", ".join(
    f"q{k} AS (SELECT q{k - 1}.*, {_smoothed(k, 'a')}, {_smoothed(k, 'r')} FROM q{k - 1} LEFT JOIN c{k} ON c{k}.g = substr(q{k - 1}.g, {5 - k}, {k}) LEFT JOIN h{k} ON h{k}.g = substr(q{k - 1}.g, {5 - k}, {k - 1}))" for k in (2, 3, 4)
)

URL_SQL = f"""
    WITH p AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
    h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    j AS (SELECT *, CASE {" ".join(f"WHEN {fits} THEN '{rule}'" for rule, _, fits in _FITS)} END AS rule, CASE {" ".join(f"WHEN {fits} THEN '{says}'" for _, says, fits in _FITS)} END AS says FROM h),
    u AS (SELECT DISTINCT rest, says, substr(md5(rest), 1, 1) IN ('0', '1', '2') AS held FROM j),
    c4 AS (SELECT g, count(*) FILTER (says = 'allow') AS a, count(*) FILTER (says = 'block') AS r FROM (SELECT says, {_GRAMS} AS g FROM u WHERE says IS NOT NULL AND NOT held) GROUP BY g),
    {_COUNTS}, {_CONTEXTS},
    total AS (SELECT coalesce(sum(a), 0) AS na, count(*) FILTER (a > 0) AS ta, coalesce(sum(r), 0) AS nr, count(*) FILTER (r > 0) AS tr FROM c1),
    s AS (SELECT rest, says, {_GRAMS} AS g FROM u WHERE says IS NULL OR held),
    q1 AS (SELECT w.g, (coalesce(c1.a, 0) + (ta + 1) / 256.0::DOUBLE) / (na + ta + 1) AS pa1, (coalesce(c1.r, 0) + (tr + 1) / 256.0::DOUBLE) / (nr + tr + 1) AS pr1
           FROM (SELECT DISTINCT g FROM s) w CROSS JOIN total LEFT JOIN c1 ON c1.g = substr(w.g, 4, 1)),
    {_ORDERS},
    scores AS (SELECT rest, says, avg(ln(pa4) - ln(pr4)) AS score FROM s JOIN q4 ON s.g = q4.g GROUP BY rest, says),
    m AS (SELECT avg(score) FILTER (says = 'allow') AS ma, stddev_pop(score) FILTER (says = 'allow') AS da, avg(score) FILTER (says = 'block') AS mr, stddev_pop(score) FILTER (says = 'block') AS dr FROM scores),
    t AS (SELECT CASE WHEN ma IS NULL OR mr IS NULL THEN '-Infinity'::DOUBLE WHEN da + dr = 0 THEN (ma + mr) / 2 ELSE (ma * dr + mr * da) / (da + dr) END AS threshold FROM m)
    SELECT page_id, host, path, rule, coalesce(j.says, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
    FROM j CROSS JOIN t LEFT JOIN scores ON j.says IS NULL AND scores.says IS NULL AND scores.rest = j.rest"""

# The plain patterns of the contract, in its order.
_KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_TERM = r"\p{L}{4,}"


def _spans(kind: str, pattern: str, rows: str) -> str:
    """The matches of a pattern in the texts of `rows` (doc, text), with their places in code points, end exclusive."""
    parts = f"SELECT doc, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS gaps FROM {rows} WHERE regexp_matches(text, '{pattern}')"
    each = f"SELECT doc, unnest(hits) AS value, unnest(gaps[:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i FROM ({parts})"
    return f"SELECT doc, '{kind}' AS kind, value, CAST(sum(length(gap) + length(value)) OVER (PARTITION BY doc ORDER BY i) - length(value) AS BIGINT) AS start FROM ({each})"


_PASSES = """CASE kind WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INTEGER) > 255)) = 0
        WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
            CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(digits), i, 1) AS INTEGER) ELSE CAST(substr(reverse(digits), i, 1) AS INTEGER) * 2 - 9 * CAST(CAST(substr(reverse(digits), i, 1) AS INTEGER) > 4 AS INTEGER) END)) % 10 = 0
        WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE true END"""

PII_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
    found AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM ({" UNION ALL ".join(_spans(k, p, "d") for k, p in _KINDS.items())})),
    e AS (SELECT doc, kind, lower(value) AS value, digits, start, start + length(value) AS stop, CASE kind WHEN 'email' THEN 1 WHEN 'ip' THEN 2 WHEN 'card' THEN 3 ELSE 4 END AS place FROM found WHERE {_PASSES}),
    part AS (SELECT DISTINCT doc, unnest([value, kind || ' of ' || CASE kind WHEN 'email' THEN split_part(value, '@', -1) WHEN 'ip' THEN split_part(value, '.', 1) || '.' || split_part(value, '.', 2)
             WHEN 'card' THEN substr(digits, 1, 6) ELSE substr(digits, 1, 4) END]) AS entity FROM e),
    words AS (SELECT DISTINCT doc, unnest(regexp_extract_all(lower(text), '{_TERM}')) AS term FROM d),
    df AS (SELECT term, count(*) AS d FROM words GROUP BY term),
    m AS (SELECT entity, count(*) AS m FROM part JOIN d USING (doc) GROUP BY entity HAVING count(DISTINCT text) >= 3),
    k AS (SELECT entity, term, count(*) AS k FROM part JOIN m USING (entity) JOIN words USING (doc) JOIN d USING (doc) GROUP BY entity, term HAVING count(DISTINCT text) >= 3),
    n AS (SELECT count(*)::DOUBLE AS n FROM d),
    flags AS (SELECT entity, term, log2(k * n / (m * greatest(d, k))) / log2(n / m) AS disclosure FROM k JOIN m USING (entity) JOIN df USING (term) CROSS JOIN n),
    own AS (SELECT doc, term, max(disclosure) AS disclosure FROM part JOIN flags USING (entity) WHERE disclosure >= 0.6 GROUP BY doc, term),
    told AS (SELECT * FROM d WHERE doc IN (SELECT doc FROM own)),
    t AS (SELECT doc, CASE WHEN disclosure >= 0.9 THEN 'remove' ELSE 'generalise' END AS kind, start, start + length(value) AS stop FROM ({_spans("term", _TERM, "told")}) s JOIN own USING (doc)
          WHERE own.term = lower(s.value) AND NOT EXISTS (SELECT 1 FROM e WHERE e.doc = s.doc AND e.start < s.start + length(s.value) AND e.stop > s.start)),
    base AS (SELECT doc, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _KINDS)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) AS listed FROM e GROUP BY doc),
    more AS (SELECT doc, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY kind, start) AS listed FROM t GROUP BY doc)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _KINDS)}, sha256(coalesce(base.listed, '')) AS base_sha256, concat_ws(',', base.listed, more.listed) AS spans
    FROM d LEFT JOIN base USING (doc) LEFT JOIN more USING (doc)"""

ORACLES = {
    "op2_poisson_mix": MIX_SQL.format(docs="documents"),
    "op4_jaccard_join": JACCARD_SQL,
    "op6_url_filter": URL_SQL,
    "op9_pii": PII_SQL,
    "op10_perspectives": CHAT_SQL,
}
