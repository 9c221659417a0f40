"""DuckDB SQL for the queries of the subpackage that SQL can express."""

from __future__ import annotations

from . import licences, personal, secrets


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NEAR_DUPLICATES = """
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS rid, doc_id,
        list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
sets AS (
    SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT rid, count(*) AS n FROM sets GROUP BY rid),
pairs AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.rid < b.rid GROUP BY a.rid, b.rid),
links AS (SELECT x, y FROM pairs p JOIN sizes a ON a.rid = p.x JOIN sizes b ON b.rid = p.y WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rid, rid AS other FROM words UNION SELECT r.rid, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
least AS (SELECT r.rid, min(w.doc_id) AS component_id FROM reach r JOIN words w ON w.rid = r.other GROUP BY r.rid)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(w.doc_id = component_id, false) AS kept
FROM words w JOIN least USING (rid) LEFT JOIN sizes USING (rid)
"""

# hexadecimal text stands for bytes: two letters each
REPEATS = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT *, length(h) // 2 AS n FROM docs),
starts AS (SELECT rid, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT rid, h, unnest(range(0, n - 399)) AS p FROM sized WHERE n >= 400)),
twice AS (SELECT k FROM starts GROUP BY k HAVING count(*) > 1),
found AS (SELECT rid, p FROM starts SEMI JOIN twice USING (k)),
marked AS (SELECT rid, p, CASE WHEN p <= lag(p) OVER w + 400 THEN 0 ELSE 1 END AS fresh FROM found WINDOW w AS (PARTITION BY rid ORDER BY p)),
islands AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS i FROM marked),
spans AS (SELECT rid, i, min(p) AS a, max(p) + 400 AS b FROM islands GROUP BY rid, i),
gaps AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY rid ORDER BY a) AS next FROM spans),
cut AS (SELECT s.rid, count(*) AS n_spans, sum(b - a) AS n_removed,
        string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || max(CASE WHEN next IS NULL THEN substr(h, 2 * b + 1) END) AS kept
    FROM gaps g JOIN sized s ON s.rid = g.rid GROUP BY s.rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, (coalesce(n_removed, 0) > 0)::INTEGER AS repeated
FROM sized LEFT JOIN cut USING (rid)
"""


def _licences() -> str:
    known = ", ".join(f"({_quoted(form)}, {_quoted(key)})" for key, forms in licences.SENTENCES.items() for form in forms)
    # RE2 looks at nothing behind a place, so white space after a sentence's end becomes a mark first
    ended = "regexp_replace(coalesce(text, ''), '([.!?:;])\\s+', '\\1\u0001', 'g')"
    cuts = [f"regexp_replace({ended}, '[\\r\\n]+', '\u0001', 'g')", f"regexp_replace({ended}, '\\r?\\n\\s*\\n\\s*', '\u0001', 'g')"]
    normal = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, name in licences.VARIABLE:
        normal = f"regexp_replace({normal}, {_quoted(pattern)}, {_quoted(chr(92) + f'1 {name} ' + chr(92) + '2 its ' + chr(92) + '3 ')})"
    steps = [
        "WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)",
        f"known(form, key) AS (VALUES {known})",
        "parts AS (" + " UNION ALL ".join(f"SELECT rid, {c} AS cut, string_split({e}, '\u0001') AS p FROM docs" for c, e in enumerate(cuts)) + ")",
        "each AS (SELECT rid, cut, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM parts)",
        f"met AS (SELECT rid, cut, i, key FROM each JOIN known ON {normal} = form)",
        "r0 AS (SELECT rid, cut, count(*) AS n, ',,' || string_agg(key, ',,' ORDER BY i) || ',,' AS ids, []::VARCHAR[] AS names FROM met GROUP BY rid, cut)",
    ]
    for k, (name, sequence) in enumerate(licences.RULES):
        pattern = _quoted(",," + ",,".join(sequence) + ",,")
        steps.append(
            f"r{k + 1} AS (SELECT rid, cut, n, replace(ids, {pattern}, ',,#,,') AS ids, CASE WHEN contains(ids, {pattern}) AND NOT list_contains(names, {_quoted(name)}) THEN list_append(names, {_quoted(name)}) ELSE names END AS names FROM r{k})"
        )
    last = len(licences.RULES)
    return ",\n".join(steps) + f"""
SELECT doc_id, coalesce(a.n, 0)::BIGINT AS n_sentences,
    array_to_string(list_concat(coalesce(a.names, []), list_filter(coalesce(b.names, []), lambda x: NOT list_contains(coalesce(a.names, []::VARCHAR[]), x))), ',') AS licences
FROM docs LEFT JOIN r{last} a ON a.rid = docs.rid AND a.cut = 0 LEFT JOIN r{last} b ON b.rid = docs.rid AND b.cut = 1"""


def _found(kind: str, pattern: str, keep: str = "true", source: str = "docs", key: str = "rid") -> str:
    """Matches of a pattern with their places: gaps between them and the matches themselves add up."""
    return f"""{kind}_m AS (SELECT {key}, regexp_extract_all(t, {_quoted(pattern)}) AS m, string_split_regex(t, {_quoted(pattern)}) AS g FROM {source}),
{kind}_e AS (SELECT {key}, unnest(m) AS m, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM {kind}_m WHERE len(m) > 0),
{kind}_p AS (SELECT {key}, m, (sum(length(g)) OVER w + sum(length(m)) OVER w - length(m))::BIGINT AS a FROM {kind}_e WINDOW w AS (PARTITION BY {key} ORDER BY i)),
{kind} AS (SELECT {key}, a, a + length(m) AS b, m FROM {kind}_p WHERE {keep})"""


def _secrets() -> str:
    value = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
    assign = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
    harmless = " OR ".join(f"regexp_matches(m, {_quoted(p)})" for p in secrets.ALLOW_WHOLE)
    allowed = _quoted(secrets.allowed(secrets.ALLOW))
    limit = "CASE " + " ".join(f"WHEN regexp_matches(m, {_quoted(shape)}) THEN {bits}" for _, shape, bits in secrets.CLASSES) + " END"
    kinds = ["assign", "access", "hex", "entropy"]
    union = " UNION ALL ".join(f"SELECT rid, a, {i} AS rank, '{k}' AS kind, b FROM {k}" for i, k in enumerate(kinds))
    joined = lambda where: f"string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank){where}"
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_found("assign", assign, f"length(regexp_extract(m, {_quoted(value)}, 1)) >= 6")},
{_found("access", "AKIA[A-Z0-9]+", "length(m) >= 20")},
{_found("hex", "[0-9a-f]{24,}")},
{_found("candidate", "[A-Za-z0-9+/_=-]{20,}", f"NOT ({harmless})")},
cut AS (SELECT rid, a, row_number() OVER () AS cid, string_split_regex(m, {allowed}) AS g, list_concat(regexp_extract_all(m, {allowed}), ['']) AS s FROM candidate),
parts AS (SELECT rid, a, cid, unnest(g) AS m, unnest(s) AS s, generate_subscripts(g, 1) AS i FROM cut),
pieces AS (SELECT rid, m, (a + sum(length(m) + length(s)) OVER w - length(m) - length(s))::BIGINT AS a FROM parts WINDOW w AS (PARTITION BY cid ORDER BY i)),
windows AS (SELECT rid, a, m, unnest(range(0, length(m) - 19)) AS i FROM pieces WHERE length(m) >= 20),
high AS (SELECT rid, a, m, i FROM windows WHERE list_aggregate(string_split(substr(m, i + 1, 20), ''), 'entropy') >= {limit}),
entropy AS (SELECT rid, a + min(i) AS a, a + max(i) + 20 AS b FROM high GROUP BY rid, a, m),
spans AS ({union}),
per_doc AS (SELECT rid, {joined("")} AS spans, {joined(" FILTER (rank < 3)")} AS base, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(kinds))} FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per_doc USING (rid)"""


def _personal() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    # from the right, every second digit counts double, less 9 beyond 9
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN substr({digits}, i, 1)::INTEGER WHEN substr({digits}, i, 1)::INTEGER > 4 THEN substr({digits}, i, 1)::INTEGER * 2 - 9 ELSE substr({digits}, i, 1)::INTEGER * 2 END)) % 10 = 0"
    parts = "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0"
    kinds = personal.KINDS
    entities = " UNION ALL ".join(f"SELECT rid, a, {i} AS rank, '{k}' AS kind, b FROM {k}" for i, k in enumerate(kinds))
    joined = lambda where: f"string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank){where}"
    reach, low = personal.REACH, f"greatest(e.a - {personal.REACH}, 0)"
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_found("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+")},
{_found("ip", r"[0-9]+(?:[.][0-9]+){3}", parts)},
{_found("card", r"[0-9](?:[ -]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn}")},
{_found("phone", r"[+][0-9][ ().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15")},
entities AS ({entities}),
sides AS (SELECT row_number() OVER () AS sid, * FROM (
    SELECT e.rid, kind, {low} AS off, substr(t, {low} + 1, e.a - {low}) AS t, {low} > 0 AS cut_first, false AS cut_last FROM entities e JOIN docs d ON d.rid = e.rid
    UNION ALL SELECT e.rid, kind, e.b, substr(t, e.b + 1, {reach}), false, e.b + {reach} < length(t) FROM entities e JOIN docs d ON d.rid = e.rid)),
{_found("word", personal.TERM.replace("}+", "}"), source="sides", key="sid")},
near AS (SELECT DISTINCT rid, kind, off + a AS a, off + b AS b, lower(m) AS term FROM word JOIN sides USING (sid) WHERE NOT (cut_first AND a = 0) AND NOT (cut_last AND b = length(t))),
anywhere AS (SELECT lower(w) AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '{personal.TERM.replace("}+", "}")}')) AS w FROM docs) GROUP BY 1),
together AS (SELECT kind, term, count(*) AS k FROM near GROUP BY kind, term),
shares AS (SELECT kind, sum(k)::DOUBLE / (SELECT sum(n) FROM anywhere)::DOUBLE AS share FROM together GROUP BY kind),
revealing AS (SELECT kind, term FROM together JOIN anywhere USING (term) JOIN shares USING (kind)
    WHERE k >= {personal.SUPPORT} AND share < 1 AND log2((k::DOUBLE / n) / share) / -log2(share) >= {personal.GENERALISE}),
spans AS (SELECT * FROM entities UNION ALL SELECT rid, a, {len(kinds)}, 'term', b FROM (SELECT DISTINCT rid, a, b FROM near JOIN revealing USING (kind, term))),
per_doc AS (SELECT rid, {joined("")} AS spans, {joined(f" FILTER (rank < {len(kinds)})")} AS base, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(kinds))} FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per_doc USING (rid)"""


ORACLES = {"op2_licences": _licences(), "op4_repeats": REPEATS, "op6_personal_data": _personal(), "op9_near_duplicates": NEAR_DUPLICATES, "op10_secret_scan": _secrets()}
