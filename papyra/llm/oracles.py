"""SQL (DuckDB) that says what the queries of this subpackage return, by plainer ways."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k + 9], ' '))) AS win FROM i WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
h AS (SELECT r, k, dw.n, item FROM dw JOIN iw USING (win, n)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


# The contract's patterns, written out, and those of the entropy scan.
ASSIGN_HEAD = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+"
ACCESS, HEX, CANDIDATE = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9+/_=-]{20,}"
WINDOW, LEAST_HEX, LEAST_BASE64 = 20, 2.9, 3.7


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _found(kind: str, pattern: str, more: str = "TRUE") -> str:
    """Rows (r, kind, start, end, s) of a pattern's matches."""
    p = _q(pattern)
    return f"""
SELECT r, '{kind}' AS kind, a + list_sum([0] || list_transform(pieces[1:k], lambda x: length(x))) + list_sum([0] || list_transform(m[1:k - 1], lambda x: length(x))) AS s0, m[k] AS s
FROM (SELECT r, 0 AS a, string_split_regex(t, '{p}') AS pieces, regexp_extract_all(t, '{p}') AS m, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS k FROM d WHERE regexp_matches(t, '{p}'))
WHERE {more}"""


OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT 0 AS o, * FROM ({_found("assign", ASSIGN, f"length(regexp_replace(m[k], '^{_q(ASSIGN_HEAD)}', '')) >= 6")})
  UNION ALL SELECT 1, * FROM ({_found("access", ACCESS)})
  UNION ALL SELECT 2, * FROM ({_found("hex", HEX)})),
b AS (SELECT r, o, kind, CAST(s0 AS BIGINT) AS s0, CAST(s0 + length(s) AS BIGINT) AS e0 FROM base),
c0 AS (SELECT r, CAST(s0 AS BIGINT) AS s0, CAST(s0 + length(s) AS BIGINT) AS e0, s FROM ({_found("entropy", CANDIDATE)})),
c1 AS (SELECT r, s0, e0, unnest(string_split(regexp_replace(s, '[^/=_-]{{0,64}}(?:(?i:example|placeholder|changeme|dummy|sample)|0123456789|abcdefghij)[^/=_-]{{0,64}}', ' ', 'g'), ' ')) AS s FROM c0
      WHERE NOT regexp_matches(s, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$|^(sha1|sha256|sha384|sha512|md5)-')
        AND length(replace(s, s[1], '')) > 0
        AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = c0.r AND b.s0 < c0.e0 AND c0.s0 < b.e0)),
c AS (SELECT *, row_number() OVER () AS piece, CASE WHEN regexp_matches(s, '^[0-9a-fA-F]+$') THEN {LEAST_HEX} ELSE {LEAST_BASE64} END AS least FROM c1
      WHERE regexp_matches(s, '[0-9]') AND length(s) >= {WINDOW}
        AND (regexp_matches(s, '^[0-9a-fA-F]+$') OR regexp_matches(s, '[A-Z]') OR regexp_matches(s, '[a-z]'))),
w AS (SELECT r, s0, e0, piece, least, k, unnest(string_split(s[k:k + {WINDOW - 1}], '')) AS ch FROM (SELECT *, unnest(range(1, length(s) - {WINDOW} + 2)) AS k FROM c)),
n AS (SELECT r, s0, e0, piece, least, k, ch, count(*) AS n FROM w GROUP BY ALL),
e AS (SELECT DISTINCT r, s0, e0 FROM (SELECT r, s0, e0, piece, least, k, round(log2({WINDOW}) - sum(n * log2(n)) / {WINDOW}, 9) AS h FROM n GROUP BY ALL) GROUP BY r, s0, e0, piece, least HAVING max(h) >= least),
a AS (SELECT r, o, kind, s0, e0 FROM b UNION ALL SELECT r, 3, 'entropy', s0, e0 FROM e),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s0 || ':' || e0, ',' ORDER BY s0, o) FILTER (o < 3) AS base, string_agg(kind || ':' || s0 || ':' || e0, ',' ORDER BY s0, o) AS spans FROM a GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

OP3 = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rh, rp, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f AS (SELECT r, rh || rp AS rule, verdict FROM p JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)
      QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC, length(rh) DESC, verdict) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (r)
"""

OP4 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS esc,
             regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS er FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
             CAST(sum(CASE WHEN role = 'assistant' THEN length(esc) + 4 ELSE 10 + length(er) + 1 + length(esc) + 8 END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d WHERE len(w) > 0),
x AS MATERIALIZED (SELECT r, len(s) AS n, hash(unnest(s)) AS h FROM s),
e AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.h = b.h AND a.r <> b.r AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
      GROUP BY a.r, b.r, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
links AS (SELECT a AS r, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, (SELECT min(m.doc_id) FROM reach JOIN d m ON m.r = reach.b WHERE reach.a = d.r) AS class_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN links USING (r)
"""

STRIP = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, k, lines[k] AS line, translate(trim(lines[k], {STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS k FROM d)),
f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
k AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS kept FROM l WHERE key NOT IN (SELECT key FROM f) GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

OP8 = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, c.r, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r AND q.vec_id % 20 = 0 AND len(q.x) = len(c.x)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""

#: How many times the held sources are found; each round holds one source at least until none is above its limit.
_ROUNDS = 8
#: How many times documents that reach three copies are set apart: a weight that isn't full below one that is can be
#: so only a few times over.
_UNIT_ROUNDS = 16
_FILLS = 4


def _op7() -> str:
    """Targets round by round; then each source's copies a unit of weight, round by round; then its documents in
    Pareto order up to the words that whole copies leave, and more documents into what is still missing."""
    rounds = "h0 AS (SELECT source, source_size, w, FALSE AS held FROM s)"
    for n in range(_ROUNDS):
        rounds += f""",
h{n + 1} AS (SELECT source, source_size, w, held OR share > 3 * source_size AS held FROM (SELECT *, CAST((sum(source_size) OVER () - sum(CASE WHEN held THEN 3 * source_size ELSE 0 END) OVER ()) * w AS DOUBLE) / CAST(sum(CASE WHEN held THEN 0 ELSE w END) OVER () AS DOUBLE) AS share FROM h{n}))"""
    units = "u0 AS (SELECT d.source, m, sum(size) AS words, max(target) >= 3 * max(source_size) AS atop FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, m)"
    per_unit = "CASE WHEN sum(CASE WHEN atop THEN 0 ELSE m * words END) OVER (PARTITION BY x.source) > 0 THEN (target - CAST(3 * sum(CASE WHEN atop THEN words ELSE 0 END) OVER (PARTITION BY x.source) AS DOUBLE)) / CAST(sum(CASE WHEN atop THEN 0 ELSE m * words END) OVER (PARTITION BY x.source) AS DOUBLE) ELSE 0 END"
    for n in range(_UNIT_ROUNDS):
        units += f""",
u{n + 1} AS (SELECT source, m, words, atop OR c * m >= 3 AS atop FROM (SELECT x.*, {per_unit} AS c FROM u{n} x JOIN t ON x.source IS NOT DISTINCT FROM t.source))"""
    fills = ",".join(
        f"""f{n} AS (SELECT n FROM (SELECT *, rest - sum(CASE WHEN taken THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM g{n}) WHERE NOT taken AND p > 0 AND size <= gap AND 2 * size > gap QUALIFY row_number() OVER (PARTITION BY source ORDER BY value, doc_id, size) = 1),
g{n + 1} AS (SELECT * EXCLUDE (taken), taken OR n IN (SELECT n FROM f{n}) AS taken FROM g{n})"""
        for n in range(_FILLS)
    )
    return rf"""
WITH d AS (SELECT *, length(bin(size)) AS m FROM (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM s0),
{rounds},
t AS (SELECT source, source_size, CASE WHEN held THEN CAST(3 * source_size AS DOUBLE) ELSE coalesce(share, 0) END AS target FROM (SELECT *, CAST((sum(source_size) OVER () - sum(CASE WHEN held THEN 3 * source_size ELSE 0 END) OVER ()) * w AS DOUBLE) / CAST(sum(CASE WHEN held THEN 0 ELSE w END) OVER () AS DOUBLE) AS share FROM h{_ROUNDS})),
{units},
c AS (SELECT source, m, CASE WHEN atop THEN 3.0::DOUBLE ELSE c * m END AS copies FROM (SELECT x.*, {per_unit} AS c FROM u{_UNIT_ROUNDS} x JOIN t ON x.source IS NOT DISTINCT FROM t.source)),
x AS (SELECT doc_id, size, d.source, source_size, target, CASE WHEN size > 0 THEN copies ELSE 0 END AS copies,
             (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.m = c.m),
p AS (SELECT *, copies - floor(copies) AS p, target - CAST(sum(floor(copies) * size) OVER (PARTITION BY source) AS DOUBLE) AS rest FROM x),
v AS (SELECT *, CASE WHEN u * (1 - p) + (1 - u) * p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) ELSE 1 END AS value FROM p),
r AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY value, doc_id, size ROWS UNBOUNDED PRECEDING) AS reach FROM v),
g0 AS (SELECT *, row_number() OVER () AS n, p > 0 AND reach <= rest AS taken FROM r),
{fills}
SELECT doc_id, size, source_size, target, CAST((floor(copies) + CASE WHEN taken THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM g{_FILLS}
"""


def _op11(rounds: int = 6) -> str:
    """Every round: parts to their nearest entries, entries to the floors of their means."""
    dealt = """
a{n} AS MATERIALIZED (SELECT p.r, p.part, p.x, c.entry, c.d FROM p,
      LATERAL (SELECT entry, list_sum(list_transform(list_zip(p.x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM c{n} WHERE c{n}.part = p.part ORDER BY d, entry LIMIT 1) c)"""
    moved = """
c{m} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN (
      SELECT part, entry, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY place) AS e FROM (
        SELECT part, entry, place, sum(v) AS s, count(*) AS k FROM (SELECT part, entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS place FROM a{n}) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))"""
    steps = ",".join(dealt.format(n=n) + "," + moved.format(n=n, m=n + 1) for n in range(rounds)) + "," + dealt.format(n=rounds)
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 8) + 1:(part + 1) * (len(x) // 8)] AS x FROM v, range(8) t(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS e FROM p WHERE r <= 16),{steps},
b AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
f AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM v JOIN f USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM v JOIN f USING (r) JOIN l ON v.label IS NOT DISTINCT FROM l.label, b
"""


_TERMS = WORDS.replace("text", "{0}.text")

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("documents")} AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS.format("benchmark")}) AS w FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0),
asked AS (SELECT item, item_id, unnest(w) AS term FROM i),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
m AS (SELECT r, doc_id, 10 + (90 * len(w) * n_docs) // n_words AS m FROM d, s),
x AS (SELECT item, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM asked JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (r) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x QUALIFY rank <= 10
"""


ORACLES = {"op1_decontaminate": OP1, "op2_secrets": OP2, "op3_url_filter": OP3, "op4_chat_format": OP4, "op5_near_duplicates": OP5, "op6_line_dedup": OP6, "op7_mix": _op7(), "op8_topk": OP8, "op11_vector_codes": _op11(), "op13_lexical_search": OP13}
