"""DuckDB SQL for the queries of this package that SQL can express.

No SQL is given for op2, op5 and op9 (trained models) and op6 (random rounding).
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK_WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_BENCH_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS rid, doc_id, {_BENCH_WORDS} AS w FROM documents),
occ AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
              FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item FROM occ JOIN win USING (n, g)),
found AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
          FROM hit GROUP BY rid),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit
            FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN found USING (rid) LEFT JOIN covered USING (rid)
"""

OP3 = """
WITH line AS (
  SELECT doc_id, source, raw, pos, trim(raw, concat(' ', chr(9), chr(13), chr(11), chr(12))) AS line
  FROM (SELECT doc_id, source, unnest(l) AS raw, unnest(range(len(l))) AS pos
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
place AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, pos) AS nth FROM line),
spread AS (
  SELECT line, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS sites
  FROM line WHERE line <> '' GROUP BY line HAVING sites >= 10),
judged AS (SELECT p.*, s.line IS NOT NULL AND nth > 1 AS gone FROM place p LEFT JOIN spread s ON p.line = s.line),
kept AS (
  SELECT doc_id, count_if(line <> '') AS n_lines, count_if(gone) AS n_removed,
         string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS t
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id
"""

OP4 = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g
        FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 - 99 AS BIGINT))) AS i FROM doc WHERE len(h) >= 200)),
hit AS (SELECT doc_id, i FROM (
          SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) AS nth FROM win)
        WHERE nth > 1),
edge AS (SELECT doc_id, i, coalesce(lag(i) OVER w + 100, 0) AS a, lag(i) OVER w IS NULL OR i > lag(i) OVER w + 100 AS opens
         FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
gap AS (SELECT doc_id, a, i AS b, opens FROM edge
        UNION ALL SELECT d.doc_id, coalesce(m.last + 100, 0), len(h) // 2, false
        FROM doc d LEFT JOIN (SELECT doc_id, max(i) AS last FROM hit GROUP BY doc_id) m ON d.doc_id IS NOT DISTINCT FROM m.doc_id),
kept AS (SELECT d.doc_id, any_value(h) AS h, count_if(opens) AS n_spans,
                coalesce(string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) FILTER (WHERE b > a), '') AS k
         FROM gap JOIN doc d ON d.doc_id IS NOT DISTINCT FROM gap.doc_id GROUP BY d.doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST((len(h) - len(k)) // 2 AS BIGINT) AS n_removed,
       CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM kept
"""

OP7 = f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_BLANK_WORD}) AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
         FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM gram GROUP BY doc_id),
node AS (SELECT k, n, min(doc_id) AS v FROM sets GROUP BY k, n),
freq AS (SELECT g, count(*) AS f FROM gram GROUP BY g),
own AS (SELECT v, n, gram.g, row_number() OVER (PARTITION BY v ORDER BY f, gram.g) AS r
        FROM node JOIN gram ON gram.doc_id = v JOIN freq USING (g)),
lead AS (SELECT v, n, g FROM own WHERE r <= n - CAST(ceil(0.8 * n - 1e-9) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.v AS a, b.v AS b, a.n AS na, b.n AS nb FROM lead a JOIN lead b USING (g)
         WHERE a.v < b.v AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
pair AS (SELECT a, b FROM cand JOIN own x ON x.v = a JOIN own y ON y.v = b AND y.g = x.g
         GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach(a, b) AS (SELECT v, v FROM node UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
comp AS (SELECT a AS v, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id,
       coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN node USING (k, n) LEFT JOIN comp USING (v)
"""

OP8 = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK_WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM doc WHERE len(w) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least_id FROM win)
        WHERE least_id < doc_id),
gap AS (SELECT doc_id, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, 0) AS a, i AS b FROM hit
        UNION ALL SELECT d.doc_id, coalesce(m.last + 50, 0), len(w)
        FROM doc d LEFT JOIN (SELECT doc_id, max(i) AS last FROM hit GROUP BY doc_id) m USING (doc_id)),
kept AS (SELECT doc_id, flatten(list(w[a + 1:b] ORDER BY a, b) FILTER (WHERE b > a)) AS k
         FROM gap JOIN doc USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(len(k), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM doc JOIN kept USING (doc_id)
"""

OP10 = """
WITH url AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
             FROM pages),
part AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                   'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM url),
ruled AS (SELECT page_id, host, path, CASE
            WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/'
            WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule FROM part)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

OP11 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT rid, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS c_lang FROM occ GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
of_lang AS (SELECT lang, count(*) AS v, sum(c_lang) AS n_lang FROM kept GROUP BY lang),
of_group AS (SELECT lang, source, term, count(*) AS c FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n
        FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN of_group o ON o.lang = g.lang AND o.source = g.source
        GROUP BY ALL),
share AS (
  SELECT grp.lang, grp.source, term, coalesce(c, 0) AS c,
         CAST(1 + 1000000000::HUGEINT * (coalesce(c, 0) + 5) // (n + 5 * v) AS BIGINT) AS p,
         CAST(1 + 1000000000::HUGEINT * (c_lang + 5) // (n_lang + 5 * v) AS BIGINT) AS q
  FROM grp JOIN kept USING (lang) JOIN of_lang USING (lang) LEFT JOIN of_group USING (lang, source, term)),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN share x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN share y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM share WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM found)
SELECT lang, source, part, item, value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 50
"""

# XXH64 with seed 42: arithmetic modulo 2**64.  The primes are fixed values of the hash.
_P1, _P2, _P3, _P4, _P5 = (f"{p}::UHUGEINT" for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_M = "18446744073709551616::UHUGEINT"


def _rotl(x: str, r: int) -> str:
    return f"(({x}) * {1 << r}::UHUGEINT % {_M} + ({x}) // {1 << (64 - r)}::UHUGEINT)"


def _xor(x: str, y: str) -> str:
    return f"xor(({x})::UBIGINT, ({y})::UBIGINT)::UHUGEINT"


def _round(acc: str, lane: str) -> str:
    moved = f"((({acc}) + ({lane})::UHUGEINT * {_P2} % {_M}) % {_M})"
    return f"({_rotl(moved, 31)} * {_P1} % {_M})"


def _number(digits: str, size: int) -> str:
    """The little-endian number of ``size`` bytes given by hex digits."""
    return "('0x' || " + " || ".join(f"substr({digits}, {2 * i + 1}, 2)" for i in reversed(range(size))) + ")::UBIGINT"


def _lane(i: int) -> str:
    start = {1: f"{_P1} + {_P2} + 42", 2: f"{_P2} + 42", 3: "42::UHUGEINT", 4: f"{_M} + 42 - {_P1}"}[i]
    return (f"list_reduce(list_prepend(({start}) % {_M}, [x::UHUGEINT FOR x IN list_transform(range(n // 32), "
            f"lambda s: lanes[4 * s + {i}])]), lambda acc, x: {_round('acc', 'x')}) AS v{i}")


def _joined() -> str:
    h = " + ".join(_rotl(f"v{i}", r) for i, r in ((1, 1), (2, 7), (3, 12), (4, 18)))
    return f"(({h}) % {_M})"


_MERGE = f"(({_xor('h', _round('0::UHUGEINT', 'x'))}) * {_P1} + {_P4}) % {_M}"
_EIGHT = f"({_rotl(_xor('h', _round('0::UHUGEINT', 'x')), 27)} * {_P1} % {_M} + {_P4}) % {_M}"
_FOUR = f"({_rotl(_xor('h8', f'four * {_P1} % {_M}'), 23)} * {_P2} % {_M} + {_P3}) % {_M}"
_ONE = f"{_rotl(_xor('h', f'x * {_P5} % {_M}'), 11)} * {_P1} % {_M}"

OP12 = rf"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_BLANK_WORD}) AS w FROM documents),
gram AS (SELECT rid, array_to_string(w[i:i + 3], ' ') AS g
         FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
b0 AS (SELECT g, hex(encode(g)) AS d, len(hex(encode(g))) // 2 AS n FROM (SELECT DISTINCT g FROM gram)),
b1 AS (SELECT g, d, n, list_transform(range(n // 8), lambda i: {_number('substr(d, 16 * i + 1, 16)', 8)}) AS lanes FROM b0),
b2 AS (SELECT g, d, n, lanes, {_lane(1)}, {_lane(2)}, {_lane(3)}, {_lane(4)} FROM b1),
b3 AS (SELECT g, d, n, lanes, CASE WHEN n < 32 THEN {_P5} + 42 + n::UHUGEINT
         ELSE (list_reduce([{_joined()}, v1, v2, v3, v4], lambda h, x: {_MERGE}) + n::UHUGEINT) % {_M} END AS h FROM b2),
b4 AS (SELECT g, d, n, list_reduce(list_prepend(h, [x::UHUGEINT FOR x IN lanes[4 * (n // 32) + 1:]]),
                                   lambda h, x: {_EIGHT}) AS h8,
              CASE WHEN n % 8 >= 4 THEN ({_number('substr(d, 16 * (n // 8) + 1, 8)', 4)})::UHUGEINT END AS four FROM b3),
b5 AS (SELECT g, d, n, CASE WHEN four IS NULL THEN h8 ELSE {_FOUR} END AS h4 FROM b4),
b6 AS (SELECT g, list_reduce(list_prepend(h4, [('0x' || substr(d, 2 * i + 1, 2))::UBIGINT::UHUGEINT
                                               FOR i IN range(4 * (n // 4), n)]), lambda h, x: {_ONE}) AS h FROM b5),
b7 AS (SELECT g, {_xor('h', 'h // 8589934592::UHUGEINT')} * {_P2} % {_M} AS h FROM b6),
b8 AS (SELECT g, {_xor('h', 'h // 536870912::UHUGEINT')} * {_P3} % {_M} AS h FROM b7),
hash AS (SELECT g, ({_xor('h', 'h // 4294967296::UHUGEINT')})::UBIGINT AS h FROM b8),
ones AS (SELECT rid, b, count(*) AS n, sum((h >> b) & 1) AS c
         FROM gram JOIN hash USING (g), (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY rid, b),
bits AS (SELECT rid, bit_or(CASE WHEN 2 * c > n THEN 1::UBIGINT << b ELSE 0::UBIGINT END) AS f FROM ones GROUP BY rid),
mark AS (SELECT rid, doc_id, coalesce(f, 0)::UBIGINT AS f FROM doc LEFT JOIN bits USING (rid)),
node AS (SELECT f, min(doc_id) AS v FROM mark GROUP BY f),
edge AS (SELECT a.f AS a, b.f AS b FROM node a, node b WHERE bit_count(xor(a.f, b.f)) <= 4),
reach(a, b) AS (SELECT f, f FROM node UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
comp AS (SELECT reach.a AS f, min(v) AS c FROM reach JOIN node ON node.f = reach.b GROUP BY reach.a)
SELECT doc_id, lpad(lower(to_hex(f)), 16, '0') AS fingerprint, c AS component_id FROM mark JOIN comp USING (f)
"""


def _edit(c: str, cost: int, letter: str, line: str = "''") -> str:
    """A state's value: nine digits of cost, the audit, chr(1), the repaired lines; NULL stays."""
    return (f"(lpad(CAST(CAST(substr({c}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || "
            f"substr({c}, 10, strpos({c}, chr(1)) - 10) || '{letter}' || substr({c}, strpos({c}, chr(1))) || {line})")


_KEPT_LINE = "(chr(10) || role || ':' || text)"
_AS_USER, _AS_ANSWER = "(chr(10) || 'user:' || text)", "(chr(10) || 'assistant:' || text)"
_NEW_USER, _NEW_ANSWER = "(chr(10) || 'user:')", "(chr(10) || 'assistant:')"


def _stay(c: str, when: str, cost: int, letter: str, line: str) -> str:
    sound, cut = _edit(c, cost, letter, line), _edit(c, cost + 3, letter, line)
    return f"CASE WHEN fault < 2 AND {when} THEN CASE WHEN fault = 1 THEN {cut} ELSE {sound} END END"


_INSERTED = f"""(SELECT *, least(s3, {_edit('u', 3, 'I', _NEW_ANSWER)}) AS a
      FROM (SELECT *, least(s2, {_edit('s0', 3, 'I', _NEW_USER)}, {_edit('s1', 3, 'I', _NEW_USER)},
                            {_edit('s3', 3, 'I', _NEW_USER)}) AS u FROM walk))"""

OP13 = rf"""
WITH RECURSIVE code AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
coded AS (
  SELECT * EXCLUDE (k, t), xor(list_reduce(list_prepend(4294967295, [ascii(x) FOR x IN string_split(k, '')]),
           lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 20 AS kind FROM keyed, code),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS t FROM damaged),
judged AS (
  SELECT *, t = '' AS blank, t <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         substr(lag(role) OVER w, 1, 1) || substr(role, 1, 1) AS two, substr(role, 1, 1) AS r1
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
faulty AS (
  SELECT *, NOT blank AND NOT again AND right(t, 1) NOT IN ('.', '!', '?') AS cut,
         CASE WHEN blank OR again THEN 2 WHEN NOT blank AND right(t, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault
  FROM judged),
walk(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '000000000' || chr(1), NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM faulty
  UNION ALL
  SELECT b.conv_id, f.i,
         {_edit('s0', 4, 'D')},
         least({_edit('s1', 4, 'D')}, {_stay('s0', "r1 = 's'", 0, 'K', _KEPT_LINE)}),
         least({_edit('u', 4, 'D')}, {_stay('s0', "r1 = 'u'", 0, 'K', _KEPT_LINE)}, {_stay('s1', "r1 = 'u'", 0, 'K', _KEPT_LINE)},
               {_stay('a', "r1 = 'u'", 0, 'K', _KEPT_LINE)}, {_stay('s0', 'true', 3, 'R', _AS_USER)},
               {_stay('s1', 'true', 3, 'R', _AS_USER)}, {_stay('a', 'true', 3, 'R', _AS_USER)}),
         least({_edit('a', 4, 'D')}, {_stay('u', "r1 = 'a'", 0, 'K', _KEPT_LINE)}, {_stay('u', 'true', 3, 'R', _AS_ANSWER)})
  FROM {_INSERTED} b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1),
told AS (
  SELECT conv_id, CAST(max(turn) - min(turn) + 1 - count(DISTINCT turn) AS BIGINT) AS gaps, count_if(blank) AS blank,
         count_if(again) AS duplicate, count_if(cut) AS truncated,
         count_if(two NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faulty GROUP BY conv_id),
ends AS (SELECT b.conv_id, b.i, least(s0, a) AS e FROM {_INSERTED} b)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(CAST(substr(e, 1, 9) AS BIGINT), 0) AS cost,
       coalesce(substr(e, 10, strpos(e, chr(1)) - 10), '') AS audit,
       sha256(coalesce(substr(e, strpos(e, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id AND ends.i = told.n AND told.n IS NOT NULL
"""

ORACLES = {"op1_decontamination": OP1, "op3_line_dedup": OP3, "op4_suffix_dedup": OP4, "op7_minhash": OP7,
           "op8_substring_dedup": OP8, "op10_url_filter": OP10, "op11_source_divergence": OP11, "op12_simhash": OP12,
           "op13_conversation_repair": OP13}
