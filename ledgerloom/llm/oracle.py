"""DuckDB SQL for the queries that SQL can express."""

from .ball_search import TERM
from .licenses import CUES, TEMPLATES, THRESHOLD, TOKEN

OP4 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), judged AS (
  SELECT page_id, host, path,
         CASE
           WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
           WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
           WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
           WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/'
         END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _kind(name: str, number: int, pattern: str, group: int, least: int, more: str = "true") -> str:
    """Spans of a kind: places from the texts between the matches, values from a group."""
    return f"""
  SELECT rn, doc_id, source, {number} AS k, '{name}' AS kind, pos AS s, pos + length(m) AS e, v FROM (
    SELECT rn, doc_id, source, m, v, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM (
      SELECT rn, doc_id, source, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g
      FROM (SELECT rn, doc_id, source, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs, string_split_regex(t, '{pattern}') AS gs FROM d)
    ) WINDOW w AS (PARTITION BY rn ORDER BY i)
  ) WHERE length(v) >= {least} AND {more}"""


OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
base AS ({_kind("assign", 0, _ASSIGN, 2, 12)} UNION ALL {_kind("access", 1, "AKIA[A-Z0-9]+", 0, 18)} UNION ALL {_kind("hex", 2, "[0-9a-f]+", 0, 16)}),
tokens AS ({_kind("token", 3, "[A-Za-z0-9_-]{24,}", 0, 24, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')")}),
apart AS (SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rn = t.rn AND b.s < t.e AND t.s < b.e)),
owners AS (SELECT v, count(DISTINCT source) AS n FROM (SELECT v, source FROM base UNION ALL SELECT v, source FROM apart) GROUP BY v),
spans AS (SELECT rn, s, k, e, kind FROM base UNION ALL SELECT rn, s, k, e, kind FROM apart JOIN owners USING (v) WHERE n < 4),
held AS (
  SELECT rn, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY rn
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN held USING (rn)
"""

_VALUES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))

OP2 = rf"""
WITH files AS (
  SELECT row_number() OVER () AS rn, doc_id, concat_ws('/', source, doc_id // 1000, doc_id // 100, doc_id) AS path, coalesce(text, '') AS t FROM documents
), templates AS (
  SELECT i, licence, unnest(regexp_extract_all(lower(body), '{TOKEN}')) AS tok FROM (VALUES {_VALUES}) v(i, licence, body)
), lines AS (
  SELECT rn, l, line FROM (SELECT rn, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS l FROM files) WHERE regexp_matches(line, '{CUES}')
), tokens AS (
  SELECT rn, l, tok, count(*) AS tf FROM (SELECT rn, l, unnest(regexp_extract_all(lower(line), '{TOKEN}')) AS tok FROM lines) GROUP BY ALL
), total AS (SELECT count(*) AS n FROM files),
vocabulary AS (SELECT tok, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT tok FROM templates) LEFT JOIN (SELECT tok, count(DISTINCT rn) AS df FROM tokens GROUP BY tok) USING (tok), total),
weighed AS (SELECT i, licence, tok, count(*) * any_value(idf) AS w FROM templates JOIN vocabulary USING (tok) GROUP BY ALL),
units AS (SELECT i, licence, tok, w / sqrt(sum(w * w) OVER (PARTITION BY i)) AS u FROM weighed),
terms AS (SELECT rn, l, tok, tf * coalesce(idf, ln(1 + n) + 1) AS w FROM tokens LEFT JOIN vocabulary USING (tok), total),
lengths AS (SELECT rn, l, sqrt(sum(w * w)) AS len FROM terms GROUP BY ALL),
scores AS (SELECT rn, l, licence, round(sum(w * u) / any_value(len), 6) AS score FROM terms JOIN units USING (tok) JOIN lengths USING (rn, l) GROUP BY rn, l, i, licence),
best AS (SELECT rn, l, max(struct_pack(score := score, licence := licence)) AS b FROM scores GROUP BY ALL HAVING max(score) >= {THRESHOLD}),
own AS (SELECT rn, coalesce(max(b) FILTER (b.licence <> 'proprietary'), max(b)) AS b, sum(length(line)) AS held FROM best JOIN lines USING (rn, l) GROUP BY rn),
judged AS (SELECT files.rn, doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, b, 2 * held >= length(t) AS covers FROM files LEFT JOIN own USING (rn)),
licensed AS (SELECT dir, max(b) AS found FROM judged WHERE covers GROUP BY dir),
dirs AS (SELECT DISTINCT dir FROM judged WHERE b IS NULL),
nearest AS (SELECT d.dir, arg_max(found, length(l.dir)) AS found FROM dirs d JOIN licensed l ON d.dir = l.dir OR starts_with(d.dir, l.dir || '/') GROUP BY d.dir)
SELECT doc_id, path, coalesce(b, found).licence AS licence, CASE WHEN b IS NOT NULL THEN 'own' WHEN found IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, coalesce(b, found).score AS score
FROM judged LEFT JOIN nearest USING (dir)
"""

_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce({_TERMS}, []) AS terms FROM documents),
size AS (SELECT rn, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM size),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
held AS (SELECT rn, term, count(*) AS tf FROM (SELECT rn, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, whole GROUP BY term),
parts AS (SELECT rn, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS part FROM held JOIN size USING (rn) JOIN weights USING (term), whole),
scores AS (SELECT item_id, rn, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores
QUALIFY rank <= 50
"""

_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _way(cost: str, letter: str, line: str, then: str) -> str:
    """A way that begins with an edit: its cost, its audit and its lines, each ended by a newline."""
    return f"struct_pack(c := {then}.c + {cost}, a := '{letter}' || {then}.a, t := {line} || {then}.t)"


def _edited(state: int, kept: str, due: tuple[str, int]) -> str:
    """The least way of a state at a row, before rows may be inserted; kept: by initial, the state after keeping the row."""
    role, then = due
    keep = " ".join(f"WHEN i = '{x}' THEN {_way('cut', 'K', line, f's{n}')}" for x, n in kept for line in ["role || ':' || text || chr(10)"])
    keeps = f"CASE WHEN must THEN struct_pack(c := 1000000000, a := '', t := '') {keep} ELSE struct_pack(c := 1000000000, a := '', t := '') END"
    line = f"'{role}:' || text || chr(10)"
    reroles = f"CASE WHEN must THEN struct_pack(c := 1000000000, a := '', t := '') ELSE {_way('2 + cut', 'R', line, f's{then}')} END"
    return _least(_way("3", "D", "''", f"s{state}"), keeps, reroles) + f" AS b{state}"


OP13 = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS k FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations)
), harmed AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END)
  FROM keyed WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM harmed
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown
  FROM placed
), judged AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN shown[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, count(*) OVER (PARTITION BY conv_id) AS top FROM seen
), found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), ways AS (
  SELECT conv_id, max(n) AS n, struct_pack(c := 0, a := '', t := '') AS s0, struct_pack(c := 4, a := 'II', t := 'user:' || chr(10) || 'assistant:' || chr(10)) AS s1,
         struct_pack(c := 2, a := 'I', t := 'assistant:' || chr(10)) AS s2, struct_pack(c := 0, a := '', t := '') AS s3
  FROM judged GROUP BY conv_id
  UNION ALL
  SELECT conv_id, n - 1, {_least("b0", _way("2", "I", "'user:' || chr(10)", "u"))}, {_least("b1", _way("2", "I", "'user:' || chr(10)", "u"))}, u, {_least("b3", _way("2", "I", "'user:' || chr(10)", "b2"))}
  FROM (
    SELECT *, {_least("b2", _way("2", "I", "'assistant:' || chr(10)", "b3"))} AS u FROM (
      SELECT conv_id, n, {_edited(0, [("s", 1), ("u", 2)], ("user", 2))}, {_edited(1, [("u", 2)], ("user", 2))}, {_edited(2, [("a", 3)], ("assistant", 3))}, {_edited(3, [("u", 2)], ("user", 2))}
      FROM (SELECT w.conv_id, w.n, s0, s1, s2, s3, role, text, role[1] AS i, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.n = w.n)
    )
  )
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(left(s0.t, length(s0.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN (SELECT * FROM ways WHERE n = 0) w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLES = {
    "op2_license_scans": OP2,
    "op4_url_filters": OP4,
    "op8_secret_scans": OP8,
    "op12_lexical_search": OP12,
    "op13_conversation_repair": OP13,
}
