"""The corpus queries that SQL can express, as DuckDB SQL over whole tables."""

from __future__ import annotations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UP}', '{LOW}')"


NO_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower('text')}, '{NO_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lower('text')}, '{NO_WORD}') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, CASE WHEN len(w) <= 10 THEN w ELSE w[i:i + 9] END AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
pos AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS piece
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(i)
),
hit AS (SELECT doc_id, i, n, item FROM pos JOIN wins ON len(win) = n AND array_to_string(win, ' ') = piece),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

BLANK = r"[\x20\x09-\x0D]"

OP7 = rf"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line FROM cut, unnest(range(1, len(ls) + 1)) t(i)),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g'), '{UP}', '{LOW}') AS key FROM l),
common AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
f AS (SELECT k.doc_id, i, line, keeper IS NOT NULL AND keeper <> k.doc_id AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

SECRET = {
    "assign": r"""(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "pem": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
}
LEAST = {"assign": (2, 6), "access": (0, 20), "hex": (0, 24), "pem": (0, 0), "jwt": (0, 0)}


def secret_part(order: int, kind: str) -> str:
    flag = "(?i)" if kind == "assign" else ""
    group, least = LEAST[kind]
    pattern = flag + SECRET[kind]
    return f"""
SELECT doc_id, '{kind}' AS kind, {order} AS ord, start, start + len AS stop FROM (
  SELECT doc_id, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(full_[1:i - 1], lambda x: length(x))), 0) AS start,
    length(full_[i]) AS len, length(part[i]) AS val
  FROM (
    SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS full_,
      regexp_extract_all(t, '{pattern}', {group}) AS part
    FROM d WHERE regexp_matches(t, '{pattern}')
  ), unnest(range(1, len(full_) + 1)) u(i)
) WHERE val >= {least}"""


OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(secret_part(i, k) for i, k in enumerate(SECRET))}),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)), ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
    string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)), ',' ORDER BY start, ord) AS spans
  FROM s GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS piece
  FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (piece) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
),
link AS (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)
),
ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT doc_id, y FROM reach JOIN ways ON r = x
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

def share(symbols: str) -> str:
    return f"(length(t) - length(translate(t, '{symbols}', ''))) / greatest(length(t), 1)"


def fill(cap: str, want: str, total: str, by: str, then: str, table: str) -> str:
    """``table`` with ``factor``, for which the sum of least(cap, factor * want) per ``by`` is ``total``."""
    part = f"PARTITION BY {by}" if by else ""
    order = f"{part} ORDER BY CASE WHEN {want} > 0 THEN {cap} / {want} ELSE CAST('inf' AS DOUBLE) END, {then}"
    return f"""
SELECT * EXCLUDE (before, rest), coalesce(max(CASE WHEN rest > 0 THEN ({total} - before) / rest END) OVER ({part}), 0) AS factor FROM (
  SELECT *, coalesce(sum({cap}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum({want}) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {table})"""


def within_caps(margin: str) -> str:
    held = f"""(SELECT value, cap, coalesce(wanted, 0) AS wanted
  FROM (SELECT {margin} AS value, sum(cap) AS cap FROM c0 GROUP BY 1) LEFT JOIN to_{margin} USING (value))"""
    return f"own_{margin} AS (SELECT value, least(cap, factor * wanted) AS goal FROM ({fill('cap', 'wanted', '1.0', '', 'value', held)}))"


def of_step(source: str, lang: str, topic: str) -> str:
    return f"CASE k % 3 WHEN 0 THEN {source} WHEN 1 THEN {lang} ELSE {topic} END"


def raking(rounds: int, every: int, tolerance: float) -> str:
    """Steps of a recursion, one per margin, each a window over the cells; every few rounds the gaps may end it."""
    gap = [f"CASE WHEN h_{m} > 0 THEN abs(h_{m} - g_{m}) ELSE 0 END" for m in ("source", "lang", "topic")]
    held = ", ".join(f"sum(least(raw, cap)) OVER (PARTITION BY {m}) AS h_{m}" for m in ("source", "lang", "topic"))
    now = f"""(
  SELECT *, {of_step('source', 'lang', 'topic')} AS v, {of_step('g_source', 'g_lang', 'g_topic')} AS goal
  FROM (SELECT *, max(greatest({', '.join(gap)})) OVER () AS gap FROM (SELECT *, {held} FROM steps WHERE k < {3 * rounds}))
  WHERE k = 0 OR k % {3 * every} > 0 OR gap > {tolerance})"""
    step = fill("cap", "raw", "goal", "v", "source, lang, topic", now)
    return f"""steps AS (
  SELECT 0 AS k, * FROM w0 UNION ALL
  SELECT k + 1, source, lang, topic, tokens, cap, least(raw * factor, 1e200), g_source, g_lang, g_topic FROM ({step})
), raked AS (SELECT * FROM steps WHERE k = (SELECT max(k) FROM steps))"""


def target(margin: str) -> str:
    return f"""to_{margin} AS (
  SELECT value, p / sum(p) OVER () AS wanted FROM (
    SELECT {margin} AS value, pow(CAST(sum(tokens) AS DOUBLE), 0.7) AS p FROM cells GROUP BY 1 HAVING sum(tokens) > 0
  )
)"""


OP4 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, coalesce(text, '') AS t,
    CASE WHEN {share('|')} >= 0.02 THEN 'table' WHEN {share('%$#*&<>{}[]=')} >= 0.05 THEN 'markup'
      WHEN {share(UP)} >= 0.3 THEN 'loud' WHEN length(t) >= 1000 THEN 'prose' ELSE 'short' END AS topic,
    CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
{target('source')}, {target('lang')}, {target('topic')},
c0 AS (SELECT *, CAST(tokens AS DOUBLE) / greatest(0.6 * (SELECT sum(tokens) FROM cells), 1e-300) AS cap FROM cells),
{within_caps('source')}, {within_caps('lang')}, {within_caps('topic')},
w0 AS (
  SELECT source, lang, topic, tokens, cap, cap * 0.6 AS raw, a.goal AS g_source, b.goal AS g_lang, c.goal AS g_topic
  FROM c0 JOIN own_source a ON source = a.value JOIN own_lang b ON lang = b.value JOIN own_topic c ON topic = c.value
),
{raking(36, 3, 1e-7)},
p AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN least(raw, cap) / cap ELSE 0 END, 6) AS p FROM raked)
SELECT doc_id, source, lang, topic, n_tokens, p AS probability,
  CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 < p AS kept
FROM d JOIN p USING (source, lang, topic)
"""

def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda x, b: {step}), 4294967295)"


def with_cost(value: str, cost: int, letters: str) -> str:
    return f"lpad(CAST(CAST({value}[1:6] AS INTEGER) + {cost} AS VARCHAR), 6, '0') || {value}[7:] || '{letters}'"


def least_words() -> str:
    """One row's step: four states (start, s, u, a), each a cost of six digits and the word so far."""
    inserted = [[0, 2, 3], [1, 2, 3], [2, 3, 2], [3, 2, 3]]
    to: list[list[str]] = [[], [], [], []]
    for q in range(4):
        for n, at in enumerate(inserted[q]):
            value, ins = f"acc[{q + 1}]", "I" * n
            to[at].append(with_cost(value, 2 * n + 3, ins + "D"))
            more = f"CASE WHEN k[1][2:2] = 't' THEN {{}} ELSE {{}} END"
            keep = lambda c, w: more.format(with_cost(value, c + 1, w), with_cost(value, c, w))  # noqa: E731, B023
            turn, then = ("a", 3) if at == 2 else ("u", 2)
            to[then].append(f"CASE WHEN k[1] <> 'd' THEN {keep(2 * n + 2, ins + 'R')} END")
            to[then].append(f"CASE WHEN k[1][1:1] = '{turn}' THEN {keep(2 * n, ins + 'K')} END")
            if at == 0:
                to[1].append(f"CASE WHEN k[1][1:1] = 's' THEN {keep(2 * n, ins + 'K')} END")
    return "[" + ", ".join(f"least({', '.join(w)})" for w in to) + "]"


OP11 = rf"""
WITH h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations
),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
    regexp_replace(text, '{BLANK}+$', '') AS bare, substr(role, 1, 1) AS ini FROM d
),
f AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY rn) AS before
  FROM o
),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal,
    list([CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' ELSE CASE WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'x' END
      || CASE WHEN fault = 'truncated' THEN 't' ELSE '' END END] ORDER BY rn) AS kinds
  FROM f GROUP BY conv_id
),
p AS (
  SELECT *, list_reduce(list_prepend(['000000', NULL, NULL, NULL], kinds), lambda acc, k: {least_words()}) AS v FROM g
),
e AS (
  SELECT * EXCLUDE (kinds, v), least(v[1], {with_cost('v[2]', 4, 'II')}, {with_cost('v[3]', 2, 'I')}, v[4]) AS best FROM p
),
l AS (
  SELECT conv_id, i, best[6 + i:6 + i] AS c, sum(CASE WHEN c = 'I' THEN 0 ELSE 1 END) OVER w AS rn, sum(CASE WHEN c = 'D' THEN 0 ELSE 1 END) OVER w AS pos
  FROM e, unnest(range(1, length(best) - 5)) t(i) WINDOW w AS (PARTITION BY conv_id ORDER BY i)
),
m AS (
  SELECT l.*, f.role, f.text, max(CASE WHEN pos = 1 AND c = 'K' AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS s
  FROM l LEFT JOIN f ON c <> 'I' AND l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.rn = f.rn
),
r AS (
  SELECT conv_id, string_agg(CASE WHEN c = 'K' THEN role WHEN (pos + s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN c = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS fixed FROM m WHERE c <> 'D' GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(best[1:6] AS BIGINT), 0) AS cost,
  coalesce(best[7:], '') AS audit, sha256(coalesce(fixed, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
  LEFT JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""


def counted(value: str) -> str:
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def leaf(n_chars: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return f"sha256({' || '.join(map(counted, fields))})"


def levels(name: str, start: str) -> str:
    """Nodes (tree, level, idx, h, n) above the given leaves."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, idx, h, n FROM {start}
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), max((n + 1) // 2) FROM {name} WHERE n > 1
  GROUP BY tree, level, idx // 2
)"""


def ways(name: str, start: str, nodes: str) -> str:
    """For each leaf its siblings as (left, right), from below."""
    return f"""{name} AS (
  SELECT s.tree, s.idx, list({{'l': coalesce(a.h, ''), 'r': coalesce(b.h, ''), 'h': ''}} ORDER BY v.level) FILTER (v.n > 1) AS way
  FROM {start} s JOIN {nodes} v ON v.tree = s.tree AND v.idx = s.idx >> v.level
  LEFT JOIN {nodes} a ON a.tree = v.tree AND a.level = v.level AND v.idx % 2 = 1 AND a.idx = v.idx - 1
  LEFT JOIN {nodes} b ON b.tree = v.tree AND b.level = v.level AND v.idx % 2 = 0 AND b.idx = v.idx + 1
  GROUP BY s.tree, s.idx
)"""


OP13 = f"""
WITH RECURSIVE x AS (
  SELECT coalesce('v' || lang, 'n') AS tree, doc_id, {leaf('n_chars')} AS h,
    CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {leaf('n_chars + 1')} END AS bent
  FROM documents
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM x
),
{levels('nodes', 'leaves')},
subs AS (SELECT tree AS lang, h, 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
{levels('tops', 'subs')},
{ways('low', 'leaves', 'nodes')},
{ways('high', 'subs', 'tops')},
p AS (
  SELECT e.doc_id, e.h AS leaf, e.bent, s.h AS subroot, t.h AS root, list_concat(coalesce(low.way, []), coalesce(high.way, [])) AS way
  FROM leaves e JOIN low USING (tree, idx) JOIN subs s ON s.lang = e.tree JOIN high ON high.idx = s.idx JOIN tops t ON t.n = 1
),
q AS (
  SELECT *, list_reduce(list_prepend({{'l': '', 'r': '', 'h': coalesce(bent, leaf)}}, way),
    lambda a, b: {{'l': '', 'r': '', 'h': sha256(b.l || a.h || b.r)}}).h AS folded_root,
    sha256(coalesce(array_to_string(list_transform(way, lambda w: w.l || w.r), ''), '')) AS proof_sha256
  FROM p
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM q
"""


ORACLES = {
    "op4_mix_sources": OP4, "op6_top_k": OP6, "op1_decontaminate": OP1, "op7_line_dedup": OP7, "op8_near_dedup": OP8,
    "op9_secret_scan": OP9, "op11_conversation_repair": OP11, "op13_merkle_manifest": OP13,
}
