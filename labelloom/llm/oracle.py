"""SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from labelloom.llm import licenses


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL: dict[str, str] = {}

SQL["op7_chat_format"] = """
WITH t AS (
  SELECT conv_id, turn, l[1].role AS role, l[1].text AS text FROM (
    SELECT conv_id, turn, list(struct_pack(role := coalesce(role, 'unknown'), text := coalesce(text, ''))
      ORDER BY coalesce(role, 'unknown'), coalesce(text, '')) AS l
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn)),
m AS (SELECT conv_id, arg_min(role || chr(10) || text, turn) AS k, max(turn) FILTER (role = 'assistant') AS reply FROM t GROUP BY conv_id),
s AS (SELECT k, min(conv_id) AS best, count(*) AS n FROM m GROUP BY k),
p AS (SELECT conv_id AS pair_id, best, reply, n = 1 AS alone FROM m JOIN s USING (k)
  WHERE (n > 1 AND conv_id <> best) OR (n = 1 AND reply IS NOT NULL)),
c AS (SELECT pair_id, turn, role, text FROM p JOIN t ON t.conv_id = best),
r AS (SELECT pair_id, turn, role, CASE WHEN alone AND turn = reply THEN substr(text, 1, length(text) // 2) ELSE text END AS text
  FROM p JOIN t ON t.conv_id = pair_id),
a AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, c.role AS cr, c.text AS ct, r.role AS rr, r.text AS rt
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.turn = r.turn),
f AS (SELECT pair_id, min(turn) AS first FROM a WHERE cr IS DISTINCT FROM rr OR ct IS DISTINCT FROM rt GROUP BY pair_id),
o AS (
  SELECT pair_id, 'prompt' AS part, turn, cr AS role, ct AS text FROM a LEFT JOIN f USING (pair_id) WHERE first IS NULL OR turn < first
  UNION ALL SELECT pair_id, 'chosen', turn, cr, ct FROM a JOIN f USING (pair_id) WHERE turn >= first AND cr IS NOT NULL
  UNION ALL SELECT pair_id, 'rejected', turn, rr, rt FROM a JOIN f USING (pair_id) WHERE turn >= first AND rr IS NOT NULL)
SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || chr(10) AS content,
  CAST(part <> 'prompt' AND role = 'assistant' AS INTEGER) AS mask FROM o
"""


def _canonical(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern, new in licenses.CLEANING:
        replaced = new.replace("{1}", "\\1")
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(replaced)}, 'g')"
    for seen, kept in licenses.SPELLINGS:
        out = f"replace({out}, {_q(seen)}, {_q(kept)})"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    return f"list_transform(string_split({out}, chr(10)), lambda x: trim(x))"


def _whole(lines: str) -> str:
    out = f"array_to_string(list_filter({lines}, lambda x: x <> ''), ' ')"
    for seen, kept in licenses.SPELLINGS:
        if " " in seen:
            out = f"replace({out}, {_q(seen)}, {_q(kept)})"
    return out


def _known() -> str:
    return ", ".join(f"({_q(k)}, {_q(t)})" for k, t in licenses.builtin_rows())


SQL["op9_license_scan"] = f"""
WITH known AS (
  SELECT sha256(t) AS digest, min(license) AS license FROM (
    SELECT license, {_whole(_canonical('text'))} AS t FROM (VALUES {_known()}) v(license, text))
  WHERE t <> '' GROUP BY 1),
d AS (SELECT doc_id, {_canonical('text')} AS lines FROM documents),
u AS (
  SELECT doc_id, -1 AS line, {_whole('lines')} AS t FROM d
  UNION ALL
  SELECT doc_id, i - 1, lines[i] FROM (
    SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d WHERE len(list_filter(lines, lambda x: x <> '')) > 1))
SELECT doc_id, CAST(line AS INTEGER) AS line, license, digest FROM u JOIN known ON sha256(t) = digest WHERE t <> ''
"""


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    step = "lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT)"
    return (
        f"xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), "
        f"lambda c: ord(c)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || range(8), {step})))"
    )


SQL["op11_periodic_runs"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    {_crc32("doc_id::VARCHAR")} AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
t AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
  THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM p),
x AS (SELECT rid, n, unnest(w) AS word, unnest(range(n)) AS i FROM t),
s AS (SELECT rid, n, unnest(range(n - 5)) AS i, unnest(list_transform(range(n - 5), lambda j: array_to_string(w[j + 1:j + 6], ' '))) AS six FROM t WHERE n >= 12),
m AS (SELECT a.rid, a.i, b.i - a.i AS d FROM s a JOIN s b ON a.rid = b.rid AND a.six = b.six AND b.i > a.i WHERE 2 * (b.i - a.i) <= a.n),
l AS (SELECT rid, d, min(i) AS start, max(i) - min(i) + 6 + d AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, d ORDER BY i) AS k FROM m) GROUP BY rid, d, k),
r AS (SELECT rid, start, length, min(d) AS period FROM l WHERE length >= greatest(12, 2 * d) GROUP BY rid, start, length),
o AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) AS place FROM r),
b AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    min(start) FILTER (place = 1) AS start, min(length) FILTER (place = 1) AS length, min(period) FILTER (place = 1) AS period
  FROM o GROUP BY rid),
z AS (SELECT DISTINCT x.rid, x.i FROM x JOIN r ON r.rid = x.rid AND x.i >= r.start + r.period AND x.i < r.start + r.length),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN z USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)
"""

SQL["op12_conversation_repair"] = rf"""
WITH RECURSIVE q AS (
  SELECT *, {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM q WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault
  FROM o),
st AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, {{'cost': 0::BIGINT, 'audit': '', 'kept': []::VARCHAR[]}} AS best FROM f
  UNION ALL
  SELECT conv_id, i, to_s, min({{'cost': cost, 'audit': audit, 'kept': kept}}) FROM (
    SELECT conv_id, i,
      CASE edit WHEN 'D' THEN here WHEN 'K' THEN CASE ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE here WHEN 2 THEN 3 ELSE 2 END END AS to_s,
      cost + CASE edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN fault = 3 AND edit <> 'D' THEN 5 ELSE 0 END AS cost,
      audit || edit AS audit,
      kept || CASE edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [CASE here WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END AS kept
    FROM (
      SELECT f.conv_id, f.i, role, text, ini, fault, unnest(['D', 'K', 'R']) AS edit, j,
        CASE j WHEN 0 THEN s WHEN 1 THEN CASE s WHEN 2 THEN 3 ELSE 2 END ELSE CASE s WHEN 2 THEN 2 ELSE 3 END END AS here,
        best.cost + 5 * j AS cost, best.audit || repeat('I', j) AS audit,
        best.kept || CASE j WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN CASE s WHEN 2 THEN ['assistant:'] ELSE ['user:'] END
          ELSE CASE s WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END END AS kept
      FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1, (SELECT unnest([0, 1, 2]) AS j) v) w
    WHERE edit = 'D' OR (fault NOT IN (1, 2) AND (edit = 'R' OR (ini = 's' AND here = 0) OR (ini = 'u' AND here <> 2) OR (ini = 'a' AND here = 2)))) y
  GROUP BY conv_id, i, to_s),
a AS (
  SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (i > 1 AND (before || ini) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
e AS (
  SELECT a.*, min({{'cost': best.cost + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': best.audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'kept': best.kept || CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE []::VARCHAR[] END}}) AS best
  FROM a JOIN st ON a.conv_id IS NOT DISTINCT FROM st.conv_id AND st.i = a.n GROUP BY ALL)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
