"""DuckDB SQL for the queries of this subpackage that SQL can state."""

from __future__ import annotations

from perimetra.llm import quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark WHERE text IS NOT NULL),
found AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
  FROM item, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i) WHERE len(w) > 0),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
size AS (SELECT DISTINCT n FROM found),
part AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM doc, size, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT p.r, p.i, p.n, f.item FROM part p JOIN found f ON p.n = f.n AND p.k = f.k),
words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hit), LATERAL (SELECT unnest(range(i, i + n)) AS place) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

SUBSTRINGS = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
part AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM doc, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM part) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, place FROM late, LATERAL (SELECT unnest(range(i, i + 20)) AS place)),
word AS (SELECT doc_id, place, w[place] AS word FROM doc, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS place)),
kept AS (
  SELECT word.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY word.place) AS text
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.place = gone.place GROUP BY word.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT)
    AS formatted_chars
FROM turns GROUP BY conv_id
"""

_SHARES = "list_transform({c}, lambda x: CASE WHEN list_sum({c}) > 0 THEN x / list_sum({c}) ELSE 0 END)"
_PART = "CASE WHEN {p}[i] > 0 THEN {p}[i] * log2({p}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END"


def _distance(p: str, q: str) -> str:
    terms = f"list_transform(range(1, len({p}) + 1), lambda i: {_PART.format(p=p, q=q)} + {_PART.format(p=q, q=p)})"
    return f"sqrt(greatest(0.0, list_sum({terms}) / 2))"


def _means(shares: str, n: int) -> str:
    return "[" + ", ".join(f"round(avg(CAST({shares}[{i}] AS DECIMAL(20, 12))), 9)" for i in range(1, n + 1)) + "]"


_LISTS = ", ".join(f"('{k}', [{', '.join(repr(w) for w in v)}])" for k, v in quality.COMMON.items())
_LONG = f"n_words >= {quality.LEAST_WORDS} AND word_chars >= {quality.LEAST_CHARS}"
QUALITY = f"""
WITH list(own, names) AS (VALUES {_LISTS}),
doc AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
part AS (SELECT r, i, w[i : i + 4] AS k FROM doc, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
again AS (SELECT r, unnest(list(i)) AS i FROM part GROUP BY r, k HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT place) AS n FROM again, LATERAL (SELECT unnest(range(i, i + 5)) AS place) GROUP BY r),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM doc),
copies AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
base AS (
  SELECT r, doc_id, own, names, w, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(copies.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[^a-z]+', '', 'g')) AS low, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS up,
    length(regexp_replace(t, '[^0-9]+', '', 'g')) AS digit, strlen(t) - length(t) AS extra
  FROM doc LEFT JOIN covered USING (r) LEFT JOIN copies USING (r) LEFT JOIN list ON list.own = doc.lang),
told AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed,
    [low, up, digit, length(t) - word_chars, greatest(0, word_chars - low - up - digit - extra), extra] AS classes,
    list_transform(names, lambda c: len(list_filter(w, lambda x: x = c))) AS seen
  FROM base),
share AS (
  SELECT *, {_SHARES.format(c="classes")} AS by_class, {_SHARES.format(c="common")} AS by_word
  FROM (SELECT *, list_append(seen, greatest(0, n_words - list_sum(seen))) AS common FROM told)),
good AS (SELECT * FROM share WHERE {_LONG} AND NOT base_failed),
ref AS (
  SELECT own, {_means("by_class", 6)} AS ref_class, {_means("by_word", max(map(len, quality.COMMON.values())) + 1)} AS ref_word FROM good WHERE own IS NOT NULL GROUP BY own
  UNION ALL SELECT NULL, {_means("by_class", 6)}, NULL FROM good),
far AS (
  SELECT share.*, CASE WHEN {_LONG} THEN {_distance("by_class", "ref_class")} END AS class_distance,
    CASE WHEN {_LONG} AND ref_word IS NOT NULL THEN {_distance("by_word", "ref_word")} END AS word_distance
  FROM share LEFT JOIN ref ON ref.own IS NOT DISTINCT FROM share.own)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_distance, 0) <= {quality.CLASS_DISTANCE} AND coalesce(class_distance, 0) + coalesce(word_distance, 0) <= {quality.BOTH_DISTANCES} AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM far
"""

_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT)), "
    "lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
    "lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"
)


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _inserted(way: str, role: str) -> str:
    return f"{{'c': {way}.c + 5, 'a': {way}.a || 'I', 't': {way}.t || CASE WHEN {way}.t = '' THEN '' ELSE chr(10) END || '{role}:'}}"


def _deleted(way: str) -> str:
    return f"{{'c': {way}.c + 2, 'a': {way}.a || 'D', 't': {way}.t}}"


def _taken(way: str, char: str, role: str) -> str:
    """The turn kept, or given another role, behind a way."""
    line = f"{way}.t || CASE WHEN {way}.t = '' THEN '' ELSE chr(10) END || CASE WHEN first = '{char}' THEN role ELSE '{role}' END || ':' || text"
    cost = f"{way}.c + CASE WHEN gone THEN 1000000 ELSE (first <> '{char}')::BIGINT + cut::BIGINT * 5 END"
    return f"{{'c': {cost}, 'a': {way}.a || CASE WHEN first = '{char}' THEN 'K' ELSE 'R' END, 't': {line}}}"


#: A walk over the turns with the best way to each place in the grammar: nothing yet (n), after system (s), user (u), assistant (a).
REPAIR = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), rolled AS (SELECT *, {_CRC} % 20 AS fault FROM raw
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM rolled WHERE fault <> 0
), placed AS (
  SELECT *, substr(role, 1, 1) AS first, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged
), turns AS (
  SELECT *, body = '' OR again AS gone, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
    lag(first) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS n, {{'c': 1000000::BIGINT, 'a': '', 't': ''}} AS s,
    {{'c': 5::BIGINT, 'a': 'I', 't': 'user:'}} AS u, {{'c': 10::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS a
  FROM conversations
  UNION ALL
  SELECT conv_id, i, n, s, {_least('u', _inserted('a', 'user'))}, a
  FROM (SELECT conv_id, i, n, s, u, {_least('a', _inserted('u', 'assistant'))} AS a
    FROM (SELECT conv_id, i, n, s, a, {_least('u', _inserted('n', 'user'), _inserted('s', 'user'), _inserted('a', 'user'))} AS u
      FROM (
        SELECT conv_id, i, {_deleted('n')} AS n, {_least(_deleted('s'), "CASE WHEN first = 's' THEN " + _taken('n', 's', '') + " ELSE {'c': 1000000::BIGINT, 'a': '', 't': ''} END")} AS s,
          {_least(_deleted('u'), _taken('n', 'u', 'user'), _taken('s', 'u', 'user'), _taken('a', 'u', 'user'))} AS u,
          {_least(_deleted('a'), _taken('u', 'a', 'assistant'))} AS a
        FROM (SELECT t.conv_id, t.i, t.first, t.role, t.text, t.gone, t.cut, w.n, w.s, w.u, w.a FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1))))
), best AS (SELECT conv_id, {_least('arg_max(n, i)', 'arg_max(a, i)')} AS w FROM walk GROUP BY conv_id
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (body = '') AS blank,
    count(*) FILTER (body <> '' AND again) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (i > 1 AND before || first NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, w.c::BIGINT AS cost, w.a AS audit, sha256(w.t) AS repaired_sha256
FROM best b LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""
