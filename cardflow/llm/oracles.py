"""SQL for the operators that SQL can express, built from the operators' parameters."""

from __future__ import annotations

from cardflow.llm import collocations, decontam, line_dedup, prefix_trie, secret_scan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lowered(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, {lowered(f'trim(line, {WHITE})')} AS key FROM l),
shared AS (
  SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= {line_dedup.MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE holder <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE holder IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN shared USING (key) GROUP BY doc_id
"""

WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, {WORDS}) AS words FROM documents),
b AS (
  SELECT item_id, words, least(len(words), {decontam.WINDOW}) AS n
  FROM (SELECT item_id, regexp_extract_all({lowered("coalesce(text, '')")}, {WORDS}) AS words FROM benchmark) WHERE len(words) > 0),
bi AS (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM b),
bw AS (SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS k FROM bi),
di AS (
  SELECT doc_id, words, n, unnest(range(1, greatest(len(words) - n + 2, 1))) AS i
  FROM d, (SELECT DISTINCT n FROM bw)),
hits AS (
  SELECT doc_id, di.n, i, item_id FROM di JOIN bw ON di.n = bw.n AND array_to_string(words[i : i + di.n - 1], ' ') = k),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _matches(name: str, pattern: str, group: int = 0, text: str = "coalesce(text, '')") -> str:
    p = quoted(pattern)
    return f"""
{name}_pieces AS (
  SELECT doc_id, unnest(range(1, len(found) + 1)) AS i, unnest(gaps[1 : len(found)]) AS gap, unnest(found) AS m, unnest(groups) AS v
  FROM (SELECT doc_id, string_split_regex({text}, {p}) AS gaps, regexp_extract_all({text}, {p}, 0) AS found,
    regexp_extract_all({text}, {p}, {group}) AS groups FROM documents)),
{name}_all AS (
  SELECT doc_id, v, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS bigint) AS stop, length(m) AS own
  FROM {name}_pieces)"""


def _blanked() -> str:
    text = "coalesce(text, '')"
    for pattern, length in secret_scan.ALLOWED:
        text = f"regexp_replace({text}, {quoted('(?i)' + pattern)}, '{' ' * length}', 'g')"
    return text


WIDTH = secret_scan.WIDTH
SECRET_SCAN = f"""
WITH {_matches("assign", secret_scan.ASSIGN, 2)}, {_matches("access", secret_scan.ACCESS)},
{_matches("hex", secret_scan.HEX)}, {_matches("run", secret_scan.CANDIDATE, 0, _blanked())},
windows AS (
  SELECT doc_id, stop - own AS start, v, unnest(range(0, length(v) - {WIDTH} + 1)) AS j FROM run_all),
shown AS (SELECT doc_id, start, j, substr(v, j + 1, {WIDTH}) AS w FROM windows),
hot AS (
  SELECT doc_id, start + min(j) AS start, start + max(j) + {WIDTH} AS stop FROM shown
  WHERE NOT regexp_matches(w, '^[A-Za-z/_-]+$') AND NOT regexp_matches(w, '^[0-9/_-]+$') AND
    list_aggregate(string_split(w, ''), 'entropy') >=
      CASE WHEN regexp_matches(w, '^[0-9a-fA-F]+$') THEN {secret_scan.HEX_BITS} ELSE {secret_scan.MIXED_BITS} END
  GROUP BY doc_id, shown.start),
spans AS (
  SELECT doc_id, 0 AS rank, 'assign' AS kind, stop - own AS start, stop FROM assign_all WHERE length(v) >= {secret_scan.ASSIGN_CHARS}
  UNION ALL SELECT doc_id, 1, 'access', stop - own, stop FROM access_all
  UNION ALL SELECT doc_id, 2, 'hex', stop - own, stop FROM hex_all
  UNION ALL SELECT doc_id, 3, 'entropy', start, stop FROM hot),
named AS (SELECT *, kind || ':' || start || ':' || stop AS name FROM spans)
SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
  count(*) FILTER (WHERE rank = 2) AS n_hex, count(*) FILTER (WHERE rank = 3) AS n_entropy,
  sha256(coalesce(string_agg(name, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
  coalesce(string_agg(name, ',' ORDER BY start, rank) FILTER (WHERE rank IS NOT NULL), '') AS spans
FROM (SELECT doc_id FROM documents) LEFT JOIN named USING (doc_id) GROUP BY doc_id
"""

COLLOCATIONS = f"""
WITH d AS (
  SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang,
    string_split_regex({lowered("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\\x20\\x09]+') AS words FROM d),
placed AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM p),
sized AS (SELECT lang, words, i, unnest(range(1, {collocations.MOST} + 1)) AS size FROM placed),
f AS (
  SELECT lang, size, words[i : i + size - 1] AS phrase, count(*) AS n FROM sized
  WHERE i + size - 1 <= len(words) GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
totals AS (SELECT lang, sum(len(words)) AS n FROM p GROUP BY lang),
cut AS (SELECT lang, size, phrase, n AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
scored AS (
  SELECT cut.lang, cut.size, cut.phrase, a, k, l.n AS l, r.n AS r,
    (1000000::hugeint * a * a) // (l.n::hugeint * r.n) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = cut.phrase[1 : k]
  JOIN f r ON r.lang = cut.lang AND r.phrase = cut.phrase[k + 1 :]),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, size, phrase, n, unnest(range(2, size)) AS m FROM f WHERE size > 2),
inner_at AS (SELECT lang, phrase, n, m, unnest(range(1, size - m + 2)) AS j FROM longer),
around AS (SELECT lang, phrase[j : j + m - 1] AS phrase, max(n) AS n FROM inner_at GROUP BY ALL),
kept AS (
  SELECT worst.* FROM worst LEFT JOIN around USING (lang, phrase)
  WHERE around.n IS NULL OR 100 * around.n < {collocations.PERCENT} * a),
named AS (SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
  CAST(totals.n AS bigint) AS n, CAST(score AS bigint) AS score
FROM named JOIN totals USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {collocations.TOP}
"""

# crc32 bit by bit: the reflected polynomial is a fixed value.
CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(conv_id::varchar, '')]),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""
PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % {prefix_trie.FAMILY} AS head, {CRC32} % {prefix_trie.MOST_SHARED} AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (
  SELECT ids.conv_id, 0 AS part, i, role, text FROM ids JOIN t ON t.conv_id = ids.head AND i <= h
  UNION ALL SELECT conv_id, 1, i, role, text FROM ids JOIN t USING (conv_id) WHERE i > h),
placed AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, list({{'role': role, 'text': text}}) OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING)),
steps AS (
  SELECT conv_id, depth, chars, path FROM placed UNION ALL SELECT conv_id, 0, 0, [] FROM ids),
lengths AS (SELECT conv_id, max(depth) AS stop FROM steps GROUP BY conv_id),
nodes AS (
  SELECT path, depth, min(conv_id) AS first, count(*) AS n, max(chars) AS chars,
    string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE depth = stop) AS ends
  FROM steps JOIN lengths USING (conv_id) GROUP BY path, depth),
kids AS (SELECT path[: depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON nodes.path = kids.path),
-- Every node's own figures go to each node on its smallest member's path.
sums AS (
  SELECT s.path, sum((n_children = 0)::int) AS n_leaves, sum((n - 1) * f.chars) AS saved
  FROM full_nodes f JOIN steps s ON s.conv_id = f.first AND s.depth <= f.depth GROUP BY s.path)
SELECT f.first AS conv_id, f.depth, up.first AS parent_conv_id, f.n AS n_convs, f.n_children,
  CAST(n_leaves AS bigint) AS n_leaves, CAST(saved AS bigint) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_nodes f JOIN sums ON sums.path = f.path
LEFT JOIN nodes up ON f.depth > 0 AND up.depth = f.depth - 1 AND up.path = f.path[: f.depth - 1]
"""

ORACLES = {"op2_secret_scan": SECRET_SCAN, "op4_line_dedup": LINE_DEDUP, "op7_decontamination": DECONTAMINATION,
           "op11_prefix_trie": PREFIX_TRIE, "op13_collocations": COLLOCATIONS}
