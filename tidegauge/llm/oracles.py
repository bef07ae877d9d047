"""DuckDB SQL that must give the same rows as the queries, where SQL can."""

SQL = {}

_WORDS4 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL["op4_decontaminate"] = rf"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS4} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM wins),
docs AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS4} AS w FROM documents),
grams AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lens)),
hits AS (SELECT r, i, grams.k, item FROM grams JOIN wins ON grams.win = wins.win AND grams.k = wins.k),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""

SQL["op7_line_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM docs)),
common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, count(*) AS n, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS text FROM lines
  WHERE key NOT IN (SELECT key FROM common) GROUP BY r)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)"""

_ESCAPED = r"""regexp_replace({}, '([<\[])(\\*)(\||/?s>|</?SYS|/?INST\])', '\1\\\2\3', 'g')"""

SQL["op10_chat_format"] = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""

SQL["op3_host_quality"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM docs)),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(lines.n, 0) AS n_lines FROM docs LEFT JOIN again USING (r) LEFT JOIN lines USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_words > 0 AND 2 * n_symbols >= n_words AS symbols_failed,
    n_dup_lines > 0 AND 100 * n_dup_lines >= 30 * n_lines AS lines_failed FROM m),
long AS (SELECT source, rule, CAST(failed AS INTEGER) AS failed
  FROM f UNPIVOT (failed FOR rule IN (base_failed, symbols_failed, lines_failed))),
h AS (SELECT source, rule, count(*) AS n, sum(failed) AS x FROM long GROUP BY ALL),
t AS (SELECT rule, sum(n) AS n, count(*) AS hosts, sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) AS sq FROM h GROUP BY rule),
p AS (SELECT rule, mean, mean * (1 - mean) AS noise,
    sq - mean * mean - mean * (1 - mean) * hosts / n AS between_hosts FROM t),
q AS (SELECT source, n, noise <= 0 OR between_hosts <= 1e-9 * noise AS alike, mean, x, greatest(noise / between_hosts - 1, 0) AS strength
  FROM h JOIN p USING (rule)),
post AS (SELECT source, n, alike, strength, CASE WHEN alike THEN mean ELSE (x + mean * strength) / (n + strength) END AS rate FROM q),
gone AS (SELECT DISTINCT coalesce(source, '(null)') AS source FROM post
  WHERE CASE WHEN alike THEN rate ELSE rate - 1.645 * sqrt(rate * (1 - rate) / (n + strength + 1)) END > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(source, '(null)') NOT IN (SELECT source FROM gone) AS kept FROM f"""
