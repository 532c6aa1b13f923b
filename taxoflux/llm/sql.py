"""DuckDB SQL that gives the same rows as the queries of the same name."""

RULES_CTE = r"""
t AS (SELECT *, coalesce(text, '') AS tx FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(tx, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(tx, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             row_number() OVER () AS rid FROM t),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
        FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c >= 2),
cov AS (SELECT rid, count(*) AS n FROM (SELECT rid, i FROM rep UNION SELECT rid, i + 1 FROM rep UNION SELECT rid, i + 2 FROM rep) GROUP BY rid),
m AS (SELECT w.*, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(tx) - length(regexp_replace(tx, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (length(tx) - length(regexp_replace(tx, '\p{Lu}', '', 'g')))::BIGINT AS n_upper,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
judged AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
                  (100 * n_symbols > 5 * word_chars OR 100 * n_upper > 50 * word_chars
                   OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines)) AS rule_failed
           FROM m)
"""

OP2 = f"""WITH {RULES_CTE}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT rule_failed) AS kept FROM judged"""

MIX_CTE = r"""
sized AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM {docs}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS weight,
                  source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM sizes),
filled AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS remains,
                  sum(weight) OVER (ORDER BY cap / weight, weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM ranked),
levels AS (SELECT *, remains / open AS level, (remains / open) * weight >= cap AS capped FROM filled),
rates AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * (SELECT max(level) FROM levels WHERE NOT capped) END AS target FROM levels),
mixed AS (SELECT s.doc_id, s.source, s.size, r.source_size, r.target,
                 CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0 END AS rate,
                 ('0x' || substr(md5('8:' || coalesce(s.doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
          FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
"""
MIX_COLUMNS = "doc_id, size, source_size, target, ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken"

OP8 = f"WITH {MIX_CTE.format(docs='documents')} SELECT {MIX_COLUMNS} FROM mixed"

OP7 = r"""WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT doc_id, words, unnest(CASE WHEN len(words) >= 5 THEN range(1, len(words) - 3) WHEN len(words) > 0 THEN [1::BIGINT] ELSE []::BIGINT[] END) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = w.doc_id"""
