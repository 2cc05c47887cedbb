"""DuckDB SQL for the operators that SQL can express on whole tables."""

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
           FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY length(text) DESC, doc_id) AS k,
             first_value(doc_id) OVER (PARTITION BY h ORDER BY length(text) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY h) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, h AS text_sha256 FROM r
"""

SUBSTRING_DEDUP = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, s, hash(w[s:s + 19]) AS a, md5_number(array_to_string(w[s:s + 19], ' ')) AS b
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM t WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, s) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
       CASE WHEN g IS NULL THEN sha256(array_to_string(w, ' '))
            ELSE sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]), ' '), ''))
       END AS kept_sha256
FROM t LEFT JOIN lists USING (doc_id)
"""

LEXICAL_SEARCH = r"""
WITH low AS (SELECT translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, doc_id FROM documents),
docs AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM low),
sized AS (SELECT doc_id, w, len(w) AS n FROM docs WHERE len(w) > 0),
total AS (SELECT count(*) AS N_, coalesce(CAST(sum(n) AS BIGINT), 0) AS L_ FROM sized),
tfs AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM sized) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * N_ + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs, total GROUP BY term, N_),
scores AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * N_) // L_)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term), total GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""

# crc32 bit by bit over the digits of the id; the trees level by level, one row a node
MERKLE = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars, text, concat(octet_length(encode(CAST(doc_id AS VARCHAR))), ':', doc_id) AS f_id,
    coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS f_mid,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS f_text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda acc, c: list_reduce(list_prepend(xor(acc, c), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
        lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS crc
  FROM documents),
leaves AS MATERIALIZED (
  SELECT doc_id, lang, leaf, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL
      THEN sha256(f_id || f_mid || length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || f_text) END AS bad,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT *, sha256(f_id || f_mid || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || f_text) AS leaf FROM fields)),
up AS (SELECT lang, 0 AS lvl, i, n, leaf AS h FROM leaves UNION ALL
  SELECT lang, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, i, n, h FROM subroots UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 2, n),
steps AS (
  SELECT l.doc_id, l.leaf, u.lvl, CASE WHEN s.h IS NULL THEN '-' WHEN (l.i >> u.lvl) % 2 = 0 THEN 'R' ELSE 'L' END AS side, s.h
  FROM leaves l JOIN (SELECT DISTINCT lang, lvl, n FROM up WHERE n > 1) u ON u.lang IS NOT DISTINCT FROM l.lang
    LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = u.lvl AND s.i = xor(l.i >> u.lvl, 1)
  UNION ALL
  SELECT l.doc_id, l.leaf, 100 + t.lvl, CASE WHEN s.h IS NULL THEN '-' WHEN (r.i >> t.lvl) % 2 = 0 THEN 'R' ELSE 'L' END, s.h
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang, (SELECT DISTINCT lvl, n FROM top WHERE n > 1) t
    LEFT JOIN top s ON s.lvl = t.lvl AND s.i = xor(r.i >> t.lvl, 1)),
paths AS (SELECT doc_id, leaf, list(side || coalesce(h, '') ORDER BY lvl) AS path, sha256(coalesce(string_agg(h, '' ORDER BY lvl), '')) AS proof
  FROM steps GROUP BY 1, 2)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (
  SELECT l.doc_id, l.leaf, r.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(bad, l.leaf), coalesce(path, [])), lambda acc, s: CASE s[1] WHEN 'L' THEN sha256(substr(s, 2) || acc)
      WHEN 'R' THEN sha256(acc || substr(s, 2)) ELSE sha256(acc) END) AS folded_root
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang LEFT JOIN paths USING (doc_id, leaf))
"""

ORACLES = {"op2_exact_dedup": EXACT_DEDUP, "op5_substring_dedup": SUBSTRING_DEDUP, "op11_lexical_search": LEXICAL_SEARCH,
           "op13_merkle_manifest": MERKLE}
