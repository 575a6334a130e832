"""DuckDB SQL for the text operators that SQL can express. Others are held against brute force in tests/llm."""

from stockwright.llm import quality, ropes, trie, urls

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = f"translate(coalesce(text, ''), '{urls.A_Z}', '{urls.a_z}')"
_ITEM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SUBSTRINGS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
  x AS (SELECT r, i, rank() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM (SELECT r, doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20))),
  g AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 20)) AS p FROM x WHERE n > 1) GROUP BY r),
  k AS (SELECT r, string_agg(v, ' ' ORDER BY p) AS s FROM (SELECT r, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN (SELECT r, unnest(ps) AS p FROM g) USING (r, p) GROUP BY r)
  SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN g USING (r) LEFT JOIN k USING (r)"""

_BOILER = " OR ".join(f"contains(lower(l), '{p}')" for p in quality.BOILERPLATE)
QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
  tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
  rep AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY r),
  ln AS (SELECT r, l, regexp_extract_all(l, '{_WORD}') AS lw FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORD}')),
  bad AS (SELECT r, len(lw) AS n FROM (SELECT *, len(list_filter(lw, lambda x: regexp_matches(x, '^[|›»•·>]+$'))) AS seps, len(list_filter(lw, lambda x: regexp_matches(x, '^(https?://|www\\.)'))) AS links FROM ln)
    WHERE (seps >= 2 AND seps >= len(lw) * {quality.MOST_SEPARATORS}) OR length(l) - length(translate(l, '{quality.SYMBOLS}', '')) > length(l) * {quality.MOST_SYMBOLS}
    OR (len(lw) <= {quality.SHORT_ENTRY} AND len(lw) > 1 AND regexp_matches(lw[1], '^[•‣●○▪◦*-]$')) OR links > len(lw) * {quality.MOST_LINKS} OR length(l) - length(translate(l, '0123456789', '')) > length(l) * {quality.MOST_DIGITS}
    OR (len(lw) <= {quality.SHORT_TEASER} AND regexp_matches(lw[len(lw)], '(\\.\\.\\.|…)$')) OR NOT regexp_matches(l, '\\p{{L}}')
    OR (len(lw) >= 4 AND len(regexp_extract_all(l, '!!+')) * 3 > len(lw)) OR (len(lw) <= {quality.MOST_BOILERPLATE} AND ({_BOILER}))),
  s AS (SELECT d.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols,
    (SELECT count(*) - count(DISTINCT l) FROM ln WHERE ln.r = d.r) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM bad WHERE bad.r = d.r), 0) AS n_lost
    FROM d LEFT JOIN rep USING (r))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost <= n_words * {quality.MOST_LOST} AS kept, n_lost FROM s"""

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ITEM}') AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_ITEM}') AS w FROM benchmark),
  bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
  h AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, k)),
  hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
  its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)"""

_DRAWN = ", ".join(f"CAST('0x' || substr(x, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
_MARKED = " OR ".join(f"contains(t, '{m}')" for m in (ropes.PREFIX, ropes.SUFFIX, ropes.MIDDLE))
FILL_IN_MIDDLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{ropes.UNIT.pattern}') AS u, sha256('{ropes.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
  h AS (SELECT *, len(u) AS n, {_DRAWN} FROM d),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR {_MARKED} OR h3 % 100 >= {ropes.RATE} THEN 'plain' WHEN h4 % 100 < {ropes.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM h),
  p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: CRC-32 of decimal digits: each byte is xored in and followed by eight shifts, which -1 stands for.
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: list_prepend(CAST(ascii(x) AS BIGINT), [CAST(-1 AS BIGINT) FOR i IN range(8)])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"""
PREFIX_TRIE = f"""WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
  k AS (SELECT *, sha256(strlen(role) || ':' || role || ':' || text) AS k FROM o),
  t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS place, k, length(text) AS chars FROM k),
  c AS (SELECT conv_id, n, xor({_CRC}, 4294967295) % {trie.HEADS} AS h, conv_id - conv_id % {trie.BLOCK} AS base FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY 1)),
  r AS (SELECT c.conv_id, t.place AS seq, k, chars FROM c JOIN t ON t.conv_id = base AND t.place < h UNION ALL SELECT conv_id, place + 1000000000, k, chars FROM c JOIN t USING (conv_id) WHERE place >= h),
  p AS (SELECT conv_id, list(k ORDER BY seq) AS ks, list(chars ORDER BY seq) AS cs FROM r GROUP BY 1),
  m AS (SELECT conv_id, d, md5(array_to_string(ks[1:d], ',')) AS node, md5(array_to_string(ks[1:d - 1], ',')) AS parent, CASE WHEN d = 0 THEN 0 ELSE cs[d] END AS chars, d = len(ks) AS last, ks[1:d] AS path
    FROM (SELECT conv_id, coalesce(ks, []) AS ks, cs, unnest(range(0, len(coalesce(ks, [])) + 1)) AS d FROM c LEFT JOIN p USING (conv_id))),
  n AS (SELECT d, node, row_number() OVER (ORDER BY min(path)) - 1 AS place, min(parent) AS parent, min(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM m GROUP BY d, node),
  q AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
  s AS (SELECT a.d, a.node, count(*) AS n_below, count(*) FILTER (n_children IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.chars) AS BIGINT) AS saved_tokens FROM n LEFT JOIN q USING (d, node) JOIN m a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.d, a.node)
  SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256, n.place, n.place + n_below - 1 AS subtree_end
  FROM n JOIN s ON s.d = n.d AND s.node = n.node LEFT JOIN q ON q.d = n.d AND q.node = n.node LEFT JOIN n u ON u.d = n.d - 1 AND u.node = n.parent"""

ORACLE_SQL = {"op2_substring_dedup": SUBSTRINGS, "op5_quality_rules": QUALITY, "op8_decontamination": DECONTAMINATION, "op11_prefix_trie": PREFIX_TRIE, "op13_fill_in_middle": FILL_IN_MIDDLE}
