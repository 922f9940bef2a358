"""DuckDB statements for the queries that SQL can express.

Left out are packing (4, 7), spans by place (8), sharding by checksums (10) and
the pipeline; tests hold those against brute-force versions.
"""

from __future__ import annotations

from changelens.llm import fixity, quality, queries, site_lines, url_filter

STATEMENTS: dict[str, str] = {}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"'[^\x20\x09-\x0D]+'"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- 1: both replicas from the pages; a path has the nodes of its offset at all levels

_TREE = fixity.TreeParams()
_RECORD = (
    "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url ||"
    " chr(13) || chr(10) || 'Content-Length: ' || strlen({html}) || chr(13) || chr(10) || chr(13) || chr(10) || {html} ||"
    " chr(13) || chr(10) || chr(13) || chr(10)"
)
_OTHER = "replace(substr(html, 1, 1), '<', '(') || substr(html, 2)"
STATEMENTS["op1_warc_fixity"] = f"""
WITH drawn AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, cast(floor(page_id / 512) AS bigint) AS archive,
    cast('0x' || substr(md5(cast(page_id AS varchar)), 1, 4) AS bigint) % 37 AS draw FROM pages
), placed AS (
  SELECT archive, draw, sha256({_RECORD.format(html='html')}) AS da,
    sha256(CASE WHEN draw = 1 THEN {_RECORD.format(html=f'({_OTHER})')} ELSE {_RECORD.format(html='html')} END) AS db,
    coalesce(sum(strlen({_RECORD.format(html='html')})) OVER (PARTITION BY archive ORDER BY page_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM drawn
), top AS (
  SELECT list_min(list_filter(range(30), lambda l: pow({_TREE.fanout}, l) >= n)) AS level FROM (
    SELECT cast(max(place) AS bigint) // {_TREE.leaf_bytes} + 1 AS n FROM placed)
), damaged AS (
  SELECT archive, cast(place AS bigint) AS "offset", CASE WHEN draw <> 3 THEN da END AS digest_a,
    CASE WHEN draw <> 2 THEN db END AS digest_b FROM placed
)
SELECT archive, "offset", array_to_string(list_transform(range(level, -1, -1), lambda l:
    cast(("offset" // {_TREE.leaf_bytes}) // cast(pow({_TREE.fanout}, l) AS bigint) AS varchar)), '/') AS path,
  CASE WHEN digest_b IS NULL THEN 'missing' WHEN digest_a IS NULL THEN 'extra' ELSE 'changed' END AS kind,
  digest_a, digest_b
FROM damaged, top WHERE digest_a IS DISTINCT FROM digest_b
"""

# --- 2: statistics by exploded windows, cutoffs by the exact tail

_RISK = quality.RiskParams()
_SHARE = _RISK.max_false_rejection


def _value(rule: quality.Rule) -> str:
    top, bottom = rule.statistic.split(" / ")
    return f"({top} / nullif({bottom}, 0))"


_GRID = ", ".join(f"({step}, {i}, {cutoff}::DOUBLE)" for step, (i, cutoff) in enumerate(_RISK.steps, 1))
_VALUES = "CASE rule " + " ".join(f"WHEN {i} THEN {_value(r)}" for i, r in enumerate(_RISK.rules)) + " END"
_REJECTED = "CASE " + " ".join(
    f"WHEN {_value(r)} > cut_{i} THEN '{r.name}'" for i, r in enumerate(_RISK.rules)
) + " END"
STATEMENTS["op2_quality_rules"] = f"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, dense_rank() OVER (ORDER BY lang) AS s, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS l FROM documents
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), repeats AS (
  SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM windows, range(3) t(j) WHERE n > 1 GROUP BY rid
), stats AS (
  SELECT doc_id, stratum, s, text, len(w) AS n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS bigint)
    AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!]', '', 'g'))
    AS n_exclamations FROM split LEFT JOIN repeats USING (rid)
), holdout AS (
  SELECT s, any_value(columns(* EXCLUDE (s, good, text))), max(good) AS good FROM (
    SELECT stats.*, good FROM stats JOIN (SELECT doc_id, max(quality) = 1 AS good FROM labels
      WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE n_words >= {_RISK.min_words}
      AND 100 * n_repeat_words <= {_RISK.max_repeat_percent} * n_words) GROUP BY s, text
), grid(step, rule, cutoff) AS (VALUES {_GRID}
), firsts AS (
  SELECT h.*, (SELECT min(step) FROM grid WHERE {_VALUES} > cutoff) AS first FROM (SELECT *, row_number() OVER () AS trial FROM holdout) h
), counted AS (
  SELECT s, step, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND first <= step) AS k,
    count(*) FILTER (NOT good AND first <= step) AS bad FROM firsts, grid GROUP BY ALL
), tails AS (
  SELECT s, step, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}::DOUBLE)
    + (n - i) * ln(1 - {_SHARE}::DOUBLE))) AS tail FROM (SELECT *, unnest(range(k + 1)) AS i FROM counted
    WHERE n > 0 AND k < n * {_SHARE}::DOUBLE) GROUP BY ALL
), tested AS (
  SELECT c.*, bool_and(coalesce(tail, 1) <= {_RISK.error}::DOUBLE / (SELECT count(DISTINCT s) FROM counted))
    OVER (PARTITION BY s ORDER BY step) AS certified
  FROM counted c LEFT JOIN tails USING (s, step)
), chosen AS (
  SELECT s, step AS last FROM tested WHERE certified AND bad > k
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY bad - k DESC, step) = 1
), cutoffs AS (
  SELECT s, {', '.join(f'min(cutoff) FILTER (rule = {i}) AS cut_{i}' for i in range(len(_RISK.rules)))}
  FROM tested JOIN chosen USING (s) WHERE step <= last GROUP BY s
), judged AS (
  SELECT stats.*, n_words < {_RISK.min_words} OR 100 * n_repeat_words > {_RISK.max_repeat_percent} * n_words AS base_failed,
    {_REJECTED} AS rejected_by FROM stats LEFT JOIN cutoffs USING (s)
)
SELECT doc_id, {', '.join(f'cast({c} AS bigint) AS {c}' for c in quality.STATS)}, base_failed,
  NOT base_failed AND rejected_by IS NULL AS kept, stratum, rejected_by FROM judged
"""

# --- 3

_SITE = site_lines.SiteParams()
_BLOCKS = (
    "(?i)</?(p|div|li|ul|ol|h[1-6]|br|hr|nav|header|footer|main|article|section|table|tr|td|title|head|body|html)\\b[^>]*>"
)
_QUIET = "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->"
_UPPER, _LOWER = lit(url_filter.UPPER), lit(url_filter.LOWER)
_HOST = (
    f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_UPPER}, {_LOWER})"
)
STATEMENTS["op3_site_lines"] = f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, page_id, {_HOST} AS host,
    regexp_replace(regexp_replace(regexp_replace(html, {lit(_QUIET)}, '', 'g'), {lit(_BLOCKS)}, chr(10), 'g'),
      '<[^>]*>', '', 'g') AS text FROM pages
), split AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM texts
), filled AS (
  SELECT DISTINCT rid, host, trim(line, {_SPACES}) AS line FROM (SELECT rid, host, unnest(ls) AS line FROM split)
  WHERE trim(line, {_SPACES}) <> ''
), totals AS (SELECT host, count(*) AS pages FROM texts GROUP BY host
), common AS (
  SELECT host, list(line) AS gone FROM (SELECT host, line, count(*) AS n FROM filled GROUP BY ALL) JOIN totals USING (host)
  WHERE n >= {_SITE.min_line_pages} AND n > {_SITE.max_ratio}::DOUBLE * pages GROUP BY host
), marked AS (
  SELECT page_id, host, text, ls, list_filter(ls, lambda x: trim(x, {_SPACES}) <> '') AS full_,
    list_filter(ls, lambda x: NOT list_contains(coalesce(gone, []), trim(x, {_SPACES}))) AS kept
  FROM split LEFT JOIN common USING (host)
)
SELECT page_id, host, CASE WHEN len(kept) < len(ls) THEN array_to_string(kept, chr(10)) ELSE text END AS text,
  cast(len(full_) AS bigint) AS n_lines, cast(len(ls) - len(kept) AS bigint) AS n_dropped FROM marked
"""

# --- 5

_LETTERED = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
STATEMENTS["op5_decontamination"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_LETTERED}) AS w FROM documents
), items AS (
  SELECT cast(item_id AS varchar) AS item,
    regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_LETTERED}) AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM (
    SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), hits AS (
  SELECT rid, i, d.n, item FROM (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM (
    SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes)) d JOIN windows USING (n, words)
), marked AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), met AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (rid) LEFT JOIN met USING (rid)
"""

# --- 6

_QUERY = "coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '')"
_KEPT = (
    f"array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT"
    f" regexp_matches(p, {lit(url_filter.TRACKING)}))), '&')"
)
_FITS = "(host = {h} OR ends_with(host, {d})) AND starts_with(path, {p})"
_RULE = "CASE " + " ".join(
    f"WHEN {_FITS.format(h=lit(r.host), d=lit('.' + r.host), p=lit(r.path))} THEN {lit(r.text)}"
    for r in sorted(queries.URL_RULES, key=lambda r: -len(r.text))
) + " END"
_VERDICT = "CASE rule " + " ".join(f"WHEN {lit(r.text)} THEN {lit(r.verdict)}" for r in queries.URL_RULES)
STATEMENTS["op6_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, url, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    {_KEPT} AS q FROM pages
), named AS (
  SELECT page_id, host, path, {_RULE} AS rule, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') ||
    regexp_replace(regexp_replace(path, '/+$', ''), '\\.html?$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END
    AS canonical_url FROM parts
), listed AS (SELECT DISTINCT canonical_url AS u FROM named WHERE regexp_matches(host, {lit(queries.LISTED_HOSTS)}))
SELECT page_id, host, path, rule, {_VERDICT} ELSE CASE WHEN u IS NOT NULL THEN 'block' ELSE 'allow' END END AS verdict,
  canonical_url, u IS NOT NULL AS listed FROM named LEFT JOIN listed ON canonical_url = u
"""

# --- 9

STATEMENTS["op9_ngram_join"] = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_WORD}) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM docs
  UNION SELECT a, y FROM reach JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) ON b = x
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id
FROM docs d JOIN reach ON a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

# --- 12: costs back and edits forward, row by row; a checksum bit by bit

_BITS = "list_concat([ascii(ch)], [-1, -1, -1, -1, -1, -1, -1, -1])"
_CRC = f"""xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(key, ''), lambda ch: {_BITS}))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, cast(x AS bigint)) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
_STEP = "[3, 3, 4, 3][s]"  # states from 1: nothing, after system, after user, after assistant
STATEMENTS["op12_conversation_repair"] = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, turn, coalesce(role, ' ') AS role,
    coalesce(text, ' ') AS txt, coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ') AS key
  FROM conversations
), drawn AS (SELECT *, {_CRC} % 20 AS fault FROM keyed
), damaged AS (
  SELECT c, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt,
    unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, txt, copy) AS i, count(*) OVER (PARTITION BY c) AS n
  FROM damaged
), marked AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(txt, '[^ 	-
]') AS blank,
    row_number() OVER (PARTITION BY c, role, txt ORDER BY i) > 1 AS repeated,
    NOT regexp_matches(txt, '[.!?][ 	-
]*$') AS cut_off FROM placed
), f AS (
  SELECT c, i, n, turn, role, txt, initial, blank, repeated AND NOT blank AS duplicate, blank OR repeated AS gone,
    cut_off AND NOT blank AND NOT repeated AS truncated, CASE WHEN cut_off THEN 1 ELSE 0 END AS extra,
    lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair,
    CASE initial WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS kept
  FROM marked
), back(c, i, w) AS (
  SELECT DISTINCT c, n + 1, [0, 4, 2, 0] FROM f
  UNION ALL
  SELECT c, i, [least(b[1], 2 + least(b[3], 2 + b[4])), least(b[2], 2 + least(b[3], 2 + b[4])), least(b[3], 2 + b[4]), least(b[4], 2 + b[3])]
  FROM (SELECT f.c, f.i, list_transform([1, 2, 3, 4], lambda s: least(3 + w[s], CASE WHEN gone THEN 99999999 ELSE 2 + extra + w[{_STEP}] END,
      CASE WHEN gone OR kept[s] = 0 THEN 99999999 ELSE extra + w[kept[s]] END)) AS b
    FROM back JOIN f ON f.c = back.c AND f.i = back.i - 1)
), paths(c, i, s, audit, rows_, done) AS (
  SELECT DISTINCT c, cast(1 AS bigint), 1, '', cast([] AS varchar[]), false FROM f
  UNION ALL
  SELECT c, CASE WHEN e = 'I' OR e = '' THEN i ELSE i + 1 END,
    CASE e WHEN 'K' THEN kept[s] WHEN 'I' THEN {_STEP} WHEN 'R' THEN {_STEP} ELSE s END, audit || e,
    CASE e WHEN 'K' THEN list_append(rows_, role || ':' || txt)
      WHEN 'R' THEN list_append(rows_, CASE WHEN s = 3 THEN 'assistant:' ELSE 'user:' END || txt)
      WHEN 'I' THEN list_append(rows_, CASE WHEN s = 3 THEN 'assistant:' ELSE 'user:' END) ELSE rows_ END, e = ''
  FROM (SELECT p.*, f.role, f.txt, f.kept, CASE
      WHEN f.i IS NULL THEN CASE WHEN now.w[s] > 0 THEN 'I' ELSE '' END
      WHEN 3 + then_.w[s] = now.w[s] THEN 'D'
      WHEN 2 + now.w[{_STEP}] = now.w[s] THEN 'I'
      WHEN NOT f.gone AND f.kept[s] > 0 AND f.extra + then_.w[f.kept[s]] = now.w[s] THEN 'K' ELSE 'R' END AS e
    FROM paths p JOIN back now ON now.c = p.c AND now.i = p.i LEFT JOIN back then_ ON then_.c = p.c AND then_.i = p.i + 1
      LEFT JOIN f ON f.c = p.c AND f.i = p.i WHERE NOT p.done)
), counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cast(coalesce(w[1], 0) AS bigint) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(rows_, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM keyed) k LEFT JOIN counts USING (c) LEFT JOIN (SELECT c, w FROM back WHERE i = 1) b USING (c)
  LEFT JOIN (SELECT c, audit, rows_ FROM paths WHERE done) d USING (c)
"""

# --- 13: groups of equal normalised texts

STATEMENTS["op13_tree_dedup"] = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS place, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS normal
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(normal) AS text_sha256
FROM t WINDOW w AS (PARTITION BY normal ORDER BY doc_id NULLS LAST, place)
"""
