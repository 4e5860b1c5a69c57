"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from strandlake.llm import licenses, quality_rules

WORD = r"[^\x20\x09-\x0D]+"
LOWERED = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a node, a reach FROM e2 UNION SELECT r.node, e2.b FROM r JOIN e2 ON e2.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(m.c, d.doc_id) component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node doc_id, min(reach) c FROM r GROUP BY 1) m USING (doc_id)"""

_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality_rules.RULES)
OP5 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{WORD}') ws FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM w),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i+1], ws[i+2]) c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) i FROM w WHERE len(ws) > 2)),
r AS (SELECT doc_id, count(DISTINCT i + k) n_repeat_words FROM v, (SELECT unnest([0, 1, 2]) k) WHERE c > 1 GROUP BY 1),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines, CAST(len(ls) AS BIGINT) n_lines, coalesce(n_repeat_words, 0) n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, CAST({_BITS} AS BIGINT) fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {quality_rules.BASE}) <> 0 base_failed, (fail_bits & {quality_rules.POLICIES['v1'] | quality_rules.BASE}) = 0 kept, fail_bits FROM b"""

_LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PHRASES = ", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES.items())
_TEMPLATES = ", ".join(f"('{label}', {words!r}, {need}, {half}, {passages!r}, {must})" for label, words, need, half, passages, must in licenses._templates(licenses.TEMPLATES, 0.8))
OP7 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{_LICENSE_WORD}') ws FROM documents),
ph(p, label) AS (VALUES {_PHRASES}), tp(label, ts, need, half, ps, must) AS (VALUES {_TEMPLATES}),
h AS (SELECT doc_id, i - 1 place, label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) i FROM w WHERE len(ws) > 0), ph WHERE ws[i:i+len(p)-1] = p),
b AS (SELECT doc_id, count(*) n_base, min(place) first_word, max(place) last_word, list(DISTINCT label) ls FROM h GROUP BY 1),
hs AS (SELECT DISTINCT half FROM tp),
bl AS (SELECT doc_id, half, list_distinct(ws[k * half + 1 : k * half + 2 * half]) xs, ' ' || array_to_string(ws[k * half + 1 : k * half + 2 * half], ' ') || ' ' tx FROM (SELECT doc_id, ws, half, unnest(range(0, CAST(ceil(len(ws) / half) AS BIGINT))) k FROM w, hs)),
mt AS (SELECT doc_id, list(DISTINCT label) ls, max(len(list_intersect(xs, ts)) / len(ts)) score FROM bl JOIN tp USING (half) WHERE len(list_intersect(xs, ts)) >= need AND len(list_filter(ps, lambda p: contains(tx, p))) >= must GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, coalesce(n_base, 0) n_base, first_word, last_word, array_to_string(list_sort(coalesce(b.ls, [])), ',') base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(mt.ls, [])))), ',') labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN mt USING (doc_id)"""

OP8 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

OP9 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i+34], ' ') g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) i FROM w WHERE len(ws) > 34)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY g) n FROM v),
o AS (SELECT doc_id, i, ws[i] x, max(i) FILTER (WHERE n > 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) last
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) i FROM w WHERE len(ws) > 0) LEFT JOIN c USING (doc_id, i)),
k AS (SELECT doc_id, count(*) FILTER (WHERE i - last < 35) n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE last IS NULL OR i - last >= 35) t FROM o GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

_TERMS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11 = f"""
WITH d AS (SELECT doc_id, {_TERMS} ts FROM documents),
n AS (SELECT doc_id, CAST(len(ts) AS BIGINT) n FROM d WHERE len(ts) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) nd, CAST(sum(n) AS BIGINT) l FROM n),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) t FROM benchmark),
p AS (SELECT doc_id, t, count(*) tf FROM (SELECT doc_id, unnest(ts) t FROM d) GROUP BY ALL),
v AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) w FROM (SELECT t, count(*) df FROM p GROUP BY 1), c),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * nd) // l) m FROM n, c),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) score FROM q JOIN v USING (t) JOIN p USING (t) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""

ORACLES = {"op4_ngram_join": OP4, "op5_quality_rules": OP5, "op7_license_scan": OP7, "op8_exact_dedup": OP8, "op9_substring_dedup": OP9, "op11_mask_search": OP11}
