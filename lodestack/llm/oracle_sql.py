"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from .licenses import TEMPLATES
from .quality import DELTA, EPSILON, PATH, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS p FROM d) AS x),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS fresh FROM w JOIN f USING (s) WHERE doc_id > m),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, k),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans UNION ALL SELECT d.doc_id, coalesce(e, 0), length(h) // 2 FROM d LEFT JOIN (SELECT doc_id, max(b) AS e FROM spans GROUP BY doc_id) AS t USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

FEATURE = {"symbols": "n_symbols / n_words", "repeats": "n_repeat_words / n_words", "dup_lines": "n_dup_lines / n_words", "long_words": "word_chars / n_words", "short_words": "word_chars / n_words"}
SIDE = {r: side for r, (_, side, _) in RULES.items()}
STEPS = ", ".join(f"({i}, '{r}', {SIDE[r]}, CAST({c} AS DOUBLE))" for i, r, c in PATH)
VALUE = "CASE rule " + " ".join(f"WHEN '{r}' THEN {x}" for r, x in FEATURE.items()) + " END"
FAILS = f"coalesce(CASE WHEN side > 0 THEN {VALUE} > cutoff ELSE {VALUE} < cutoff END, false)"

OP3 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d) AS x),
twice AS (SELECT doc_id, i FROM win JOIN (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1) AS r USING (doc_id, s)),
rep AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM twice) AS x GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) AS x WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
path(step, rule, side, cutoff) AS (VALUES {STEPS}),
lab AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)),
held AS (SELECT m.lang, m.doc_id, quality, min(CASE WHEN {FAILS} THEN step END) AS failed FROM m JOIN lab USING (doc_id) CROSS JOIN path WHERE NOT base_failed GROUP BY m.lang, m.doc_id, quality),
k AS (SELECT lang, step, count(*) FILTER (quality = 1) AS ng, count(*) FILTER (quality = 0) AS nb, count(*) FILTER (quality = 1 AND failed <= step) AS kg, count(*) FILTER (quality = 0 AND failed <= step) AS kb FROM held CROSS JOIN path GROUP BY lang, step),
strata AS (SELECT count(DISTINCT coalesce(lang, '')) AS s FROM k WHERE ng > 0),
p AS (SELECT *, coalesce(kb / nullif(nb, 0), 0.0) - coalesce(kg / nullif(ng, 0), 0.0) AS gain, CASE WHEN ng = 0 OR kg >= ng * {EPSILON} THEN 1.0
  ELSE list_sum(list_transform(range(0, kg + 1), lambda i: exp(lgamma(ng + 1) - lgamma(i + 1) - lgamma(ng - i + 1) + i * ln({EPSILON}) + (ng - i) * ln(1 - {EPSILON})))) END AS risk FROM k),
sure AS (SELECT lang, step, gain, bool_and(risk <= {DELTA} / s) OVER (PARTITION BY lang ORDER BY step) AS ok FROM p CROSS JOIN strata),
best AS (SELECT lang, max_by(step, (gain, -step)) AS upto FROM sure WHERE ok AND gain > 0 GROUP BY lang),
cut AS (SELECT lang, rule, side, max_by(cutoff, step) AS cutoff FROM best JOIN path ON step <= upto GROUP BY lang, rule, side),
bad AS (SELECT DISTINCT doc_id FROM m JOIN cut ON m.lang IS NOT DISTINCT FROM cut.lang WHERE {FAILS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS k FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, 10 * (i // 8) + 1, 10) AS UBIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = k THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> k THEN k END AS refers_to FROM x
"""

TEMPLATE_ROWS = ", ".join("({}, '{}', '{}', '{}')".format(i, f, n, t.replace("'", "''")) for i, (f, n, t) in enumerate(TEMPLATES))
FOLDED = f"regexp_extract_all(translate(%s, '{UPPER}', '{LOWER}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
CUT = "SELECT DISTINCT %s, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT %s, w, unnest(range(1, len(w) - 3)) AS i FROM %s) AS x"

OP7 = f"""
WITH t(id, family, name, notice) AS (VALUES {TEMPLATE_ROWS}),
tw AS (SELECT id, {FOLDED % 'notice'} AS w FROM t), ts AS ({CUT % ('id', 'id', 'tw')}), tn AS (SELECT id, count(*) AS n FROM ts GROUP BY id),
dw AS (SELECT doc_id, {FOLDED % "coalesce(text, '')"} AS w FROM documents), ds AS ({CUT % ('doc_id', 'doc_id', 'dw')}),
hit AS (SELECT doc_id, id, count(*) AS k FROM ds JOIN ts USING (s) GROUP BY doc_id, id),
good AS (SELECT doc_id, id, family, name, k, n FROM hit JOIN tn USING (id) JOIN t USING (id) WHERE k / n >= 0.8),
within AS (SELECT a.id AS i, b.id AS j FROM ts a JOIN ts b USING (s) JOIN t x ON x.id = a.id JOIN t y ON y.id = b.id AND x.family = y.family AND x.name <> y.name JOIN tn m ON m.id = a.id JOIN tn n ON n.id = b.id AND n.n > m.n GROUP BY a.id, b.id, m.n HAVING count(*) / m.n >= 0.8),
more AS (SELECT i, j, ts.s FROM within JOIN ts ON ts.id = j LEFT JOIN ts own ON own.id = i AND own.s = ts.s WHERE own.s IS NULL),
gone AS (SELECT doc_id, i FROM ds JOIN more USING (s) JOIN (SELECT i, j, count(*) AS more_n FROM more GROUP BY i, j) AS c USING (i, j) JOIN good g USING (doc_id) WHERE g.id = j GROUP BY doc_id, i, j, more_n HAVING 2 * count(*) > more_n),
found AS (SELECT doc_id, family, name, max(k / n) AS share, max_by(n, (k / n, n)) AS size FROM good WHERE (doc_id, id) NOT IN (SELECT doc_id, i FROM gone) GROUP BY doc_id, family, name),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, family ORDER BY share DESC, size DESC, name) AS r FROM found)
SELECT d.doc_id, count(name) AS n_licenses, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses, max(share) AS containment FROM documents d LEFT JOIN (SELECT * FROM best WHERE r = 1 OR share = 1) b ON d.doc_id = b.doc_id GROUP BY d.doc_id
"""

OP9 = f"""
WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents) AS s),
k AS (SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM l),
v AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, v.last IS NOT NULL AND doc_id <> v.last AS gone FROM k LEFT JOIN v ON k.key = v.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) AS x WHERE rank <= 10
"""

#: The 256 entries of CRC32 by its rule, and the checksum of the bytes in the hexadecimal text {h}.
CRC_TABLE = "tab AS MATERIALIZED (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"
CRC32 = "xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(length({h}) // 2), lambda i: CAST('0x' || substr({h}, 2 * i + 1, 2) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def drawn_shard(shards: int) -> str:
    draw = "-ln((CAST('0x' || substr(md5(doc_id || ':{i}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"
    return f"list_position([{', '.join(draw.format(i=i) for i in range(shards))}], list_min([{', '.join(draw.format(i=i) for i in range(shards))}])) - 1"


OP11 = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, size, {CRC32.format(h="h")} AS text_crc32, CAST({drawn_shard(8)} AS INTEGER) AS shard, CAST({drawn_shard(9)} AS INTEGER) AS grown_shard FROM d, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""

OP12 = rf"""
WITH {CRC_TABLE},
w AS (SELECT doc_id, 0 AS target, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT item_id, 1, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT doc_id, target, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
u AS (SELECT f, {CRC32.format(h="h")} % 10000 AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)), tab),
b AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM f JOIN u USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM b),
m AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN u USING (f) JOIN g USING (bucket) WHERE target = 0 GROUP BY doc_id),
r AS (SELECT w.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((total - (total % n_features + n_features) % n_features) // n_features, 0) AS weight, CAST('0x' || substr(sha256('7:' || w.doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m ON w.doc_id = m.doc_id WHERE target = 0),
x AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM x)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_words >= 20 AND k <= 25 * n // 100 THEN k END AS rank FROM k
"""

ORACLE_SQL = {"op1_suffix_dedup": OP1, "op3_quality_rules": OP3, "op6_warc": OP6, "op7_license_scan": OP7, "op9_line_dedup": OP9, "op10_topk_search": OP10, "op11_sharding": OP11, "op12_importance_resampling": OP12}
