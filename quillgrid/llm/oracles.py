r"""The queries of this subpackage in SQL, as DuckDB reads it: by other ways than the operators take, over whole tables.

There is none for what SQL can't say: automata (op1), XXH64 and reachability (op2), media files (op3), a greedy path
of cutoffs (op6), a tokenizer (op9). Tests hold those against brute force.
"""

from __future__ import annotations

from . import mixing, pii, repeats, spans
from .anchors import SHORT, WIDTH

_WORD = r"[^\x20\x09-\x0D]+"

WARC = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS h FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS original FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
{" || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::INT >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))} AS payload_digest,
CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to FROM o"""

MIX = rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
  ('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, {mixing.MAX_EPOCHS}.0::DOUBLE * source_size AS stop, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
r AS (SELECT *, (total - coalesce(sum(stop) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM w),
t AS (SELECT source AS of, source_size, least(stop, (SELECT min({{'a': stop / weight, 'r': reach}}).r FROM r WHERE stop / weight >= reach) * weight) AS target FROM r),
x AS (SELECT d.*, source_size, target, draw % {mixing.BUCKETS} AS bucket, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM d JOIN t ON source IS NOT DISTINCT FROM of),
y AS (SELECT *, greatest(target - whole * source_size, 0) AS rest, sum(size) OVER (PARTITION BY source ORDER BY bucket) AS upto,
  coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket, draw, size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
z AS (SELECT *, coalesce(min(bucket) FILTER (upto > rest) OVER (PARTITION BY source), {mixing.BUCKETS}) AS last FROM y)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN bucket < last OR bucket = last AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM z"""


def _windows(width: int, tag: str) -> str:
    """CTEs: the stretches (doc_id, a, z), from 0, that windows of a width cover which start twice or more."""
    return f"""w{tag} AS (SELECT doc_id, i, md5(b[i + 1:i + {width}]) AS h FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - {width - 1})) AS i FROM t)),
f{tag} AS (SELECT doc_id, i FROM w{tag} SEMI JOIN (SELECT h FROM w{tag} GROUP BY h HAVING count(*) > 1) USING (h)),
g{tag} AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {width} THEN 0 ELSE 1 END AS fresh FROM f{tag}),
k{tag} AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g{tag}),
s{tag} AS (SELECT doc_id, min(i) AS a, max(i) + {width} AS z FROM k{tag} GROUP BY doc_id, k)"""


REPEATS = rf"""WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
{_windows(WIDTH, "")},
{_windows(SHORT, "p")},
edges AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM (SELECT doc_id, a, z FROM s UNION ALL SELECT doc_id, -1, 0 FROM t)),
kept AS (SELECT doc_id, string_agg(hex(b[e.a + 1:coalesce(e.z, octet_length(b))]), '' ORDER BY e.a) AS kept FROM edges e JOIN t USING (doc_id) GROUP BY 1),
gone AS (SELECT doc_id, sum(z - a) AS n, count(*) AS spans FROM s GROUP BY 1),
long AS (SELECT doc_id, count(*) AS n FROM sp JOIN t USING (doc_id)
  WHERE len(regexp_extract_all(regexp_replace(hex(b[a + 1:z]), '(..)', '\1 ', 'g'), '(?:(?:[13-9A-F][0-9A-F]|2[1-9A-F]|0[0-8EF]) )+')) > {repeats.PASSAGE_WORDS} GROUP BY 1)
SELECT t.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(gone.spans, 0) AS BIGINT) AS n_spans,
sha256(unhex(kept)) AS kept_sha256, CAST(coalesce(long.n, 0) AS BIGINT) AS n_passages
FROM t JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN long USING (doc_id)"""

_BREAK = r"""[.!?]+["'')\]]*\s+|\n\s*|[。！？]+\s*"""
SPANS = rf"""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '(?s).*?(?:{_BREAK}|$)'), lambda x: x <> '') AS s FROM documents),
u AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM d),
v AS (SELECT doc_id, i, s[i] AS said, array_to_string(regexp_extract_all(s[i], '{_WORD}'), ' ') AS plain, len(regexp_extract_all(s[i], '{_WORD}')) AS n FROM u),
c AS (SELECT *, CAST(sum(n) OVER o AS BIGINT) AS upto, CAST(sum(n) OVER o - n AS BIGINT) AS before, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total, max(i) OVER (PARTITION BY doc_id) AS most,
  CASE WHEN first_value(n) OVER (PARTITION BY doc_id ORDER BY i) = 0 AND max(i) OVER (PARTITION BY doc_id) > 1 THEN 2 ELSE 1 END AS lead FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT a.doc_id, a.i, min(z.i) AS j FROM c a ASOF JOIN c z ON a.doc_id = z.doc_id AND a.before + {spans.MIN_WORDS} <= z.upto WHERE a.i >= a.lead GROUP BY 1, 2
  UNION SELECT z.doc_id, max(a.i), z.i FROM c z ASOF JOIN c a ON a.doc_id = z.doc_id AND z.upto - {spans.MIN_WORDS} >= a.before WHERE a.i >= a.lead GROUP BY 1, 3
  UNION SELECT doc_id, lead, most FROM c WHERE total BETWEEN 1 AND {spans.MIN_WORDS - 1} AND i = 1),
runs AS (SELECT r.doc_id, CASE WHEN r.i = lead THEN 1 ELSE r.i END AS i, r.j, md5(string_agg(c.plain, ' ' ORDER BY c.i)) AS h FROM r JOIN c ON r.doc_id = c.doc_id AND c.i BETWEEN r.i AND r.j GROUP BY r.doc_id, r.i, r.j, lead),
later AS (SELECT *, first_value(doc_id) OVER o AS first_id, row_number() OVER o AS k FROM runs WINDOW o AS (PARTITION BY h ORDER BY doc_id, i)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM later WHERE k > 1),
m AS (SELECT v.doc_id, v.i, said, gone.i IS NOT NULL AS x FROM v LEFT JOIN gone ON v.doc_id = gone.doc_id AND v.i = gone.i),
e AS (SELECT *, x AND NOT coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (x) AS gone, count(*) FILTER (opens) AS spans, coalesce(string_agg(said, '' ORDER BY i) FILTER (NOT x), '') AS kept FROM e GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS INTEGER) AS n_sentences, CAST(coalesce(n.gone, 0) AS INTEGER) AS n_removed, CAST(coalesce(n.spans, 0) AS INTEGER) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256,
coalesce((SELECT list(DISTINCT first_id ORDER BY first_id) FROM later WHERE later.doc_id = d.doc_id AND k > 1), []) AS first_ids FROM d LEFT JOIN n USING (doc_id)"""

_PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def _found(source: str, text: str, pattern: str, of: str = "doc_id") -> str:
    """(of, pos, value) of a pattern's matches; pos from 0: what lies between and the matches before are added up."""
    return f"""(SELECT {of}, CAST(sum(length(gap)) OVER o + sum(length(value)) OVER o - length(value) AS BIGINT) AS pos, value
  FROM (SELECT {of}, unnest(regexp_extract_all({text}, '{pattern}')) AS value, unnest(regexp_split_to_array({text}, '{pattern}')[:-2]) AS gap, unnest(range(len(regexp_extract_all({text}, '{pattern}')))) AS k FROM {source})
  WINDOW o AS (PARTITION BY {of} ORDER BY k))"""


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_HOLDS = {
    1: "len(list_filter(string_split(value, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0",
    2: f"length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(reverse({_DIGITS})[k] AS INT) ELSE CAST(reverse({_DIGITS})[k] AS INT) * 2 % 10 + CAST(reverse({_DIGITS})[k] AS INT) // 5 END)) % 10 = 0",
    3: f"length({_DIGITS}) BETWEEN 10 AND 15",
}
_TERM = r"\p{L}[\p{L}\p{M}\p{N}]*"
PII = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS ({" UNION ALL ".join(f"SELECT doc_id, pos AS a, {k} AS kind, pos + length(value) AS z, value FROM {_found('d', 'text', p)} WHERE {_HOLDS.get(k, 'true')}" for k, p in enumerate(_PLAIN))}),
-- what lies outside base spans
e AS (SELECT doc_id, a, z, max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM b),
g AS (SELECT doc_id, upto AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a, z) AS z FROM (SELECT doc_id, a, z, upto FROM e UNION ALL SELECT DISTINCT doc_id, -1, -1, 0 FROM b)),
p AS (SELECT doc_id * 1000000 + g.a AS id, doc_id, g.a AS lead, substr(text, g.a + 1, coalesce(g.z, length(text)) - g.a) AS piece FROM g JOIN d USING (doc_id) WHERE coalesce(g.z, length(text)) > g.a),
w AS (SELECT p.doc_id, lead + f.pos AS a, lead + f.pos + length(value) AS z, lower(value) AS term FROM {_found('p', 'piece', _TERM, 'id')} f JOIN p USING (id)),
one AS (SELECT min(doc_id) AS doc_id FROM d SEMI JOIN b USING (doc_id) GROUP BY text),
n_t AS (SELECT term, count(*) AS n_t FROM (SELECT term FROM w SEMI JOIN one USING (doc_id) UNION ALL
  SELECT lower(unnest(regexp_extract_all(text, '{_TERM}'))) FROM d ANTI JOIN b USING (doc_id)) GROUP BY 1),
n_e AS (SELECT kind, value, count(*) AS n_e FROM b SEMI JOIN one USING (doc_id) GROUP BY 1, 2),
n_te AS (SELECT kind, value, term, count(*) AS n_te FROM w SEMI JOIN one USING (doc_id) JOIN (SELECT DISTINCT doc_id, kind, value FROM b) USING (doc_id) GROUP BY 1, 2, 3 HAVING count(DISTINCT doc_id) > 1),
told AS (SELECT *, 1 - ln(greatest(n_t / n_te, 1.0)) / ln(greatest((SELECT sum(n_t) FROM n_t)::DOUBLE / n_e, exp(1))) AS told FROM n_te JOIN n_t USING (term) JOIN n_e USING (kind, value)),
more AS (SELECT doc_id, a, CASE WHEN max(told) >= {pii.REMOVE} THEN 5 ELSE 4 END AS kind, z FROM w JOIN (SELECT DISTINCT doc_id, kind, value FROM b) h USING (doc_id) JOIN told t ON w.term = t.term AND h.kind = t.kind AND h.value = t.value
  WHERE told >= {pii.GENERALISE} GROUP BY doc_id, a, z),
s AS (SELECT doc_id, a, kind, z, ['{"', '".join(pii.KINDS)}'][kind + 1] || ':' || a || ':' || z AS said FROM (SELECT doc_id, a, kind, z FROM b UNION ALL SELECT doc_id, a, kind, z FROM more)),
o AS (SELECT doc_id, coalesce(string_agg(said, ',' ORDER BY a, kind, z) FILTER (kind < 4), '') AS base, string_agg(said, ',' ORDER BY a, kind, z) AS spans,
  {", ".join(f"count(*) FILTER (kind = {k}) AS n_{x}" for k, x in enumerate(pii.KINDS[:4]))} FROM s GROUP BY 1)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{x}, 0) AS BIGINT) AS n_{x}" for x in pii.KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)"""

ORACLES = {"op4_suffix_array_dedup": REPEATS, "op5_mixing": MIX, "op7_substring_dedup": SPANS, "op8_pii": PII, "op10_warc": WARC}
