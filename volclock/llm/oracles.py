"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from volclock.llm import codes, divergence, lines, mixing, quality_rules

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key
  FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, key, size) AS number FROM sized),
by_source AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST({mixing.MAX_EPOCHS} * source_size AS DOUBLE) AS lim,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM by_source),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM by_source) - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(lim, (SELECT max(level) FROM levels) * weight) AS target FROM levels),
sent AS (
  SELECT s.source, s.size, s.key, s.number, s.key % {mixing.BUCKETS} AS bucket, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key % {mixing.BUCKETS}, s.key, s.size, s.number) AS sent
  FROM numbered s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source WHERE s.size > 0 AND t.target > 0),
packets AS (
  SELECT *, ((epoch - 1) * source_size + sent) / target AS finish
  FROM (SELECT *, unnest(range(1, 1 + CAST(least({mixing.MAX_EPOCHS}, ceil(target / source_size)) AS BIGINT))) AS epoch FROM sent)),
queued AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, bucket, key, size, number, epoch ROWS UNBOUNDED PRECEDING) AS running FROM packets),
last AS (
  SELECT source, max((epoch, bucket, key, size, number)) AS l FROM queued
  WHERE running <= (SELECT round(sum(target)) FROM targets) GROUP BY source),
decided AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN s.size = 0 OR l.l IS NULL THEN 0
              ELSE l.l[1] - 1 + CASE WHEN (s.key % {mixing.BUCKETS}, s.key, s.size, s.number) <= (l.l[2], l.l[3], l.l[4], l.l[5]) THEN 1 ELSE 0 END END AS epochs
  FROM numbered s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
  LEFT JOIN last l ON s.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size AS BIGINT) AS taken, CAST(epochs AS BIGINT) AS epochs FROM decided
"""

#: Set of word shingles of each document, then pairs that share enough, then what links reach.
GROUPS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {n} THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + {n} - 1], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, 1 + greatest(1, len(w) - {n} + 1))) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= {numerator} * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT l.b, r.c FROM reach r JOIN both_ways l ON l.a = r.d),
components AS (SELECT d, min(c) AS component_id FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN sizes USING (doc_id) JOIN components ON d = w.doc_id
"""

OP5 = GROUPS.format(n=3, numerator=90)

_METRICS = list(quality_rules.UPPER_SLACK)
_RATIOS = {"m_length": ("word_chars", "n_words"), "m_symbols": ("n_symbols", "n_words"), "m_lines": ("n_dup_lines", "n_lines"), "m_repeats": ("n_repeat_words", "n_words")}


def _values(metric: str) -> str:
    part, whole = _RATIOS[metric]
    return f"coalesce((1000 * {part}) // nullif({whole}, 0), 0)"


def _bounds() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {quality_rules.UPPER_SLACK[m]} AS up, {quality_rules.LOWER_SLACK.get(m, 'NULL')} AS down" for m in _METRICS
    )
    return rows


#: For a table named documents; ends with the relation ``judged``.
QUALITY = rf"""
base_words AS (SELECT doc_id, lang, source, {WORDS} AS w, coalesce(text, '') AS t FROM documents),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base_words WHERE len(w) >= 3))),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM grams, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
base AS (
  SELECT b.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base_words) b LEFT JOIN repeats USING (doc_id)),
flagged AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PCT} * n_words AS base_failed FROM base),
measured AS (
  {" UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS metric, {_values(m)} AS value FROM flagged" for m in _METRICS)}),
sketch AS (
  SELECT lang, source, metric, value - value % (1 << CAST(greatest(length(bin(value)) - 6, 0) AS INTEGER)) AS bin, count(*) AS n
  FROM measured WHERE NOT base_failed GROUP BY 1, 2, 3, 4),
levels AS (
  SELECT 1 AS rank, lang, source, metric, bin, n FROM sketch UNION ALL
  SELECT 2, lang, NULL, metric, bin, sum(n) FROM sketch GROUP BY lang, metric, bin UNION ALL
  SELECT 3, NULL, NULL, metric, bin, sum(n) FROM sketch GROUP BY metric, bin),
summed AS (
  SELECT *, sum(n) OVER (PARTITION BY rank, lang, source, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY rank, lang, source, metric) AS total FROM levels),
quartiles AS (
  SELECT rank, lang, source, metric, max(total) AS n, min(bin) FILTER (4 * upto >= total) AS lo, min(bin) FILTER (4 * upto >= 3 * total) AS hi
  FROM summed GROUP BY 1, 2, 3, 4),
chosen AS (
  SELECT g.lang, g.source, s.metric, up, down,
         CASE WHEN o.n >= {quality_rules.MIN_GROUP} THEN o.lo WHEN l.n >= {quality_rules.MIN_GROUP} THEN l.lo ELSE a.lo END AS lo,
         CASE WHEN o.n >= {quality_rules.MIN_GROUP} THEN o.hi WHEN l.n >= {quality_rules.MIN_GROUP} THEN l.hi ELSE a.hi END AS hi
  FROM (SELECT DISTINCT lang, source FROM flagged) g CROSS JOIN ({_bounds()}) s
  LEFT JOIN quartiles o ON o.rank = 1 AND o.metric = s.metric AND o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source
  LEFT JOIN quartiles l ON l.rank = 2 AND l.metric = s.metric AND l.lang IS NOT DISTINCT FROM g.lang
  LEFT JOIN quartiles a ON a.rank = 3 AND a.metric = s.metric),
failing AS (
  SELECT DISTINCT m.doc_id FROM measured m JOIN chosen c
    ON c.metric = m.metric AND c.lang IS NOT DISTINCT FROM m.lang AND c.source IS NOT DISTINCT FROM m.source
  WHERE m.value > hi + greatest({quality_rules.FENCE} * (hi - lo), up) OR m.value < lo - greatest({quality_rules.FENCE} * (hi - lo), down)),
judged AS (
  SELECT f.*, NOT base_failed AND x.doc_id IS NULL AS kept FROM flagged f LEFT JOIN failing x USING (doc_id))
"""

OP6 = f"""WITH {QUALITY} SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept FROM judged"""

OP8 = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n
  FROM (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35))),
starts AS (SELECT DISTINCT doc_id, i FROM windows WHERE n > 1),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
near AS (SELECT p.doc_id, p.i, p.word, s.i AS start FROM placed p ASOF LEFT JOIN starts s ON p.doc_id = s.doc_id AND p.i >= s.i),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM near WHERE start IS NULL OR start + 34 < i GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_P = f"""v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (n // {codes.PARTS}) AS part, (i - 1) % (n // {codes.PARTS}) AS place, v[i] AS x
  FROM (SELECT vec_id, v, len(v) AS n, unnest(range(1, len(v) + 1)) AS i FROM v)),
c0 AS MATERIALIZED (
  SELECT part, entry, place, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {codes.ENTRIES}) USING (vec_id))"""


def _rounds() -> str:
    out = ""
    for i in range(codes.ROUNDS + 1):
        out += f"""
d{i} AS MATERIALIZED (
  SELECT vec_id, part, min((d, entry)) AS best FROM (
    SELECT vec_id, part, entry, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM p JOIN c{i} c USING (part, place) GROUP BY 1, 2, 3)
  GROUP BY 1, 2),"""
        if i < codes.ROUNDS:
            out += f"""
n{i} AS MATERIALIZED (SELECT part, best[2] AS entry, place, sum(x) AS total, count(*) AS n FROM d{i} JOIN p USING (vec_id, part) GROUP BY 1, 2, 3),
c{i + 1} AS MATERIALIZED (
  SELECT part, entry, place, CASE WHEN n IS NULL THEN x ELSE CAST((total - ((total % n) + n) % n) // n AS BIGINT) END AS x
  FROM c{i} LEFT JOIN n{i} USING (part, entry, place)),"""
    return out


OP11 = f"""
WITH {_P},{_rounds()}
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM d{codes.ROUNDS} GROUP BY vec_id),
printed AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{codes.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), printed
"""

_PROBABILITY = "1 + CAST((1000000000 * (CAST({n} AS HUGEINT) + 2)) // ({total} + 2 * v) AS BIGINT)"

#: Every term of every pair of sources, without any saving.
OP12 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= {divergence.LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS of_lang FROM kept GROUP BY 1),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY 1, 2),
sources AS MATERIALIZED (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, of_lang
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN totals USING (lang, source) LEFT JOIN langs USING (lang)),
dense AS MATERIALIZED (
  SELECT lang, source, term, n, {_PROBABILITY.format(n="coalesce(n, 0)", total="total")} AS p, {_PROBABILITY.format(n="n_lang", total="of_lang")} AS q
  FROM sources JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
both_parts AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM dense WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts
QUALIFY part = 'pair' OR rank <= {divergence.TOP}
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, doc_id, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{lines.UPPER}', '{lines.LOWER}') AS key
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
common AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= {lines.LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.LEAST_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (last IS NOT NULL AND doc_id <> last) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM l LEFT JOIN common USING (key) GROUP BY r
"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": OP1, "op5_ngram_jaccard": OP5, "op6_quality_rules": OP6, "op8_substring_dedup": OP8,
    "op11_vector_codes": OP11, "op12_source_divergence": OP12, "op13_line_dedup": OP13,
}
