"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from patronage.llm.mixing import MOST_COPIES, SEED, WEIGHTS
from patronage.llm.quality import POLICIES, RULES
from patronage.llm.urls import LEAST_OVERLAP, MOST_OVERLAP, THRESHOLD, TWO_LABEL_SUFFIXES, Z

WORD = r"[^\x20\x09-\x0D]+"
ORACLE: dict[str, str] = {}

ORACLE["op4_mixing"] = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
  FROM sized GROUP BY source),
weighted AS (
  SELECT source, s, {MOST_COPIES} * s AS stop, [{", ".join(map(str, WEIGHTS))}][i % {len(WEIGHTS)} + 1] AS w
  FROM sources),
ahead AS (
  SELECT coalesce(sum(stop) OVER before, 0) AS given, sum(w) OVER rest AS open, sum(s) OVER () AS total FROM weighted
  WINDOW before AS (ORDER BY stop / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY stop / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT max(CAST(total - given AS DOUBLE) / CAST(open AS DOUBLE)) AS level FROM ahead),
targets AS (
  SELECT source, s, least(CAST(stop AS DOUBLE), level * w) AS target,
         CAST('0x' || substr(md5(coalesce('{SEED}:' || source, '{SEED}')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM weighted, level),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS k FROM sized),
taking AS (
  SELECT doc_id, size, s AS source_size, target,
         CASE WHEN s > 0 THEN target / s ELSE 0.0::DOUBLE END AS e, u, k
  FROM numbered n JOIN targets t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, c AS copies, c * size AS taken FROM (
  SELECT *, least(CAST(floor(u + (k + 1) * e) - floor(u + k * e) AS BIGINT), {MOST_COPIES}) AS c FROM taking)
"""

_BITS = " + ".join(f"CASE WHEN {rule.sql} THEN {1 << place} ELSE 0 END" for place, rule in enumerate(RULES))
ORACLE["op6_quality_rules"] = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words FROM texts),
places AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM worded),
threes AS (
  SELECT r, p, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM places WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM threes WHERE c IS NOT NULL)
  WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT p + step) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS step) GROUP BY r),
lined AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts),
lines AS (
  SELECT r, count(*) AS n, count(DISTINCT line) AS d FROM lined WHERE regexp_matches(line, '{WORD}') GROUP BY r),
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n - l.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines,
         CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclamations
  FROM worded LEFT JOIN covered c USING (r) LEFT JOIN lines l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {POLICIES["base.1"]}) <> 0 AS base_failed, (failed & {POLICIES["web.2"]}) = 0 AS kept, failed
FROM (SELECT *, CAST({_BITS} AS INTEGER) AS failed FROM measured)
"""

_TWO = ", ".join(f"'{suffix}'" for suffix in TWO_LABEL_SUFFIXES)
_LABELS = "string_split(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', ''), '.')"


def _overlap(groups: str) -> str:
    chance = "n * prior * (1 - prior)"
    return f"""SELECT 1 / least(greatest(coalesce(sum((bad - n * prior) ** 2 - {chance})
      / nullif(sum({chance} * (n - 1)), 0), {LEAST_OVERLAP}), {LEAST_OVERLAP}), {MOST_OVERLAP}) - 1 AS k FROM {groups}"""


ORACLE["op8_url_filter"] = f"""
WITH parsed AS (
  SELECT page_id, url, lower(regexp_extract(rest, '^[^/?#]*')) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages)),
labelled AS (
  SELECT p.host, 1 - l.quality AS bad FROM parsed p
  LEFT JOIN labels l ON l.doc_id = try_cast(regexp_extract(p.path, '/(\\d{{1,18}})(\\.html|/)?$', 1) AS BIGINT)
  WHERE p.host <> ''),
hosts AS (
  SELECT host, n, bad, parts, CASE WHEN wide THEN array_to_string(parts[-3:], '.') ELSE two END AS domain,
         CASE WHEN wide THEN two ELSE parts[-1] END AS suffix
  FROM (SELECT *, array_to_string(parts[-2:], '.') AS two, array_to_string(parts[-2:], '.') IN ({_TWO}) AS wide
        FROM (SELECT host, {_LABELS} AS parts, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM labelled GROUP BY host))),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, sum(sum(bad)) OVER () / sum(sum(n)) OVER () AS prior
  FROM domains GROUP BY suffix),
suffix_k AS ({_overlap("suffixes")}),
domains_p AS (
  SELECT d.*, (s.bad + k * s.prior) / (s.n + k) AS prior FROM domains d JOIN suffixes s USING (suffix), suffix_k),
domain_k AS ({_overlap("domains_p")}),
hosts_p AS (
  SELECT h.host, h.n, h.bad, (d.bad + k * d.prior) / (d.n + k) AS prior
  FROM hosts h JOIN domains_p d USING (domain, suffix), domain_k),
host_k AS ({_overlap("hosts_p")}),
posterior AS (SELECT host, n, k, (bad + k * prior) / (n + k) AS mean FROM hosts_p, host_k),
blocked AS (SELECT host FROM posterior WHERE mean - {Z} * sqrt(mean * (1 - mean) / (n + k + 1)) > {THRESHOLD}),
ruled AS (
  SELECT *, '.' || host AS dotted FROM parsed)
SELECT page_id, host, path, rule, coalesce(CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block' END,
       CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, CASE WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM ruled)
"""


def shingles_sql(words: int = 5) -> str:
    """CTEs that end in ``shingles`` (doc_id, s): the distinct shingles of every document."""
    ahead = ", ".join(f"lead(w, {i}) OVER o AS w{i}" for i in range(1, words))
    joined = " || ' ' || ".join(["w", *[f"w{i}" for i in range(1, words)]])
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
texts AS (SELECT doc_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '{WORD}') AS words FROM documents),
places AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS p, len(words) AS n FROM texts),
runs AS (SELECT doc_id, n, w, {ahead} FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
shingles AS (
  SELECT DISTINCT doc_id, {joined} AS s FROM runs WHERE w{words - 1} IS NOT NULL
  UNION SELECT doc_id, array_to_string(words, ' ') FROM texts WHERE len(words) BETWEEN 1 AND {words - 1})"""


ORACLE["op9_minhash"] = f"""
WITH RECURSIVE {shingles_sql()},
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(l.c, d.doc_id) AS component_id,
       coalesce(l.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""

_PASSAGE = 50  # 32 + 16 + 2 words, joined by doubling
_OVER = "OVER (PARTITION BY doc_id ORDER BY p)"
ORACLE["op10_repeated_passages"] = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS words FROM documents WHERE doc_id IS NOT NULL),
w1 AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p, len(words) AS n FROM texts),
w2 AS (SELECT *, w || ' ' || lead(w, 1) {_OVER} AS a2 FROM w1),
w4 AS (SELECT *, a2 || ' ' || lead(a2, 2) {_OVER} AS a4 FROM w2),
w8 AS (SELECT *, a4 || ' ' || lead(a4, 4) {_OVER} AS a8 FROM w4),
w16 AS (SELECT *, a8 || ' ' || lead(a8, 8) {_OVER} AS a16 FROM w8),
w32 AS (SELECT *, a16 || ' ' || lead(a16, 16) {_OVER} AS a32 FROM w16),
w50 AS (SELECT doc_id, p, n, a32 || ' ' || lead(a16, 32) {_OVER} || ' ' || lead(a2, 48) {_OVER} AS s FROM w32),
seen AS (
  SELECT doc_id, p, first_value(doc_id) OVER o AS source, first_value(p) OVER o AS source_p, row_number() OVER o AS k
  FROM w50 WHERE p + {_PASSAGE} <= n WINDOW o AS (PARTITION BY s ORDER BY doc_id, p)),
later AS (SELECT *, p > lag(p) {_OVER} + {_PASSAGE} AS apart FROM seen WHERE k > 1),
islands AS (SELECT *, sum(CASE WHEN apart IS NOT FALSE THEN 1 ELSE 0 END) {_OVER} AS island FROM later)
SELECT doc_id, CAST(min(p) AS BIGINT) AS start_word, CAST(max(p) - min(p) + {_PASSAGE} AS BIGINT) AS n_words,
       arg_min(source, p) AS source_doc_id, CAST(arg_min(source_p, p) AS BIGINT) AS source_start
FROM islands GROUP BY doc_id, island
"""

ORACLE["op2_nearest"] = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""

# every run holds five words in a row that equal those one period before: pairs of such stretches give all lags
ORACLE["op11_periodic_runs"] = f"""
WITH worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w,
    flatten([[(ascii(c) >> k) & 1 FOR k IN range(8)] FOR c IN string_split(doc_id::VARCHAR, '')]) AS bits
  FROM documents
),
hashed AS (
  SELECT doc_id, w, len(w) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b:
    xor(c >> 1, CASE WHEN xor(c, b::BIGINT) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))) AS h
  FROM worded
),
dealt AS (
  SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS hit, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM hashed
),
listed AS (
  SELECT doc_id, n, hit, a, 1 + (n - a) // (3 + g % 8) AS p, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM dealt
),
words AS (
  SELECT l.doc_id, l.n, l.i, coalesce(o.word, l.word) AS word
  FROM listed l LEFT JOIN listed o ON l.hit AND l.i >= l.a AND o.doc_id = l.doc_id AND o.i = l.a + (l.i - l.a) % l.p
),
grams AS (
  SELECT doc_id, n, i, concat_ws(' ', word, lead(word, 1) OVER t, lead(word, 2) OVER t, lead(word, 3) OVER t, lead(word, 4) OVER t) AS gram
  FROM words WINDOW t AS (PARTITION BY doc_id ORDER BY i)
),
diagonals AS (
  SELECT a.doc_id, a.i - b.i AS q, a.i FROM grams a JOIN grams b USING (doc_id, gram)
  WHERE a.i > b.i AND 4 * (a.i - b.i) <= a.n AND a.i + 5 <= a.n
),
stretches AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM diagonals
),
candidates AS (
  SELECT doc_id, min(i) - q AS start, count(*) + 4 + q AS length, q AS period FROM stretches
  GROUP BY doc_id, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)
),
runs AS (
  SELECT * FROM candidates r WHERE NOT EXISTS (FROM candidates s WHERE s.doc_id = r.doc_id AND s.period < r.period
    AND r.period % s.period = 0 AND s.start <= r.start AND r.start + r.length <= s.start + s.length)
),
totals AS (
  SELECT doc_id, count(*) AS n_runs, max({{'length': length, 'start': -start, 'period': -period}}) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id
),
dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
),
collapsed AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_words, coalesce(t.n_runs, 0) AS n_runs, -t.best.start AS start, t.best.length AS length,
  -t.best.period AS period, 1000 * t.best.length // -t.best.period AS exponent_milli,
  sha256(coalesce(t.lines, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM dealt d LEFT JOIN totals t USING (doc_id) LEFT JOIN collapsed c USING (doc_id)
"""

ORACLE["op12_hard_negatives"] = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_dot_product(a.vector, b.vector) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
