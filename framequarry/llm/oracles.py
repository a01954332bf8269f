"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_RULES = (("symbols", "n_symbols", "word_chars", 50), ("bangs", "n_bangs", "word_chars", 100), ("capitals", "n_capitals", "word_chars", 400), ("echoes", "n_echoes", "n_words", 300))
_ratio = {r: f"((10000 * {a}) // greatest({b}, 1))" for r, a, b, _ in _RULES}
_union = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {s} AS spread, {_ratio[r]} AS v FROM counts WHERE n_words > 0" for r, _, _, s in _RULES)


_top = lambda q: f"min(CASE WHEN up_to * 4 >= total * {q} THEN top END)"

ORACLES["op2_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM s WHERE len(w) >= 5),
gr AS (SELECT rid, i, w[i:i+4] AS gram FROM g),
twice AS (SELECT rid, gram FROM gr GROUP BY rid, gram HAVING count(*) > 1),
hit AS (SELECT gr.rid, gr.i FROM gr JOIN twice t ON gr.rid = t.rid AND gr.gram = t.gram),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
counts AS (SELECT s.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  (length(text) - length(replace(text, '!', '')))::BIGINT AS n_bangs,
  (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_echoes
  FROM s LEFT JOIN rep ON s.rid = rep.rid),
vals AS ({_union}),
tops AS (SELECT *, CASE WHEN v < 64 THEN v ELSE (((v >> (length(bin(v)) - 6)) + 1) << (length(bin(v)) - 6)) - 1 END AS top FROM vals),
own AS (SELECT lang, source, rule, top, max(spread) AS spread, 1000 * count(*) AS n FROM tops GROUP BY ALL),
bylang AS (SELECT lang, rule, top, spread, 50000 * n // sum(n) OVER (PARTITION BY lang, rule) AS n FROM (SELECT lang, rule, top, max(spread) AS spread, sum(n) // 1000 AS n FROM own GROUP BY lang, rule, top)),
both_of AS (SELECT * FROM own UNION ALL SELECT g.lang, g.source, l.rule, l.top, l.spread, l.n FROM (SELECT DISTINCT lang, source FROM own) g JOIN bylang l ON g.lang IS NOT DISTINCT FROM l.lang),
mixed AS (SELECT lang, source, rule, top, max(spread) AS spread, sum(n) AS n FROM both_of GROUP BY lang, source, rule, top),
lim AS (SELECT lang, source, rule, {_top(3)} + 3 * greatest({_top(3)} - {_top(1)}, max(spread)) AS hi FROM (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY top) AS up_to, sum(n) OVER (PARTITION BY lang, source, rule) AS total FROM mixed) GROUP BY lang, source, rule),
lims AS (SELECT lang, source, {", ".join(f"max(CASE WHEN rule = '{r}' THEN hi END)::BIGINT AS max_{r}" for r, *_ in _RULES)} FROM lim GROUP BY lang, source),
v AS (SELECT counts.*, {", ".join(f"max_{r}" for r, *_ in _RULES)}, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed
  FROM counts LEFT JOIN lims ON counts.lang IS NOT DISTINCT FROM lims.lang AND counts.source IS NOT DISTINCT FROM lims.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed) AND {" AND ".join(f"{_ratio[r]} <= coalesce(max_{r}, 4611686018427387904)" for r, *_ in _RULES)} AS kept,
  {", ".join(f"{_ratio[r]}::BIGINT AS {r}_ratio" for r, *_ in _RULES)}, {", ".join(f"max_{r}" for r, *_ in _RULES)}
FROM v
"""

_BASE10 = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def _license_sql() -> str:
    from .license_scan import TEMPLATES

    rows = [(0 + i, x, y, True) for i, (x, y) in enumerate(_BASE10)] + [(3 + i, x, y, False) for i, (y, x) in enumerate(TEMPLATES)]
    values = ", ".join(f"({t}, '{x}', '{y}', {e})" for t, x, y, e in rows)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT rid, p, w[p+1] || ' ' || w[p+2] || ' ' || w[p+3] AS gram FROM (SELECT rid, w, unnest(range(0, len(w) - 2)) AS p FROM d WHERE len(w) >= 3)),
t AS (SELECT t, string_split(x, ' ') AS tw, label, exact FROM (VALUES {values}) v(t, x, label, exact)),
tg AS (SELECT t, j, len(tw) AS n, label, exact, tw[j+1] || ' ' || tw[j+2] || ' ' || tw[j+3] AS gram FROM (SELECT *, unnest(range(0, len(tw) - 2)) AS j FROM t)),
hits AS (SELECT rid, t, n, label, exact, p - j AS d, j FROM g JOIN tg USING (gram)),
diag AS (SELECT DISTINCT rid, t, exact, d FROM hits),
new AS (SELECT *, CASE WHEN exact OR d - lag(d) OVER (PARTITION BY rid, t ORDER BY d) > 2 THEN 1 ELSE 0 END AS new FROM diag),
span AS (SELECT rid, t, d, sum(new) OVER (PARTITION BY rid, t ORDER BY d) AS span FROM new),
cov AS (SELECT h.rid, h.t, any_value(n) AS n, any_value(label) AS label, any_value(exact) AS exact, min(h.d) AS d, count(DISTINCT j + k) AS c
  FROM hits h JOIN span s ON h.rid = s.rid AND h.t = s.t AND h.d = s.d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY h.rid, h.t, s.span),
f AS (SELECT *, c / n::DOUBLE AS share, exact AND c = n AS whole, NOT exact AND c / n::DOUBLE >= 0.7 AS found FROM cov),
a AS (SELECT rid, count(*) FILTER (whole) AS n_base, min(d) FILTER (whole) AS first_word, max(d) FILTER (whole) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole OR found) AS labels, max(share) FILTER (whole OR NOT exact) AS score FROM f GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN a USING (rid)
"""


ORACLES["op10_license_scan"] = _license_sql()

ORACLES["op9_mix_sources"] = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
s AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n)::DOUBLE * n) AS rate FROM n),
r AS (SELECT source, rate, greatest(ceil(rate / 32.0), 1)::INT AS draws FROM s),
pois(source, k, lam, p, c) AS (SELECT source, 0, rate / draws, exp(-(rate / draws)), exp(-(rate / draws)) FROM r
  UNION ALL SELECT source, k + 1, lam, p * lam / (k + 1), c + p * lam / (k + 1) FROM pois WHERE k < ceil(lam + 12 * sqrt(lam) + 24)),
d AS (SELECT row_number() OVER () AS rid, row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) AS no, * FROM documents),
u AS (SELECT rid, d.source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':' || no || ':' || i || ':20'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM (SELECT d.rid, d.no, d.doc_id, d.text, d.source, unnest(range(1, draws + 1)) AS i FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source) d),
c AS (SELECT rid, count(*) AS n FROM u JOIN pois ON u.source IS NOT DISTINCT FROM pois.source AND pois.c <= u.u GROUP BY rid)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy FROM d JOIN c USING (rid)
"""
ORACLES["op8_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, *, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, source, ls[i] AS line, i FROM (SELECT rid, doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
  WHERE regexp_matches(ls[i], '[^\x20\x09-\x0D]')),
b AS (SELECT line, min((doc_id, i)) AS first FROM l GROUP BY line HAVING count(DISTINCT source) >= 5),
g AS (SELECT rid, list(i) AS gone FROM l JOIN b USING (line) WHERE (doc_id, i) <> first GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM l GROUP BY rid),
t AS (SELECT d.*, gone, coalesce(n.n, 0) AS n, CASE WHEN gone IS NULL THEN text ELSE array_to_string([ls[i] for i in range(1, len(ls) + 1) if NOT list_contains(gone, i)], chr(10)) END AS t
  FROM d LEFT JOIN g USING (rid) LEFT JOIN n USING (rid))
SELECT doc_id, t AS text, lang, source, length(t)::BIGINT AS n_chars, n::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed FROM t
"""
