"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from panelforge.llm.cross_tokenizer import op11_cross_tokenizer
from panelforge.llm.decontamination import op8_decontamination
from panelforge.llm.html_extraction import op1_html_extraction
from panelforge.llm.license_scan import BAND, BASE, LEAST_SCORE, NOTICES, op13_license_scan
from panelforge.llm.line_dedup import op3_line_dedup
from panelforge.llm.mixing import op9_mix_sources
from panelforge.llm.nearest import op10_nearest
from panelforge.llm.ngram_join import op6_ngram_join
from panelforge.llm.quality import op5_quality
from panelforge.llm.sharding import op4_sharding
from panelforge.llm.spelling_variants import op12_spelling
from panelforge.llm.suffix_dedup import op7_suffix_dedup
from panelforge.llm.token_counts import op2_token_counts

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_ngram_join": op6_ngram_join,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_mix_sources": op9_mix_sources,
    "op10_nearest": op10_nearest,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_spelling": op12_spelling,
    "op13_license_scan": op13_license_scan,
}

_LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, frequent.k IS NOT NULL AND keyed.doc_id <> keeper AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS src FROM d GROUP BY source
), w AS (
  SELECT *, CASE (src - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM s
), total AS (SELECT sum(source_size) * 1.5::DOUBLE AS budget FROM w),
filled AS (
  SELECT w.*, budget,
         most <= weight * ((budget - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))) AS is_full
  FROM w, total WINDOW before AS (ORDER BY most / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), p AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN most ELSE weight * (budget - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0))
              / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target
  FROM filled
), q AS (
  SELECT *, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS epochs,
         CAST(floor(target) AS BIGINT) - (CAST(floor(target) AS BIGINT) // greatest(source_size, 1)) * source_size AS rest
  FROM p
), o AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.epochs, q.rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM o
"""

_NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram
  FROM w
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 80 * (s.n + t.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT w.doc_id, coalesce(sizes.n, 0) AS n_shingles, min(reach.y) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.x = w.doc_id GROUP BY w.doc_id, sizes.n
"""

_PLAIN_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_LICENSES = f"""
WITH notices(label, base, text) AS (
  VALUES {", ".join(f"('{label}', {base}, '{text}')" for base, listed in ((True, BASE), (False, NOTICES)) for label, text in listed)}
), t AS (SELECT row_number() OVER () AS notice, label, base, {_PLAIN_WORDS} AS w FROM notices
), places AS (
  SELECT notice, label, base, m, j, w[j] AS a, w[j + 1] AS b FROM (SELECT *, len(w) AS m, unnest(range(1, len(w))) AS j FROM t)
), d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN_WORDS} AS w FROM documents
), pairs AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d)
), agreeing AS (
  SELECT DISTINCT rid, notice, label, base, m, i - j AS diagonal, unnest([j, j + 1]) AS j FROM pairs JOIN places USING (a, b)
), own AS (SELECT rid, notice, label, base, m, diagonal, count(*) AS own FROM agreeing GROUP BY ALL
), merged AS (
  SELECT own.*, count(DISTINCT g.j) AS of_notice, count(DISTINCT g.diagonal + g.j) AS of_text,
         max(g.diagonal + g.j) - min(g.diagonal + g.j) + 1 AS span
  FROM own JOIN agreeing g ON g.rid = own.rid AND g.notice = own.notice AND abs(g.diagonal - own.diagonal) <= {BAND}
  WHERE 3 * own >= own.m GROUP BY ALL
), spans AS (
  SELECT *, greatest(own / m, least(of_notice, of_text) / greatest(m, span)) AS score FROM merged
), found AS (
  SELECT rid, count(*) FILTER (base AND own = m) AS n_base, min(diagonal) FILTER (base AND own = m) AS first_word,
         max(diagonal) FILTER (base AND own = m) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND own = m) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM spans WHERE score >= {LEAST_SCORE} GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN found USING (rid)
"""

ORACLE_SQL = {"op3_line_dedup": _LINE_DEDUP, "op6_ngram_join": _NGRAM_JOIN, "op9_mix_sources": _MIX, "op13_license_scan": _LICENSES}
