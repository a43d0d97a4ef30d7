"""DuckDB SQL for the operators that SQL expresses."""

from __future__ import annotations

from .common import LOWER, UPPER
from .decontamination import SHARE, WINDOW
from .divergence import ADDED, LEAST_DOCS, SCALE, TOP
from .jaccard import PERCENT, SHINGLE
from .quality import HOST_LIMIT, RULES, SYMBOLS
from .substring import WINDOW as PASSAGE

WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
NORMAL = r"list_filter(regexp_split_to_array(" + LOWERED + r", '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {NORMAL} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {NORMAL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS key FROM b, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM d, (SELECT DISTINCT n FROM bw) k, unnest(range(1, len(w) - n + 2)) AS r(i)),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.key = bw.key AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit) h, unnest(range(0, n)) AS s(j) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + {PASSAGE - 1}], ' ') AS key FROM d, unnest(range(1, len(w) - {PASSAGE} + 2)) AS r(i)),
rep AS (SELECT doc_id, i FROM v WHERE key IN (SELECT key FROM v GROUP BY key HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM rep, unnest(range(0, {PASSAGE})) AS s(j)),
word AS (SELECT doc_id, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWERED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least({SHINGLE}, len(w)) - 1], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - {SHINGLE} + 2, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_in JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {PERCENT} * (x.k + y.k - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.k, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least_of.b, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON d.doc_id = least_of.a
"""

_FAILS = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "lengths": "(word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}
QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM d, unnest(range(1, len(w) - 1)) AS r(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, unnest(range(0, 3)) AS s(j) GROUP BY doc_id),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, {", ".join(f"({e})::INT AS fail_{r}" for r, e in _FAILS.items())} FROM m),
h AS (SELECT source AS host, count(*) AS n_docs, {", ".join(f"sum(fail_{r}) AS {r}" for r in RULES)} FROM f GROUP BY source),
p AS (SELECT {", ".join(f"sum({r}) / sum(n_docs) AS m_{r}, sum({r} * {r} / n_docs) / sum(n_docs) - (sum({r}) / sum(n_docs)) * (sum({r}) / sum(n_docs)) AS v_{r}" for r in RULES)} FROM h),
v AS (SELECT host, {" OR ".join(f"({r} + m_{r} * k_{r}) / (n_docs + k_{r}) > {HOST_LIMIT}" for r in RULES)} AS rejected
  FROM h, (SELECT *, {", ".join(f"CASE WHEN v_{r} > 1e-12 THEN least(1000.0, greatest(1.0, m_{r} * (1 - m_{r}) / v_{r} - 1)) ELSE 1000.0 END AS k_{r}" for r in RULES)} FROM p))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_short + fail_repeats > 0 AS base_failed, fail_short + fail_repeats = 0 AND NOT rejected AS kept FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.host
"""


#: Written for itself: the text's line feeds are counted and cut at, rather than its lines collected and joined.
FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text[-1] = chr(10) THEN 0 ELSE 1 END)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, string_split(text, chr(10)) AS parts, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, length(array_to_string(parts[1:a], chr(10))) + CASE WHEN a > 0 AND a < len(parts) THEN 1 ELSE 0 END AS pre, length(array_to_string(parts[1:b], chr(10))) + CASE WHEN b > 0 AND b < len(parts) THEN 1 ELSE 0 END AS mid FROM c),
t AS (SELECT *, substr(text, 1, pre) AS prefix, substr(text, pre + 1, mid - pre) AS middle, substr(text, mid + 1) AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM t
"""

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {ADDED})) // (gn.n + {ADDED} * v.v) AS p, 1 + ({SCALE}::HUGEINT * (kept.total + {ADDED})) // (v.n + {ADDED} * v.v) AS q
  FROM gn JOIN v ON gn.lang = v.lang JOIN kept ON kept.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
found AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_benchmark_decontamination": DECONTAMINATION, "op5_substring_dedup": SUBSTRINGS, "op8_quality_rules": QUALITY, "op10_ngram_jaccard_join": NEAR_DUPLICATES,
        "op11_fill_in_middle": FILL_IN_MIDDLE, "op13_source_divergence": DIVERGENCE}
