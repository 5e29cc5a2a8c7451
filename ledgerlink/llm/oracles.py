"""SQL, for DuckDB, that returns what the operators' queries return."""

from __future__ import annotations

from ledgerlink.llm import licenses, quality

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
link AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT link.b, r.root FROM r JOIN link ON link.a = r.id)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) m ON m.id = n.doc_id
"""


def quality_sql() -> str:
    ratios = {
        "symbols_per_word": "n_symbols / nw", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)::DOUBLE", "repeat_share": "n_repeat_words / nw", "marks_per_word": "n_marks / nw",
        "upper_share": "n_upper / greatest(word_chars, 1)::DOUBLE", "long_words": "word_chars / nw", "short_words": "-word_chars / nw",
    }
    grid = ", ".join(f"('{r}', {j}, {c}::DOUBLE)" for r, cs in quality.GRID.items() for j, c in enumerate(cs))
    look = "CASE rule " + " ".join(f"WHEN '{r}' THEN {x}" for r, x in ratios.items()) + " END"
    risk, tests = quality.RISK / len(quality.GRID), sum(map(len, quality.GRID.values()))
    names = "concat_ws(',', " + ", ".join(f"CASE WHEN {ratios[r]} > (SELECT c.cutoff FROM best c WHERE c.rule = '{r}' AND c.stratum IS NOT DISTINCT FROM f.lang) THEN '{r}' END" for r in quality.GRID) + ")"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) >= 5),
h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM h) x GROUP BY doc_id),
b AS (SELECT doc_id, lang, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(text) - length(replace(text, '!', '')) AS n_marks, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
f AS (SELECT b.doc_id, lang, text, CAST(n_words AS BIGINT) AS n_words, greatest(n_words, 1)::DOUBLE AS nw, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_marks, n_upper,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        (n_words < 10 OR 100 * coalesce(c.n, 0) > 20 * n_words) AS base_failed FROM b LEFT JOIN c ON c.doc_id = b.doc_id),
l AS (SELECT doc_id, min(quality) AS label FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
held AS (SELECT f.*, min(label) OVER (PARTITION BY lang, text) AS label FROM f JOIN l ON l.doc_id = f.doc_id WHERE NOT base_failed QUALIFY row_number() OVER (PARTITION BY lang, text) = 1),
grid(rule, rank, cutoff) AS (VALUES {grid}),
k AS (SELECT lang AS stratum, rule, rank, cutoff, sum(label) AS good, count(*) FILTER (label = 1 AND {look} > cutoff) AS false_, count(*) FILTER (label = 0 AND {look} > cutoff) AS caught FROM held, grid GROUP BY ALL),
p AS (SELECT k.*, CASE WHEN false_ >= good * {risk}::DOUBLE THEN 1.0 ELSE (SELECT sum(exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({risk}::DOUBLE) + (good - i) * ln(1 - {risk}::DOUBLE))) FROM range(0, CAST(false_ + 1 AS BIGINT)) r(i)) END AS p FROM k),
sure AS (SELECT * FROM p WHERE p <= {quality.LEVEL}::DOUBLE / ({tests} * (SELECT count(DISTINCT coalesce(stratum, '')) FROM k)) AND caught > false_),
best AS (SELECT stratum, rule, cutoff FROM sure QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - false_ DESC, rank) = 1),
v AS (SELECT f.*, nullif({names}, '') AS failed_rules FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND failed_rules IS NULL) AS kept, failed_rules FROM v
"""


def licence_sql(num: int = 80, den: int = 100) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    sets = ", ".join(f"({quoted(k)}, [{', '.join(quoted(b) for b in licenses.template_bigrams(v))}])" for k, v in sorted(licenses.TEMPLATES.items()))
    return f"""
WITH t(template, m) AS (VALUES {sets}),
u AS (SELECT doc_id, unnest(range(0, len(p))) AS unit, unnest(p) AS part FROM (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN list_concat([text], string_split(text, chr(10))) ELSE [text] END AS p FROM documents WHERE text IS NOT NULL) x),
w AS (SELECT doc_id, unit, string_split(trim(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), '[^0-9a-z\\x{{80}}-\\x{{FFFF}}]+', ' ', 'g')), ' ') AS w FROM u),
g AS (SELECT doc_id, CAST(unit AS INTEGER) AS unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM w WHERE len(w) > 1),
j AS (SELECT doc_id, unit, len(s) AS n, template, len(m) AS k, len(list_intersect(s, m)) AS c FROM g, t WHERE {num} * (len(s) + len(m)) <= 2 * {den} * least(len(s), len(m)))
SELECT doc_id, unit, CAST(n AS INTEGER) AS unit_bigrams, template, CAST(c AS INTEGER) AS shared, CAST(k AS INTEGER) AS template_bigrams, 2.0::DOUBLE * c / (n + k) AS dice FROM j WHERE 2 * {den} * c >= {num} * (n + k)
QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY 2.0::DOUBLE * c / (n + k) DESC, template) = 1
"""
