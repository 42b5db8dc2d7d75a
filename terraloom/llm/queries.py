"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_extract, importance, language_id, license_scan, line_dedup, packing, pii_bootstrap, quality_rules, secret_scan, simhash_gray, token_alignment, warc_zip


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, pages, benchmark, labels = map(_table, ("documents", "pages", "benchmark", "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": lambda s, d: quality_rules.query(documents(s, d), labels(s, d)),
        "op2_language_id": lambda s, d: language_id.query(documents(s, d)),
        "op3_html_extract": lambda s, d: html_extract.query(pages(s, d)),
        "op4_simhash_gray": lambda s, d: simhash_gray.query(documents(s, d)),
        "op5_secret_scan": lambda s, d: secret_scan.query(documents(s, d)),
        "op6_license_scan": lambda s, d: license_scan.query(documents(s, d)),
        "op7_decontam": lambda s, d: decontam.query(documents(s, d), benchmark(s, d)),
        "op8_warc_zip": lambda s, d: warc_zip.query(pages(s, d)),
        "op9_packing": lambda s, d: packing.query(documents(s, d)),
        "op10_line_dedup": lambda s, d: line_dedup.query(documents(s, d)),
        "op11_importance": lambda s, d: importance.query(documents(s, d), benchmark(s, d)),
        "op12_token_alignment": lambda s, d: token_alignment.query(documents(s, d)),
        "op13_pii_bootstrap": lambda s, d: pii_bootstrap.query(documents(s, d)),
    }


#: Line dedup: keys of 40 code points or more in 5 documents or more stay in the largest doc_id only.
_LINES = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, keeper IS NOT NULL AND keyed.doc_id <> keeper AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


_WORD = r"[^\x20\x09-\x0D]+"


def _quality_sql() -> str:
    pct = lambda a, b: f"CASE WHEN {b} > 0 THEN 100e0*{a}/{b} ELSE 0e0 END"
    values = {"repeat_pct": pct("n_repeat_words", "n_words"), "symbol_pct": pct("n_symbols", "word_chars"), "dup_line_pct": pct("n_dup_lines", "n_lines"), "long_word_pct": pct("n_long_words", "n_words")}
    grid = ", ".join(f"('{rule}', {j}, {cut}::DOUBLE)" for rule, cuts in quality_rules.RULES.items() for j, cut in enumerate(cuts))
    p = quality_rules.ALPHA / len(quality_rules.RULES)
    value = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {v}" for rule, v in values.items()) + " END"
    cutoff = {rule: f"max(cut) FILTER (rule = '{rule}')" for rule in values}
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{_WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM t),
g AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words)-6)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT at_) AS n FROM (SELECT doc_id, unnest(range(i, i+8)) AS at_ FROM d) GROUP BY doc_id),
f AS (SELECT w.doc_id, CASE WHEN lang IS NULL THEN 'none' ELSE 'is ' || lang END AS stratum, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, length(text)-length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines)-len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(words, lambda x: length(x) > {quality_rules.LONG_WORD})) AS n_long_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100*n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT}*n_words AS base_failed FROM f),
grid(rule, j, cut) AS (VALUES {grid}),
c AS (SELECT stratum, rule, j, cut, count(*) AS n, sum(({value} > cut)::INT)::BIGINT AS k FROM b, grid WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
q AS (SELECT *, CASE WHEN k >= n*{p} THEN 1 ELSE list_sum(list_transform(range(0, k+1), lambda i: exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)+i*ln({p})+(n-i)*ln(1-{p})))) END <= {quality_rules.DELTA}/((SELECT count(DISTINCT stratum) FROM c)*{len(values)}) AS ok FROM c),
h AS (SELECT *, min(ok::INT) OVER (PARTITION BY stratum, rule ORDER BY j) AS held FROM q),
best AS (SELECT stratum, rule, first(cut ORDER BY j DESC) AS cut FROM h WHERE held = 1 GROUP BY stratum, rule),
cuts AS (SELECT stratum, {', '.join(f'{c} AS max_{rule}' for rule, c in cutoff.items())} FROM best GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rule_failed IS NULL AS kept, rule_failed
FROM (SELECT b.*, CASE {' '.join(f"WHEN {v} > max_{rule} THEN '{rule}'" for rule, v in values.items())} END AS rule_failed FROM b LEFT JOIN cuts USING (stratum))
"""


def _secret_sql() -> str:
    quote = lambda p: p.replace("'", "''")
    parts = " UNION ALL ".join(
        f"SELECT doc_id, source, {k} AS kind, '{kind}' AS name, regexp_extract_all(text, '{quote(p)}', 0) AS m, regexp_extract_all(text, '{quote(p)}', {group}) AS v, string_split_regex(text, '{quote(p)}') AS g, {least} AS least FROM t WHERE regexp_matches(text, '{quote(p)}')"
        for k, (kind, (p, group, least)) in enumerate(secret_scan.KINDS.items())
    )
    base = ", ".join(f"count(*) FILTER (name = '{x}') AS n_{x}" for x in secret_scan.BASE)
    span = "name || ':' || start || ':' || stop"
    return f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
f AS ({parts}),
u AS (SELECT *, unnest(range(1, len(m)+1)) AS i FROM f),
p AS (SELECT doc_id, source, kind, name, v[i] AS value, list_sum(list_transform(g[1:i], lambda x: length(x)))+coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start, length(m[i]) AS n FROM u WHERE length(v[i]) >= least),
o AS (SELECT value, count(DISTINCT coalesce(source, '?null')) AS owners, count(DISTINCT (coalesce(source, '?null'), doc_id)) AS repositories FROM p GROUP BY value),
j AS (SELECT doc_id, kind, name, start::BIGINT AS start, (start+n)::BIGINT AS stop, CASE WHEN owners > {secret_scan.MAX_OWNERS} OR repositories > {secret_scan.MAX_REPOSITORIES} THEN 'copied' WHEN len(list_distinct(string_split(value, ''))) >= 8 AND NOT regexp_matches(value, '{secret_scan._PLACEHOLDER}') AND regexp_matches(value, '[0-9]') THEN 'owner_specific' ELSE 'plain' END AS verdict FROM p JOIN o USING (value)),
k AS (SELECT * FROM j WHERE kind < {len(secret_scan.BASE)} OR verdict = 'owner_specific')
SELECT d.doc_id, {base}, sha256(coalesce(string_agg({span}, ',' ORDER BY start, kind) FILTER (kind < {len(secret_scan.BASE)}), '')) AS base_sha256, coalesce(string_agg({span}, ',' ORDER BY start, kind), '') AS spans, count(*) FILTER (verdict = 'owner_specific') AS n_owner_specific, count(*) FILTER (verdict = 'copied') AS n_copied
FROM (SELECT doc_id FROM documents) d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""


def _license_sql() -> str:
    words = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in license_scan.TEMPLATES.items())
    size = license_scan.SHINGLE
    grams = lambda key, source: f"SELECT DISTINCT {key}, array_to_string(w[i:i+{size - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w)-{size - 2})) AS i FROM {source})"
    return f"""
WITH tpl(license, text) AS (VALUES {rows}),
tw AS (SELECT license, {words('text')} AS w FROM tpl), dw AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
tg AS ({grams('license', 'tw')}), dg AS ({grams('doc_id', 'dw')}),
n AS (SELECT license, count(*) AS n FROM tg GROUP BY license)
SELECT doc_id, license, round(count(*)/any_value(n)::DOUBLE, 6) AS containment FROM dg JOIN tg USING (g) JOIN n USING (license) GROUP BY doc_id, license HAVING count(*) >= {license_scan.THRESHOLD}*any_value(n)
"""


def oracle_sql() -> dict[str, str]:
    """Shingle containment over the whole text stands for license windows where no notice is cut in parts."""
    return {"op1_quality_rules": _quality_sql(), "op5_secret_scan": _secret_sql(), "op6_license_scan": _license_sql(), "op10_line_dedup": _LINES}
