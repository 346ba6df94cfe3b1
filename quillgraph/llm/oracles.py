"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from quillgraph.llm import licenses, secrets

TOPK = """
WITH rows AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.row, q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM rows q JOIN rows x ON q.vec_id % 100 = 0 AND q.row <> x.row)
SELECT query_id, rank::INT AS rank, vec_id, coalesce(score, 0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""


def _spans(pattern: str, rank: str, group: int = 0, least: int = 0) -> str:
    """Matches of a pattern in t, where they stand by the lengths of what lies between."""
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{'start': list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i-1], lambda x: length(x))), 0), 'rank': {rank}, 'size': length(regexp_extract_all(t, '{p}')[i]), 'found': regexp_extract_all(t, '{p}')[i], 'fits': length(regexp_extract_all(t, '{p}', {group})[i]) >= {least}}}), lambda s: s.fits)"""


#: RE2 has no back references: a character eight times in a row is written out over the alphabet of candidates.
_REPEATED = "|".join(f"{c}{{8}}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-".replace("+", ""))
_ALLOW = secrets.ALLOW.replace(r"(.)\1{7}", _REPEATED + r"|\+{8}").replace("(?i)", "(?i:", 1) + ")"
_SUMS = ", ".join(str(sum(secrets.STEP[:c])) for c in range(1, secrets.WINDOW + 1))
_KINDS = ", ".join(f"'{k}'" for k in secrets.KINDS)


def _written(spans: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_sort(list_transform({spans}, lambda s: {{'start': s.start, 'rank': s.rank, 'stop': s.start + s.size}})), lambda s: [{_KINDS}][s.rank + 1] || ':' || s.start::BIGINT || ':' || s.stop::BIGINT), ','), '')"


SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, {_spans(secrets.ASSIGN, "0", 2, 8)} AS assign, {_spans(secrets.ACCESS, "1")} AS access, {_spans(secrets.HEX, "2")} AS hex, {_spans(secrets.RUN, "4")} AS runs FROM texts),
judged AS (SELECT *, list_concat(assign, access, hex) AS base,
  list_filter(list_transform(list_filter(runs, lambda s: NOT regexp_matches(s.found, '{_ALLOW}')), lambda s: {{'start': s.start, 'rank': CASE WHEN regexp_full_match(s.found, '[0-9A-Fa-f]+') THEN 3 ELSE 4 END, 'size': s.size, 'found': s.found, 'fits': true,
    'least': list_min(list_transform(range(1, s.size - {secrets.WINDOW} + 2), lambda i: list_sum(list_transform(list_distinct(string_split(s.found[i:i+{secrets.WINDOW - 1}], '')), lambda c: [{_SUMS}][{secrets.WINDOW} - length(replace(s.found[i:i+{secrets.WINDOW - 1}], c, ''))]))))}}),
    lambda s: s.least <= CASE s.rank WHEN 3 THEN {secrets.most_allowed(secrets.CLASSES["hexrun"])} ELSE {secrets.most_allowed(secrets.CLASSES["b64run"])} END) AS high FROM found),
added AS (SELECT *, list_transform(list_filter(high, lambda s: len(list_filter(base, lambda b: b.start <= s.start AND b.start + b.size >= s.start + s.size)) = 0), lambda s: {{'start': s.start, 'rank': s.rank, 'size': s.size, 'found': s.found, 'fits': true}}) AS extra FROM judged)
SELECT doc_id, len(assign) AS n_assign, len(access) AS n_access, len(hex) AS n_hex, sha256({_written("base")}) AS base_sha256, {_written("list_concat(base, extra)")} AS spans FROM added
"""


def _templates() -> str:
    rows = []
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        grams = licenses.bigrams_of(licenses.normal_words(text))
        rows.append(f"({i}, '{name}', [{', '.join(repr(g) for g in grams)}])")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(i, name, grams)"


LICENSES = rf"""
WITH templates AS ({_templates()}),
texts AS (SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS t FROM documents),
units AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(t, chr(10)), string_split_regex(t, '\n\n+'), [t]))) AS unit FROM texts),
worded AS (SELECT doc_id, unit, list_filter(string_split_regex(unit, '[ \n]'), lambda w: w <> '') AS w FROM units),
paired AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM worded WHERE len(w) >= 2),
scored AS (SELECT doc_id, unit, i, name, 2.0::DOUBLE * len(list_intersect(p.grams, t.grams)) / (len(p.grams) + len(t.grams)) AS dice FROM paired p CROSS JOIN templates t),
best AS (SELECT * FROM scored WHERE dice >= {licenses.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, i) = 1),
top AS (SELECT doc_id, first(name ORDER BY dice DESC, i) AS license, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n_units FROM best GROUP BY doc_id)
SELECT d.doc_id, license, dice, coalesce(licenses, '') AS licenses, coalesce(n_units, 0) AS n_units FROM documents d LEFT JOIN top USING (doc_id)
"""
