"""DuckDB SQL for the registered queries that SQL can express over whole tables."""

from __future__ import annotations

from tabwright.llm.quality_rules import STOP_WORDS
from tabwright.llm.secrets import BASE, RULES

_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

OP10 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), p AS (
  SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8
), h AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM p
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM h) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM r, range(0, 8) AS g(j) GROUP BY rid
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\pL]+', '', 'g')) AS n_letters,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals,
         len(list_filter(ws, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words,
         len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS n_stop,
         len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_same
  FROM w LEFT JOIN cov USING (rid)
), f AS (
  SELECT *,
    n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END > 0.1 AS f3,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END < 2.5
      OR CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END > 14 AS f4,
    CASE WHEN n_letters > 0 THEN n_capitals / n_letters ELSE 0 END > 0.6 AS f5,
    CASE WHEN n_words > 0 THEN n_letter_words / n_words ELSE 0 END < 0.7 AS f6,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END > 0.5 AS f7,
    CASE WHEN n_words >= 50 THEN n_stop / n_words ELSE 1 END < 0.02 AS f8,
    CASE WHEN n_words > 0 THEN n_same / n_words ELSE 0 END > 0.3 AS f9
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR f7 OR f8 OR f9) AS kept,
       concat_ws(',', CASE WHEN f1 THEN 'too_short' END, CASE WHEN f2 THEN 'repeated_windows' END,
         CASE WHEN f3 THEN 'symbols_per_word' END, CASE WHEN f4 THEN 'mean_word_length' END,
         CASE WHEN f5 THEN 'capital_letters' END, CASE WHEN f6 THEN 'words_with_letters' END,
         CASE WHEN f7 THEN 'repeated_lines' END, CASE WHEN f8 THEN 'stop_words' END,
         CASE WHEN f9 THEN 'same_word_next' END) AS reasons
FROM f
"""



def _span_sql(rule) -> str:
    """List of (start, rank, end, kind) of a rule's matches: lengths of gaps and matches, summed."""
    rank = [r.kind for r in RULES].index(rule.kind)
    pattern = rule.pattern.replace("'", "''")
    return f"""list_transform(list_filter(range(1, len(regexp_extract_all(t, '{pattern}')) + 1),
      lambda i: length(regexp_extract_all(t, '{pattern}', {rule.group})[i]) >= {rule.least}),
      lambda i: {{'s': list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], lambda x: length(x))), 0),
        'r': {rank}, 'e': list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x)))
                  + list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i], lambda x: length(x))), 'k': '{rule.kind}'}})"""


def _join_sql(spans: str) -> str:
    return f"coalesce(array_to_string(list_transform({spans}, lambda x: concat_ws(':', x.k, x.s::BIGINT, x.e::BIGINT)), ','), '')"


_BASE_KINDS = ", ".join(f"'{r.kind}'" for r in BASE)
OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort(list_concat({", ".join(_span_sql(r) for r in RULES)})) AS found FROM d),
b AS (SELECT *, list_filter(found, lambda x: x.k IN ({_BASE_KINDS})) AS base FROM f)
SELECT doc_id, {", ".join(f"len(list_filter(found, lambda x: x.k = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in BASE)},
  sha256({_join_sql("base")}) AS base_sha256, {_join_sql("found")} AS spans
FROM b
"""

OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.x FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(x) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP13 = """
WITH RECURSIVE t AS (
  SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL
), b AS (
  SELECT count(DISTINCT sale_id)::BIGINT AS total FROM t
), f AS (
  SELECT item_id, count(*)::BIGINT AS n FROM t, b GROUP BY item_id, total HAVING count(*) >= 8 AND count(*) * 5000 >= total
), l AS (
  SELECT sale_id, item_id FROM t SEMI JOIN f USING (item_id)
), o AS (
  SELECT [item_id] AS items, item_id AS last, sale_id FROM l
  UNION ALL
  SELECT items, last, sale_id FROM (
    SELECT list_append(o.items, l.item_id) AS items, l.item_id AS last, o.sale_id,
           count(*) OVER (PARTITION BY list_append(o.items, l.item_id)) AS n
    FROM o JOIN l ON l.sale_id = o.sale_id AND l.item_id > o.last
  ), b WHERE n >= 8 AND n * 5000 >= total
), s AS (
  SELECT items, count(*)::BIGINT AS support FROM o GROUP BY items
), x AS (
  SELECT items, support, c, list_filter(items, lambda i: i <> c) AS rest FROM (SELECT items, support, unnest(items) AS c FROM s)
), p AS (
  SELECT x.items, x.support, x.c, x.rest, r.support AS a, f.n AS s,
         len(x.items) > 1 AND 100 * x.support >= 10 * r.support AND x.support * total > r.support * f.n AS rule
  FROM x CROSS JOIN b JOIN f ON f.item_id = x.c LEFT JOIN s AS r ON r.items = x.rest
), covered AS (
  SELECT DISTINCT rest AS items FROM p WHERE a = support
)
SELECT array_to_string(items, ',') AS items, len(items)::BIGINT AS n_items, support,
       count(*) FILTER (rule)::BIGINT AS n_rules,
       (min({'a': a, 'c': c}) FILTER (rule)).c AS best_item,
       sha256(coalesce(string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) FILTER (rule), '')) AS rules_sha256
FROM p ANTI JOIN covered USING (items) GROUP BY items, support
"""

ORACLES = {
    "op4_lsh_forest": OP4,
    "op8_secret_scan": OP8,
    "op10_quality_rules": OP10,
    "op13_basket_itemsets": OP13,
}
