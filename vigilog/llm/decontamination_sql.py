"""The decontamination as SQL: every window that shares a shingle in place is compared exactly."""

from __future__ import annotations

from .decontamination import SHINGLE, SIMILARITY_PERCENT

_PARTS = f"list_transform(range(greatest(len(w) - {SHINGLE} + 1, least(len(w), 1))), lambda i: array_to_string(w[i + 1:i + {SHINGLE}], ' '))"


def _words(table: str, key: str) -> str:
    return f"SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}"


LEAKS_SQL = f"""WITH docs AS MATERIALIZED ({_words('documents', 'doc_id')}), items AS ({_words('benchmark', 'item_id')}),
item_lists AS MATERIALIZED (SELECT item_id, len(w) AS m, {_PARTS} AS l FROM items WHERE len(w) > 0),
doc_lists AS MATERIALIZED (SELECT doc_id, len(w) AS n, {_PARTS} AS l FROM docs WHERE len(w) > 0),
item_parts AS (SELECT item_id, m, l[p] AS s, p FROM (SELECT item_id, m, l, unnest(range(1, len(l) + 1)) AS p FROM item_lists)),
doc_parts AS (SELECT doc_id, n, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS p FROM doc_lists),
windows AS MATERIALIZED (SELECT DISTINCT d.doc_id, i.item_id, m, greatest(1, least(d.p - i.p + 1, n - m + 1)) AS first FROM doc_parts d JOIN item_parts i USING (s)),
window_counts AS (SELECT w.doc_id, w.item_id, w.first, d.s, count(*) AS n FROM windows w JOIN doc_parts d ON d.doc_id = w.doc_id AND d.p BETWEEN w.first AND w.first + greatest(w.m - {SHINGLE}, 0) GROUP BY ALL),
item_counts AS (SELECT item_id, s, count(*) AS n FROM item_parts GROUP BY ALL),
sizes AS (SELECT item_id, sum(n) AS n FROM item_counts GROUP BY ALL),
pairs AS (SELECT c.doc_id, c.item_id, c.first, sum(least(c.n, coalesce(i.n, 0))) AS shared, sum(c.n) + any_value(z.n) AS total
  FROM window_counts c LEFT JOIN item_counts i ON i.item_id = c.item_id AND i.s = c.s JOIN sizes z ON z.item_id = c.item_id GROUP BY ALL)
SELECT doc_id, item_id, max(shared / (total - shared)) AS similarity FROM pairs WHERE 100 * shared >= {SIMILARITY_PERCENT} * (total - shared) GROUP BY ALL"""
