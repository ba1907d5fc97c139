"""The quality rules as SQL, in long form: one row a document, kind of histogram and bucket."""

from __future__ import annotations

from . import quality as q

_WORD = r"[\x20\x09-\x0D]+"


def _list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _without(pattern: str) -> str:
    return "length(regexp_replace(t, '" + pattern.replace("'", "''") + "', '', 'g'))"


def _learn(source: str) -> str:
    return f"""SELECT lang, kind, bucket, round(avg(share), 9) AS ref FROM shares JOIN {source} USING (doc_id)
    WHERE NOT base_failed AND judged AND lang IN ({', '.join(f"'{x}'" for x in q.COMMON_WORDS)}) GROUP BY ALL"""


def _near(refs: str) -> str:
    half = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    return f"""SELECT doc_id, kind, min(d) AS d FROM (
      SELECT doc_id, kind, sqrt(greatest(0, sum({half.format(a='share', b='ref')} + {half.format(a='ref', b='share')}) / 2)) AS d
      FROM shares JOIN (SELECT lang, kind, bucket, ref FROM {refs}) r USING (kind, bucket) WHERE share IS NOT NULL GROUP BY doc_id, r.lang, kind
    ) GROUP BY doc_id, kind"""


def _judge(near: str) -> str:
    limit = f"CASE kind WHEN 'class' THEN {q.MAX_CLASS_DISTANCE} ELSE {q.MAX_WORD_DISTANCE} END"
    return f"""SELECT b.*, NOT (judged AND EXISTS (FROM {near} n WHERE n.doc_id = b.doc_id AND n.d > {limit})) AS accepted FROM base b"""


QUALITY_SQL = f"""WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(string_split_regex(t, '{_WORD}'), lambda x: x <> '') AS w FROM texts),
triples AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM split WHERE len(w) > 2)),
places AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM triples) WHERE n > 1),
repeats AS (SELECT doc_id, sum(least(3, coalesce(gap, 3))) AS n FROM (SELECT doc_id, lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p AS gap FROM places) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM texts) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counts AS (SELECT doc_id, lang, t, length(t) AS chars, CAST(len(w) AS BIGINT) AS n_words, CAST({_without(_WORD)} AS BIGINT) AS word_chars,
  CAST({_without('[^#*$%&|<>]+')} AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
base AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED_PERCENT} * n_words AS base_failed,
  n_words >= {q.MIN_HISTOGRAM_WORDS} AND chars >= {q.MIN_HISTOGRAM_CHARS} AS judged FROM counts),
class_list AS (SELECT doc_id, chars, [{', '.join(_without(x) for x in q.CLASSES.values())}, chars - word_chars] AS c FROM base),
found AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(t, '[\\x20\\x09-\\x0D.,;:!?]+')) AS x FROM texts) WHERE list_contains({_list(q.ALL_COMMON)}, x) GROUP BY ALL),
parts AS (
  SELECT doc_id, 'class' AS kind, unnest(range(1, len(c) + 1)) AS bucket, unnest(c) AS n FROM class_list
  UNION ALL SELECT doc_id, 'word', bucket, coalesce(n, 0) FROM (SELECT doc_id, bucket, {_list(q.ALL_COMMON)}[bucket] AS x FROM texts, range(1, {len(q.ALL_COMMON) + 1}) r(bucket)) LEFT JOIN found USING (doc_id, x)),
filled AS (FROM parts UNION ALL SELECT doc_id, kind, 0, CASE kind WHEN 'class' THEN chars ELSE n_words END - n FROM (SELECT doc_id, kind, sum(n) AS n FROM parts GROUP BY ALL) JOIN base USING (doc_id)),
shares AS (SELECT doc_id, kind, bucket, n / nullif(sum(n) OVER (PARTITION BY doc_id, kind), 0) AS share FROM filled),
refs1 AS ({_learn('base')}), near1 AS ({_near('refs1')}), judge1 AS ({_judge('near1')}),
refs2 AS ({_learn('(SELECT * FROM judge1 WHERE accepted)')}), near2 AS ({_near('refs2')}), judge2 AS ({_judge('near2')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, accepted AND NOT base_failed AS kept FROM judge2"""
