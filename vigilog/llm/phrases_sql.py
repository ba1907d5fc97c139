"""op11 in SQL: every phrase counted."""

COLLOCATIONS_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM
    (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
grams AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) FROM p
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) FROM p),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM c
    UNION ALL SELECT lang, phrase, a, 2, concat(w[1], ' ', w[2]), w[3] FROM c WHERE k = 3),
s AS (SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s) WHERE o = 1),
longer AS (SELECT lang, inside, max(a) AS most FROM
    (SELECT lang, a, unnest([concat(w[1], ' ', w[2]), concat(w[2], ' ', w[3])]) AS inside FROM c WHERE k = 3) GROUP BY lang, inside)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM b LEFT JOIN longer ON longer.lang = b.lang AND longer.inside = b.phrase WHERE 100 * coalesce(most, 0) < 50 * a) JOIN total USING (lang)
WHERE rank <= 2000
"""
