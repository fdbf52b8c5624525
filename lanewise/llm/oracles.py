"""DuckDB SQL for the operators whose rows SQL can make from whole tables: windows by window functions, no hashing."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Rows are told apart by their place in the table, as doc_id may repeat.
_ROWS = "d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({text}, '{word}') AS words FROM documents),\nw AS (SELECT row, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d)"
_SPACED, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _grams(n: int, partition: str = "row") -> str:
    frame = f"OVER (PARTITION BY {partition} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"string_agg(word, ' ') {frame} AS gram, count(*) {frame} AS size"


SUPERKMERS = rf"""
WITH {_ROWS.format(text="text", word=_SPACED)},
g AS (SELECT row, doc_id, pos, word, {_grams(13)} FROM w),
least AS (SELECT gram, min(doc_id) AS first FROM g WHERE size = 13 GROUP BY gram),
h AS (SELECT g.*, CASE WHEN size = 13 AND first < doc_id THEN 1 ELSE 0 END AS hit FROM g LEFT JOIN least USING (gram)),
r AS (SELECT row, pos, word, max(hit) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h),
k AS (SELECT row, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM r GROUP BY row)
SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (row)
"""

DECONTAMINATION = rf"""
WITH {_ROWS.format(text=LOWER, word=_ALNUM)},
i AS (SELECT item_id, regexp_extract_all({LOWER}, '{_ALNUM}') AS words FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT row_number() OVER () AS item, item_id, words FROM i),
iu AS (SELECT item AS row, item_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM iw),
ig AS (SELECT DISTINCT item_id, gram FROM (SELECT item_id, {_grams(13)} FROM iu) WHERE size = 13),
dg AS (SELECT row, pos, {_grams(13)} FROM w),
long AS (SELECT row, pos, 13 AS len, item_id FROM dg JOIN ig USING (gram) WHERE size = 13),
short AS (SELECT w.row, w.pos, len(i.words) AS len, i.item_id FROM i JOIN w ON w.word = i.words[1] JOIN d ON d.row = w.row WHERE len(i.words) BETWEEN 1 AND 12 AND d.words[w.pos : w.pos + len(i.words) - 1] = i.words),
hits AS (SELECT * FROM long UNION ALL SELECT * FROM short),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(pos, pos + len)) AS p FROM hits) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY row),
o AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256 FROM d LEFT JOIN covered USING (row) LEFT JOIN named USING (row))
SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM o
"""

JACCARD = rf"""
WITH RECURSIVE {_ROWS.format(text=LOWER, word=_SPACED)},
s AS (SELECT DISTINCT row, gram FROM (SELECT w.row, pos, len(d.words) AS n, {_grams(5, "w.row")} FROM w JOIN d ON d.row = w.row) WHERE size = 5 OR (n < 5 AND pos = 1)),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
shared AS (SELECT a.row AS u, b.row AS v, count(*) AS n_shared FROM s a JOIN s b ON a.gram = b.gram AND a.row < b.row GROUP BY ALL),
near AS (SELECT u, v FROM shared JOIN n x ON x.row = u JOIN n y ON y.row = v WHERE 100 * n_shared >= 75 * (x.n + y.n - n_shared)),
links AS (SELECT u, v FROM near UNION ALL SELECT v, u FROM near),
reach AS (SELECT row AS a, row AS b FROM d UNION SELECT r.a, l.v FROM reach r JOIN links l ON l.u = r.b),
least AS (SELECT r.a AS row, min(d.doc_id) AS component_id FROM reach r JOIN d ON d.row = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (row) JOIN least USING (row)
"""

INFILL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
h AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || key[1:8] AS BIGINT) AS h1, CAST('0x' || key[9:16] AS BIGINT) AS h2, CAST('0x' || key[17:24] AS BIGINT) AS h3, CAST('0x' || key[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
s AS (SELECT *, array_to_string(units[1 : a], '') AS p, array_to_string(units[a + 1 : b], '') AS m, array_to_string(units[b + 1 : n], '') AS x,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END AS output FROM s)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""


def _phrases(k: int) -> str:
    frame = f"OVER (PARTITION BY piece ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
    return f"SELECT lang, phrase, {k} AS size, count(*) AS n FROM (SELECT lang, string_agg(word, ' ') {frame} AS phrase, count(*) {frame} AS size FROM w) WHERE size = {k} GROUP BY lang, phrase HAVING count(*) >= 100"


COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all({LOWER}, '[^.,;:!?\x0A-\x0D]+')) AS text FROM documents),
q AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(text, '[^\x20\x09]+') AS words FROM p),
w AS (SELECT piece, lang, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM q),
f AS ({" UNION ALL ".join(_phrases(k) for k in range(1, 6))}),
total AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = c.lang AND o.size > c.size AND 100 * o.a >= 100 * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cut AS (SELECT lang, phrase, a, k, array_to_string(words[1 : k], ' ') AS first, array_to_string(words[k + 1 : size], ' ') AS rest FROM kept, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k < size),
scored AS (SELECT cut.lang, cut.phrase, a, k, x.n AS l, y.n AS r, total.n AS n, CAST(CAST(1000 AS HUGEINT) * a * total.n // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest JOIN total ON total.lang = cut.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM worst QUALIFY rank <= 2000
"""

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM d WINDOW g AS (PARTITION BY text)
"""

ORACLE_SQL = {"op2_decontamination": DECONTAMINATION, "op9_jaccard_join": JACCARD, "op10_superkmer_dedup": SUPERKMERS, "op11_fill_in_middle": INFILL, "op12_collocations": COLLOCATIONS, "op13_exact_dedup": EXACT}
