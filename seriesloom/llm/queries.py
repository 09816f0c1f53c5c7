"""Registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import collocations, decontaminate, exact_dedup, fingerprint, html_text, language_id, line_dedup, lm_score, near_dedup, pii, quality, search, sentencepiece_scan
from seriesloom.llm.common import table

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sentencepiece_scan.decode(sentencepiece_scan.encode(docs))
    same = F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip")
    return rows.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), same)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


_SETS = f"""
words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM shingles)
"""
OP4_SQL = f"""
WITH RECURSIVE {_SETS},
each AS (SELECT doc_id, unnest(s) AS x FROM shingles),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM sizes JOIN reach ON id = doc_id GROUP BY doc_id, n
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _words_sql(id_col: str, source: str) -> str:
    return f"SELECT {id_col}, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {source}"


OP6_SQL = f"""
WITH b AS ({_words_sql("item_id", "benchmark")}),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
       FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT size FROM bw),
d AS ({_words_sql("doc_id", "documents")}),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, lengths WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP8_SQL = r"""
WITH c AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '(?:[^ \n]+ +){0,7}(?:[^ \n]*[^ \n.!?] +){0,8}[^ \n]* *\n?'), lambda x: x <> '') AS l FROM documents),
l AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] WHEN text = '' OR ends_with(text, chr(10)) THEN list_append(l, '') ELSE l END AS l FROM c),
places AS (SELECT doc_id, i, array_to_string(list_transform(l[i:i + 2], lambda x: rtrim(x, ' ' || chr(10))), chr(10)) AS s
           FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM l WHERE len(l) >= 3)),
later AS (SELECT doc_id, i FROM places QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM later) GROUP BY doc_id),
rest AS (SELECT doc_id, p, coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(p, i)), lambda i: l[i]), ''), '') AS t FROM gone JOIN l USING (doc_id))
SELECT l.doc_id, len(l)::INTEGER AS n_lines, coalesce(len(p), 0)::INTEGER AS n_removed,
       CASE WHEN p IS NULL THEN text WHEN list_contains(p, len(l)) THEN regexp_replace(t, '\n\z', '') ELSE t END AS text
FROM l LEFT JOIN rest ON l.doc_id = rest.doc_id
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents")).select("doc_id", "n_entities", "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {LOWER} AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
places AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) AS o(m) WHERE len(w) >= m),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT *, string_split(phrase, ' ') AS p, unnest(range(1, m)) AS k FROM f WHERE m > 1),
priced AS (
  SELECT c.lang, c.phrase, c.m, c.a, k, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(p[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(p[k + 1:], ' ')),
best AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f g WHERE g.lang = b.lang AND g.m > b.m AND 100 * g.a >= 100 * b.a AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, w, len(w) AS n FROM ({_words_sql("doc_id", "documents")})),
s AS (SELECT count(*) FILTER (n > 0) AS total, sum(n)::BIGINT AS words FROM d),
i AS (SELECT DISTINCT item_id, unnest(w) AS term FROM ({_words_sql("item_id", "benchmark")})),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY id, term),
weights AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, s GROUP BY term, total),
parts AS (
  SELECT item_id, id, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * total) // words)))) AS part
  FROM i JOIN tf USING (term) JOIN weights USING (term) JOIN d USING (id), s),
scores AS (SELECT item_id, id, sum(part)::BIGINT AS score FROM parts GROUP BY item_id, id HAVING sum(part) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores JOIN d USING (id) QUALIFY rank <= 10
"""


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def _digests_sql(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, '[^.!?\\n]{{0,199}}[.!?\\n]|[^.!?\\n]{{1,200}}'), lambda x: ('0x' || left(md5(x), 15))::BIGINT))"


def _cells_sql(keys: str) -> str:
    own = f"list_filter({keys}, lambda k: (k >> (3 * (i // 8))) & 7 = i % 8)"
    check = f"list_transform({own}, lambda k: (k % 2147483629) * (k % 2147483587))"
    cell = f"len({own}) || '.' || hex(coalesce(list_aggregate({own}, 'bit_xor'), 0)) || '.' || hex(coalesce(list_aggregate({check}, 'bit_xor'), 0))"
    return f"len({keys}) || ':' || array_to_string(list_transform(range(24), lambda i: {cell}), ',')"


def _likeness_sql(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE {common}::DOUBLE / (len({a}) + len({b}) - {common})::DOUBLE END"


OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(t) AS n, n // 4 AS cut FROM documents),
f AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, t)),
e AS (SELECT *, left(t, n - cut) || left(nt, cut) AS et FROM f),
k AS (SELECT *, {_digests_sql("t")} AS a, {_digests_sql("et")} AS b, {_digests_sql("nt")} AS c FROM e)
SELECT doc_id, n AS n_chars, sha256(et) AS edited_sha256, {_cells_sql("a")} AS fingerprint, {_cells_sql("b")} AS edited_fingerprint,
       {_likeness_sql("a", "b")} AS near_edited, {_likeness_sql("a", "c")} AS near_next
FROM k
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_lm_score,
        op3_sentencepiece,
        op4_near_dedup,
        op5_quality,
        op6_decontaminate,
        op7_html_text,
        op8_line_dedup,
        op9_pii,
        op10_language_id,
        op11_collocations,
        op12_search,
        op13_fingerprint,
    )
}
SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op4_near_dedup": OP4_SQL,
    "op6_decontaminate": OP6_SQL,
    "op8_line_dedup": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op12_search": OP12_SQL,
    "op13_fingerprint": OP13_SQL,
}
