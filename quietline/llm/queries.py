"""One query an operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, linededup, masked_lm, mix, ngram_join, phrases, pii, quality, search, sharding, tokens, urls


def tokenizer_path() -> str:
    """The vocabulary file; it is read where it is installed, by driver and executors."""
    if at := os.environ.get("TOKENIZER_FILE"):
        return at
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), end_id=2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.taken(mix.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.found(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find(docs, table(spark, sf_dir, "benchmark"), columns=["doc_id"]))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search.top(index, table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id")


def op13_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.laid_out(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), 12)
    return sharding.digest(sharding.resharded(store, 16, law="bytes"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = (op1_ngram_join, op2_token_store, op3_quality, op4_mix, op5_pii, op6_masked_lm, op7_html, op8_urls, op9_line_dedup, op10_decontaminate, op11_phrases, op12_search, op13_reshard, pipeline)
    return {f.__name__: f for f in every}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id))::BIGINT AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaim
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END + CASE WHEN 100 * n_upper > 40 * word_chars THEN 16 ELSE 0 END + CASE WHEN 100 * n_exclaim > 40 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 64 ELSE 0 END + CASE WHEN 100 * n_digits > 40 * word_chars THEN 128 ELSE 0 END)::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

#: Windows by their first line (f) and by their last line (b), which together reach both ends of a repeated run.
OP9 = r"""
WITH x AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS line, unnest(ls) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL)),
l AS (SELECT doc_id, line, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, line, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS x FROM x) WHERE x <> ''),
a AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at, sum(n) OVER (PARTITION BY doc_id) AS total FROM l),
w AS (
  SELECT 'f' AS side, i.doc_id, i.line, max(j.line) AS last, string_agg(j.x, chr(10) ORDER BY j.line) AS body
  FROM a i JOIN a j ON i.doc_id = j.doc_id AND j.at BETWEEN i.at AND i.at + 49 WHERE i.total - i.at >= 50 GROUP BY i.doc_id, i.line
  UNION ALL
  SELECT 'b' AS side, j.doc_id, min(i.line) AS line, j.line AS last, string_agg(i.x, chr(10) ORDER BY i.line) AS body
  FROM a j JOIN a i ON i.doc_id = j.doc_id AND i.at + i.n BETWEEN j.at + j.n - 49 AND j.at + j.n GROUP BY j.doc_id, j.line, j.n HAVING sum(i.n) - j.n >= 50
),
f AS (SELECT side, body, min({'d': doc_id, 'l': line, 'e': last}) AS f FROM w GROUP BY side, body HAVING count(*) > 1),
g AS (SELECT doc_id, CASE WHEN doc_id = f.f.d AND line <= f.f.e THEN f.f.e + 1 ELSE line END AS start, last FROM w JOIN f USING (side, body) WHERE NOT (doc_id = f.f.d AND line = f.f.l AND last = f.f.e)),
u AS (SELECT DISTINCT doc_id, unnest(generate_series(start, last)) AS line FROM g WHERE start <= last),
k AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM u),
s AS (SELECT doc_id, sum(n) AS n, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS removed FROM (SELECT doc_id, min(line) AS lo, max(line) AS hi, count(*) AS n FROM k GROUP BY doc_id, run) GROUP BY doc_id),
t AS (SELECT x.doc_id, string_agg(raw, chr(10) ORDER BY x.line) AS kept FROM x LEFT JOIN u ON u.doc_id = x.doc_id AND u.line = x.line WHERE u.line IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_removed, coalesce(s.removed, '') AS removed, CASE WHEN s.n IS NULL THEN d.text ELSE coalesce(t.kept, '') END AS text
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


OP11 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(k))),
f AS (SELECT lang, k, p, count(*) AS a FROM g GROUP BY lang, k, p),
c AS (SELECT lang, k, p, a, string_split(p, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
u AS (SELECT lang, p, k, a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:k], ' ') AS rp FROM c, (VALUES (1), (2), (3)) v(j) WHERE j < k),
s AS (SELECT u.lang, u.p, u.k, u.a, j, x.a AS l, y.a AS r, (2000000::HUGEINT * u.a) // (x.a + y.a) AS score FROM u JOIN f x ON x.lang = u.lang AND x.p = lp JOIN f y ON y.lang = u.lang AND y.p = rp),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, j) AS o FROM s) WHERE o = 1),
i AS (SELECT lang, array_to_string(ws[j:j + m - 1], ' ') AS p, max(a) AS longer FROM c, (VALUES (1), (2), (3)) v(j), (VALUES (2), (3)) n(m) WHERE m < k AND j + m - 1 <= k GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.p) AS rank, b.p AS phrase, a, l, r, score::BIGINT AS score FROM b LEFT JOIN i ON i.lang = b.lang AND i.p = b.p WHERE i.p IS NULL OR 100 * longer < 80 * a)
SELECT o.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""

OP12 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
q2 AS (SELECT item_id, t, count(*) AS q FROM q GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, 75 + (25 * len(w) * n_docs) // total AS m FROM d, s WHERE len(w) > 0),
p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
i AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, n_docs),
r AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q2 JOIN i USING (t) JOIN p USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1, "op3_quality": OP3, "op9_line_dedup": OP9, "op10_decontaminate": OP10, "op11_phrases": OP11, "op12_search": OP12}


ORACLE_NAMES = tuple(sorted(oracle_sql()))
