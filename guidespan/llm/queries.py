"""The queries of this folder's operators, (spark, sf_dir) to a DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guidespan.llm import audio, decontam, fill_middle, html_text, language, mixing, near_dedup, ngram_join, phrases, pii, sharding, tokens, toxicity
from guidespan.llm.common import id_crc, table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.fit(pages))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), id_crc("doc_id") % 3 == 1
    return language.identify(docs, language.fit(docs, ~out)).withColumn("held_out", out)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), id_crc("doc_id") % 4 == 2
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~out), 0.3).withColumn("held_out", out)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{kind}" for kind in pii.KINDS), F.size("spans").cast("long").alias("n_spans"), F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), 0.8)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.describe(table(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return rows.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op11_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 80)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.describe(table(spark, sf_dir, "documents"), 7, 100, 50)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), 10, 50, 2000)


QUERIES = {f.__name__: f for f in (op1_html_text, op2_language, op3_mixing, op4_toxicity, op5_pii, op6_ngram_join, op7_media, op8_tokens, op9_decontamination, op10_sharding, op11_near_dedup, op12_fill_middle, op13_collocations)}

SQL: dict[str, str] = {
    # The slots of the points are ranked within their source; rank r takes block r of the source's words, repeated to its target.
    "op3_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
k AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || CAST(size AS VARCHAR)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM k GROUP BY source),
w AS (SELECT *, CAST(CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER e, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) > cap / weight AS is_full
      FROM w WINDOW e AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN is_full THEN cap ELSE least(cap, weight * ((sum(source_size) OVER () - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0))
      / (sum(weight) OVER () - coalesce(sum(CASE WHEN is_full THEN weight END) OVER (), 0)))) END AS target FROM f),
n AS (SELECT CAST(sum(source_size) AS BIGINT) AS total, greatest(1, least({mixing.BLOCK_WORDS}, CAST(sum(source_size) AS BIGINT) // {mixing.SLOTS})) AS block FROM t),
r AS (SELECT sid, target, coalesce(sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / total AS lo, sum(target) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) / total AS hi FROM t, n),
o AS (SELECT i AS slot, (i + 1) * {mixing.GOLDEN}::DOUBLE - floor((i + 1) * {mixing.GOLDEN}::DOUBLE) AS x FROM (SELECT unnest(range(0, CAST(ceil(total / block) AS BIGINT))) AS i FROM n)),
z AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM o JOIN r ON x >= lo AND x < hi),
m AS (SELECT t.sid, t.source, source_size, t.target, block, least(CAST(floor(t.target) AS BIGINT), block * (SELECT count(*) FROM z WHERE z.sid = t.sid)) AS goal FROM t, n),
p AS (SELECT k.doc_id, k.size, m.sid, m.source_size, m.target, m.block, m.goal, CAST(coalesce(sum(k.size) OVER (PARTITION BY m.sid ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
      FROM k JOIN m ON k.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size, source_size, p.target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (goal // source_size) + greatest(0, least(place + size, goal % source_size) - place) END AS BIGINT) AS taken,
  CASE WHEN size > 0 AND place < goal THEN slot END AS first_slot
FROM p LEFT JOIN z ON z.sid = p.sid AND z.rank = p.place // p.block""",
    "op12_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS x, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS y,
      text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM u),
p AS (SELECT *, array_to_string(units[1:x], '') AS a, array_to_string(units[x + 1:y], '') AS b, array_to_string(units[y + 1:], '') AS e FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN h4 % 100 < 50 THEN '<S>' || e || '<P>' || a || '<M>' || b ELSE '<P>' || a || '<S>' || e || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""",
    "op13_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
i AS (SELECT lang, unnest(list_zip(w, w[2:], w[3:])) AS z FROM w WHERE len(w) > 0),
j AS (SELECT lang, z[1] AS w1, z[2] AS w2, z[3] AS w3 FROM i),
g AS (SELECT lang, w1, NULL AS w2, NULL AS w3 FROM j UNION ALL SELECT lang, w1, w2, NULL FROM j WHERE w2 IS NOT NULL UNION ALL SELECT * FROM j WHERE w3 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, w1, w2, w3, concat_ws(' ', w1, w2, w3) AS phrase, CAST(count(*) AS HUGEINT) AS n FROM g GROUP BY lang, w1, w2, w3),
s AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE w2 IS NULL GROUP BY lang),
c AS (SELECT lang, phrase, w3, n AS a, 1 AS k, w1 AS lp, concat_ws(' ', w2, w3) AS rp FROM f WHERE w2 IS NOT NULL AND n >= 10
      UNION ALL SELECT lang, phrase, w3, n, 2, w1 || ' ' || w2, w3 FROM f WHERE w3 IS NOT NULL AND n >= 10),
y AS MATERIALIZED (SELECT c.*, f.n AS l FROM c JOIN f ON f.lang = c.lang AND f.phrase = lp),
x AS (SELECT y.*, f.n AS r, 1000000 * a * a // (l * f.n) AS score FROM y JOIN f ON f.lang = y.lang AND f.phrase = rp),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS best FROM x),
z AS (SELECT lang, phrase, max(n) AS longer FROM (SELECT lang, w1 || ' ' || w2 AS phrase, n FROM f WHERE w3 IS NOT NULL AND n >= 10 UNION ALL SELECT lang, w2 || ' ' || w3, n FROM f WHERE w3 IS NOT NULL AND n >= 10) GROUP BY lang, phrase),
k AS (SELECT b.* FROM b LEFT JOIN z ON z.lang = b.lang AND z.phrase = b.phrase WHERE best = 1 AND (w3 IS NOT NULL OR longer IS NULL OR 100 * longer < 50 * a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, s.n AS n, CAST(score AS BIGINT) AS score FROM o JOIN s ON s.lang = o.lang WHERE rank <= 2000""",
}
