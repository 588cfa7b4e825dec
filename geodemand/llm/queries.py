"""The registered queries: each applies an operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodemand.llm import (
    bpe, hard_negatives, lexical, licences, line_dedup, lm_score, media, merkle, mixing, ngram_join, packing, suffix_dedup, toxicity,
)
from geodemand.llm.common import table
from geodemand.llm.registry import query


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_source_mix")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), F.col("copies").cast("long").alias("copies")
    )


@query("op2_ngram_join")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join(table(spark, sf, "documents"))


@query("op3_bpe")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"), word_bpe_path())


@query("op4_image_copies")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures of all pages, and the groups of copies among them."""
    return media.copies(media.page_images(table(spark, sf, "pages")), "page_id")


@query("op5_toxicity")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels")).select("doc_id", "held_out", "score", "predicted", "peak_evidence")


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS pos, x[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS u(i)
), k AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE common.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common ON k.key = common.key GROUP BY doc_id
"""


@query("op6_line_dedup", LINES_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


@query("op7_licences")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan(table(spark, sf, "documents")).drop("spans")


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return suffix_dedup.dedup(table(spark, sf, "documents")).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op9_lm_score")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.score(table(spark, sf, "documents"))


@query("op10_merkle")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.with_edits(table(spark, sf, "documents"))


NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS "rank",
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n USING (anchor_id)
WHERE NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 3
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth vector against all; the labels of every seventh are changed, and components become whole numbers."""
    x = table(spark, sf, "embeddings")
    whole = F.transform("embedding", lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.floor(c.cast("double") * 256)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = x.select("vec_id", label.alias("label"), whole.alias("vector"))
    return hard_negatives.mine(rows, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


@query("op12_packing")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), word_bpe_path())


SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents WHERE text IS NOT NULL
), n AS (SELECT doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
s AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark
), t AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY doc_id, w),
weight AS (SELECT w, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY w, big_n),
r AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN t USING (w) JOIN weight USING (w) JOIN n USING (doc_id), s GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS "rank", doc_id, score
FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


@query("op13_lexical_search", SEARCH_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
