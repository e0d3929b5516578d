"""One registered query per operator, over whole tables, and the DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetta.llm import (byte_bpe, collocations, exact_dedup, jaccard_join, main_text, mixing, pieces, quality, resampling,
                       substring_dedup, token_counts, topk, toxicity)
from vetta.llm.common import label_fold, staged, table, word_count

TOKEN_LIMIT = 4096
TOXIC_SCORE = 0.7


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"),
        F.size("factors").alias("n_factors"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    vectors = (table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
               .select(F.col("vec_id").alias("id"), scaled.alias("vector")))
    return topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = staged(exact_dedup.with_hash(docs).drop("text"), "hashes")
    return exact_dedup.exact_dedup(hashed).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def piece_model() -> str:
    """Path of the vocabulary that the token queries use."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def piece_digests(encoded: DataFrame) -> DataFrame:
    """Digest columns of ``pieces.encode_decode`` rows."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_digests(pieces.encode_decode(docs, piece_model()))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract(pages).select("page_id", "url", F.col("main_text").alias("text"),
                                           F.length("main_text").cast("long").alias("n_chars"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, piece_model()).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (label_fold(F.col("doc_id")) == 1).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    return scores.select(F.col("id").alias("doc_id"), (label_fold(F.col("id")) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(staged(docs, "sizes"), "size")
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("repeats")).alias("taken"), "source", "repeats")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resampling.resample(docs, table(spark, sf_dir, "benchmark").select("text"), percent=5)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def byte_vocabulary() -> str:
    """Path of the byte-level vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode_decode(docs, byte_vocabulary(), packed=True)
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_topk": op2_topk,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_collocations": op12_collocations,
    "op13_byte_bpe": op13_byte_bpe,
}

# A-Z only: lower() would also change other letters
_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op2_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op3_exact_dedup": f"""
WITH h AS (SELECT doc_id, sha256({_NORM}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)
""",
    "op9_mixing": """
WITH d AS (
  SELECT doc_id, source,
         length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'w', 'g'),
                               '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 3))::INT AS slot
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
-- water level: sources in order of cap / weight; with the first k clamped the
-- others share what is left; the true level is the largest over all k
o AS (
  SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS clamped,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight,
         sum(source_size) OVER () * 1.5 AS total
  FROM s WINDOW before AS (ORDER BY 2 * source_size / weight, encode(source)
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total::DOUBLE - clamped::DOUBLE) / open_weight::DOUBLE) AS level FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN weight * level > 2 * source_size THEN (2 * source_size)::DOUBLE
              ELSE weight * level END AS target
  FROM s, l),
w AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::INT END AS whole FROM t),
b AS (SELECT source, slot, sum(size) AS words FROM d GROUP BY source, slot),
u AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY slot) AS upto FROM b),
c AS (
  SELECT u.source, u.slot, w.source_size, w.target,
         least(2, w.whole + (CASE WHEN u.upto - u.words / 2.0 < w.target - w.whole * w.source_size
                             THEN 1 ELSE 0 END)) AS repeats
  FROM u JOIN w ON u.source IS NOT DISTINCT FROM w.source)
SELECT d.doc_id, d.size, c.source_size, c.target, (d.size * c.repeats)::BIGINT AS taken, d.source, c.repeats
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.slot = c.slot
""",
    "op12_collocations": f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, {_NORM} AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (
  SELECT lang, 1 AS size, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
k AS (
  SELECT *, unnest(range(1, size)) AS k FROM c),
cut AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r,
         (1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.k], ' ')
         JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1:k.size], ' ')),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cut),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE size = 3
    UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT s.* FROM weakest s LEFT JOIN longer x ON x.lang = s.lang AND x.phrase = s.phrase
  WHERE s.o = 1 AND (x.a IS NULL OR 100 * x.a < 50 * s.a)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score::BIGINT AS score
FROM r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
""",
}
