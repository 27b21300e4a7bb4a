"""One thin query per operator over its whole table, and the SQL that each must equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.ann import nearest
from plumbline.llm.bpe import DECODED, IDS, decode, encode
from plumbline.llm.common import read
from plumbline.llm.embedding_dedup import dedup_vectors
from plumbline.llm.line_dedup import MIN_SITES, dedup_lines
from plumbline.llm.mixing import MOST_REPEATS, WEIGHTS, mix
from plumbline.llm.minhash import near_duplicates
from plumbline.llm.packing import pack
from plumbline.llm.quality import classify_quality, held_out, train
from plumbline.llm.resampling import BUCKETS, LEAST_WORDS, PERCENT, SEED, resample
from plumbline.llm.sharding import shard_rows
from plumbline.llm.span_crc import POLYNOMIAL
from plumbline.llm.token_counts import count_tokens
from plumbline.llm.warc import BASE32_DIGITS, archive
from plumbline.llm.whitening import COUNT, DEVIATION, ERROR, EXPLAINED, WHITENED, whiten

COUNT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PACK_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines that stand elsewhere first."""
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "text", F.col("_pl_lines").alias("n_lines"), F.col("_pl_removed").alias("n_removed")
    )


OP1_SQL = f"""
WITH line AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), spread AS (
  SELECT trim(line) AS line, min((doc_id, pos)) AS first
  FROM line WHERE trim(line) <> ''
  GROUP BY trim(line) HAVING count(DISTINCT source) >= {MIN_SITES}
), judged AS (
  SELECT doc_id, pos, l.line, coalesce(first <> (doc_id, pos), false) AS gone
  FROM line l LEFT JOIN spread s ON trim(l.line) = s.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*)::INT AS n_lines, (count(*) FILTER (gone))::INT AS n_removed
FROM judged GROUP BY doc_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text."""
    return count_tokens(
        read(spark, sf_dir, "documents").select("doc_id", "text"), COUNT_VOCABULARY
    ).select(
        "doc_id", F.col("_pl_bytes").alias("n_bytes"), F.col("_pl_tokens").alias("n_tokens"),
        F.col("_pl_over_limit").alias("over_limit"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links at cosine 0.98 within its label, and its component."""
    return dedup_vectors(read(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 24 shards whose counts differ by one at most."""
    return shard_rows(read(spark, sf_dir, "documents").select("doc_id", "text"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near copies; the smallest id of a group is kept."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(read(spark, sf_dir, "documents"), PACK_VOCABULARY)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_quality(docs, train(docs, read(spark, sf_dir, "labels"))).select(
        "doc_id", held_out("doc_id").alias("held_out"),
        F.col("_pl_score").alias("score"), F.col("_pl_predicted").alias("predicted"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from a written archive."""
    return archive(read(spark, sf_dir, "pages")).drop("intact")


OP8_SQL = f"""
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), named AS (
  SELECT *, list_aggregate(list_transform(range(1, 41, 5), lambda pos:
    list_aggregate(list_transform([15, 10, 5, 0], lambda bits:
      substr('{BASE32_DIGITS}', ((('0x' || substr(hex, pos, 5))::INT >> bits) & 31) + 1, 1)
    ), 'string_agg', '')), 'string_agg', '') AS digest,
    max(page_id) OVER (PARTITION BY html) AS top
  FROM page
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM named
"""


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), 5)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", F.col("_pl_size").alias("size"), F.col("_pl_source_size").alias("source_size"),
        F.col("_pl_target").alias("target"), F.col("_pl_taken").alias("taken"),
    )


OP10_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || doc_id || ':' || md5(coalesce(text, ''))) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {WEIGHTS} + 1)::BIGINT AS w
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, {MOST_REPEATS} * source_size / w AS ratio FROM src
), rates AS (
  SELECT ratio,
    ((SELECT sum(source_size) FROM src)
      - coalesce(sum({MOST_REPEATS} * source_size) OVER before, 0))
    / sum(w) OVER rest AS rate
  FROM ranked
  WINDOW before AS (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP),
         rest AS (ORDER BY ratio RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), chosen AS (
  SELECT coalesce(max(rate) FILTER (rate < ratio), 0) AS rate FROM rates
), target AS (
  SELECT source, source_size,
         least(({MOST_REPEATS} * source_size)::DOUBLE, (SELECT rate FROM chosen) * w) AS target
  FROM src
), plan AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized JOIN target USING (source)
)
SELECT doc_id, size, source_size, target,
  ((CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * size
   + greatest(0, least((CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END) - before,
                       size)))::BIGINT AS taken
FROM plan
"""


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weight towards the benchmark texts, and a tenth of them drawn."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, read(spark, sf_dir, "benchmark").select("text")).select(
        "doc_id", F.col("_pl_features").alias("n_features"), F.col("_pl_weight").alias("weight"),
        F.col("_pl_score").alias("score"), F.col("_pl_rank").alias("rank"),
    )


OP11_SQL = rf"""
WITH RECURSIVE step AS (
  SELECT b, b AS r, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, xor(r >> 1, CASE WHEN r & 1 = 1 THEN {POLYNOMIAL} ELSE 0 END), k + 1 FROM step WHERE k < 8
), tables AS (
  SELECT list(r ORDER BY b) AS t FROM step WHERE k = 8
), word AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), spelt AS (
  SELECT w, hex(encode(w)) AS hex FROM (SELECT DISTINCT w FROM word)
), hashed AS (
  SELECT w, xor(list_reduce(list_transform(range(1, length(hex) // 2 + 1), lambda i:
      ('0x' || substr(hex, 2 * i - 1, 2))::BIGINT), lambda acc, x: xor(acc >> 8, t[xor(acc & 255, x) + 1]),
      4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM spelt, tables
), counted AS (
  SELECT side, doc_id, bucket, count(*) AS n FROM word JOIN hashed USING (w) GROUP BY ALL
), buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t
  FROM counted GROUP BY bucket
), totals AS (
  SELECT sum(s) AS all_s, sum(t) AS all_t FROM buckets
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (all_s + {BUCKETS}) / ((s + 1) * (all_t + {BUCKETS}))))::BIGINT AS gain
  FROM buckets, totals
), weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total
  FROM counted JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features,
    coalesce(total // n_features - CASE WHEN total < 0 AND total % n_features <> 0 THEN 1 ELSE 0 END, 0) AS weight,
    ('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM documents d LEFT JOIN weighed USING (doc_id)
), noisy AS (
  SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM scored
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM noisy WHERE n_features >= {LEAST_WORDS}
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score,
  CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank
FROM noisy LEFT JOIN ranked USING (doc_id)
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole vectors on their eight leading components, at unit variance."""
    rows = whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip(F.col(WHITENED).alias("w"), F.col(EXPLAINED).alias("e"))).alias("at", "one")
    return rows.select("vec_id", COUNT, DEVIATION, ERROR, each).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.col(COUNT).alias("n"), F.col(DEVIATION).alias("deviation"),
        F.col("one.w").alias("whitened"), F.col("one.e").alias("explained"), F.col(ERROR).alias("identity_error"),
    )


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts, encoded and decoded again."""
    tokens = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text"), RANKS).drop("text"), RANKS)
    return tokens.select(
        "doc_id", F.size(IDS).cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col(IDS).cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(DECODED, 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_sharding": op4_sharding,
    "op5_minhash": op5_minhash,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_ann": op9_ann,
    "op10_mixing": op10_mixing,
    "op11_resampling": op11_resampling,
    "op12_whitening": op12_whitening,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLE = {"op1_line_dedup": OP1_SQL, "op8_warc": OP8_SQL, "op10_mixing": OP10_SQL, "op11_resampling": OP11_SQL}
