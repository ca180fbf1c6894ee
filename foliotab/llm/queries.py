"""Registered queries of the operators, one each, over whole tables; SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliotab.llm import ann, decontaminate, hard_negatives, html_text, langid, linedup, neardup, packing, resample, secrets, sharding, token_counts, toxicity

SHARDS = sharding.shard_names(64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(by: int):
    """CRC-32 of the id as text, modulo ``by``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), limit=512)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(secrets.written(F.col("base")).cast("binary"), 256).alias("base_sha256")
    every = secrets.written(F.array_sort(F.concat("base", "added"))).alias("spans")
    return found.select("doc_id", *[count(k) for k in secrets.PATTERNS], digest, every)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = langid.fit(docs.where(remainder(4) != 2))
    return langid.identify(docs.select("doc_id", (remainder(4) == 2).alias("held_out"), "text"), langs, model).drop("text")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    scored = docs.select("doc_id", (remainder(3) == 1).alias("held_out"), toxicity.toxicity(F.coalesce("text", F.lit("")), index).alias("t"))
    return scored.select("doc_id", "held_out", "t.score", F.when(F.col("t.score") >= 0.7, 1).otherwise(0).alias("predicted"), "t.evidence")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, threshold=0.8)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.fuzzy_lines(table(spark, sf_dir, "documents"), flips=None).select("doc_id", "n_lines", "n_removed", "text")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def hard_negatives_sql() -> str:
    """Every anchor against every row, which SQL bears on a small table."""
    return """
        WITH e AS (
            SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, list_dot_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
        pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        neg AS (
            SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
            FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
        SELECT * FROM neg WHERE rank <= 5
    """


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def resampling_sql() -> str:
    """CRC-32 over the bytes of each distinct word, by its table; all else are sums."""
    a, z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"unnest(regexp_extract_all(translate(text, '{a}', '{z}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS w"
    return f"""
        WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
        dw AS (SELECT doc_id, {words} FROM documents), bw AS (SELECT {words} FROM benchmark),
        vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
        hashed AS (
            SELECT w, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {resample.BUCKETS} AS bucket
            FROM vocabulary, crc),
        s AS (SELECT bucket, count(*)::DOUBLE AS n FROM dw JOIN hashed USING (w) GROUP BY bucket),
        t AS (SELECT bucket, count(*)::DOUBLE AS n FROM bw JOIN hashed USING (w) GROUP BY bucket),
        gain AS (
            SELECT h.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + {resample.BUCKETS}) / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + {resample.BUCKETS}))))::BIGINT AS g
            FROM (SELECT DISTINCT bucket FROM hashed) h LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
        summed AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS g FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
        scored AS (
            SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(g, 0) AS weight,
                coalesce(g, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resample.SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM documents d LEFT JOIN summed USING (doc_id)),
        placed AS (SELECT *, row_number() OVER (ORDER BY n_features < {resample.MIN_WORDS}, score DESC, doc_id) AS place FROM scored)
        SELECT doc_id, n_features, weight, score,
            CASE WHEN n_features >= {resample.MIN_WORDS} AND place <= {resample.PERCENT} * (SELECT count(*) FROM scored WHERE n_features >= {resample.MIN_WORDS}) // 100 THEN place END AS rank
        FROM placed
    """


def sharding_sql() -> str:
    """The lookup table as a list; 60 bits of the MD5 of the key choose the place."""
    shards = ",".join(map(str, sharding.lookup_table(SHARDS)))
    slot = f"(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.SLOTS})"
    return f"""
        WITH filled AS (SELECT string_split('{shards}', ',') AS shards)
        SELECT doc_id, {slot} AS slot, 'shard-' || lpad(shards[CAST({slot} + 1 AS INTEGER)], 4, '0') AS shard FROM documents, filled
    """


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_token_counts, op3_secrets, op4_nearest, op5_languages, op6_packing, op7_sharding, op8_toxicity, op9_near_duplicates, op10_line_dedup, op11_hard_negatives, op12_resampling, op13_main_text)}


def oracle_sql() -> dict[str, str]:
    return {"op7_sharding": sharding_sql(), "op11_hard_negatives": hard_negatives_sql(), "op12_resampling": resampling_sql()}
