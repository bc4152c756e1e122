"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from wardline.llm import (
    bpe, collocations, exact_dedup, language, mixing, quality, simhash_dedup, spelling, suffix_dedup, token_counts,
    toxicity, vector_search, warc,
)
from wardline.llm.common import fold_of, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.per_row(mixing.allot(table(spark, folder, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents")).drop("bucket", "chain")


def _judged(scores: DataFrame, folds: int, held: int) -> DataFrame:
    return scores.select(
        "doc_id", (fold_of("doc_id", folds) == held).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    machine = toxicity.fit(docs, table(spark, folder, "labels"), fold_of("doc_id", 5) != 0)
    return _judged(toxicity.score(docs, machine), 5, 0)


def op4_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.simhash_groups(table(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"), fold_of("doc_id", 3) != 1)
    return _judged(quality.score(docs, model), 3, 1)


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = vector_search.integer_vectors(table(spark, folder, "embeddings"), largest=False)
    return vector_search.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    predicted = language.predict(docs, language.fit(docs, fold_of("doc_id", 4) != 2))
    return predicted.withColumn("held_out", fold_of("doc_id", 4) == 2)


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return bpe.digests(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True))


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, folder, "documents"), TOKENIZER)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling.count_words(table(spark, folder, "documents"), every=199, least_length=6, least_n=5)
    return spelling.group_variants(words, factor=5)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(
        table(spark, folder, "documents"), least=10, covered_percent=50, top=2_000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mix_sources, op2_exact_dedup, op3_toxicity, op4_simhash_dedup, op5_quality, op6_suffix_dedup, op7_warc,
             op8_vector_search, op9_language, op10_bpe, op11_token_counts, op12_spelling, op13_collocations)
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
              doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
        "op7_warc": """
            WITH p AS (
              SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                sha1(coalesce(html, '')) AS payload_digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder
              FROM pages)
            SELECT page_id, payload_bytes, payload_digest,
              CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to
            FROM p""",
        "op8_vector_search": """
            WITH v AS (
              SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
              SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
              FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
            r AS (
              SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
              FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op13_collocations": r"""
            WITH d AS (
              SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
            p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
            w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
            starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
            f AS (
              SELECT lang, array_to_string(words[i:i + z.size - 1], ' ') AS phrase, z.size AS words, count(*) AS f
              FROM starts, (VALUES (1), (2), (3)) AS z(size) WHERE i + z.size - 1 <= len(words)
              GROUP BY ALL),
            total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
            c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS v FROM f WHERE words > 1 AND f >= 10),
            cut AS (
              SELECT lang, phrase, words, a, v, k, array_to_string(v[1:k], ' ') AS first, array_to_string(v[k + 1:], ' ') AS rest
              FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
            scored AS (
              SELECT cut.*, x.f AS l, y.f AS r,
                CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
              FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = cut.first
              JOIN f AS y ON y.lang = cut.lang AND y.phrase = cut.rest),
            worst AS (
              SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
            covers AS (
              SELECT lang, phrase, max(a) AS longer FROM (
                SELECT lang, array_to_string(v[1:2], ' ') AS phrase, a FROM c WHERE words = 3
                UNION ALL SELECT lang, array_to_string(v[2:3], ' '), a FROM c WHERE words = 3) GROUP BY ALL),
            ranked AS (
              SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
                phrase, a, l, r, n, score
              FROM worst LEFT JOIN covers USING (lang, phrase) JOIN total USING (lang)
              WHERE longer IS NULL OR 100 * longer < 50 * a)
            SELECT * FROM ranked WHERE rank <= 2000""",
    }
