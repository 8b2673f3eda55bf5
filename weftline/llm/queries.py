"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards with exact shares: the law is `rows`."""
    from pyspark.sql import functions as F

    from .sharding import assign_shards

    placed = assign_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"), min_words=1)


def op3_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .vector_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


def op7_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_report

    return token_file_report(spark, table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import aligned_documents

    return aligned_documents(table(spark, sf_dir, "documents"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .language_model import scored_texts

    return scored_texts(table(spark, sf_dir, "documents"), lambda doc_id: F.crc32(doc_id.cast("string")) % 7 == 2)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_vector_top_k": """
            WITH v AS (
                SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            ), s AS (
                SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.n <> c.n AND len(q.v) = len(c.v)
            ), r AS (
                SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
        """,
        "op10_exact_dedup": """
            WITH d AS (
                SELECT doc_id, length(coalesce(text, '')) AS points,
                       translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
                FROM documents
            ), g AS (
                SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                       first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept
                FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
            )
            SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM g
        """,
        "op11_lexical_search": r"""
            WITH d AS (
                SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
                FROM documents
            ), i AS (
                SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
                FROM benchmark
            ), g AS (
                SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
            ), tf AS (
                SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term
            ), q AS (
                SELECT r AS item, term, count(*) AS mult FROM (SELECT r, unnest(terms) AS term FROM i) GROUP BY r, term
            ), w AS (
                SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w
                FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g
            ), s AS (
                SELECT q.item, tf.r, sum(q.mult * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + ((75 * len(d.terms) * g.n_docs) // g.n_terms)))))::BIGINT AS score
                FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d ON d.r = tf.r, g GROUP BY q.item, tf.r
            ), o AS (
                SELECT s.item, d.doc_id, s.score, row_number() OVER (PARTITION BY s.item ORDER BY s.score DESC, d.doc_id NULLS LAST)::INTEGER AS rank
                FROM s JOIN d USING (r) WHERE s.score > 0
            )
            SELECT i.item_id, o.rank, o.doc_id, o.score FROM o JOIN i ON i.r = o.item WHERE o.rank <= 10
        """,
    }
