"""The queries over the test tables: each applies one operator, as it is used in production, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm.common import table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.simhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("group_size")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.piece_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), piece_model())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.token_store import read, write

    return read(write(table(spark, sf_dir, "documents"), byte_model()))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_exact_dedup, op3_simhash_near_dedup, op4_suffix_array_dedup, op5_sentencepiece,
    op6_toxicity, op7_quality_classifier, op8_token_ids, op9_benchmark_decontamination, op10_secret_scans,
)}

ORACLE_SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op9_benchmark_decontamination": r"""
        WITH cut AS (
            SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
            UNION ALL
            SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark WHERE item_id IS NOT NULL),
        items AS (SELECT id AS item_id, w, least(8, len(w)) AS n FROM cut WHERE side = 'b' AND len(w) > 0),
        wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS win FROM items, unnest(range(len(w) - n + 1)) AS r(i)),
        sizes AS (SELECT DISTINCT n FROM wanted),
        docs AS (SELECT id AS doc_id, w FROM cut WHERE side = 'd'),
        seen AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win FROM docs, sizes, unnest(range(greatest(0, len(w) - n + 1))) AS r(i)),
        found AS (SELECT doc_id, seen.n, i, item_id FROM seen JOIN wanted ON seen.n = wanted.n AND seen.win = wanted.win),
        hits AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(n)) AS r(j) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
