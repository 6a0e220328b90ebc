"""The queries of this subpackage: name -> f(spark, sf_dir), and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .bpe import encode_documents
from .decontaminate import find_contamination
from .exact_dedup import exact_duplicates
from .htmltext import extract_text
from .langid import identify_languages
from .licenses import oracle as licence_sql
from .licenses import scan_licences
from .media import media_columns
from .pii import find_personal_data
from .resampling import oracle as resampling_sql
from .resampling import resample
from .simhash import near_duplicates
from .toxicity import score_toxicity
from .vector_codes import compress
from .vector_codes import oracle as vector_sql
from .warc import BASE32, archive_pages


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_hyperdimensional_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op5_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_boosted_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op7_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_tree_model_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licence_sentences": op1_licence_sentences,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_hyperdimensional_language_id": op4_hyperdimensional_language_id,
    "op5_gru_toxicity": op5_gru_toxicity,
    "op6_boosted_personal_data": op6_boosted_personal_data,
    "op7_bpe_speculate_verify": op7_bpe_speculate_verify,
    "op8_tree_model_html_text": op8_tree_model_html_text,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_latent_decontamination": op10_latent_decontamination,
    "op11_media_columns": op11_media_columns,
    "op12_vector_codes": op12_vector_codes,
    "op13_importance_resampling": op13_importance_resampling,
}

#: Base32 of a hexadecimal SHA-1 h: five digits make four letters.
BASE32_SQL = " || ".join(f"substr('{BASE32}', CAST(((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {15 - 5 * k}) & 31) + 1 AS INTEGER), 1)" for i in range(8) for k in range(4))

ORACLE_SQL: dict[str, str] = {
    "op2_warc_revisits": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, regexp_replace(coalesce(url, ''), '[\\x00-\\x20\\x7f]+', '%20', 'g') AS url FROM pages),
        f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {BASE32_SQL} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url FROM p JOIN f USING (h)
    """,
    "op1_licence_sentences": licence_sql(),
    "op12_vector_codes": vector_sql(),
    "op13_importance_resampling": resampling_sql(),
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
    """,
}
