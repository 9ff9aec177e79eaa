"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extract import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op2_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import text_media

    return text_media(table(spark, sf_dir, "documents"))


def op3_benchmark_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_copies

    return find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_ids

    return encode_ids(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op8_id_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pfor import ids_file

    return ids_file(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


# what SQL can express of the operators' results, as queries of their own


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_interleaved_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def id_file_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the id file, and whether each begins where the one before ends."""
    own = op8_id_blocks(spark, sf_dir)
    follows = own.select((F.col("start") + F.col("n_tokens")).alias("start")).distinct()
    return own.join(follows.withColumn("joins_on", F.lit(True)), "start", "left").select("doc_id", (F.coalesce("joins_on", F.lit(False)) | (F.col("start") == 0)).alias("placed"))


def near_duplicates_of_equal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes within equal texts: each such text has one class."""
    found = op10_near_duplicates(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return found.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")).agg(F.count("*").alias("n"), F.countDistinct("class_id").alias("classes"))


SQL = {
    "media_payloads": """SELECT doc_id, octet_length(b) AS n_bytes, CAST(greatest(64, ceil(octet_length(b) / 64) * 64) AS BIGINT) AS payload_bytes,
        sha256(b || from_hex(repeat('00', CAST(greatest(64, ceil(octet_length(b) / 64) * 64) AS BIGINT) - octet_length(b)))) AS payload_sha256
        FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)""",
    "token_bytes": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents",
    "pii_counts": r"""SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
        len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: len(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 4) AS BIGINT) > 255)) = 0)) AS n_ip,
        len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))), lambda d: len(d) BETWEEN 16 AND 19
            AND list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[i] AS BIGINT) WHEN d[i] < '5' THEN 2 * CAST(d[i] AS BIGINT) ELSE 2 * CAST(d[i] AS BIGINT) - 9 END)) % 10 = 0)) AS n_card,
        len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15)) AS n_phone
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "id_file_documents": "SELECT doc_id, true AS placed FROM documents",
    "near_duplicates_of_equal_texts": "SELECT sha256(coalesce(text, '')) AS text_sha256, count(*) AS n, CAST(1 AS BIGINT) AS classes FROM documents GROUP BY 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_interleaved_media": op2_interleaved_media,
        "op3_benchmark_copies": op3_benchmark_copies,
        "op4_licences": op4_licences,
        "op5_token_counts": op5_token_counts,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_pii": op7_pii,
        "op8_id_blocks": op8_id_blocks,
        "op9_quality": op9_quality,
        "op10_near_duplicates": op10_near_duplicates,
        "media_payloads": media_payloads,
        "token_bytes": token_bytes,
        "pii_counts": pii_counts,
        "id_file_documents": id_file_documents,
        "near_duplicates_of_equal_texts": near_duplicates_of_equal_texts,
    }


def oracle_sql() -> dict[str, str]:
    return {name: " ".join(sql.split()) for name, sql in SQL.items()}
