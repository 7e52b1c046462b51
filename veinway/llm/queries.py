"""The queries of this subpackage and their SQL, added to the registry of __spark_entry__.py."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinway.llm.bpe import round_trip
from veinway.llm.common import table
from veinway.llm.exact_dedup import exact_dedup
from veinway.llm.fingerprints import fingerprints
from veinway.llm.infill import fill_in_middle, original
from veinway.llm.languages import dictionaries, languages, learned_rows
from veinway.llm.near_dedup import near_components
from veinway.llm.packing import pack
from veinway.llm.periodic import digests, periodic_runs, with_repeats
from veinway.llm.quality import quality_scores
from veinway.llm.secret_scan import scan
from veinway.llm.sharding import shard_by_bytes
from veinway.llm.token_files import token_files
from veinway.llm.toxicity import toxicity_scores


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Of a sequence of 2048 tokens: documents, and attention cost as the sum of squared lengths.
MAX_DOCS, MAX_COST = 128, 2048**2


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), max_docs=MAX_DOCS, max_cost=MAX_COST)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.sha2("candidate", 256).alias("candidate_sha256"), "start", "length", "occurrences", "probability", "is_secret"
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(original("output", "form")).alias("restored_sha256"),
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages(docs, dictionaries(docs.filter(learned_rows("doc_id"))))
    return found.select("doc_id", (~learned_rows("doc_id") & F.col("doc_id").isNotNull()).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_repeats(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_packing, op7_exact_dedup, op10_near_dedup, op6_fingerprints, op9_byte_bpe, op4_toxicity, op8_quality, op3_secret_scan, op5_token_files, op11_fill_in_middle, op12_language_id, op13_periodic_runs)
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)
    """,
    "op11_fill_in_middle": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
                   sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents
        ), u AS (
            SELECT doc_id, text, units, len(units) AS n, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT)) AS h FROM t
        ), v AS (
            SELECT doc_id, text, units, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                        WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM u
        ), w AS (
            SELECT doc_id, text, n, form, array_to_string(units[1 : a], '') AS prefix, array_to_string(units[a + 1 : b], '') AS middle,
                   array_to_string(units[b + 1 : n], '') AS suffix
            FROM v
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM w
    """,
}
