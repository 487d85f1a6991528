"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whence.llm import (
    backoff_lm,
    conversations,
    decontaminate,
    html_text,
    lexical_search,
    ngram_join,
    pii,
    quality,
    quality_rules,
    sentencepieces,
    suffix_dedup,
    toxicity,
    warc,
)
from whence.llm.common import fold, table

#: Documents whose score reaches it are called 1.
DECIDE = 0.7
#: Key of the pseudonyms in the registered queries; a real run passes its own secret.
PII_KEY = "whence"


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels, "quality", learn=fold(F.col("doc_id"), 4) != 2)
    return quality.score(docs, weights).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= DECIDE).cast("int").alias("predicted")
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.deduplicated(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = sentencepieces.encode(docs, piece_model()).drop("text")
    return sentencepieces.decode(ids, piece_model()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, PII_KEY).select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.array_join("pii", ",").alias("kinds"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_leaks"), "leaks"
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.fit(docs, labels, "toxic", learn=fold(F.col("doc_id"), 3) != 1)
    return toxicity.score(docs, weights).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= DECIDE).cast("int").alias("predicted"), "offending"
    )


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op8_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.scored(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(*warc.archived(table(spark, sf_dir, "pages")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.searched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_suffix_dedup, op3_sentencepiece, op4_pii, op5_decontamination,
    op6_toxicity, op7_html_text, op8_backoff_lm, op9_quality_rules, op10_ngram_join,
    op11_warc, op12_conversation_repair, op13_lexical_search,
)}

ORACLE_SQL: dict[str, str] = {
    "op11_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
        ), q AS (
            SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p
        )
        SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
            CASE WHEN first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
        FROM q""",
    "op13_lexical_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), tf AS (
            SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
        ), docs AS (
            SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL
        ), total AS (
            SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM docs
        ), asked AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), terms AS (
            SELECT term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM tf, total GROUP BY term
        ), scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))::BIGINT AS score
            FROM asked JOIN terms USING (term) JOIN tf USING (term) JOIN docs USING (doc_id), total GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 20""",
}
