"""The registered query of each operator, with the parameters of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .ball_search import rank_documents
from .bpe import encode_texts, ids_sha256
from .common import bucket_of, if_few, table
from . import conversations, lang_id, quality
from .decontaminate import mark_leaks
from .hnsw import near_vectors
from .html_extract import extract
from .jaccard_join import jaccard_components
from .licenses import scan_licences
from .lm_score import score_texts
from .secrets_scan import scan_secrets
from .url_filter import Rule, filter_urls

URL_RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def bpe_vocabulary() -> tuple[bytes, str]:
    """The vocabulary file's bytes and the pattern that cuts texts into pieces."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each passage that leaks an item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = mark_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return leaks.select("doc_id", "leak.item_id", "leak.start", "leak.end", "leak.edits")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: a source is a repository, its ids are dealt to directories of a thousand and a hundred."""
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100), "doc_id")
    files = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return scan_licences(files, keep=["doc_id", "path"])


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, ranks, pattern, decoded=True)
    return encoded.select("doc_id", "n_tokens", ids_sha256("ids").alias("ids_sha256"), "decoded_sha256")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def subword_model() -> bytes:
    """The vocabulary file whose pieces the language model's lattice is made of."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (bucket_of(F.col("doc_id")) == 1).alias("held_out"))
    return score_texts(docs, "held_out", subword_model())


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, words=4, percent=85)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return scan_secrets(docs, keep=["doc_id"]).drop("found")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", bucket_of(F.col("doc_id")) == 0)
    model = lang_id.fit(docs.where("not held_out"))
    return lang_id.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", bucket_of(F.col("doc_id")) == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs.where("not held_out").join(if_few(labels), "doc_id"))
    return quality.judge(docs, model).select("doc_id", "held_out", "score", "predicted")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair_digests(conversations.damaged(rows), rows)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scans": op2_license_scans,
    "op3_bpe": op3_bpe,
    "op4_url_filters": op4_url_filters,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_secret_scans": op8_secret_scans,
    "op9_html_extraction": op9_html_extraction,
    "op10_language_id": op10_language_id,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_lexical_search": op12_lexical_search,
    "op13_conversation_repair": op13_conversation_repair,
}
