"""From raw documents to token ids: language, near-duplicates, benchmark leaks, secrets, tokens.

Every stage takes documents with the columns doc_id, text, lang and source, of which any may
hold nulls, and n_chars; further columns of any name travel along, also those named like
something that an operator adds, since columns are renamed while an operator works. Repeated
rows are kept or dropped as each stage says. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.llm import lang_id
from ledgerloom.llm.bpe import encode_texts
from ledgerloom.llm.common import table, written
from ledgerloom.llm.decontaminate import mark_leaks
from ledgerloom.llm.jaccard_join import without_near_duplicates
from ledgerloom.llm.queries import bpe_vocabulary
from ledgerloom.llm.secrets_scan import redacted, scan_secrets


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """docs with columns of names that no operator uses, the new name of each column, and the way back."""
    names = {c: f"column{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, [F.col(n).alias(c) for c, n in names.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: learnt from the labelled ones, the rejected ones go.

    Null and empty texts, and those without letters, are rejected. Repeated rows fare alike.
    """
    plain, names, back = _plain(docs)
    model = lang_id.fit(plain, text=names["text"], lang=names["lang"])
    return lang_id.predict(plain, model, text=names["text"]).where("not rejected").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share four fifths of their five-word shingles, the one with the smallest id.

    Texts without words are like no other and stay. Of repeated rows one stays.
    """
    plain, names, back = _plain(docs)
    return without_near_duplicates(plain, words=5, percent=80, doc_id=names["doc_id"], text=names["text"]).select(*back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; null and empty texts have none."""
    plain, names, back = _plain(docs)
    return mark_leaks(plain, table(spark, sf_dir, "benchmark"), text=names["text"]).where("size(leaks) = 0").select(*back)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; credentials that belong to few owners are cut out of their texts, and n_chars counts what is left.

    A null text stays null.
    """
    plain, names, _ = _plain(docs)
    found = scan_secrets(plain, keep=plain.columns, text=names["text"], owner=names["source"], repo=names["doc_id"])
    text, live = F.col(names["text"]), F.exists("found", lambda s: s["live"])
    new = redacted(text, F.col("found"))
    changed = {"text": new, "n_chars": F.when(live, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names["n_chars"])) if "n_chars" in names else None}
    return found.select(*(changed.get(c, F.col(n)).alias(c) for c, n in names.items()))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document instead of its text, and whether decoding them gives the text again.

    The result has ids, n_tokens and round_trip after the other columns; columns of these names are
    replaced. A null text counts as empty.
    """
    ranks, pattern = bpe_vocabulary()
    plain, names, _ = _plain(docs)
    encoded = encode_texts(plain, ranks, pattern, text=names["text"], decoded=True)
    kept = [F.col(n).alias(c) for c, n in names.items() if c not in ("text", "ids", "n_tokens", "round_trip")]
    same = F.col("decoded_sha256") == F.sha2(F.coalesce(names["text"], F.lit("")), 256)
    return encoded.select(*kept, "ids", "n_tokens", same.alias("round_trip"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("byte-level BPE", tokens),
]

#: Language ID and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
