"""From raw documents to tokens: language ID, near-dedup, redaction of secrets, mixing of sources, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, language, mixing, neardup, secrets
from strandloom.llm.common import packed, scratch, staged, table, unpacked


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; a null lang becomes the predicted one.

    Null texts and those without a letter are rejected. Without a labelled document nothing can be told, and all are.
    Equal texts get equal answers, repeated rows stay repeated, a null doc_id is carried along, an empty table gives no
    rows. Other columns pass through, whatever they are called.
    """
    model = language.train(docs.select("doc_id", "text", "lang").where(language.may_learn()))
    names = ["text", "lang"]
    told = language.predicted(packed(docs, names), model).where("NOT rejected")
    return unpacked(told.withColumn("lang", F.coalesce("lang", "lang_pred")), docs.columns, names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays.

    Texts without a word are linked with nothing. Rows that repeat doc_id and text leave one, chosen by a digest of the
    rest; rows with a null doc_id all stay. An empty table gives no rows. Other columns pass through.
    """
    return neardup.deduplicated(docs, shingle=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span of a text is replaced by a mark; n_chars follows.

    Null and empty texts and all texts without a span stay as they are. Equal rows get equal answers, a null doc_id is
    carried along, an empty table gives no rows. Other columns pass through.
    """
    return secrets.redacted(docs, secrets.spans(docs.select("doc_id", "text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice.

    A null source is a source of its own, last in order. Rows that repeat doc_id and text are taken together, from the
    one whose other columns come first by their digest. Null texts have no words. An empty table gives no rows.
    """
    return mixing.resampled(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of them and of the text decoded from them.

    Null and empty texts have no tokens. Equal rows get equal answers; an empty table gives no rows.
    """
    return bpe.encoded(docs.select("doc_id", "lang", "source", "text"), with_ids=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("bpe_encode", bpe_encode)]

#: No SQL says what a trained model predicts; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
