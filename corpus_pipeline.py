"""A training corpus from raw documents: quality rules, near-dedup, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns
of documents. A stage's passes run when its result is written, so Arrow batches stay small in the session from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontaminate, near_copies, quality, secrets
from lodestone.llm.common import Scratch, hold_small_batches, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject, null, empty and blank texts among them.

    Rows are judged each for itself, so ties, repeated rows and null ids don't matter; very long texts are judged whole; other columns pass as
    they are, whatever their names; no rows: no rows.
    """
    hold_small_batches(spark)
    return quality.good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near copies (five-word shingles, similarity 0.8 or more).

    Rows without an id stay, and connect others. Rows that repeat a doc_id are told apart by their text; of equal rows one stays. Texts
    without words are copies of one another. Very long texts are compared whole; other columns pass as they are; no rows: no rows.
    """
    hold_small_batches(spark)
    return near_copies.deduplicated(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share a window of words with a benchmark item.

    Null and empty texts share none. Rows are told apart by their text, so repeated ids and null ids don't matter and equal texts
    share one fate. Very long texts are searched whole; other columns pass as they are; no rows: no rows; no items: all rows.
    """
    hold_small_batches(spark)
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, and n_chars by the new length; keeps every row.

    Null texts stay null. Rows are scanned each for itself, so ties, repeated rows and null ids don't matter; very long texts are scanned
    whole; other columns pass as they are, whatever their names; no rows: no rows.
    """
    hold_small_batches(spark)
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of each text's tokens, their places in the text, and digests of the ids, the decoded text and the places.

    Null and empty texts have no tokens. Rows are encoded each for itself, so ties, repeated rows and null ids don't matter; very long
    texts are encoded whole; other columns are left out; no rows: no rows.
    """
    hold_small_batches(spark)
    return bpe.digests(docs, keep=True)


STAGES = [
    ("quality rules", keep_good),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level bpe", encode),
]

#: SQL has neither BPE nor components of near copies; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, f"stage{k}")
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs
