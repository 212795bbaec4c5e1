"""A corpus pipeline over documents: quality rules, near-duplicates, benchmark passages, secrets, tokens.

Each stage is a function of (spark, docs, sf_dir) that works on all rows of docs, the Parquet
that the stage before has written; all but the last return the columns of documents. Nulls in any
column, empty and very long texts, repeated rows, several texts of one doc_id, empty tables and
extra columns are taken as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontaminate, quality_rules, secrets, simhash
from tracelake.llm.common import discard, materialize, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the adaptive quality rules keep: null, empty and wordless texts go, repeated rows stay or go alike."""
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id (nulls last), one row of it.

    Texts without words are near-duplicates of one another; of one doc_id's texts each is judged for itself.
    """
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no passage of the benchmark overlaps; null and wordless texts stay, as with an empty benchmark all do."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars counted anew; null and empty texts stay as they are."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) for each row; null and empty texts have no tokens."""
    found = bpe.decode(bpe.encode(docs))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", drop_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("byte-level BPE", tokenize),
]

#: Fingerprints, spaced seeds, the random field and BPE are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
            if before is not None:
                discard(before)
            before = docs
    return docs
