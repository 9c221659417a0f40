"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame. All but the last
return the columns of their input, whatever further ones there are and however they are named. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common, decontamination, near_dups, packing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity reaches 0.7; learned from the rows that op3 learns from.

    Null and empty texts get the model's bias and stay; repeated rows are judged alike; without labels nothing is learned and all
    rows stay; a null id is never learned from.
    """
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), trainable=lambda x: F.crc32(x.cast("string").cast("binary")) % 3 != 1)
    return toxicity.filtered(docs, model, 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id.

    Null and empty texts are nobody's duplicates; repeated rows count as one; a null id comes after all others of its group.
    """
    return near_dups.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item.

    Null and empty texts and items match nothing; repeated rows go or stay together; without items all rows stay.
    """
    return decontamination.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted anew where that happened.

    Rows without secrets stay as they are, null and empty texts and null counts too; repeated rows are rows of their own.
    """
    return secrets.redacted_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in full sequences, with their token ids.

    A null or empty text is one id, the end of a document; repeated rows are packed each; a null id stays null; long texts are
    cut into several pieces.
    """
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The learned and the sketched stages can't be put in SQL; tests/llm/test_pipeline.py checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    paths: list[str] = []
    for name, stage in STAGES[:-1]:
        docs, path = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if paths:
            common.drop_path(spark, paths.pop())
        paths.append(path)
    return STAGES[-1][1](spark, docs, sf_dir)
