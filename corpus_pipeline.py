"""Corpus pipeline: quality rules, toxicity, SimHash near-duplicates, personal data, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared
folder and reads it back as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import packing, pii, quality, simhash, toxicity
from meterlake.llm.common import materialize, table

VOCABULARY = "word_bpe_49k.json"
#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5
#: Least Jaccard similarity of near duplicates.
SIMILARITY = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weakly supervised rules reject.

    Null and empty texts go; null and repeated ids, repeated rows and columns of any name stay as they are; ties (a
    posterior of exactly one half) are kept; an empty table gives none. Texts of any length are measured whole.
    """
    return quality.keep_good(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; the labels of documents still here train the scores.

    Without labels, or with an empty table of them, nothing was learned and all stay. Null and empty texts score by the
    bias alone; equal texts stay or go alike; a score of exactly one half goes; an empty table gives none.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts whose sets of five-word shingles are linked at a similarity of 0.8 or more:
    that of the smallest doc_id.

    Ties go to the smallest hash of the text; null ids lose; rows that agree in id and text count as one; texts without
    words, null or empty, are alike; an empty table gives none.
    """
    return simhash.keep_one(docs, words=SHINGLE_WORDS, similarity=SIMILARITY)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind, spans that overlap together; ``n_chars`` is counted anew.

    A null text stays null, every row stays, and all other columns stay as they are; an empty table gives none.
    """
    return pii.redact_pii(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences; one row a piece, with its token ids (little-endian u32).

    A null or empty text is its end id alone; null and repeated ids are packed each; an empty table gives no piece.
    """
    return packing.pack(docs, VOCABULARY, end_id=0, capacity=2048, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near duplicates", near_duplicates),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the scores nor the packing; tests/llm runs all stages against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the whole ``documents`` table of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
