"""A training corpus from raw documents: toxicity, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes what its predecessor kept; all but the last return the columns of documents, whatever further ones there
are, but for names that begin with an underscore. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import bpe, decontaminate, pii, simhash, toxicity
from strandloom.llm.common import cut, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; those without text stay, and so do repeated rows. Without labels all stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    return toxicity.scored(docs, model, score="_toxicity").where("_toxicity < 0.5").select(*columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that shares 0.8 of its shingles of five words.

    Documents without words, null or empty, are one group; repeated rows are one; a null doc_id comes after all others.
    """
    return simhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without eight consecutive words of a benchmark item, and without shorter items that tell.

    Documents without text stay, and repeated rows; an empty benchmark removes none.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and the words that reveal it generalised or removed. Null texts stay null."""
    return pii.sanitised(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, their digest and that of the text they decode to; null and empty texts have no ids."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("bpe", tokenised),
]

#: SQL can express neither the learned lexicon nor the sketches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
