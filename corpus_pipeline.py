"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's
result as Parquet in the folder that the cluster shares and gives what it reads back to the
next stage. All stages but the last return the columns of ``documents``, as they are but for
masked texts; further columns stay too, whatever their names.

In all stages an empty table gives an empty table, and repeated rows are treated alike: they stay
together or go together. A null text counts as an empty one, texts of any length are read whole, and
a null id, language, source or length has no effect on what becomes of a row. Each stage says what
else it does with such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import decontaminate, langid, partenum, secrets, unigram
from keelson.llm.common import materialize, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language ID rejects: without a letter (null and empty texts), or of no learned language.

    Ties between languages do not matter here. Without a row to learn from all are rejected.
    """
    return langid.stage(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five words, similarity 0.8) the document with the smallest id.

    Null and empty texts are near to nothing and stay, as do rows without an id; rows of one id are one document.
    """
    return partenum.stage(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap with a benchmark item. Rows go by their own text, also without an id; null and empty texts stay."""
    return decontaminate.stage(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets and linked credentials in the texts; all documents stay. Of spans that overlap the first is masked; null texts stay null."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document that is left; none for null and empty texts. Of segmentations with one score one is taken, always the same."""
    return unigram.stage(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding", encode_pieces),
]

#: The first and the last stage hold models that SQL cannot express; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
