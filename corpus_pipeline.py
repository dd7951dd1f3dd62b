"""A corpus pipeline made of five operators of ``wattline.llm``: language, toxicity, near duplicates, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
``documents``. Near copies and benchmark passages are decided row by row, whatever the ids; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import decontamination, encoding, jaccard, language, toxicity
from wattline.llm.common import stash
from wattline.llm.registry import table

#: Words whose ids a worker keeps in the last stage.
KEPT_WORDS = 100_000


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those that are null or have no letter go."""
    model = language.train(docs, language.id_remainder("doc_id", 3) != 1)
    return language.identify(docs, model).where(F.col("lang_pred") != language.UNKNOWN).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"), language.id_remainder("doc_id", 5) != 0)
    return toxicity.score_toxicity(docs, scorer).where(F.col("toxic_pred") == 0).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group linked by five-word shingles at 0.8 or more."""
    return jaccard.keep_one(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left, with digests of the ids and of the text they decode to."""
    # the workers also hold what the other stages left, so they keep fewer words
    out = encoding.encode(docs.select("doc_id", "source", "text"), encoding.model_path(), digests=True, kept_words=KEPT_WORDS)
    return out.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", keep_identified),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: Trained models and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the ``documents`` of ``sf_dir``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
