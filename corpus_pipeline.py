"""The corpus pipeline: five stages from raw documents to piece ids.

1. ``language``: documents whose text has no language (none, or no letters) go.
2. ``near_duplicates``: of each group of documents linked by five-word shingles with a
   Jaccard similarity of 0.8 or more, the one with the least id stays.
3. ``decontamination``: documents with a window of a benchmark item go.
4. ``personal_data``: spans of personal data give way to their kind's name.
5. ``pieces``: texts become ids of a SentencePiece vocabulary.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before kept; all
but the last return the columns of ``documents``, with their values, whatever further
columns there are and however they are named.

Defined results: a null text, or one without letters, goes at the first stage; of rows
that share an id all stay or go together at the second, and of linked ids the least, null
before all; repeated rows go through the others row by row; an empty table stays empty;
texts are read whole, whatever their length, and other columns may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm import decontaminate, language_id, ngram_join, pii, sentence_pieces
from glyphflow.llm.common import checkpoint, fresh, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    into = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = language_id.predict(docs, language_id.learn(docs), into=into)
    return found.where(F.col(into[0]) != language_id.UNKNOWN).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs, n=5, threshold=(80, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    into = fresh(docs, "pii_base"), fresh(docs, "pii_spans")
    found = pii.find_pii(docs, into=into).withColumn("text", pii.redact(F.col("text"), F.col(into[1])))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = sentence_pieces.encode(docs)
    return found.select("doc_id", "lang", "source", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("pieces", encode_pieces),
]

#: A recurrent network and a lattice can't be written as SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
