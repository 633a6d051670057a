"""Corpus pipeline: five filtering and cleaning stages over `documents`, the last one of which encodes what is left.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes it as Parquet in the shared folder and reads it
again as the next one's docs. All stages but the last return the columns of documents:
  1. toxicity: rows that the classifier scores 0.5 or more go;
  2. line dedup: repeated lines go from the texts; n_chars follows the text;
  3. n-gram Jaccard join: of each class of near copies the document with the least id stays;
  4. benchmark decontamination: documents in which a benchmark item occurs within its error budget go;
  5. byte-level BPE: texts are encoded, and the ids decoded again; the columns ids, n_tokens, ids_sha256 and decoded_sha256 are added.
The classifier, the join and the edit distance have no SQL form, so the rows are tested against brute force instead.

Defined cases: a null or empty text is no more toxic than the classifier's intercept, has one empty line, links with
nothing, holds no item and has no ids, so such rows stay; a text of any length is worked on whole. Rows that repeat an id
and its text stay or go together; an id on several texts is told by them. Rows with a null id stay unless their text is
toxic or holds an item; their repeated lines go. Ties don't occur: the keeping document is named by its id. Columns
besides doc_id and text pass through (n_chars, where there is one, follows the text), and result names that clash with
them get a trailing underscore. An empty table gives empty stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageloom.llm import byte_bpe, decontamination, jaccard_join, line_dedup, toxicity
from usageloom.llm.shared import load, stored

BYTE_BPE = "byte_bpe_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, load(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(docs).select(docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.add_tokens(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
