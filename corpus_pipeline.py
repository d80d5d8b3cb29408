"""The corpus pipeline: quality, language, lines, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; all but the last
return the columns of documents. Models are learnt only from labelled rows outside the held-out quarter.

Defined cases: a null or empty text has no letter, so it goes at the language stage if quality keeps it; rows are judged by
their own texts, whatever their ids, so null and repeated ids are safe; of repeated rows, and of near-copies, one row stays
(the least id, null ids last, of several with that id one, always of the same text); with no label at all quality keeps
every row, and with no language learnt the language stage rejects every row; an empty table gives no rows; further columns, of any
name, are carried along to packing, which returns its pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import language_id, line_dedup, minhash, packing, quality
from lodestone.llm.common import held_out, table
from lodestone.llm.queries import vocabulary
from lodestone.session import materialize, release


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out("doc_id")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.fit(docs, usable=~held_out("doc_id")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first_of_class(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pieces(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("packing", packing_stage),
]
#: SQL can't express the learnt stages, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written to the shared folder, so later stages do not compute them again; once a stage is
    written, the documents of the stage before are deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
