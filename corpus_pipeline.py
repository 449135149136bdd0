"""A training-data pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on every row the stage before
it kept; all but the last return the columns of ``documents``. Stages are
written as Parquet and read back in between, so a lost executor costs one stage
at most.

Cases that hold for every stage: a null text counts as empty (and stays null);
very long texts are read whole; an empty table gives no rows; equal rows are
treated alike, except that near duplicates leave one of them; extra columns pass
through the stages whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm import decontaminate, lines, ngram_join, packing, quality
from sparkveil.llm.common import save
from sparkveil.llm.queries import table, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; trained on the labelled rows outside the held-out fold.

    Empty texts are scored as such; without labels every document stays; rows are judged one by one, so ties don't arise.
    """
    labels = quality.training_labels(table(spark, sf_dir, "labels"), "quality", 5, 0)
    return quality.keep_quality(docs, quality.fit_quality(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; ``n_chars`` follows the text.

    The first copy is that of the smallest doc_id (null first), then the first line; a document that loses every line stays, empty.
    """
    names = {c: f"`{c.replace('`', '``')}`" for c in docs.columns}
    cleaned = lines.remove_repeated_lines(docs, report=None)
    n_chars = F.length("text").cast("long").alias("n_chars")
    return cleaned.select(*[n_chars if c == "n_chars" else F.col(names[c]) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near duplicates.

    Rows equal in id and text leave one, unlike texts of that id stay; documents without shingles or id are in no group.
    """
    return ngram_join.keep_one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate; those without words stay, and all do without benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences; an empty text is a piece of one token."""
    packed = packing.pack_documents(docs, tokenizer_path(), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Trees, tokenizer and packing are beyond SQL; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
