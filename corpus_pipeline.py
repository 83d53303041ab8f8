"""The corpus pipeline: five stages, each on what the stage before it kept.

1. ``toxicity``: documents scored as toxic go.
2. ``line_dedup``: repeated runs of words are taken out of the texts, wherever lines end.
3. ``near_dedup``: of each SimHash group one document stays, that with the smallest id.
4. ``decontamination``: documents that cover a benchmark item go.
5. ``packing``: the rest is packed into sequences.

All but the last return the columns of ``documents``, with ``n_chars`` kept in step
with the text. Each decision is about a row, not about its id: rows that share an
id but not the text are documents of their own, and so are rows without an id
(null ids come last in order). Of rows that repeat id and text one stays in the
third stage. A null or empty text passes the first two stages unchanged, is in the
group of texts without words in the third and packs as one end id. Empty tables
give empty results; other columns are never read.

``run`` deletes what a stage leaves behind as soon as the next table is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import fresh_path, scratch, table
from helixloom.llm.decontamination import uncontaminated
from helixloom.llm.packing import pack
from helixloom.llm.passage_dedup import passage_dedup
from helixloom.llm.simhash import one_of_each
from helixloom.llm.toxicity import THRESHOLD, labelled_rows, learn, predict
from helixloom.session import delete, ensure_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scores come with the rows themselves: nothing is joined back."""
    ensure_package(spark)
    model = learn(labelled_rows(docs, table(spark, sf_dir, "labels")))
    kept = predict(docs.select(*COLUMNS), model, ["doc_id", "lang", "source", "n_chars"], with_text=True)
    return kept.where(F.col("score") < THRESHOLD).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_package(spark)
    return passage_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_package(spark)
    return one_of_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_package(spark)
    return uncontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_package(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing)]
#: Learned scores, fingerprints and token ids are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before, path = path, fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs = spark.read.parquet(path)
    return docs
