"""Documents cleaned and packed for training: five stages, each written and read again.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``. Clean documents stay; no stage removes a row without a finding:
toxic documents, repeated lines, near copies (one row of a group stays), documents that
hold a benchmark item. The last stage packs what is left into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dateline.llm import decontaminate, lines, packing, simhash, toxicity
from dateline.llm.queries import tokenizer_files
from dateline.session import cut


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; the model learns from the labelled ones."""
    model = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(model, F.col("text")) < toxicity.THRESHOLD)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of other documents taken out; ``n_chars`` follows the text."""
    cleaned = lines.drop_shared_lines(docs)
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of every group of near copies (five words, 0.8)."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(docs, *tokenizer_files())


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: The learned first stage has no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; a table in the shared folder stands between two stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
