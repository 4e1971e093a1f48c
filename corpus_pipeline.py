"""From raw documents to packed training sequences: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and reads
it back as the next stage's documents. All stages but the last return the columns of ``documents``, more columns included, whatever their names.

Defined cases, beside those of the operators: an empty table gives an empty result in every stage. Null and empty texts are judged by the grades' base
rates, are equal to each other, are near nothing, hold no words for the mix to take, so end there, and pack as the end token alone. Rows that repeat are judged each;
of equal texts one row stays, also where ids repeat or are null. Texts of any length are taken whole; only packing cuts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe.llm import exact_dedup, minhash_dedup, mixing, packing, quality, queries
from cubeframe.llm._store import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose probability of the top grade is below what the model asks for (see ``quality.CLEAN_LOSS``)."""
    model = quality.train(docs, quality.ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.selected(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one document stays."""
    return exact_dedup.without(docs, exact_dedup.exact_dedup(docs), text="text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the one with the smallest id stays."""
    return exact_dedup.without(docs, minhash_dedup.minhash_dedup(docs, width=5, percent=80))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: unused words go, words used again come again in rows with the same id."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence."""
    return packing.pack(docs, queries.tokenizer_path()).drop("ids")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The model's sums, the sketches and the tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
