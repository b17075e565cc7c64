"""Documents to packed training sequences, in stages that are written and read again one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import minhash, packing, quality, substring
from pricelens.llm._spark import documents, quoted, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, as they are. A column named quality comes back as it was."""
    own = "quality" in docs.columns
    if own:
        name = next(c for k in range(len(docs.columns) + 1) if (c := f"quality_{k}") not in docs.columns)
        docs = docs.withColumnRenamed("quality", name)
    kept = quality.judged(spark, docs, sf_dir).where("quality.kept").drop("quality")
    return kept.withColumnRenamed(name, "quality") if own else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id. Rows with a null doc_id stay."""
    return minhash.first_of_groups(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the words that the substring dedup removes. n_chars counts the text's characters again, if there."""
    out = substring.dedup_substrings(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select([quoted(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of what is left; a document whose words are all gone brings its end only."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", keep_quality), ("near-dedup", drop_near_duplicates), ("substring dedup", remove_repeats), ("packing", pack)]
#: No SQL expresses the stages. tests/llm holds them, and run(), against plain Python on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result written as Parquet to the shared folder and read again."""
    docs, folder = documents(spark, sf_dir), shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
