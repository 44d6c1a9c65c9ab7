"""From raw documents to packed sequences: each stage takes what its predecessor kept. STAGES go by name; run() applies them to documents.

In every stage but the last a row keeps all its columns, whatever their names: they travel as one struct. A null text counts as empty and stays null, a null doc_id is a
document of its own, and an empty table gives an empty one. What each stage makes of repeated rows and ties is said in its function.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismatic.llm import exact_dedup, near_dedup, packing, secrets, shared, toxicity


def carried(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row as one struct `doc`, and further columns."""
    return docs.select(F.struct("*").alias("doc"), *[c.alias(name) for name, c in more.items()])


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. Without labels of both kinds none does. Repeated rows share their fate."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one row stays: the longest, then the smallest doc_id; of rows that repeat with that doc_id and text, any one."""
    kept = exact_dedup.decided(docs).where("stays").select(F.col("doc_id").alias("keep_id"), F.col("row_hash").alias("keep_hash")).distinct()
    rows = carried(docs, id=docs["doc_id"].cast("long"), hash=F.xxhash64(text_of(docs)))
    left = rows.join(kept, rows["id"].eqNullSafe(kept["keep_id"]) & (rows["hash"] == kept["keep_hash"]), "left_semi")
    once = Window.partitionBy("id", "hash").orderBy(F.lit(1))
    return left.withColumn("nth", F.row_number().over(once)).where("nth = 1").select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays: the smallest doc_id, with all its rows."""
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("keep_id")).distinct()
    rows = carried(docs, id=docs["doc_id"].cast("long"))
    return rows.join(kept, rows["id"].eqNullSafe(kept["keep_id"]), "left_semi").select("doc.*")


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; its secrets are masked, and n_chars (where there is such a column) counts the new text."""
    repo = F.concat_ws("/", "source", "lang")
    _, found = secrets.judged(docs)
    hit = found.where("spans <> ''").select("row", "spans").distinct()
    marked = carried(docs, row=secrets.row_key(text_of(docs), docs["doc_id"].cast("long"), docs["source"].cast("string"), repo)).join(hit, "row", "left")
    masked = F.when(F.col("spans").isNotNull(), secrets.masked(F.col("doc")["text"], F.col("spans"))).otherwise(F.col("doc")["text"])
    marked = marked.withColumn("masked", masked)
    counted = F.when(F.col("spans").isNotNull(), F.char_length("masked")).otherwise(F.col("doc")["n_chars"]) if "n_chars" in docs.columns else None
    own = {"text": F.col("masked"), "n_chars": counted}
    return marked.select(*[own.get(c, F.col("doc")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens. Repeated rows are packed each; an empty text is its end token."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, window=1024, end=0)


STAGES = [("toxicity", toxicity_filter), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("secret_scans", secret_masking), ("packing", pack_sequences)]

#: Trained weights, exact Unicode tokenisation and components have no SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(shared.WRITTEN)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.materialize(docs, f"pipeline-{name}")
            shared.discard(spark, since, -1)  # what led to it
    return docs
