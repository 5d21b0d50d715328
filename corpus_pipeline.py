"""From documents to packed training sequences: five stages, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. `run` applies them in order, each stage written as Parquet in the cluster's
spark.checkpoint.dir and read again. Extra columns of the input are not carried on.

* toxicity: documents that the classifier rejects go; it learns from `labels` of sf_dir.
* line_dedup: repeated lines go; a document stays even if no line is left. n_chars follows the text.
* jaccard_join: of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id
  stays. Documents without words or without doc_id all stay; rows are documents, also those of one doc_id.
* mixing: the documents in the order of the mix, none dropped or repeated.
* packing: pieces of documents in sequences of 1024 tokens, which follow the mix to within a group of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import jaccard_join, line_dedup, mixing, packing, toxicity
from llm.common import table, written
from llm.queries import tokenizer_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WIDTH, SIMILARITY = 5, (80, 100)
# What a Python worker has in hand at once: whole texts, and what is worked out from them, several times their size. A batch
# ends at so many rows or bytes, whichever comes first.
ROWS_IN_HAND, BYTES_IN_HAND = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """For the stages that hand texts to Python; workers and executors keep the memory of their largest batch."""
    for name, most in (("maxRecordsPerBatch", ROWS_IN_HAND), ("maxBytesPerBatch", BYTES_IN_HAND)):
        name = f"spark.sql.execution.arrow.{name}"
        # Both settings are unlimited when not above 0; sizes are given back in bytes, with or without a unit.
        now = int(spark.conf.get(name).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), carry=COLUMNS)
    return scored.filter(F.col("score") < toxicity.DECISION).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    kept = line_dedup.drop_repeated_lines(docs, carry=["lang", "source"])
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source",
                       F.length("kept").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_join.first_of_class(docs, WIDTH, *SIMILARITY, carry=COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.DEFAULT_WEIGHTS).orderBy("slot", "position").select(*COLUMNS)


def placed(docs: DataFrame) -> DataFrame:
    """Rows of written files with `place`, dense from 0: files by name, which is how a sorted table is written, then rows."""
    rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # One row for each file.
    counts = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = counts.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_file").withColumn("place", F.col("_before") + F.col("_row")).drop(
        "_file", "_row", "_before")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """In the order of the files that the stage before has written; rows that come from no files have no order."""
    small_batches(spark)
    if docs.inputFiles():
        return packing.pack(placed(docs), *tokenizer_files(), order="place")
    return packing.pack(docs, *tokenizer_files())


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("jaccard_join", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack_sequences)]
# A trained classifier and a tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
