"""Training from a stream of sentences: counts are kept as one small file set a batch and merged on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyloom.config import Training
from keyloom.operators import ngrams

COUNTS = "tokens ARRAY<STRING>, n BIGINT, entry_type INT, batch BIGINT"


def running_counts(stream: DataFrame, words: str, most: int = 3) -> DataFrame:
    """A streaming count of words and n-grams, for update or complete mode. Counts don't depend on order, so no
    watermark is needed, and its state is the vocabulary."""
    return ngrams.count_ngrams(stream, words, most).select("tokens", "n")


def train_stream(stream: DataFrame, words: str, store: str, checkpoint: str, most: int = 3) -> StreamingQuery:
    """Counts each batch and writes it under its own number, so that a batch that is run again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        counted = ngrams.count_ngrams(df, words, most)
        counted.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, store: str, training: Training = Training(), dict_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(entries, penalties) of all batches so far."""
    counts = spark.read.schema(COUNTS).parquet(store).groupBy("tokens", "entry_type").agg(F.sum("n").alias("n"))
    return ngrams.train(counts, training, dict_id), ngrams.penalties(counts, training, dict_id)


def compact(spark: SparkSession, store: str, target: str) -> None:
    """All batches added up, as one snapshot of counts in another folder."""
    counts = spark.read.schema(COUNTS).parquet(store).groupBy("tokens", "entry_type").agg(F.sum("n").alias("n"))
    counts.select("tokens", "n", "entry_type").write.mode("overwrite").parquet(f"{target}/batch=0")
