"""Raw text files: prose whose lines are cut into sentences and trained on.

A line end always ends a sentence (as in the Unicode rules for sentence boundaries), so files are read line by line and
a file of any size is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.config import Training
from keyloom.functions.text import segment_sentences, trimmed
from keyloom.operators import ngrams


def read_raw_text(spark: SparkSession, path: str, segment: Callable[[Column], Column] = segment_sentences) -> DataFrame:
    """``words``: one row a sentence with words, of all text files below ``path``.

    ``segment`` turns a line, its blanks taken off at both ends, into arrays of words, one a sentence. Empty files and
    blank lines give no rows; bytes that aren't UTF-8 are read as replacement signs.
    """
    lines = spark.read.text(path).select(trimmed(F.col("value")).alias("line")).filter("line <> ''")
    return lines.select(F.explode(segment(F.col("line"))).alias("words")).filter(F.size("words") > 0)


def train_raw_text(spark: SparkSession, path: str, training: Training = Training(), dict_id: int = 0, segment: Callable[[Column], Column] = segment_sentences) -> tuple[DataFrame, DataFrame]:
    """(entries, penalties) of the words, pairs and triples in raw text files; merge them into a user's dictionary."""
    counts = ngrams.count_ngrams(read_raw_text(spark, path, segment), "words")
    return ngrams.train(counts, training, dict_id), ngrams.penalties(counts, training, dict_id)
