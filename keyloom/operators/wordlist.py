"""Word lists: counts of yearly unigrams, exclusion, and scores added to a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.config import WORD
from keyloom.functions.text import without_pos


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """``word, count`` of ``word TAB count`` lines; lines with more or fewer columns, or no number, are passed over."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    rows = parts.filter(F.size("p") == 2).select(F.col("p")[0].alias("word"), F.col("p")[1].try_cast("bigint").alias("count"))
    return rows.filter("count IS NOT NULL")


def write_wordlist(counts: DataFrame, path: str) -> None:
    counts.select(F.concat_ws("\t", "word", F.col("count").cast("string"))).write.mode("overwrite").text(path)


def line_counts(lines: DataFrame, line: str = "line", skip_tagged: bool = False) -> DataFrame:
    """``word, count`` of each unigram line: the part of speech taken off, match counts of all years added.

    Data points without three parts count nothing, counts that aren't numbers neither. Tagged and untagged lines both
    count unless ``skip_tagged``. A null line has no word.
    """
    fields = F.split(F.col(line), "\t", -1)
    points = F.filter(F.transform(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))), lambda x: F.split(x, ",", -1)), lambda p: F.size(p) == 3)
    number = lambda x: F.when(x.rlike(r"\A[0-9]+\z"), x.try_cast("bigint")).cast("decimal(38,0)")
    total = F.aggregate(points, F.lit(0).cast("decimal(38,0)"), lambda s, p: (s + F.coalesce(number(p[1]), F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)"))
    token = fields[0]
    rows = lines.filter(F.col(line).isNotNull())
    if skip_tagged:
        rows = rows.filter(~token.contains("_"))
    return rows.select(without_pos(token).alias("word"), total.alias("count"))


def add_up(counts: DataFrame) -> DataFrame:
    """``word, count`` with the counts of all parts added."""
    return counts.groupBy("word").agg(F.sum("count").alias("count"))


def exclude(counts: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Words that no pattern fits from their beginning."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.col("word").rlike(f"^(?:{p})")
    return counts.filter(~F.coalesce(out, F.lit(False)))


def score_words(entries: DataFrame, counts: DataFrame, least: int = 1) -> DataFrame:
    """Word scores raised by the words' counts; words below ``least`` leave, other entries stay.

    Counts are added up before the join, so that a frequent word is one row; words the dictionary lacks are of no
    account.
    """
    total = add_up(counts).select(F.col("word").alias("text"), "count")
    listed = entries.filter(F.col("entry_type") == WORD).join(total, "text", "left").withColumn("score", F.col("score") + F.coalesce("count", F.lit(0)))
    return listed.filter(F.col("score") >= least).select(*entries.columns).unionByName(entries.filter(F.col("entry_type") != WORD))
