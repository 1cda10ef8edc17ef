"""Rows held against a list of reference words: what the look-alike and the encoding operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.session import BROADCAST_ROWS


def reference_words(reference: DataFrame, word: str) -> DataFrame:
    """The distinct non-null reference words, as ``kl_form``; marked for broadcast only where they are proven few."""
    known = reference.select(reference[word].alias("kl_form")).filter("kl_form IS NOT NULL").distinct()
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(known) if few else known


def unlisted(df: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """Rows whose text is not null and not stored exactly as a reference word."""
    rows = df.filter(df[text].isNotNull())
    return rows.join(known, rows[text] == known["kl_form"], "left_anti")


def spread(texts: DataFrame) -> DataFrame:
    """Distinct texts over all the session's shuffle partitions, for work in Python that is heavy for their bytes."""
    return texts.distinct().repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def word_pieces(words: DataFrame, most: int) -> list[DataFrame]:
    """The distinct words (``w``) in pieces by hash of about ``most`` bytes, to be held one at a time: one piece unless
    they are more."""
    count = max(1, -(-(words.agg(F.sum(F.octet_length("w"))).first()[0] or 0) // most))
    return [words] if count == 1 else [words.filter(F.pmod(F.xxhash64("w"), F.lit(count)) == k) for k in range(count)]
