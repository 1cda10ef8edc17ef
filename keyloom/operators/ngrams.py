"""Training: words and n-grams of sentences counted into scores, and snapshots merged.

Training only adds integers, so the order of sentences is of no account: it is a grouped count, with the start tokens of
n-grams set in front, and a penalty for each type that grows with all its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.config import SOS, Training


#: Stands between the words of an n-gram while it is counted: a string is half the bytes of an array and hashes faster.
PARTED = "\u0000"


def windows(words: Column, size: int) -> Column:
    """The n-grams of ``size`` words of a sentence as strings with ``PARTED`` between the words, ``size - 1`` start tokens
    in front; none of an empty one.

    Size 1 gives the words. A sentence of m words has m windows. Each is put together from the sentence moved on by 0, 1
    and more places, in time linear in m, so that a sentence can be a whole message.
    """
    moved = lambda k: F.slice(F.concat(F.array_repeat(F.lit(SOS), k), words), F.lit(1), F.size(words)) if k else words
    grams = moved(size - 1)
    for k in range(size - 2, -1, -1):
        grams = F.zip_with(grams, moved(k), lambda held, x: F.concat(held, F.lit(PARTED), x))
    return grams


def _grams(sentences: DataFrame, words: str, most: int) -> DataFrame:
    """``gram``: one row an occurrence, in one pass."""
    usable = lambda x: x.isNotNull() & (x != "") & ~x.contains(PARTED)
    clean = F.filter(F.coalesce(F.col(words), F.array().cast("array<string>")), usable)
    every = F.concat(*(windows(F.col("kl_clean"), n) for n in range(1, most + 1)))
    return sentences.select(clean.alias("kl_clean")).filter(F.size("kl_clean") > 0).select(F.explode(every).alias("gram"))


def occurrences(sentences: DataFrame, words: str, most: int = 3) -> DataFrame:
    """``tokens`` of each word and n-gram up to ``most`` words, one row an occurrence. Null sentences give none; null and
    empty words, and words that hold the character NUL, are passed over."""
    return _grams(sentences, words, most).select(F.split("gram", PARTED).alias("tokens"))


def count_ngrams(sentences: DataFrame, words: str, most: int = 3) -> DataFrame:
    """``tokens, entry_type, n``; partial counts are made before the shuffle."""
    counted = _grams(sentences, words, most).groupBy("gram").agg(F.count("*").alias("n"))
    return counted.select(F.split("gram", PARTED).alias("tokens"), "n").withColumn("entry_type", F.size("tokens"))


def train(counts: DataFrame, training: Training = Training(), dict_id: int = 0) -> DataFrame:
    """Entries of a fresh dictionary: each use adds the bonus and what uses of others will take off again."""
    score = (F.col("n") * (training.bonus + training.reduction)).cast("bigint")
    return counts.select(
        F.lit(dict_id).alias("dict_id"), "entry_type", "tokens", F.element_at("tokens", -1).alias("text"), score.alias("score"),
        F.lit(False).alias("is_possibly_offensive"), F.lit(False).alias("is_hidden"), F.lit(None).cast("string").alias("shortcut_phrase"),
    )


def penalties(counts: DataFrame, training: Training = Training(), dict_id: int = 0) -> DataFrame:
    """``dict_id, entry_type, penalty``: the reduction times all events of a type."""
    return counts.groupBy("entry_type").agg((F.sum("n") * training.reduction).alias("penalty")).select(F.lit(dict_id).alias("dict_id"), "entry_type", "penalty")


def merge(*snapshots: DataFrame) -> DataFrame:
    """One snapshot of several: scores are added, flags are or-ed; the newest phrase of a shortcut holds."""
    marked = snapshots[0].withColumn("kl_age", F.lit(0))
    for k, s in enumerate(snapshots[1:], 1):
        marked = marked.unionByName(s.withColumn("kl_age", F.lit(k)))
    return marked.groupBy("dict_id", "entry_type", "tokens").agg(
        F.max("text").alias("text"), F.sum("score").alias("score"), F.max("is_possibly_offensive").alias("is_possibly_offensive"),
        F.max("is_hidden").alias("is_hidden"), F.max_by("shortcut_phrase", "kl_age").alias("shortcut_phrase"),
    )


def merge_penalties(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("dict_id", "entry_type").agg(F.sum("penalty").alias("penalty"))


def penalised(entries: DataFrame, penalty: DataFrame, charge_new: bool = True) -> DataFrame:
    """Scores as they are saved: less by the penalty of their type, possibly below 0.

    Every entry is charged for all events, also those before its first use, unless ``charge_new`` is off: then an entry
    is charged for no more than keeps it at 0.
    """
    own = entries.join(F.broadcast(penalty), ["dict_id", "entry_type"], "left")  # a row a dictionary and type
    left = F.col("score") - F.coalesce("penalty", F.lit(0))
    return own.withColumn("score", left if charge_new else F.greatest(left, F.lit(0).cast("bigint"))).select(*entries.columns)


def reloaded(entries: DataFrame) -> DataFrame:
    """Scores as they are after a save and a load: none is below 0."""
    return entries.withColumn("score", F.greatest("score", F.lit(0).cast("bigint")))
