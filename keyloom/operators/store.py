"""The dictionary store: entries, their prefixes (presence) and totals, as three tables.

``entries``: ``dict_id, entry_type, tokens, text, score, is_possibly_offensive, is_hidden, shortcut_phrase``; one row a
word (type 1), n-gram (type n) or shortcut (type -1), so that one key can be all three. ``presence``: each non-empty
prefix of an entry's tokens, by dictionary. ``stats``: total score and vocabulary by dictionary and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.config import SHORTCUT, WORD

ENTRIES = (
    "dict_id INT, entry_type INT, tokens ARRAY<STRING>, text STRING, score BIGINT, "
    "is_possibly_offensive BOOLEAN, is_hidden BOOLEAN, shortcut_phrase STRING"
)


def as_entries(df: DataFrame, dict_id: int | Column = 1, tokens: Column | None = None, score: str = "score", entry_type: Column | None = None) -> DataFrame:
    """Entries from rows with ``text`` (or ``tokens``) and a score; absent flags are false.

    Rows with a null or empty text have no entry; a null score is 0.
    """
    parts = tokens if tokens is not None else F.array("text")
    have = set(df.columns)
    column = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    out = df.select(
        (F.lit(dict_id) if isinstance(dict_id, int) else dict_id).cast("int").alias("dict_id"),
        (entry_type if entry_type is not None else F.size(parts)).cast("int").alias("entry_type"),
        parts.alias("tokens"),
        F.element_at(parts, -1).alias("text"),
        F.coalesce(F.col(score).cast("bigint"), F.lit(0)).alias("score"),
        column("is_possibly_offensive", False).alias("is_possibly_offensive"),
        column("is_hidden", False).alias("is_hidden"),
        (F.col("shortcut_phrase") if "shortcut_phrase" in have else F.lit(None).cast("string")).alias("shortcut_phrase"),
    )
    return out.filter("text IS NOT NULL AND text <> ''")


def union_dictionaries(*parts: DataFrame) -> DataFrame:
    """All dictionaries of a session in one table; which is which stays in ``dict_id``."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def words(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("entry_type") == WORD)


def shortcuts(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("entry_type") == SHORTCUT)


def ngrams(entries: DataFrame, least: int = 2, most: int = -1) -> DataFrame:
    """n-grams of ``least`` to ``most`` words; -1 is no bound, ``most`` 0 gives none."""
    if most == 0:
        return entries.limit(0)
    kept = entries.filter(F.col("entry_type") >= max(2, least))
    return kept if most < 0 else kept.filter(F.col("entry_type") <= most)


def without(entries: DataFrame, keys: DataFrame, entry_type: int) -> DataFrame:
    """Entries without the properties of one type for the given ``dict_id, tokens``."""
    gone = keys.select("dict_id", "tokens").withColumn("entry_type", F.lit(entry_type))
    return entries.join(gone, ["dict_id", "tokens", "entry_type"], "left_anti").select(*entries.columns)


def presence(entries: DataFrame) -> DataFrame:
    """``dict_id, tokens``: every non-empty prefix of every entry's tokens, once."""
    steps = F.when(F.size("tokens") > 0, F.sequence(F.lit(1), F.size("tokens")))
    return entries.select("dict_id", F.explode(F.transform(steps, lambda n: F.slice("tokens", 1, n))).alias("tokens")).distinct()


def stats(entries: DataFrame, penalty: DataFrame | None = None) -> DataFrame:
    """``dict_id, entry_type, total_score, vocab_size, penalty``. Entries of score 0 count in the vocabulary.

    With ``penalty`` (``dict_id, entry_type, penalty``) each score counts less by it, but no less than 0.
    """
    kind = F.col("entry_type")
    if penalty is None:
        return entries.groupBy("dict_id", kind).agg(F.sum(F.greatest("score", F.lit(0))).alias("total_score"), F.count("*").alias("vocab_size"), F.lit(0).cast("bigint").alias("penalty"))
    own = entries.join(F.broadcast(penalty), ["dict_id", "entry_type"], "left").withColumn("penalty", F.coalesce("penalty", F.lit(0)))  # a row a dictionary and type
    return own.groupBy("dict_id", "entry_type").agg(
        F.sum(F.greatest(F.col("score") - F.col("penalty"), F.lit(0))).alias("total_score"), F.count("*").alias("vocab_size"), F.max("penalty").alias("penalty")
    )


def laplace(score: Column, total: Column, vocabulary: Column, k: int = 1) -> Column:
    """Smoothed frequency; a missing type has total and vocabulary 0."""
    bottom = F.coalesce(total, F.lit(0)).cast("double") + k * F.coalesce(vocabulary, F.lit(0)).cast("double")
    return F.when(bottom > 0, (score.cast("double") + k) / bottom).otherwise(0.0)


def with_frequency(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """Entries with ``frequency``. The totals have one row a dictionary and type, so they are sent to all."""
    own = F.broadcast(totals.select("dict_id", "entry_type", "total_score", "vocab_size"))
    joined = entries.join(own, ["dict_id", "entry_type"], "left")
    return joined.withColumn("frequency", laplace(F.col("score"), F.col("total_score"), F.col("vocab_size"))).select(*entries.columns, "frequency")


def merged(entries: DataFrame, entry_type: Column | int, searched: tuple[int, ...] | None = (0, 1)) -> DataFrame:
    """Properties of each key over the searched dictionaries (None: all there are): ``tokens, entry_type, text, score, frequency`` and flags.

    Scores are added and flags are or-ed; the frequency is the sum over the number of dictionaries in which the key, or
    anything that begins with it, is present at all. One aggregation over entries and their prefixes, so that entries
    and presence need no join.
    """
    own = entries if searched is None else entries.filter(F.col("dict_id").isin(*searched))
    frequent = with_frequency(own, stats(own))
    here = frequent.filter(F.col("entry_type") == entry_type) if isinstance(entry_type, int) else frequent.filter(entry_type)
    keys = here.select("tokens", "entry_type", F.lit(None).cast("int").alias("present"), "score", "frequency", "is_possibly_offensive", "is_hidden", "text")
    if isinstance(entry_type, int):  # only beginnings of the one length are needed
        size = entry_type if entry_type > 0 else 1
        marks = own.filter(F.size("tokens") >= size).select("dict_id", F.slice("tokens", 1, size).alias("tokens")).distinct().withColumn("entry_type", F.lit(entry_type))
    else:
        marks = presence(own).withColumn("entry_type", F.size("tokens"))
    rows = keys.unionByName(
        marks.select("tokens", "entry_type", F.col("dict_id").alias("present"), F.lit(None).cast("bigint").alias("score"), F.lit(None).cast("double").alias("frequency"), F.lit(None).cast("boolean").alias("is_possibly_offensive"), F.lit(None).cast("boolean").alias("is_hidden"), F.lit(None).cast("string").alias("text"))
    )
    out = rows.groupBy("tokens", "entry_type").agg(
        F.max("text").alias("text"),
        F.sum("score").alias("score"),
        F.sum("frequency").alias("sum_frequency"),
        F.count("present").alias("dictionaries"),
        F.max("is_possibly_offensive").alias("is_possibly_offensive"),
        F.max("is_hidden").alias("is_hidden"),
    )
    return out.filter("text IS NOT NULL").select(
        "tokens", "entry_type", "text", "score", (F.col("sum_frequency") / F.greatest("dictionaries", F.lit(1))).alias("frequency"), "is_possibly_offensive", "is_hidden"
    )


def find(entries: DataFrame, keys: DataFrame, ignoring_case: bool = False) -> DataFrame:
    """Entries of the given ``tokens``, exactly or sign by sign in lower or upper case.

    Without case the join is on the lower-case form, with the exact comparison behind it, and on the upper-case form
    for keys whose length changes with their case.
    """
    if not ignoring_case:
        return entries.join(keys.select("tokens").distinct(), "tokens", "left_semi")
    from keyloom.functions.text import equal_ignoring_case, graphemes

    fold = lambda c: F.transform(c, lambda x: F.lower(F.upper(x)))  # noqa: E731  both cases of a sign fold alike
    wanted = keys.select(F.col("tokens").alias("wanted")).distinct().withColumn("fold", fold("wanted"))
    have = entries.withColumn("fold", fold("tokens"))
    signs = lambda c: F.transform(c, graphemes)
    alike = F.forall(F.zip_with(signs("wanted"), signs("tokens"), equal_ignoring_case), lambda x: x) & (F.size("wanted") == F.size("tokens"))
    return have.join(wanted, "fold").filter(alike).drop("fold")


def register(loaded: dict[str, DataFrame], path: str, entries: DataFrame) -> dict[str, DataFrame]:
    """Dictionaries by path, numbered in the order of loading; a path loaded before is passed over."""
    if path in loaded:
        return loaded
    return {**loaded, path: entries.withColumn("dict_id", F.lit(len(loaded)))}
