"""Suggestions and spell checks for many requests at once: requests in, ranked suggestions out.

``requests``: ``query_id, raw_word, prev_words, flags``. A null word is an empty one, null previous words are none, null
flags are ``Flags()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.config import SHORTCUT, SPELL, SUGGEST, WORD, Flags, Session
from keyloom.functions.text import IN_DICTIONARY, TYPO, case_mapped, flag, graphemes, is_special, padded_context
from keyloom.operators import store
from keyloom.operators.fuzzy import confidence, fuzzy_matches, similarity
from keyloom.session import settled


def _prepared(requests: DataFrame) -> DataFrame:
    flags = F.coalesce("flags", F.lit(Flags().pack()))
    return requests.select(
        "query_id",
        F.coalesce("raw_word", F.lit("")).alias("raw_word"),
        F.coalesce("prev_words", F.array().cast("array<string>")).alias("prev_words"),
        flags.alias("flags"),
        F.greatest(flag(flags, 8, 4), F.lit(1)).alias("levels"),
        (flag(flags, 16, 1) == 1).alias("allow_offensive"),
        (flag(flags, 17, 1) == 1).alias("show_hidden"),
    )


def _scored(matches: DataFrame, mode: str, filtered: bool) -> DataFrame:
    kept = matches.filter("frequency > 0")
    if mode == SPELL:
        kept = kept.filter(F.col("text") != F.col("raw_word"))
    if filtered:
        kept = kept.filter("(allow_offensive OR NOT is_possibly_offensive) AND (show_hidden OR NOT is_hidden)")
    alike = similarity(F.col("cost"), F.col("via_prefix"), F.col("raw_word"), F.col("text"))
    return kept.select("query_id", "text", confidence(alike, F.col("frequency")).alias("confidence"))


def _folded(tokens):
    return F.transform(tokens, lambda x: F.lower(F.upper(x)))


def _continuations(asked: DataFrame, entries: DataFrame, level: int, searched: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Requests with the key of their context, and the words that the user's n-grams of ``level`` go on with."""
    own = entries.filter(F.col("dict_id") == searched[0])
    grams = store.merged(entries, level, searched).filter(F.size("tokens") == level)
    head = F.slice("tokens", 1, level - 1)
    valued = own.filter(F.size("tokens") == level - 1).filter(F.col("entry_type") == level - 1 if level > 2 else F.col("entry_type").isin(WORD, SHORTCUT)).select(F.col("tokens").alias("head")).distinct()
    listed = grams.select(head.alias("head"), "text", "frequency", "is_possibly_offensive", "is_hidden").filter(~is_special(F.col("text"))).join(valued, "head", "left_semi")
    asked = asked.withColumn("context", padded_context(F.col("prev_words"), level - 1)).withColumn("fold", _folded(F.col("context")))
    contexts = asked.select("context", "fold").distinct()
    heads = listed.select("head", _folded(F.col("head")).alias("fold")).distinct()
    signs = lambda c: F.transform(c, lambda x: graphemes(x))
    exact = F.forall(
        F.zip_with(signs("context"), signs("head"), lambda a, b: (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (y == F.lower(x)) | (y == F.upper(x))), lambda z: z)), lambda z: z
    )
    linked = contexts.join(heads, "fold").filter(exact).select("context", "head")
    return asked.join(linked, "context").drop("context", "fold", "prev_words"), listed


def suggestions(
    requests: DataFrame, entries: DataFrame, session: Session = Session(), mode: str = SUGGEST, searched: tuple[int, ...] = (0, 1), filter_ngrams: bool = False, stored: bool = False
) -> DataFrame:
    """Ranked suggestions: ``query_id, rank, text, secondary_text, confidence`` and the two flags of a result.

    Words are searched in the two dictionaries, contexts in the user's; a text found in several ways keeps its greatest
    confidence. Ties are ranked by text. A count of 0 is no limit. n-grams pass the filter of offensive and hidden
    words unless ``filter_ngrams`` is set. ``stored`` entries are a table already and need not be written. The
    levels that are searched, and the most words that may be wanted below a typed prefix, are the requests' own greatest.
    A missing dictionary is an empty one; no requests or no entries give no rows.
    """
    asked = _prepared(requests)
    wanted = flag(F.col("flags"), 0, 8)
    told = asked.agg(F.max("levels").alias("levels"), F.max(wanted).alias("top"), F.min(wanted).alias("least"), F.max(F.col("raw_word") != "").alias("typed")).first()
    columns = ["query_id", "raw_word", "allow_offensive", "show_hidden"]
    entries = entries if stored else settled(entries)  # read several times below
    near = session.near_keys
    found = asked.sparkSession.createDataFrame([], "query_id STRING, text STRING, confidence DOUBLE").withColumn("query_id", F.col("query_id").cast(asked.schema["query_id"].dataType))
    if told.typed:
        singles = settled(store.merged(entries, WORD, searched).select("text", "frequency", "is_possibly_offensive", "is_hidden"))
        typed = asked.filter("raw_word <> ''").select(*columns)
        found = _scored(fuzzy_matches(typed, singles, session.lookup, near, mode, top=told.top if told.least else 0), mode, True)
        phrases = entries.filter((F.col("entry_type") == SHORTCUT) & F.col("dict_id").isin(*searched)).select(F.col("text").alias("raw_word"), "shortcut_phrase")
        found = found.unionByName(typed.join(phrases, "raw_word").select("query_id", F.col("shortcut_phrase").alias("text"), F.lit(1.0).alias("confidence")))
    for level in range(2, (told.levels or 1) + 1):
        own, listed = _continuations(asked.filter(F.col("levels") >= level), entries, level, searched)
        own, listed = own.select(*columns, "head"), settled(listed)
        parts = [(own, listed)]
        if told.least and mode == SUGGEST:  # nothing typed: all words that may follow are alike but for their frequency
            kinds = ["is_possibly_offensive", "is_hidden"] if filter_ngrams else []
            order = Window.partitionBy("head", *kinds).orderBy(F.desc(confidence(F.lit(1.0), F.col("frequency"))), "text")
            best = listed.filter("frequency > 0").withColumn("kl_rank", F.row_number().over(order)).filter(F.col("kl_rank") <= told.top).drop("kl_rank")
            parts = [(own.filter("raw_word = ''"), best), *([(own.filter("raw_word <> ''"), listed)] if told.typed else [])]
        for asking, words in parts:
            found = found.unionByName(_scored(fuzzy_matches(asking, words, session.lookup, near, mode, ("head",)), mode, filter_ngrams))
    # One exchange by request serves both the greatest confidence of a text and the ranks.
    best = found.repartition("query_id").groupBy("query_id", "text").agg(F.max("confidence").alias("confidence"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "text")))
    shown = ranked.join(asked.select("query_id", "flags"), "query_id").filter((flag(F.col("flags"), 0, 8) == 0) | (F.col("rank") <= flag(F.col("flags"), 0, 8)))
    text = case_mapped(F.col("text"), flag(F.col("flags"), 12, 2), flag(F.col("flags"), 14, 2))
    return shown.select(
        "query_id", "rank", text.alias("text"), F.lit("").alias("secondary_text"), "confidence",
        F.lit(False).alias("is_eligible_for_auto_commit"), F.lit(True).alias("is_eligible_for_user_removal"),
    )


def known_words(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests whose word is in any dictionary, as it is written: as a word, a shortcut, or the begin of an n-gram."""
    there = store.presence(entries).filter(F.size("tokens") == 1).select(F.element_at("tokens", 1).alias("raw_word")).distinct()
    return requests.join(there, "raw_word", "left_semi").select(*requests.columns)


def spell(requests: DataFrame, entries: DataFrame, session: Session = Session(), searched: tuple[int, ...] = (0, 1), stored: bool = False) -> DataFrame:
    """``query_id, result, suggestions``: bits of the result, and for words in no dictionary the ranked suggestions."""
    asked = requests.withColumn("raw_word", F.coalesce("raw_word", F.lit("")))
    entries = entries if stored else settled(entries)
    there = store.presence(entries).filter(F.size("tokens") == 1).select(F.element_at("tokens", 1).alias("raw_word")).distinct().withColumn("known", F.lit(True))
    judged = asked.join(there, "raw_word", "left")
    typos = judged.filter("known IS NULL AND raw_word <> ''").select(*requests.columns)
    ranked = suggestions(typos, entries, session, SPELL, searched, stored=True)
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("s"))
    bits = F.when(F.col("raw_word") == "", 0).when(F.col("known"), IN_DICTIONARY).otherwise(TYPO)
    return judged.join(lists, "query_id", "left").select("query_id", bits.alias("result"), F.coalesce(F.col("s.text"), F.array().cast("array<string>")).alias("suggestions"))
