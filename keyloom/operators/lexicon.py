"""Lexicon records to a dictionary: senses counted by rules, forms followed to their words, words classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.config import LexiconConfig, LexiconFilter, Rules

SENSE = "tags ARRAY<STRING>, categories ARRAY<STRUCT<name: STRING>>, form_of ARRAY<STRUCT<word: STRING>>, alt_of ARRAY<STRUCT<word: STRING>>"
RECORD = f"word STRING, pos STRING, senses ARRAY<STRUCT<{SENSE}>>"
#: Steps along form-of links, each counting one more than the one before.
HOPS = 2


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; a broken line fails, one without word, part of speech or senses is left out."""
    return complete(spark.read.schema(RECORD).option("mode", "FAILFAST").json(path))


def complete(records: DataFrame) -> DataFrame:
    return records.filter("word IS NOT NULL AND pos IS NOT NULL AND senses IS NOT NULL")


def _texts(parts: Column) -> Column:
    return F.coalesce(parts, F.array().cast("array<string>"))


def matches(rules: Rules, word: Column, tags: Column, categories: Column) -> Column:
    """Whether a pattern fits the whole word, or a tag or a category is listed."""
    out = F.lit(False)
    for p in rules.words:
        out = out | word.rlike(rf"\A(?:{p})\z")
    if rules.tags:
        out = out | F.arrays_overlap(tags, F.array(*map(F.lit, rules.tags)))
    if rules.categories:
        out = out | F.arrays_overlap(categories, F.array(*map(F.lit, rules.categories)))
    return F.coalesce(out, F.lit(False))


def senses(records: DataFrame, rules: LexiconFilter = LexiconFilter()) -> DataFrame:
    """``word, pos, verdict, form_of`` of each sense; a record without senses gives one row with a null verdict.

    ``excluded`` goes before ``offensive``, that before ``normal``. Null tags and categories are none. The form is the
    first of ``form_of``, or of ``alt_of`` where that is missing.
    """
    each = complete(records).select("word", "pos", F.explode_outer("senses").alias("s"))
    tags, categories = _texts(F.col("s.tags")), _texts(F.col("s.categories.name"))
    verdict = F.when(F.col("s").isNull(), None).when(matches(rules.excluded, F.col("word"), tags, categories), "excluded").when(
        matches(rules.offensive, F.col("word"), tags, categories), "offensive"
    ).otherwise("normal")
    form = F.when(F.col("s.form_of").isNotNull(), F.get("s.form_of", F.lit(0))["word"]).otherwise(F.get("s.alt_of", F.lit(0))["word"])
    return each.select("word", "pos", verdict.alias("verdict"), form.alias("form_of"))


def sense_counts(judged: DataFrame) -> DataFrame:
    """``word, pos, excluded, offensive, normal`` of senses."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return judged.groupBy("word", "pos").agg(n("excluded"), n("offensive"), n("normal"))


def form_weights(judged: DataFrame, hops: int = HOPS) -> DataFrame:
    """``word, pos, own, depth`` of every walk along form-of links within a part of speech, at most ``hops`` long.

    Walks are counted, not nodes: a link given twice counts twice, and cycles end with the hops. ``own`` is where the
    walk began.
    """
    links = judged.filter("form_of IS NOT NULL").select(F.col("word").alias("from"), "pos", "form_of")
    walks = judged.select(F.col("word").alias("own"), "word", "pos").distinct().withColumn("depth", F.lit(0))
    out, last = walks, walks
    for depth in range(1, hops + 1):
        step = last.select("own", F.col("word").alias("from"), "pos")
        last = step.join(links, ["from", "pos"]).select("own", F.col("form_of").alias("word"), "pos", F.lit(depth).alias("depth"))
        out = out.unionByName(last)
    return out


def word_totals(judged: DataFrame, hops: int = HOPS) -> DataFrame:
    """``word`` with its own sense counts over all parts of speech (depth 0), and those of its forms besides, each
    counting one more a hop (``deep_`` columns)."""
    counts = sense_counts(judged)
    reached = form_weights(judged, hops).groupBy("own", "word", "pos", "depth").agg(F.count("*").alias("times"))
    own = reached.join(counts, ["word", "pos"])
    weight = (F.col("depth") + 1) * F.col("times")
    sums = [F.sum(F.when(F.col("depth") == 0, F.col(c))).alias(c) for c in ("excluded", "offensive", "normal")]
    deep = [F.sum(F.col(c) * weight).alias(f"deep_{c}") for c in ("excluded", "offensive", "normal")]
    return own.groupBy(F.col("own").alias("word")).agg(*sums, *deep)


def is_valid(word: Column) -> Column:
    """Whether all of a word is letters, apostrophes and hyphens."""
    return word.rlike(r"^[\p{L}'-]*\z")


def is_excluded(excluded: Column, offensive: Column, normal: Column) -> Column:
    """At least as many excluded senses as of either other kind; without any sense too."""
    return (excluded >= offensive) & (excluded >= normal)


def classify(totals: DataFrame) -> DataFrame:
    """``word, class``: excluded, invalid, offensive or normal, by a word's own counts and those with its forms."""
    out = is_excluded(F.col("excluded"), F.col("offensive"), F.col("normal")) | is_excluded(F.col("deep_excluded"), F.col("deep_offensive"), F.col("deep_normal"))
    kind = F.when(out, "excluded").when(~is_valid(F.col("word")), "invalid").when(F.col("deep_offensive") >= F.col("deep_normal"), "offensive").otherwise("normal")
    return totals.select("word", kind.alias("class"))


def build_dictionary(records: DataFrame, config: LexiconConfig = LexiconConfig(), name: str = "root", dict_id: int = 1) -> DataFrame:
    """Entries of score 1 of all words that are kept, and of the project's own words."""
    from keyloom.operators.store import as_entries

    kept = classify(word_totals(senses(records, config.filter(name)))).filter("class IN ('normal', 'offensive')")
    rows = kept.select(F.col("word").alias("text"), F.lit(1).alias("score"), (F.col("class") == "offensive").alias("is_possibly_offensive"))
    if config.project_words:
        own = records.sparkSession.createDataFrame([(w, 1, False) for w in config.project_words], "text STRING, score INT, is_possibly_offensive BOOLEAN")
        rows = rows.unionByName(own).groupBy("text").agg(F.max("score").alias("score"), F.max("is_possibly_offensive").alias("is_possibly_offensive"))
    return as_entries(rows, dict_id)


def counters(records: DataFrame) -> DataFrame:
    """``kind, name, n``: words, senses, parts of speech, tags and categories of all records."""
    whole = complete(records)
    sense = whole.select(F.explode("senses").alias("s"))
    kinds = [
        whole.select(F.lit("records").alias("kind"), F.lit("").alias("name")),
        sense.select(F.lit("senses").alias("kind"), F.lit("").alias("name")),
        whole.select(F.lit("pos").alias("kind"), F.col("pos").alias("name")),
        sense.select(F.lit("tag").alias("kind"), F.explode("s.tags").alias("name")),
        sense.select(F.lit("category").alias("kind"), F.explode("s.categories.name").alias("name")),
    ]
    rows = kinds[0]
    for k in kinds[1:]:
        rows = rows.unionByName(k)
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"))


def stats(records: DataFrame, classes: DataFrame) -> DataFrame:
    """``kind, name, n``: the counters of all records, and the words of each class (kind ``class``). Nulls are counted
    under a null name."""
    return counters(records).unionByName(classes.groupBy(F.lit("class").alias("kind"), F.col("class").alias("name")).agg(F.count("*").alias("n")))


def write_stats(rows: DataFrame, path: str, seconds: float) -> None:
    """The statistics as JSON lines, one object a part of speech, tag and category (these grow with the lexicon, so they
    are written where they are), and one with the duration and the totals under the published names."""
    total = lambda kind, *names: F.coalesce(F.sum(F.when((F.col("kind") == kind) & F.col("name").isin(*names), F.col("n"))), F.lit(0))
    totals = rows.agg(
        F.lit(int(seconds)).alias("_parse_duration_in_seconds"), total("records", "").alias("_total_raw_words"), total("senses", "").alias("_total_raw_senses"), total("class", "excluded", "invalid").alias("_total_words_excluded"),
        total("class", "offensive").alias("_total_words_offensive"), total("class", "normal").alias("_total_words_normal"),
    )
    each = rows.filter("kind IN ('pos', 'tag', 'category')").select(F.to_json(F.struct(F.concat("kind", F.lit("_stats")).alias("stats"), F.coalesce("name", F.lit("")).alias("name"), "n")).alias("value"))
    each.unionByName(totals.select(F.to_json(F.struct(*totals.columns)).alias("value"))).write.mode("overwrite").text(path)
