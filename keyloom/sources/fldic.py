"""Dictionary text files: a header, then sections of words, n-grams and shortcuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.config import SHORTCUT, WORD
from keyloom.functions.text import id_to_special, special_to_id
from keyloom.session import settled

# How the address of the format's schema ends, and the encoding that its header names.
SCHEMA_END, ENCODING = "/nlp/v0~draft1/fldic.txt", "utf-8"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of dictionary files. ``line_no`` puts the lines of a file in their order: the place of the
    split that a line was read in, and its order there, so that a file of any size is many tasks' work."""
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), place.alias("line_no"), F.col("value").alias("line"))


def check_header(lines: DataFrame, strict: bool = False) -> None:
    """Fails where a header names another schema or encoding; a missing one is accepted unless ``strict``. The header of
    a file is what stands before its first section."""
    first = lines.filter(F.col("line").startswith("[")).groupBy("path").agg(F.min("line_no").alias("first"))
    head = lines.filter(F.col("line").startswith("#~")).join(first, "path", "left").filter("first IS NULL OR line_no < first")
    parts = F.split(F.expr("substring(line, 3)"), ":", 2)
    key, value = F.trim(parts[0]), F.trim(parts[1])
    wants = (("schema", SCHEMA_END), ("encoding", ENCODING))
    right = lambda wanted: F.coalesce(F.endswith(value, F.lit(wanted)), F.lit(False))
    sums = [c for k, (name, wanted) in enumerate(wants) for c in (F.count_if(key == name).alias(f"there{k}"), F.max(F.when((key == name) & ~right(wanted), F.coalesce(value, F.lit("")))).alias(f"wrong{k}"))]
    told = head.agg(*sums).first()
    for k, (name, wanted) in enumerate(wants):
        if told[f"wrong{k}"] is not None or (strict and not told[f"there{k}"]):
            raise ValueError(f"dictionary {name} is {told[f'wrong{k}'] if told[f'there{k}'] else 'missing'}, not {wanted}")


def sections(lines: DataFrame) -> DataFrame:
    """Lines with their section; blank ones, comments and the section heads themselves are left out.

    The heads are a few rows a file; each line looks up the last one before it, so that no file has to lie in one task.
    """
    head = F.col("line").startswith("[")
    heads = lines.filter(head).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("name")))).alias("heads"))
    named = lines.filter(~head & ~F.col("line").startswith("#") & (F.trim("line") != "")).join(heads, "path", "left")
    name = F.try_element_at(F.filter("heads", lambda h: h["line_no"] < F.col("line_no")), F.lit(-1))["name"]
    known = F.when(F.col("wrong").isNotNull(), F.raise_error(F.concat(F.lit("unknown section "), F.col("wrong"))).cast("string")).otherwise(name)
    wrong = F.get(F.filter("heads", lambda h: ~h["name"].isin("[words]", "[ngrams]", "[shortcuts]")), F.lit(0))["name"]
    return named.withColumn("wrong", wrong).withColumn("section", known).drop("heads", "wrong")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``id``, 1 upwards in the given order, without one task for all: places within ranges, on top of the
    sizes of the ranges before."""
    placed = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("kl_part", F.spark_partition_id()))
    before = placed.groupBy("kl_part").count().withColumn("kl_before", F.sum("count").over(Window.orderBy("kl_part").rowsBetween(Window.unboundedPreceding, -1)))
    own = placed.withColumn("kl_own", F.row_number().over(Window.partitionBy("kl_part").orderBy(*order)))
    joined = own.join(F.broadcast(before), "kl_part")  # a row a range
    return joined.withColumn("id", F.coalesce("kl_before", F.lit(0)) + F.col("kl_own")).drop("kl_part", "kl_own", "kl_before", "count")


def parse(lines: DataFrame, dict_id: int | Column = 1) -> DataFrame:
    """Entries of numbered lines (``path, line_no, line``).

    A key given twice keeps its last score, and any flag it ever had. n-grams with an id that no word has, or that is no
    number, are dropped; see ``unresolved``. The lines are read several times, so they are written down once.
    """
    lines = settled(lines)
    number = F.lit(dict_id) if isinstance(dict_id, int) else dict_id
    rows = sections(lines).withColumn("f", F.split("line", "\t"))
    listed = rows.filter("section = '[words]'").select(
        "path", "line_no", F.col("f")[0].alias("text"), F.get("f", F.lit(1)).cast("bigint").alias("score"), F.coalesce(F.get("f", F.lit(2)), F.lit("")).alias("flags")
    )
    words = listed.groupBy("path", "text").agg(
        F.max_by("score", "line_no").alias("score"), F.max(F.contains("flags", F.lit("p"))).alias("is_possibly_offensive"), F.max(F.contains("flags", F.lit("h"))).alias("is_hidden")
    )
    grams = _resolved(rows, listed)
    whole = grams.filter("missing = 0").groupBy("path", "tokens").agg(F.max_by("score", "line_no").alias("score"))
    short = rows.filter("section = '[shortcuts]'").groupBy("path", F.col("f")[0].alias("text")).agg(F.max_by(F.get("f", F.lit(1)), "line_no").alias("shortcut_phrase"))
    no, none = F.lit(False), F.lit(None).cast("string")
    columns = lambda kind, tokens, text, score, bad, hidden, phrase: [
        number.cast("int").alias("dict_id"), kind.cast("int").alias("entry_type"), tokens.alias("tokens"), text.alias("text"), score.cast("bigint").alias("score"),
        bad.alias("is_possibly_offensive"), hidden.alias("is_hidden"), phrase.alias("shortcut_phrase"),
    ]
    return (
        words.select(*columns(F.lit(WORD), F.array("text"), F.col("text"), F.col("score"), F.col("is_possibly_offensive"), F.col("is_hidden"), none))
        .unionByName(whole.select(*columns(F.size("tokens"), F.col("tokens"), F.element_at("tokens", -1), F.col("score"), no, no, none)))
        .unionByName(short.select(*columns(F.lit(SHORTCUT), F.array("text"), F.col("text"), F.lit(1), no, no, F.col("shortcut_phrase"))))
    )


def _looked_up(rows: DataFrame, parts: str, keys: DataFrame, on: list[str], key: str, value: str, most: int) -> DataFrame:
    """``rows`` with ``value`` of each element of the array ``parts`` as the array ``kl_values``, nulls where there is none.

    One left join a place of the longest array: the rows are never taken apart, and stay as they are where ``keys`` (one
    row a ``key``) is small enough for the planner to send it to all.
    """
    for k in range(most):
        own = keys.select(*on, F.col(key).alias(f"kl_key{k}"), F.col(value).alias(f"kl_value{k}"))
        rows = rows.withColumn(f"kl_key{k}", F.get(parts, F.lit(k))).join(own, [*on, f"kl_key{k}"], "left").drop(f"kl_key{k}")
    found = F.array(*(F.col(f"kl_value{k}") for k in range(most))) if most else F.array()
    return rows.withColumn("kl_values", F.slice(found, F.lit(1), F.size(parts))).drop(*(f"kl_value{k}" for k in range(most)))


def _resolved(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """n-gram lines with their words: ids are the words' places in their section."""
    placed = numbered(listed.select("path", "line_no", "text"), "path", "line_no")
    first = placed.groupBy("path").agg(F.min("id").alias("first"))
    ids = placed.join(F.broadcast(first), "path").select("path", (F.col("id") - F.col("first") + 1).alias("id"), "text")  # a row a file
    grams = rows.filter("section = '[ngrams]'").select("path", "line_no", F.get("f", F.lit(1)).cast("bigint").alias("score"), F.transform(F.split(F.col("f")[0], ","), lambda x: F.trim(x).try_cast("bigint")).alias("ids"))
    most = grams.agg(F.max(F.size("ids"))).first()[0] or 0
    found = _looked_up(grams, "ids", ids, ["path"], "id", "text", most)
    tokens = F.zip_with("ids", "kl_values", lambda k, w: F.coalesce(id_to_special(k), w))
    return found.withColumn("tokens", tokens).withColumn("missing", F.size(F.filter("tokens", lambda x: x.isNull()))).drop("ids", "kl_values")


def unresolved(lines: DataFrame) -> int:
    """Number of n-gram lines with an id that no word has."""
    rows = sections(settled(lines)).withColumn("f", F.split("line", "\t"))
    listed = rows.filter("section = '[words]'").select("path", "line_no", F.col("f")[0].alias("text"))
    return _resolved(rows, listed).filter("missing > 0").count()


def read(spark: SparkSession, path: str, dict_id: int = 1, strict: bool = False) -> DataFrame:
    lines = lines_of(spark, path)
    check_header(lines, strict)
    return parse(lines, dict_id)


def to_lines(entries: DataFrame) -> DataFrame:
    """``section, id, line`` of entries: words by text with their ids, n-grams with all members known, shortcuts.

    A word that begins with ``#`` or ``[`` or holds a tab or a line end can't be written in this format and is an error.
    """
    entries = settled(entries)  # read three times below
    bad = F.col("text").rlike(r"^[#\[]|[\t\r\n]") | (F.trim("text") == "")
    listed = numbered(entries.filter(F.col("entry_type") == WORD).select("text", "score", "is_possibly_offensive", "is_hidden"), "text")
    flags = F.concat(F.when(F.col("is_possibly_offensive"), "p").otherwise(""), F.when(F.col("is_hidden"), "h").otherwise(""))
    word = F.concat_ws("\t", "text", F.col("score").cast("string"), F.when(flags != "", flags))
    words = listed.select(F.lit("[words]").alias("section"), "id", F.when(bad, F.raise_error(F.concat(F.lit("can't be written: "), F.col("text"))).cast("string")).otherwise(word).alias("line"))
    grams = entries.filter(F.col("entry_type") >= 2)
    most = grams.agg(F.max(F.size("tokens"))).first()[0] or 0
    found = _looked_up(grams.select("tokens", "score"), "tokens", listed, [], "text", "id", most)
    lists = found.withColumn("m", F.zip_with("tokens", "kl_values", lambda w, k: F.coalesce(special_to_id(w).cast("bigint"), k)))
    kept = lists.filter(F.forall("m", lambda x: x.isNotNull()) & F.exists("m", lambda x: x >= 0))
    gram = F.concat_ws("\t", F.array_join(F.transform("m", lambda x: x.cast("string")), ","), F.col("score").cast("string"))
    short = entries.filter(F.col("entry_type") == SHORTCUT)
    return words.unionByName(kept.select(F.lit("[ngrams]").alias("section"), F.lit(None).cast("bigint").alias("id"), gram.alias("line"))).unionByName(
        short.select(F.lit("[shortcuts]").alias("section"), F.lit(None).cast("bigint").alias("id"), F.concat_ws("\t", "text", "shortcut_phrase").alias("line"))
    )


def write(entries: DataFrame, path: str, schema: str) -> None:
    """One dictionary file, with the address of its schema. The format is a single file, so its lines pass one task, sorted by Spark, never the driver."""
    rank = F.when(F.col("section") == "[words]", 1).when(F.col("section") == "[ngrams]", 2).otherwise(3)
    body = to_lines(entries).select(rank.alias("a"), F.coalesce("id", F.lit(0)).alias("b"), "line")
    spark = entries.sparkSession
    head = [(0, 0, f"#~schema: {schema}"), (0, 1, f"#~encoding: {ENCODING}"), (1, -1, "[words]"), (2, -1, "[ngrams]"), (3, -1, "[shortcuts]")]
    whole = body.unionByName(spark.createDataFrame(head, "a INT, b BIGINT, line STRING"))
    whole.repartition(1).sortWithinPartitions("a", "b", "line").select("line").write.mode("overwrite").text(path)


def as_file(lines: DataFrame, path: str = "memory") -> DataFrame:
    """Lines as ``path, line_no, line`` of one file, heads included, as ``parse`` takes them."""
    place = F.when(F.col("section") == "[words]", F.col("id")).when(F.col("section") == "[ngrams]", F.monotonically_increasing_id() + (1 << 60)).otherwise(F.monotonically_increasing_id() + (3 << 59))
    heads = lines.sparkSession.createDataFrame([(0, "[words]"), ((1 << 60) - 1, "[ngrams]"), ((3 << 59) - 1, "[shortcuts]")], "line_no BIGINT, line STRING")
    return lines.select(place.alias("line_no"), "line").unionByName(heads).select(F.lit(path).alias("path"), "line_no", "line")
