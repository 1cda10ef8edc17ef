"""Yearly unigram lines and single data points: valid rows are loaded, broken ones come out with the reason.

A line is ``token TAB year,match_count,volume_count [TAB ...]``. Fields may stand in double quotes. Everything runs in
JVM expressions in one narrow pass: a quote-aware split keeps the raw text, every data point is read permissively
under an explicit schema that retains the corrupt raw text, and corrupt ones are then sorted by what is wrong: number
of columns, quoting, or the casts and ranges of the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = (1470, 2019)
POINT_SCHEMA = "year INT, match_count BIGINT, volume_count BIGINT, raw STRING"
_READ = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "raw", "sep": ",", "quote": "\u0000", "escape": "\u0000"}
#: One field with the tab before it; possessive, so that very long fields need neither backtracking nor stack.
_FIELD = r'\t("[^"]*+(?:""[^"]*+)*+"|[^"\t]*+)(?=\t|\z)'
_POINT = r"\A[0-9]{4},[0-9]+,[0-9]+\z"


def _fields(line: Column) -> Column:
    """The raw fields of a line, quotes kept."""
    plain = F.split(line, "\t", -1)
    quoted = F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(_FIELD), F.lit(1))
    return F.when(F.instr(line, '"') == 0, plain).otherwise(quoted)


def _unquoted(field: Column) -> Column:
    inner = F.substring(field, F.lit(2), F.length(field) - 2)
    return F.when(field.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field)


def _points(texts: Column) -> Column:
    """Data points as structs of their three values and ``reason`` (null where valid), for an array of raw texts."""
    read = F.transform(texts, lambda x: F.struct(x.alias("text"), F.from_csv(x, POINT_SCHEMA, _READ).alias("row")))  # read once each
    return F.transform(read, _judged)


def _judged(point: Column) -> Column:
    text, row = point["text"], point["row"]
    year, match, volume = row["year"], row["match_count"], row["volume_count"]
    reason = (
        F.when(F.length(text) == 0, "empty point")
        .when(row["raw"].isNotNull() & (F.size(F.split(text, ",", -1)) != 3), "point without three numbers")
        .when(~text.rlike(_POINT), "point with an invalid number")
        .when(match.isNull() | volume.isNull(), "count beyond 64 bits")
        .when(~year.between(*YEARS), "year out of range")
        .when(match < 1, "match count below 1")
        .when((volume < 1) | (volume > match), "volume count out of range")
    )
    return F.struct(year.alias("year"), match.alias("match_count"), volume.alias("volume_count"), reason.alias("reason"))


def parse_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """``df`` with ``kl_token``, ``kl_points`` (array of year, match_count, volume_count, reason) and ``kl_reason``.

    ``kl_reason`` is null for a valid line; a null line gives ``null line``, an empty one ``empty token``. Columns of
    the input stay as they are, whatever their names.
    """
    raw = df[line]
    fields = df.withColumn("kl_fields", _fields(raw)).withColumn(
        "kl_whole", F.length(F.array_join("kl_fields", "\t")) == F.length(raw)
    )
    read = fields.withColumn("kl_token", _unquoted(F.get("kl_fields", F.lit(0)))).withColumn(
        "kl_points", _points(F.transform(F.slice("kl_fields", 2, F.greatest(F.size("kl_fields") - 1, F.lit(0))), _unquoted))
    )
    wrong = F.filter("kl_points", lambda x: x["reason"].isNotNull())
    reason = (
        F.when(raw.isNull(), "null line")
        .when(~F.col("kl_whole") | (F.size("kl_fields") < 1), "broken quoting")
        .when(F.length("kl_token") == 0, "empty token")
        .when(F.size("kl_points") < 1, "no data point")
        .when(F.size(wrong) > 0, F.get(wrong, F.lit(0))["reason"])
    )
    return read.withColumn("kl_reason", reason).drop("kl_fields", "kl_whole")


def parse_points(df: DataFrame, point: str = "data_point") -> DataFrame:
    """``df`` with ``kl_point`` (year, match_count, volume_count) and ``kl_reason``, null for a valid point."""
    raw = df[point]
    whole = raw.rlike(r'\A(?:"[^"]*+(?:""[^"]*+)*+"|[^"\t]*+)\z')
    read = df.withColumn("kl_point", F.get(_points(F.array(_unquoted(raw))), F.lit(0)))
    reason = (
        F.when(raw.isNull(), "null point")
        .when(~whole & raw.contains('"'), "broken quoting")
        .when(~whole, "more than one field")
        .otherwise(F.col("kl_point.reason"))
    )
    return read.withColumn("kl_reason", reason)


def load_unigrams(df: DataFrame, line: str = "line", key: str = "line_id") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of raw lines, a line delivered again counting once.

    valid: ``key, word, year, match_count, volume_count``, one row per data point. rejected: ``key, line, reason``.
    The lines are parsed where they lie, and repeats leave before a line is opened into its points: by key and two hashes
    of the line (128 bits), so that whole lines aren't compared. Neither result drops a record: each distinct (key, line)
    is in exactly one of them.
    """
    parsed = parse_lines(df.select(key, line), line).withColumns({"kl_a": F.xxhash64(line), "kl_b": F.xxhash64(F.lit(1), F.col(line))}).dropDuplicates([key, "kl_a", "kl_b"])
    good = parsed.filter(F.col("kl_reason").isNull()).select(key, F.col("kl_token").alias("word"), F.explode("kl_points").alias("p"))
    valid = good.select(key, "word", "p.year", "p.match_count", "p.volume_count")
    rejected = parsed.filter(F.col("kl_reason").isNotNull()).select(key, line, F.col("kl_reason").alias("reason"))
    return valid, rejected


def rejected_records(lines: DataFrame, points: DataFrame) -> DataFrame:
    """``src_table, record_id, reason`` of every line and data point that breaks the format, each record once.

    The repeats leave only after the parse: broken records are few, so the tables themselves are never shuffled. A null
    id is kept as one record of its own.
    """
    a = parse_lines(lines.select("line_id", "line")).filter("kl_reason IS NOT NULL")
    b = parse_points(points.select("point_id", "data_point")).filter("kl_reason IS NOT NULL")
    rows = a.select(F.lit("unigram_lines").alias("src_table"), F.col("line_id").alias("record_id"), F.col("kl_reason").alias("reason")).unionByName(
        b.select(F.lit("data_points").alias("src_table"), F.col("point_id").alias("record_id"), F.col("kl_reason").alias("reason"))
    )
    return rows.groupBy("src_table", "record_id").agg(F.min("reason").alias("reason"))


def read_unigram_files(spark: SparkSession, folder: str) -> DataFrame:
    """Raw lines of the files ``1-*.gz`` of a folder: ``partition_file, line`` (one task a file, as gzip can't be split)."""
    files = spark.read.option("pathGlobFilter", "1-*.gz").text(folder)
    return files.select(F.col("_metadata.file_name").alias("partition_file"), F.col("value").alias("line"))


def write_unigram_files(lines: DataFrame, folder: str) -> None:
    """``partition_file, line`` as gzip files ``1-*.gz`` named by their partition, each by one task, as gzip can't be
    split. Null lines and lines that hold a line end can't be written and are an error."""
    bad = F.col("line").isNull() | F.col("line").rlike(r"[\r\n]")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("can't be written: "), F.coalesce("line", F.lit("null")))).cast("string")).otherwise(F.col("line"))
    lines.select("partition_file", checked.alias("line")).repartition("partition_file").write.mode("overwrite").partitionBy("partition_file").option("compression", "gzip").text(folder)
    jvm = lines.sparkSession._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(lines.sparkSession._jsc.hadoopConfiguration())
    for held in files.listStatus(root):  # a folder a partition
        if held.isDirectory():
            name = held.getPath().getName().partition("=")[2]
            for part in files.globStatus(jvm.org.apache.hadoop.fs.Path(held.getPath(), "part-*")):
                files.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(root, name))
            files.delete(held.getPath(), True)
