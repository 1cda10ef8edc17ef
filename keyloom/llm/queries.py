"""Queries of the problems 2 to 8 and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm.heavy import heavy_items
from keyloom.llm.leak import leaked_items
from keyloom.llm.lookalike import disguised_words
from keyloom.llm.mojibake import damaged_words
from keyloom.llm.sentences import sentences
from keyloom.llm.terms import term_frequencies, term_verdicts
from keyloom.llm.tokens import decode_corpus, encode_corpus
from keyloom.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = term_verdicts(table(spark, d, "wordlist"), "word", "row_id", "word_count")
    return rows.filter("verdict IS NOT NULL").selectExpr("term AS word", "verdict")


def p2_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(table(spark, d, "wordlist"), "word", "row_id", "word_count").withColumnRenamed("term", "word")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "wordlist").select("row_id", "word")
    return disguised_words(rows, "word", table(spark, d, "lexicon"), "word").selectExpr("row_id", "kl_form AS word").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_items(table(spark, d, "wordlist"), "word", "row_id", "word_count").selectExpr("item AS word")


def p4_weights(spark: SparkSession, d: str) -> DataFrame:
    return heavy_items(table(spark, d, "wordlist"), "word", "row_id", "word_count").selectExpr("item AS word", "weight AS occurrences")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "wordlist").select("row_id", "word")
    return damaged_words(rows, "word", table(spark, d, "lexicon"), "word").selectExpr("row_id", "kl_form AS word").distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return decode_corpus(encode_corpus(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", slack=3)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"), "doc_id", "text", "lang")


QUERIES = {"p2_found": p2_found, "p2_frequencies": p2_frequencies, "p3_found": p3_found, "p4_found": p4_found, "p4_weights": p4_weights, "p5_found": p5_found, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_found": p7_found, "p7_near": p7_near, "p8_found": p8_found}

_ONCE = "with u as (select distinct row_id, word, coalesce(word_count, 0) word_count from wordlist)"
SQL = {
    "p2_found": _ONCE
    + """, t as (select word, sum(word_count) o, count(distinct row_id) r from u where word is not null group by word), n as (select count(distinct row_id) n from u)
select word, case when r > 0.004 * n then 'common' else 'rare' end as verdict from t, n where r > 0.004 * n or (r < 3 and o < 20)""",
    "p2_frequencies": _ONCE + " select word, sum(word_count)::bigint as occurrences, count(distinct row_id) as records from u group by word",
    "p4_found": _ONCE + " select word from u where word is not null group by word having sum(word_count) * 1000 >= (select sum(word_count) from u)",
    "p4_weights": _ONCE
    + " select word, sum(word_count)::bigint as occurrences from u where word is not null group by word having sum(word_count) * 1000 >= (select sum(word_count) from u)",
    "p6_roundtrip": "select doc_id, coalesce(text, '') as text from documents",
}
