"""Queries of the dictionary operators over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.config import SHORTCUT, SOS, SPELL, SUGGEST, Flags, LexiconConfig, Session
from keyloom.functions import text as fn
from keyloom.operators import fuzzy, lexicon, ngrams, predict, store, syllables, wordlist
from keyloom.session import place_for, settled, table
from keyloom.sources import fldic, rawtext, unigrams

JOINED = " "
# The published division rules of British English, as in their rule file.
SYLLABLE_RULES = {
    "characterSets": [
        {"shorthand": "L", "values": ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l", "m", "n", "o", "p", "q", "r", "s", "t", "u", "v", "w", "x", "y", "z"]},
        {"shorthand": "V", "values": ["a", "e", "i", "o", "u"]},
        {"shorthand": "C", "values": ["b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "q", "r", "s", "t", "v", "w", "x", "y", "z"]},
    ],
    "divisionRules": [
        {"tokens": ["<C>e<EOW>"]},
        {"tokens": ["ai", "ay", "ea", "ee", "ei", "ey", "ie", "oa", "oe", "oi", "oo", "ou", "oy", "ui"]},
        {"tokens": ["<C>-<\\1>"]},
        {"tokens": ["re-", "un-", "pre-"]},
        {"tokens": ["-ent", "-ing", "-less", "-ly", "-ment", "-ness"]},
        {"tokens": ["ch", "sh", "ph", "th", "wh", "gh"]},
        {"tokens": ["ck-le", "-ble", "-cle", "-dle", "-fle", "-gle", "-hle", "-jle", "-kle", "-lle", "-mle", "-nle", "-ple", "-qle", "-rle", "-sle", "-tle", "-vle", "-wle", "-xle", "-yle", "-zle"]},
    ],
}
SCHEMA_ADDRESS = f"https://schemas.example{fldic.SCHEMA_END}"


def _keyboard(*rows: str) -> dict[str, tuple[str, ...]]:
    """Neighbours of each key on a keyboard of staggered rows: beside it, and the two above and below."""
    out = {}
    for k, row in enumerate(rows):
        for i, key in enumerate(row):
            near = [row[i - 1 : i], row[i + 1 : i + 2], *(rows[k - 1][i : i + 2] if k else ()), *(rows[k + 1][max(0, i - 1) : i + 1] if k + 1 < len(rows) else ())]
            out[key] = tuple(x for x in near if x)
    return out


NEAR = _keyboard("qwertyuiop", "asdfghjkl", "zxcvbnm")


# --- corpora to dictionaries ---------------------------------------------------------------------------------------


def _corpus_words(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", F.explode(fn.segment_words(F.col("text"))).alias("word"))
    return docs.groupBy("lang", "word").agg(F.count("*").alias("n"))


def word_counts_by_lang(spark, d):
    return _corpus_words(spark, d)


def vocab_stats(spark, d):
    return _corpus_words(spark, d).groupBy("lang").agg(F.sum("n").alias("total_score"), F.count("*").alias("vocab_size"))


def laplace_frequency(spark, d):
    counts = _corpus_words(spark, d)
    totals = counts.groupBy(F.col("lang").alias("own")).agg(F.sum("n").alias("total"), F.count("*").alias("vocabulary"))
    own = counts.join(F.broadcast(totals), F.col("lang").eqNullSafe(F.col("own"))).withColumn("frequency", store.laplace(F.col("n"), F.col("total"), F.col("vocabulary")))  # a row a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return own.withColumn("rank", rank).filter("rank <= 100").select("lang", "word", "rank", F.round("frequency", 9).alias("frequency"))


def multi_dict_merge(spark, d):
    """Every distinct ``lang`` as stored is a dictionary, null one of its own; all are searched."""
    counts = _corpus_words(spark, d).withColumnsRenamed({"word": "text", "n": "score"})
    langs = counts.select("lang").distinct().select(F.col("lang").alias("own"), F.row_number().over(Window.orderBy("lang")).alias("dict_id"))  # a row a language
    out = store.merged(store.as_entries(counts.join(langs, F.col("lang").eqNullSafe(F.col("own"))), F.col("dict_id")), 1, None)
    return out.select("text", "score", F.round("frequency", 9).alias("frequency"))


def _sentences(spark, d, name="documents"):
    """The words of each text, whole texts and all rows."""
    key = "doc_id" if name == "documents" else "item_id"
    return table(spark, d, name).select(F.col(key).alias("key"), fn.segment_words(F.col("text")).alias("words"))


def _counts(spark, d):
    return ngrams.count_ngrams(_sentences(spark, d), "words")


def _named(entries: DataFrame) -> DataFrame:
    return entries.select(F.array_join("tokens", JOINED).alias("ngram"), "entry_type", "score")


def ngram_train(spark, d):
    return _named(ngrams.train(_counts(spark, d)))


def penalised_scores(spark, d):
    counts = settled(_counts(spark, d))
    return _named(ngrams.penalised(ngrams.train(counts), ngrams.penalties(counts)))


def reload_clamp(spark, d):
    counts = settled(_counts(spark, d))
    out = ngrams.reloaded(ngrams.penalised(ngrams.train(counts), ngrams.penalties(counts)))
    return store.stats(out).select("entry_type", "total_score", "vocab_size")


def incremental_merge(spark, d):
    """The texts with even ids and those with odd ids, trained apart and merged: all are in one of the two."""
    rows = _sentences(spark, d)
    parts = [ngrams.train(ngrams.count_ngrams(rows.filter(F.pmod("key", F.lit(2)) == k), "words")) for k in (0, 1)]
    return _named(ngrams.merge(*parts))


def ngram_presence(spark, d):
    return store.presence(ngrams.train(_counts(spark, d))).select(F.array_join("tokens", JOINED).alias("prefix"))


def ngram_find(spark, d):
    """The corpus' entries of all words and pairs of the evaluation passages, exactly as they are written."""
    keys = ngrams.count_ngrams(_sentences(spark, d, "eval_items"), "words", 2).select("tokens")
    return _named(store.find(ngrams.train(_counts(spark, d)), keys))


def context_ignoring_case(spark, d):
    entries = settled(ngrams.train(_counts(spark, d)).filter("entry_type = 2"))
    keys = entries.select(F.transform("tokens", F.upper).alias("tokens")).distinct()
    return store.find(entries, keys, ignoring_case=True).select(F.array_join("tokens", JOINED).alias("ngram"), F.array_join("wanted", JOINED).alias("wanted"))


def next_word(spark, d):
    """Texts whose last word but one is the same have the same answer, so each such word is asked about once."""
    rows = _sentences(spark, d).filter(F.size("words") > 1).select(F.col("key").alias("asked_by"), F.get("words", F.size("words") - 2).alias("query_id"))
    entries = ngrams.train(_counts(spark, d))
    flags = Flags(count=5, level=2).pack()
    asked = rows.select("query_id").distinct().select("query_id", F.lit("").alias("raw_word"), F.array("query_id").alias("prev_words"), F.lit(flags).alias("flags"))
    out = predict.suggestions(asked, entries, Session())
    return rows.join(out, "query_id").select(F.col("asked_by").alias("query_id"), "rank", "text", F.round("confidence", 9).alias("confidence"))


def stream_train(spark, d):
    """The stream's snapshot of what ``ngram_train`` counts in one go."""
    from keyloom.streaming.trainer import snapshot, train_stream

    batch = table(spark, d, "documents")
    stream = spark.readStream.schema(batch.schema).parquet(f"{d}/documents.parque[t]").select(fn.segment_words(F.col("text")).alias("words"))
    place = place_for(spark, "stream")
    train_stream(stream, "words", f"{place}/counts", f"{place}/checkpoint").awaitTermination()
    return _named(snapshot(spark, f"{place}/counts")[0])


def raw_text_train(spark, d):
    """The corpus as raw text files, trained line by line; a line is one sentence here, as SQL has no sentence rules."""
    place = place_for(spark, "text")
    table(spark, d, "documents").select("text").filter("text IS NOT NULL").write.text(place)
    return _named(rawtext.train_raw_text(spark, place, segment=lambda line: F.array(fn.segment_words(line)))[0])


def registry_totals(spark, d):
    """Three dictionaries under one registry (a path given twice is loaded once), and their totals by type."""
    parts = {"documents": _sentences(spark, d), "eval_items": _sentences(spark, d, "eval_items")}
    loaded: dict[str, DataFrame] = {}
    for path in ("documents", "eval_items", "documents"):
        loaded = store.register(loaded, path, ngrams.train(ngrams.count_ngrams(parts[path], "words")))
    whole = store.union_dictionaries(*loaded.values(), _shortcuts(spark, d, len(loaded)))
    kinds = store.words(whole).unionByName(store.ngrams(whole, 2, 3)).unionByName(store.shortcuts(whole))
    return store.stats(kinds).select("dict_id", "entry_type", "total_score", "vocab_size")


def entries_removed(spark, d):
    """The corpus' entries without the words of the evaluation passages; their n-grams stay."""
    entries = ngrams.train(_counts(spark, d))
    gone = ngrams.count_ngrams(_sentences(spark, d, "eval_items"), "words", 1).select(F.lit(0).alias("dict_id"), "tokens")
    return _named(store.without(entries, gone, 1))


# --- lexicon and word lists ----------------------------------------------------------------------------------------


def lexicon_senses(spark, d):
    return lexicon.sense_counts(lexicon.senses(table(spark, d, "lexicon")))


def lexicon_forms(spark, d):
    return lexicon.word_totals(lexicon.senses(table(spark, d, "lexicon")))


def lexicon_classify(spark, d):
    return lexicon.classify(lexicon.word_totals(lexicon.senses(table(spark, d, "lexicon"))))


def lexicon_counters(spark, d):
    return lexicon.counters(table(spark, d, "lexicon"))


def lexicon_stats(spark, d):
    records = table(spark, d, "lexicon")
    return lexicon.stats(records, lexicon.classify(lexicon.word_totals(lexicon.senses(records))))


def lexicon_files(spark, d):
    """The records through JSON lines and back."""
    place = place_for(spark, "lexicon")
    table(spark, d, "lexicon").select("word", "pos", "senses").write.json(place)
    return lexicon.sense_counts(lexicon.senses(lexicon.read_lexicon(spark, place)))


def lexicon_project_words(spark, d):
    """The dictionary of a lexicon with the project's own words, one of which may be in it already."""
    config = LexiconConfig(("Keyloom", "keyloom", "table"))
    return lexicon.build_dictionary(table(spark, d, "lexicon"), config).select("text", "score", "is_possibly_offensive")


def _word_counts(spark, d):
    once = table(spark, d, "wordlist").select("row_id", "word", "word_count").filter("word IS NOT NULL").distinct()
    return once.select("word", F.coalesce("word_count", F.lit(0)).alias("count"))


def _dictionary(spark, d):
    return wordlist.score_words(lexicon.build_dictionary(table(spark, d, "lexicon")), _word_counts(spark, d), 2)


def wordlist_scores(spark, d):
    return _dictionary(spark, d).select("text", "score", "is_possibly_offensive")


def wordlist_excluded(spark, d):
    return wordlist.exclude(wordlist.add_up(_word_counts(spark, d)), ("[A-Z]", ".*x"))


def wordlist_files(spark, d):
    """Word counts through a word list's files and back."""
    place = place_for(spark, "wordlist")
    wordlist.write_wordlist(wordlist.add_up(_word_counts(spark, d)), place)
    return wordlist.read_wordlist(spark, place)


def yearly_counts(spark, d):
    lines = table(spark, d, "unigram_lines").select("line_id", "line").distinct()
    return wordlist.add_up(wordlist.line_counts(lines)).select("word", F.col("count").cast("double").alias("matches"))


def unigram_files(spark, d):
    """The raw lines through gzip files and back: lines by file, as often as they were delivered."""
    place = place_for(spark, "unigrams")
    unigrams.write_unigram_files(table(spark, d, "unigram_lines").filter("line IS NOT NULL").select("partition_file", "line"), place)
    return unigrams.read_unigram_files(spark, place).groupBy("partition_file", "line").agg(F.count("*").alias("n"))


def _flagged(entries: DataFrame) -> DataFrame:
    """Words of an even length are marked offensive, those whose length is a multiple of three hidden."""
    size = F.when(F.col("entry_type") == 1, F.length("text"))
    return entries.withColumns({"is_possibly_offensive": F.coalesce(size % 2 == 0, F.lit(False)), "is_hidden": F.coalesce(size % 3 == 0, F.lit(False))})


def codec_roundtrip(spark, d):
    entries = _flagged(ngrams.train(_counts(spark, d)))
    short = spark.createDataFrame([(1, SHORTCUT, ["brb"], "brb", 1, False, False, "be right back")], store.ENTRIES)
    back = fldic.parse(fldic.as_file(fldic.to_lines(entries.unionByName(short))))
    return back.select("entry_type", F.array_join("tokens", JOINED).alias("key"), "score", "is_possibly_offensive", "is_hidden", "shortcut_phrase")


def dictionary_files(spark, d):
    """The scored lexicon with its shortcuts and flags, written as a dictionary file and read again, header and all."""
    place = place_for(spark, "dictionary")
    fldic.write(_flagged(_dictionary(spark, d)).unionByName(_shortcuts(spark, d)), place, SCHEMA_ADDRESS)
    return fldic.read(spark, place, strict=True).select("entry_type", "text", "score", "is_possibly_offensive", "is_hidden", "shortcut_phrase")


# --- requests ------------------------------------------------------------------------------------------------------


def _asked(spark, d):
    """One request for each record of the word list whose id is divisible by 100."""
    rows = table(spark, d, "wordlist").filter("row_id % 100 = 0 AND word IS NOT NULL").select(F.col("row_id").alias("query_id"), F.col("word").alias("raw_word")).distinct()
    return rows.withColumn("prev_words", F.array().cast("array<string>")).withColumn("flags", F.lit(Flags(count=5, level=1).pack()))


def fuzzy_cost(spark, d):
    """Costs of all words near the distinct words asked about, in the mode of the spell check."""
    typed = _asked(spark, d).select("raw_word").distinct()
    words = _dictionary(spark, d).select("text")
    return fuzzy.fuzzy_matches(typed, words, mode=SPELL).select(F.col("raw_word").alias("typed"), F.col("text").alias("word"), "cost")


def fuzzy_near_keys(spark, d):
    """As suggestions see them, with neighbouring keys: costs and whether a word was found by a prefix."""
    typed = _asked(spark, d).select("raw_word").distinct()
    words = _dictionary(spark, d).select("text")
    return fuzzy.fuzzy_matches(typed, words, near=NEAR, mode=SUGGEST).select(F.col("raw_word").alias("typed"), F.col("text").alias("word"), "cost", "via_prefix")


def fuzzy_suggest(spark, d):
    out = predict.suggestions(_asked(spark, d), _dictionary(spark, d))
    return out.select("query_id", "rank", "text", F.round("confidence", 9).alias("confidence"))


def suggest_flags(spark, d):
    """Flags that change from request to request: offensive and hidden words, capitals, and no limit at all."""
    k = (F.col("query_id") / 100).cast("int")
    flags = F.when(k % 5 == 0, 0).otherwise(1 + k % 4) + F.lit(1 << 8) + F.when(k % 3 == 0, 3 << 14).otherwise(0) + F.when(k % 2 == 0, 1 << 16).otherwise(0) + F.when(k % 7 == 0, 1 << 17).otherwise(0)
    out = predict.suggestions(_asked(spark, d).withColumn("flags", flags), _flagged(_dictionary(spark, d)))
    return out.select("query_id", "rank", "text", F.round("confidence", 9).alias("confidence"))


def spell_check(spark, d):
    out = predict.spell(_asked(spark, d), _dictionary(spark, d))
    return out.select("query_id", "result", fn.spelling_label(F.col("result")).alias("label"), F.array_join("suggestions", "|").alias("suggestions"))


def spell_valid(spark, d):
    asked = table(spark, d, "wordlist").select(F.col("word").alias("raw_word")).filter("raw_word IS NOT NULL").distinct()
    return predict.known_words(asked, _dictionary(spark, d)).select(F.col("raw_word").alias("word"))


def spell_typos(spark, d):
    asked = table(spark, d, "wordlist").select("word").filter("word IS NOT NULL").distinct()
    there = store.presence(_dictionary(spark, d)).filter(F.size("tokens") == 1).select(F.col("tokens")[0].alias("word"))
    return asked.join(there, "word", "left_anti")


def _shortcuts(spark, d, dict_id=1):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("text"), F.lit(1).alias("score"), F.col("r_name").alias("shortcut_phrase"))
    return store.as_entries(rows, dict_id, entry_type=F.lit(SHORTCUT))


def shortcut_expand(spark, d):
    asked = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.col("n_name").alias("raw_word"), F.array().cast("array<string>").alias("prev_words"), F.lit(Flags(level=1).pack()).alias("flags"))
    return predict.suggestions(asked, _shortcuts(spark, d)).select("query_id", "rank", "text", "confidence")


# --- functions -----------------------------------------------------------------------------------------------------


def flags_decode(spark, d):
    events = table(spark, d, "events")
    decoded = events.select("event_id", fn.decode_flags(F.col("event_id").cast("int")).alias("f")).select("event_id", "f.*")
    return decoded.withColumns({"start_label": fn.shift_label(F.col("start_shift")), "cursor_label": fn.shift_label(F.col("cursor_shift"))})


def case_map(spark, d):
    parts = table(spark, d, "part")
    return parts.select("p_partkey", F.upper("p_name").alias("upper"), F.lower("p_name").alias("lower"), fn.titlecase("p_name").alias("title"))


def suggestion_json(spark, d):
    """Suggestions through JSON and back, nulls included."""
    events = table(spark, d, "events")
    source = fn.suggestion_to_json(F.col("event_type"), F.lit(""), F.col("value"), F.col("event_id") % 2 == 0, F.col("value") > 10)
    back = events.select("event_id", fn.suggestion_from_json(source).alias("s"))
    return back.select("event_id", "s.text", "s.secondaryText", "s.confidence", "s.isEligibleForAutoCommit", "s.isEligibleForUserRemoval")


def name_pieces(spark, d):
    """Names cut at single blanks, two cuts at most; one with a blank at its end has an empty last piece."""
    part = table(spark, d, "part")
    pieces = fn.split_at(F.concat("p_name", F.lit(" ")), " ", 2)
    return part.select("p_partkey", F.posexplode(pieces).alias("place", "piece"))


def grapheme_split(spark, d):
    words = table(spark, d, "wordlist").select("word").filter("word IS NOT NULL").distinct()
    return words.select("word", F.size(fn.graphemes(F.col("word"))).alias("graphemes"))


def sign_checks(spark, d):
    """Words by their signs: joined again, whether they begin with two given ones, and whether the keys of the first two
    are neighbours on the row that the first is on."""
    near = F.create_map(*(x for k, v in NEAR.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = F.create_map(*(F.lit(x) for k, row in enumerate(("qwertyuiop", "asdfghjkl", "zxcvbnm")) for key in row for x in (key, k)))
    words = table(spark, d, "lexicon").select("word", fn.graphemes(F.col("word")).alias("s")).filter("word IS NOT NULL").distinct()
    first, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    return words.select("word", fn.joined(F.reverse("s")).alias("back"), fn.starts_with(F.col("s"), F.array(F.lit("s"), F.lit("h"))).alias("begins"), fn.in_proximity(near, first, second).alias("near"), fn.find_or(rows, first, F.lit(-1)).alias("row"))


def sentence_segment(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(fn.segment_sentences(F.col("text"))).alias("place", "words")).select("doc_id", "place", F.array_join("words", JOINED).alias("words"))


def syllable_division(spark, d):
    words = table(spark, d, "lexicon").select("word").filter("word IS NOT NULL").distinct()
    return words.select("word", F.array_join(syllables.divider(syllables.compile_rules(SYLLABLE_RULES))("word"), "-").alias("syllables"))


def page_links(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.explode(fn.links(F.col("text"), r"(https?://[\w./-]+)")).alias("link"))


def context_padding(spark, d):
    rows = _sentences(spark, d)
    return rows.select(F.col("key").alias("doc_id"), F.array_join(F.transform(fn.padded_context(F.slice("words", 1, F.least(F.size("words"), F.col("key").cast("int") % 4)), 2), lambda x: F.when(x == SOS, "<s>").otherwise(x)), JOINED).alias("context"))


QUERIES = {
    f.__name__: f
    for f in (
        word_counts_by_lang, vocab_stats, laplace_frequency, multi_dict_merge, ngram_train, penalised_scores, reload_clamp, incremental_merge, ngram_presence, ngram_find,
        context_ignoring_case, next_word, stream_train, raw_text_train, registry_totals, entries_removed, lexicon_senses, lexicon_forms, lexicon_classify, lexicon_counters, lexicon_stats,
        lexicon_files, lexicon_project_words, wordlist_scores, wordlist_excluded, wordlist_files, yearly_counts, unigram_files, codec_roundtrip, dictionary_files, fuzzy_cost, fuzzy_near_keys,
        fuzzy_suggest, suggest_flags, spell_check, spell_valid, spell_typos, shortcut_expand, flags_decode, case_map, suggestion_json, name_pieces, grapheme_split, sign_checks, sentence_segment,
        syllable_division, page_links, context_padding,
    )
}

_W = "[\\p{L}'']+"
_CORPUS = f"c as (select lang, w as word, count(*) n from (select lang, unnest(regexp_extract_all(text, '{_W}')) w from documents) group by lang, w)"
_GRAMS = f"""s as (select doc_id, ws, list_concat([chr(2)], ws) one, list_concat([chr(2), chr(2)], ws) two from (select doc_id, regexp_extract_all(text, '{_W}') ws from documents where text is not null)),
o as (select unnest(list_concat(list_transform(ws, lambda x: [x]), list_concat(list_transform(range(1, len(ws) + 1), lambda k: one[k:k + 1]), list_transform(range(1, len(ws) + 1), lambda k: two[k:k + 2])))) tokens from s),
g as (select tokens, len(tokens) entry_type, count(*) n from o group by tokens)"""
_ITEMS = f"""i as (select regexp_extract_all(text, '{_W}') ws from eval_items where text is not null), j as (select ws, list_concat([chr(2)], ws) one from i),
h as (select distinct unnest(list_concat(list_transform(ws, lambda x: [x]), list_transform(range(1, len(ws) + 1), lambda k: one[k:k + 1]))) tokens from j)"""
_TRAINED = "array_to_string(tokens, ' ') as ngram, entry_type::int as entry_type, n * 129 as score"
_LEXICON = """r as (select word, pos, senses from lexicon where word is not null and pos is not null and senses is not null),
x as (select word, pos, unnest(case when len(senses) = 0 then [null] else senses end) s from r),
j as (select word, pos, case when s is null then null when list_has_any(coalesce(s.tags, []), ['obsolete', 'misspelling', 'morpheme']) then 'excluded'
  when list_has_any(coalesce(s.tags, []), ['offensive', 'vulgar']) then 'offensive' else 'normal' end verdict,
  case when s.form_of is not null then s.form_of[1].word else s.alt_of[1].word end form_of from x),
k as (select word, pos, count(*) filter (verdict = 'excluded') excluded, count(*) filter (verdict = 'offensive') offensive, count(*) filter (verdict = 'normal') normal from j group by word, pos),
l as (select word f, pos, form_of from j where form_of is not null),
w0 as (select distinct word own, word, pos, 0 depth from j),
w1 as (select own, form_of word, w0.pos, 1 depth from w0 join l on w0.word = l.f and w0.pos = l.pos),
w2 as (select own, form_of word, w1.pos, 2 depth from w1 join l on w1.word = l.f and w1.pos = l.pos),
a as (select * from w0 union all select * from w1 union all select * from w2),
t as (select own word, sum(case when depth = 0 then excluded end)::bigint excluded, sum(case when depth = 0 then offensive end)::bigint offensive, sum(case when depth = 0 then normal end)::bigint normal,
  sum((depth + 1) * excluded)::bigint deep_excluded, sum((depth + 1) * offensive)::bigint deep_offensive, sum((depth + 1) * normal)::bigint deep_normal from a join k using (word, pos) group by own),
q as (select word, case when (excluded >= offensive and excluded >= normal) or (deep_excluded >= deep_offensive and deep_excluded >= deep_normal) then 'excluded'
  when not regexp_full_match(word, '[\\p{L}''-]*') then 'invalid' when deep_offensive >= deep_normal then 'offensive' else 'normal' end as class from t)"""
_COUNTED = """y as (select s from x where s is not null),
z as (select 'records' kind, '' as name from r union all select 'senses', '' from y union all select 'pos', pos from r union all select 'tag', unnest(s.tags) from y
  union all select 'category', unnest(list_transform(s.categories, lambda c: c.name)) from y)"""
_COUNTS = """u as (select word, sum(coalesce(word_count, 0))::bigint n from (select distinct row_id, word, word_count from wordlist where word is not null) group by word)"""
_DICT = f"""{_LEXICON}, {_COUNTS}, dict as (select q.word as text, 1 + coalesce(n, 0) as score, class = 'offensive' as is_possibly_offensive from q left join u on q.word = u.word
  where class in ('normal', 'offensive') and 1 + coalesce(n, 0) >= 2 and q.word <> '')"""

_KEYS = ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]" for k, v in NEAR.items())
#: Whether a word is marked by ``_flagged``.
_FLAGS = "len({0}) % 2 = 0 as is_possibly_offensive, len({0}) % 3 = 0 as is_hidden"


def _walk(near: bool, prefixes: bool) -> str:
    """The fuzzy search as a recursion over the beginnings of the dictionary's words: ``hits (w, text, n, m, via, cost)``.

    ``px`` has every beginning of k signs with its last two signs; ``rec`` has, for a typed word and a beginning that is
    no dead end before, the row of the distance matrix, the cell at the typed word's own length, and whether the first
    signs are alike.
    """
    beside = f"when list_contains(coalesce(map_extract_value(map {{{_KEYS}}}, s), []), l[i]) then 0.25::double" if near else ""
    by_prefix = "(t1 > n and f1 and q1 <= 1.5)" if prefixes else "false"
    return f"""ws as (select w, l, len(l) n, list_transform(l, lambda x: case when upper(x) <> x then upper(x) else lower(x) end) o
  from (select distinct word w, list_transform(range(1, length_grapheme(word) + 1), lambda k: substring_grapheme(word, k, 1)) l from wordlist where row_id % 100 = 0 and word is not null)),
cs as (select text, list_transform(range(1, length_grapheme(text) + 1), lambda k: substring_grapheme(text, k, 1)) c from dict),
px as (select distinct k, array_to_string(c[1:k], chr(1)) as own, case when k = 1 then '' else array_to_string(c[1:k - 1], chr(1)) end as up, c[k] as s, case when k > 1 then c[k - 1] end as b from (select c, unnest(range(1, len(c) + 1)) k from cs)),
rec as (
  select w, '' as own, 0 as t, n = 0 as f, case when n = 0 then 0.0::double end as q, false as via, list_transform(range(0, n + 1), lambda i: (i * case when i = 1 then 1.0 else 0.5 end)::double) as r from ws
  union all
  select w, own, t1, f1, q1, via1, r1 from (
    select *, {by_prefix} as via1 from (
      select w, own, t1, n, r1, f or (t1 = 1 and n > 0 and (s = l[1] or s = o[1])) as f1, case when t1 = n then r1[n + 1] else q end as q1 from (
        select *, list_transform(range(0, n + 1), lambda i: list_min(list_transform(range(0, i + 1), lambda k: bl[k + 1] + dl * (i - k)))) as r1 from (
          select *, list_transform(range(0, n + 1), lambda i: case when i = 0 then t1 * ins else least(r[i + 1] + ins, r[i] + case when s = l[i] then 0.0::double when s = o[i] then 0.25::double
            when t1 > 1 and i > 1 and b = l[i] and s = l[i - 1] then 0.0::double {beside} else sub end) end) as bl from (
            select rec.w, rec.t + 1 as t1, rec.f, rec.q, rec.r, ws.n, ws.l, ws.o, px.own, px.s, px.b, case when rec.t = 0 then 1.0::double else 0.5::double end as ins, case when rec.t = 0 then 1.0::double else 0.5::double end as dl,
              case when rec.t = 0 then 1.0::double else 0.5::double end as sub
            from rec join ws on rec.w = ws.w join px on px.up = rec.own and px.k = rec.t + 1 where rec.via or case when rec.t < ws.n then rec.r[rec.t + 1] else rec.r[ws.n + 1] end < 1.5)))))),
hits as (select rec.w, cs.text, ws.n, len(cs.c) m, rec.via, case when rec.via then rec.q else rec.r[ws.n + 1] end as cost from rec join ws on rec.w = ws.w join cs on array_to_string(cs.c, chr(1)) = rec.own and len(cs.c) = rec.t
  where rec.t > 0 and (rec.via or rec.r[ws.n + 1] <= 1.5))"""


def _ranked(prefixes: bool, kept: str = "true", flags: str = "is_possibly_offensive, false as is_hidden") -> str:
    """``best (query_id, text, c, rank)`` of the requests over ``hits``."""
    return f"""tot as (select sum(score)::double t, count(*)::double v from dict), fr as (select text, {flags}, (score::double + 1) / (t + v) fq from dict, tot),
req as (select distinct row_id as query_id, word w, (row_id // 100)::int as k from wordlist where row_id % 100 = 0 and word is not null),
conf as (select query_id, k, hits.text, max(((1.0::double - cost / case when via then greatest(n, 1) else greatest(n, m, 1) end) + 0.1::double * fq) / 1.1::double) c
  from req join hits on req.w = hits.w join fr on hits.text = fr.text where ({kept}) {"" if prefixes else "and hits.text <> hits.w"} group by query_id, k, hits.text),
best as (select *, row_number() over (partition by query_id order by c desc, text) as rank from conf)"""


SQL = {
    "word_counts_by_lang": f"with {_CORPUS} select * from c",
    "vocab_stats": f"with {_CORPUS} select lang, sum(n)::bigint as total_score, count(*) as vocab_size from c group by lang",
    "laplace_frequency": f"""with {_CORPUS}, n as (select lang, sum(n)::double t, count(*)::double v from c group by lang),
b as (select c.lang, word, row_number() over (partition by c.lang order by c.n desc, word) as rank, round((c.n::double + 1) / (t + v), 9) as frequency from c join n on c.lang is not distinct from n.lang)
select lang, word, rank::int as rank, frequency from b where rank <= 100""",
    "multi_dict_merge": f"""with {_CORPUS}, n as (select lang, sum(n)::double t, count(*)::double v from c group by lang)
select word as text, sum(c.n)::bigint as score, round(sum((c.n::double + 1) / (t + v)) / count(*), 9) as frequency from c join n on c.lang is not distinct from n.lang group by word""",
    "ngram_train": f"with {_GRAMS} select {_TRAINED} from g",
    "penalised_scores": f"with {_GRAMS}, p as (select entry_type, sum(n)::bigint p from g group by entry_type) select array_to_string(tokens, ' ') as ngram, g.entry_type::int as entry_type, n * 129 - p as score from g join p on g.entry_type = p.entry_type",
    "reload_clamp": f"""with {_GRAMS}, p as (select entry_type, sum(n)::bigint p from g group by entry_type)
select g.entry_type::int as entry_type, sum(greatest(n * 129 - p, 0))::bigint as total_score, count(*) as vocab_size from g join p on g.entry_type = p.entry_type group by g.entry_type""",
    "incremental_merge": f"with {_GRAMS} select {_TRAINED} from g",
    "ngram_presence": f"with {_GRAMS}, h as (select unnest(list_transform(range(1, len(tokens) + 1), lambda k: tokens[1:k])) t from g) select distinct array_to_string(t, ' ') as prefix from h",
    "ngram_find": f"with {_GRAMS}, {_ITEMS} select {_TRAINED} from g where tokens in (select tokens from h)",
    "entries_removed": f"with {_GRAMS}, {_ITEMS} select {_TRAINED} from g where not (entry_type = 1 and tokens in (select tokens from h))",
    "registry_totals": f"""with {_GRAMS}, i as (select regexp_extract_all(text, '{_W}') ws from eval_items where text is not null), i2 as (select ws, list_concat([chr(2)], ws) one, list_concat([chr(2), chr(2)], ws) two from i),
e as (select unnest(list_concat(list_transform(ws, lambda x: [x]), list_concat(list_transform(range(1, len(ws) + 1), lambda k: one[k:k + 1]), list_transform(range(1, len(ws) + 1), lambda k: two[k:k + 2])))) tokens from i2),
a as (select 0 as dict_id, entry_type, sum(n * 129) t, count(*) v from g group by entry_type union all select 1, len(tokens), count(*) * 129, count(distinct tokens) from e group by len(tokens)
  union all select 2, -1, count(*), count(*) from nation join region on n_regionkey = r_regionkey)
select dict_id::int as dict_id, entry_type::int as entry_type, t::bigint as total_score, v as vocab_size from a""",
    "raw_text_train": f"""with l as (select unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) x from documents where text is not null), s as (select ws, list_concat([chr(2)], ws) one, list_concat([chr(2), chr(2)], ws) two from (select regexp_extract_all(x, '{_W}') ws from l)),
o as (select unnest(list_concat(list_transform(ws, lambda x: [x]), list_concat(list_transform(range(1, len(ws) + 1), lambda k: one[k:k + 1]), list_transform(range(1, len(ws) + 1), lambda k: two[k:k + 2])))) tokens from s),
g as (select tokens, len(tokens) entry_type, count(*) n from o group by tokens) select {_TRAINED} from g""",
    "context_ignoring_case": f"""with {_GRAMS}, b as (select tokens, list_transform(tokens, lambda x: lower(x)) low from g where entry_type = 2), w as (select distinct list_transform(tokens, lambda x: replace(upper(x), 'ẞ', 'SS')) t from b), v as (select t, list_transform(t, lambda x: lower(x)) low from w)
select array_to_string(tokens, ' ') as ngram, array_to_string(t, ' ') as wanted from b join v on b.low = v.low""",
    "next_word": f"""with {_GRAMS}, b as (select tokens[1] h, tokens[2] t, n * 129 as score from g where entry_type = 2 and tokens[1] <> chr(2)), n as (select sum(n * 129)::double t, count(*)::double v from g where entry_type = 2),
a as (select doc_id, ws[len(ws) - 1] h from s where len(ws) > 1), ah as (select distinct h from a),
m as (select ah.h, b.t as text, max((1.0::double + 0.1::double * ((score::double + 1) / (n.t + n.v))) / 1.1::double) c from ah join b on lower(ah.h) = lower(b.h), n group by ah.h, b.t),
k as (select h, row_number() over (partition by h order by c desc, text) as rank, text, round(c, 9) as confidence from m)
select doc_id as query_id, rank::int as rank, text, confidence from a join k on a.h = k.h where rank <= 5""",
    "stream_train": f"with {_GRAMS} select {_TRAINED} from g",
    "lexicon_senses": f"with {_LEXICON} select * from k",
    "lexicon_forms": f"with {_LEXICON} select * from t",
    "lexicon_classify": f"with {_LEXICON} select * from q",
    "lexicon_counters": f"""with {_LEXICON}, {_COUNTED} select kind, name, count(*) as n from z group by kind, name""",
    "lexicon_stats": f"""with {_LEXICON}, {_COUNTED} select kind, name, count(*) as n from z group by kind, name union all select 'class', class, count(*) from q group by class""",
    "lexicon_files": f"with {_LEXICON} select * from k",
    "lexicon_project_words": f"""with {_LEXICON}, p as (select word as text, class = 'offensive' as bad from q where class in ('normal', 'offensive') and word <> '' union all select unnest(['Keyloom', 'keyloom', 'table']), false)
select text, 1::bigint as score, bool_or(bad) as is_possibly_offensive from p group by text""",
    "wordlist_scores": f"with {_DICT} select * from dict",
    "wordlist_excluded": f"with {_COUNTS} select word, n as count from u where not regexp_matches(word, '^([A-Z])') and not regexp_matches(word, '^(.*x)')",
    "yearly_counts": """with u as (select distinct line_id, line from unigram_lines where line is not null), f as (select string_split(line, chr(9)) p from u),
e as (select regexp_replace(p[1], '_[^_]*$', '') word, list_sum(list_transform(list_filter(list_transform(p[2:], lambda x: string_split(x, ',')), lambda q: len(q) = 3),
  lambda q: coalesce(case when regexp_full_match(q[2], '[0-9]+') then try_cast(q[2] as bigint) end, 0)::hugeint)) n from f)
select word, sum(coalesce(n, 0))::double as matches from e group by word""",
    "codec_roundtrip": f"""with {_GRAMS} select entry_type::int as entry_type, array_to_string(tokens, ' ') as key, n * 129 as score, entry_type = 1 and len(tokens[1]) % 2 = 0 as is_possibly_offensive, entry_type = 1 and len(tokens[1]) % 3 = 0 as is_hidden, null::varchar as shortcut_phrase from g
union all select -1, 'brb', 1, false, false, 'be right back'""",
    "dictionary_files": f"""with {_DICT} select 1 as entry_type, text, score, {_FLAGS.format('text')}, null::varchar as shortcut_phrase from dict
union all select -1, n_name, 1, false, false, r_name from nation join region on n_regionkey = r_regionkey""",
    "wordlist_files": f"with {_COUNTS} select word, n as count from u where not contains(word, chr(9)) and not contains(word, chr(10)) and not contains(word, chr(13))",
    "unigram_files": "select partition_file, line, count(*) as n from unigram_lines where line is not null group by partition_file, line",
    "fuzzy_cost": f"with recursive {_DICT}, {_walk(False, False)} select w as typed, text as word, cost from hits",
    "fuzzy_near_keys": f"with recursive {_DICT}, {_walk(True, True)} select w as typed, text as word, cost, via as via_prefix from hits",
    "fuzzy_suggest": f"with recursive {_DICT}, {_walk(False, True)}, {_ranked(True, 'not is_possibly_offensive')} select query_id, rank::int as rank, text, round(c, 9) as confidence from best where rank <= 5",
    "suggest_flags": f"""with recursive {_DICT}, {_walk(False, True)}, {_ranked(True, '(k % 2 = 0 or not is_possibly_offensive) and (k % 7 = 0 or not is_hidden)', _FLAGS.format('text'))}
select query_id, rank::int as rank, case when k % 3 = 0 then replace(upper(text), 'ẞ', 'SS') else text end as text, round(c, 9) as confidence from best where k % 5 = 0 or rank <= 1 + k % 4""",
    "spell_check": f"""with recursive {_DICT}, {_walk(False, False)}, {_ranked(False, 'not is_possibly_offensive')},
lists as (select query_id, string_agg(text, '|' order by rank) as suggestions from best where rank <= 5 group by query_id), bits as (select query_id, case when w = '' then 0 when w in (select text from dict) then 1 else 2 end as result from req)
select bits.query_id, result::int as result, case result when 1 then 'valid' when 2 then 'typo' else 'unspecified' end as label, case when result = 2 then coalesce(suggestions, '') else '' end as suggestions from bits left join lists on bits.query_id = lists.query_id""",
    "spell_valid": f"with {_DICT}, v as (select distinct word from wordlist where word is not null) select word from v where word in (select text from dict)",
    "spell_typos": f"with {_DICT}, v as (select distinct word from wordlist where word is not null) select word from v where word not in (select text from dict)",
    "shortcut_expand": "select n_nationkey::bigint as query_id, 1 as rank, r_name as text, 1.0::double as confidence from nation join region on n_regionkey = r_regionkey",
    "flags_decode": """select *, ['US', 'SM', 'SA', 'CL'][start_shift + 1] as start_label, ['US', 'SM', 'SA', 'CL'][cursor_shift + 1] as cursor_label from (
select event_id, (event_id & 255)::int as max_count, ((event_id >> 8) & 15)::int as ngram_level, ((event_id >> 12) & 3)::int as start_shift, ((event_id >> 14) & 3)::int as cursor_shift,
((event_id >> 16) & 1) = 1 as allow_offensive, ((event_id >> 17) & 1) = 1 as show_hidden, ((event_id >> 18) & 1) = 1 as is_private from events)""",
    "suggestion_json": "select event_id, event_type as text, '' as \"secondaryText\", value as confidence, event_id % 2 = 0 as \"isEligibleForAutoCommit\", value > 10 as \"isEligibleForUserRemoval\" from events",
    "name_pieces": """with p as (select p_partkey, string_split(p_name || ' ', ' ') x from part), c as (select p_partkey, case when len(x) > 3 then list_concat(x[1:2], [array_to_string(x[3:], ' ')]) else x end x from p)
select p_partkey, (unnest(range(0, len(x)::int)))::int as place, unnest(x) as piece from c""",
    "case_map": "select p_partkey, upper(p_name) as upper, lower(p_name) as lower, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ') as title from part",
    "sign_checks": f"""with w as (select distinct word, list_transform(range(1, length_grapheme(word) + 1), lambda k: substring_grapheme(word, k, 1)) s from lexicon where word is not null)
select word, array_to_string(list_reverse(s), '') as back, len(s) > 1 and s[1] = 's' and s[2] = 'h' as begins, coalesce(list_contains(map_extract_value(map {{{_KEYS}}}, s[1]), s[2]), false) as near,
  case when contains('qwertyuiop', s[1]) then 0 when contains('asdfghjkl', s[1]) then 1 when contains('zxcvbnm', s[1]) then 2 else -1 end::int as row from w""",
    "grapheme_split": "select distinct word, length_grapheme(word)::int as graphemes from wordlist where word is not null",
    "page_links": "select doc_id, unnest(regexp_extract_all(text, '(https?://[\\w./-]+)', 1)) as link from documents",
    "context_padding": f"""with s as (select doc_id, regexp_extract_all(text, '{_W}') ws from documents)
select doc_id, array_to_string(list_concat(['<s>', '<s>'], coalesce(ws[1:(doc_id % 4)], []))[-2:], ' ') as context from s""",
}
