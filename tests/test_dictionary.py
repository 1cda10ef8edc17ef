import json
import random

import pytest

from keyloom.config import SHORTCUT, SOS, Flags, LexiconConfig, Rules, Session, Training
from keyloom.functions import text as fn
from keyloom.operators import lexicon, ngrams, predict, store, syllables, wordlist
from keyloom.plans.dictionary import SYLLABLE_RULES
from keyloom.sources import archive, fldic, rawtext, unigrams
from pyspark.sql import functions as F


def entries(spark, rows):
    return spark.createDataFrame([(d, k, t, t[-1], s, p, h, ph) for d, k, t, s, p, h, ph in rows], store.ENTRIES)


def word(text, score, d=1, bad=False, hidden=False):
    return (d, 1, [text], score, bad, hidden, None)


def sentences(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "words ARRAY<STRING>")


def test_one_sentence(spark):
    counts = ngrams.count_ngrams(sentences(spark, [["a", "b"]]), "words")
    got = {tuple(r.tokens): r.score for r in ngrams.train(counts).collect()}
    assert got == {("a",): 129, ("b",): 129, (SOS, "a"): 129, ("a", "b"): 129, (SOS, SOS, "a"): 129, (SOS, "a", "b"): 129}
    saved = ngrams.penalised(ngrams.train(counts), ngrams.penalties(counts))
    assert {r.score for r in saved.collect()} == {127}
    assert {(r.entry_type, r.total_score, r.vocab_size) for r in store.stats(ngrams.train(counts)).collect()} == {(1, 258, 2), (2, 258, 2), (3, 258, 2)}


def test_training_is_sequential_training(spark):
    rng = random.Random(5)
    corpus = [[rng.choice("abcd") for _ in range(rng.randint(0, 6))] for _ in range(40)] + [None, ["a", None, ""]]
    score, penalty = {}, {}
    for s in corpus:
        clean = [w for w in s or [] if w]
        for n in (1, 2, 3):
            padded = [SOS] * (n - 1) + clean
            for k in range(len(clean)):
                key = tuple(padded[k : k + n])
                score[key] = score.get(key, 0) + 128 + 1
                penalty[n] = penalty.get(n, 0) + 1
    counts = ngrams.count_ngrams(sentences(spark, corpus[::-1]), "words")
    assert {tuple(r.tokens): r.score for r in ngrams.train(counts).collect()} == score
    assert {r.entry_type: r.penalty for r in ngrams.penalties(counts).collect()} == penalty
    halves = [ngrams.train(ngrams.count_ngrams(sentences(spark, corpus[k::2]), "words")) for k in (0, 1)]
    assert {tuple(r.tokens): r.score for r in ngrams.merge(*halves).collect()} == score


def test_late_words_are_charged_for_all(spark):
    counts = ngrams.count_ngrams(sentences(spark, [["x"] * 128, ["late"]]), "words")
    saved = ngrams.penalised(ngrams.train(counts), ngrams.penalties(counts)).filter("entry_type = 1")
    assert {r.text: r.score for r in saved.collect()}["late"] == 0
    assert {r.score for r in ngrams.reloaded(ngrams.penalised(ngrams.train(counts, Training(1, 1)), ngrams.penalties(counts))).collect() if r.text == "late"} == {0}


def test_laplace_and_presence_average(spark):
    rows = entries(spark, [word("w", 3), word("v", 7, 1), (0, SHORTCUT, ["w"], 1, False, False, "phrase")])
    one = spark.range(1).select(store.laplace(F.lit(3), F.lit(10), F.lit(5)).alias("x")).first().x
    assert one == pytest.approx(4 / 15)
    got = {r.text: r.frequency for r in store.merged(rows, 1).collect()}
    assert got["w"] == pytest.approx(4 / 12 / 2) and got["v"] == pytest.approx(8 / 12)
    assert store.presence(entries(spark, [(0, 3, ["a", "b", "c"], 1, False, False, None)])).count() == 3
    assert store.merged(rows.limit(0), 1).count() == 0


def test_find_ignoring_case(spark):
    rows = entries(spark, [(0, 2, ["Ab", "c"], 1, False, False, None), (0, 2, ["ab", "C"], 1, False, False, None), (0, 2, ["abc", "c"], 1, False, False, None)])
    keys = spark.createDataFrame([(["AB", "c"],)], "tokens ARRAY<STRING>")
    assert {tuple(r.tokens) for r in store.find(rows, keys, True).collect()} == {("Ab", "c"), ("ab", "C")}
    assert store.find(rows, keys).count() == 0 and store.without(rows, rows.select("dict_id", "tokens"), 2).count() == 0


def suggest(spark, rows, asked, **more):
    requests = spark.createDataFrame(asked, "query_id BIGINT, raw_word STRING, prev_words ARRAY<STRING>, flags INT")
    out = {}
    for r in predict.suggestions(requests, entries(spark, rows), **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.text)
    return out


def test_suggestions(spark):
    rows = [
        word("hello", 10), word("help", 50), word("helmet", 5), word("damn", 9, bad=True), word("secret", 9, hidden=True), word("hello", 3, 0), (1, SHORTCUT, ["hel"], 1, False, False, "be right there"),
        word("good", 5, 0), (0, 2, ["good", "morning"], 30, False, False, None), (0, 2, ["good", "night"], 20, False, False, None), (0, 2, ["Good", "day"], 20, False, False, None), word("Good", 1, 0),
        word("other", 99, 2),
    ]
    f = lambda **x: Flags(**({"count": 8, "level": 1} | x)).pack()
    asked = [
        (1, "hel", None, f()), (2, "hel", [], f(count=1)), (3, "dam", [], f()), (4, "dam", [], f(offensive=True)), (5, "secre", [], f(hidden=True)), (6, "", ["good"], f(level=2)),
        (7, "hel", [], f(start_shift=1)), (8, "hel", [], f(cursor_shift=3, count=2)), (9, "othe", [], f()), (10, "hel", [], f(count=0)), (11, None, None, None), (12, "nig", ["GOOD"], f(level=2)),
    ]
    got = suggest(spark, rows, asked)
    assert got[1][0] == "be right there" and set(got[1][1:]) == {"hello", "help", "helmet"} and got[1][1] == "help"
    assert got[2] == ["be right there"] and 3 not in got and got[4] == ["damn"] and got[5] == ["secret"]
    assert got[6] == ["morning", "day", "night"] and got[12] == ["night"]
    assert got[7][0] == "Be Right There" and got[8] == ["BE RIGHT THERE", "HELP"] and 9 not in got and len(got[10]) == 4 and 11 not in got
    assert suggest(spark, rows, []) == {} and suggest(spark, [], asked) == {}


def test_spell(spark):
    rows = entries(spark, [word("hello", 10), word("help", 5), (0, 2, ["path", "only"], 3, False, False, None), word("bad", 3, 5, True)])
    requests = spark.createDataFrame([(1, "hello"), (2, "helo"), (3, ""), (4, None), (5, "path"), (6, "bad"), (7, "zzzzzz")], "query_id BIGINT, raw_word STRING")
    asked = requests.select("*", F.array().cast("array<string>").alias("prev_words"), F.lit(Flags(level=1).pack()).alias("flags"))
    got = {r.query_id: (r.result, r.suggestions) for r in predict.spell(asked, rows).collect()}
    assert got == {1: (1, []), 2: (2, ["hello", "help"]), 3: (0, []), 4: (0, []), 5: (1, []), 6: (1, []), 7: (2, [])}


def test_codec_roundtrip_and_errors(spark):
    rows = entries(spark, [
        word("b", 5), word("a", -3, bad=True), word("c", 7, bad=True, hidden=True), (1, 2, ["a", "b"], 4, False, False, None), (1, 3, [SOS, SOS, "b"], 2, False, False, None),
        (1, 2, ["a", "gone"], 4, False, False, None), (1, SHORTCUT, ["x"], 1, False, False, "y z"),
    ])
    lines = fldic.to_lines(rows)
    listed = [r.line for r in lines.orderBy("section", "id", "line").collect()]
    assert "a\t-3\tp" in listed and "c\t7\tph" in listed and "1,2\t4" in listed and "-2,-2,2\t2" in listed and "x\ty z" in listed
    key = lambda r: (r.entry_type, tuple(r.tokens), r.score, r.is_possibly_offensive, r.is_hidden, r.shortcut_phrase)
    want = {key(r) for r in rows.collect() if "gone" not in r.tokens}
    assert {key(r) for r in fldic.parse(fldic.as_file(lines)).collect()} == want
    with pytest.raises(Exception, match="can't be written"):
        fldic.to_lines(entries(spark, [word("#x", 1)])).collect()


def test_dictionary_files(spark, tmp_path):
    path = tmp_path / "d.fldic"
    path.write_text("#~schema: https://schemas.example/nlp/v0~draft1/fldic.txt\n#~encoding: utf-8\n\n[words]\na\t1\nb\t2\tp\na\t9\th\n# no\n[ngrams]\n1,2\t5\n1,9\t5\n-2,2\t6\n[shortcuts]\nx\tlong\n")
    got = {(r.entry_type, tuple(r.tokens)): (r.score, r.is_possibly_offensive, r.is_hidden, r.shortcut_phrase) for r in fldic.read(spark, str(path)).collect()}
    assert got == {(1, ("a",)): (9, False, True, None), (1, ("b",)): (2, True, False, None), (2, ("a", "b")): (5, False, False, None), (2, (SOS, "b")): (6, False, False, None), (-1, ("x",)): (1, False, False, "long")}
    assert fldic.unresolved(fldic.lines_of(spark, str(path))) == 1
    fldic.write(fldic.read(spark, str(path)), str(tmp_path / "out"), "https://schemas.example/nlp/v0~draft1/fldic.txt")
    assert {(r.entry_type, tuple(r.tokens), r.score) for r in fldic.read(spark, str(tmp_path / "out")).collect()} == {(k, t, v[0]) for (k, t), v in got.items()}
    bad = tmp_path / "bad.fldic"
    bad.write_text("#~schema: other\n[words]\na\t1\n")
    with pytest.raises(ValueError):
        fldic.read(spark, str(bad))
    bad.write_text("[other]\na\t1\n")
    with pytest.raises(ValueError):
        fldic.read(spark, str(bad), strict=True)
    with pytest.raises(Exception, match="unknown section"):
        fldic.read(spark, str(bad)).collect()


def record(spark, *rows):
    sense = lambda tags=None, form=None, cats=None: (tags, cats and [(c,) for c in cats], form and [(form,)], None)
    return spark.createDataFrame([(w, p, s and [sense(*x) for x in s] if s is not None else None) for w, p, s in rows], lexicon.RECORD)


def test_lexicon_golden(spark):
    df = record(spark, ("a", "noun", [(["obsolete"],), ([],)]), ("b", "noun", [(["vulgar"],), ([],)]), ("c", "noun", []), ("d", "noun", [(None,)]), ("e1", "noun", [([],)]), (None, "noun", [([],)]), ("f", None, [([],)]), ("g", "noun", None))
    totals = lexicon.word_totals(lexicon.senses(df))
    assert {r.word: r["class"] for r in lexicon.classify(totals).collect()} == {"a": "excluded", "b": "offensive", "c": "excluded", "d": "normal", "e1": "invalid"}
    built = lexicon.build_dictionary(df, LexiconConfig(("Own", "d")))
    assert {(r.text, r.score, r.is_possibly_offensive) for r in built.collect()} == {("b", 1, True), ("d", 1, False), ("Own", 1, False)}
    assert lexicon.classify(lexicon.word_totals(lexicon.senses(df.limit(0)))).count() == 0


def test_forms_two_steps_and_cycles(spark):
    df = record(spark, ("x", "verb", [([], "y"), ([], "y")]), ("y", "verb", [([], "z")]), ("z", "verb", [(["obsolete"], "x"), ([],)]), ("z", "noun", [(["obsolete"],)]))
    r = {x.word: x for x in lexicon.word_totals(lexicon.senses(df)).collect()}["x"]
    assert (r.normal, r.deep_normal, r.deep_excluded) == (2, 2 + 2 * 2 * 1 + 2 * 3 * 1, 2 * 3 * 1)


def test_lexicon_rules(spark):
    rules = Rules(("^[b-z]$", "ab+", "no|cd$"), ("t",), ("c",))
    df = spark.createDataFrame([("b", [], []), ("abb", [], []), ("abbx", [], []), ("nox", [], []), ("xcd", [], []), ("cd\n", [], []), ("cd", [], []), ("x1", ["t"], []), ("x2", [], ["c"]), ("x3", None, None)], "w STRING, t ARRAY<STRING>, c ARRAY<STRING>")
    got = {r.w: r.m for r in df.select("w", lexicon.matches(rules, F.col("w"), F.col("t"), F.col("c")).alias("m")).collect()}
    assert got == {"b": True, "abb": True, "abbx": False, "nox": False, "xcd": False, "cd\n": False, "cd": True, "x1": True, "x2": True, "x3": False}


def test_word_lists(spark, tmp_path):
    lines = spark.createDataFrame([("run_VERB\t1999,3,1\t2000,4,2",), ("x_y_NOUN\t2000,1,1",), ("bad\t2000,1",), (None,), ("run\t2001,9223372036854775807,1",)], "line STRING")
    assert {r.word: int(r["count"]) for r in wordlist.add_up(wordlist.line_counts(lines)).collect()} == {"run": 9223372036854775814, "x_y": 1, "bad": 0}
    assert wordlist.line_counts(lines, skip_tagged=True).count() == 2
    path = tmp_path / "w.tsv"
    path.write_text("a\t3\nb\t1\tx\n\nc\tno\na\t2\n")
    counts = wordlist.read_wordlist(spark, str(path))
    base = entries(spark, [word("a", 1), word("z", 1), (1, 2, ["a", "z"], 1, False, False, None)])
    assert {(tuple(r.tokens), r.score) for r in wordlist.score_words(base, counts, 2).collect()} == {(("a",), 6), (("a", "z"), 1)}
    assert {r.word for r in wordlist.exclude(wordlist.add_up(counts), ("b", "[x-z]")).collect()} == {"a"}


SYLLABLES = {"running": "run-n-ing", "happy": "hap-py", "careless": "care-les-s", "table": "ta-ble", "unhappy": "un-hap-py", "rewrite": "re-write", "pickle": "pick-le", "kindness": "kindnes-s", "slowly": "slow-ly", "payment": "paym-ent", "": ""}
COMPAT = SYLLABLES | {"careless": "careles-s", "unhappy": "unhap-py", "rewrite": "rewrite", "pickle": "pic-kle"}


def test_syllables(spark):
    for compat, golden in ((False, SYLLABLES), (True, COMPAT)):
        rules = syllables.compile_rules(json.dumps(SYLLABLE_RULES), compat)
        assert {w: "-".join(syllables.divide(w, rules)) for w in golden} == golden
    df = spark.createDataFrame([("table",), (None,), ("",)], "w STRING")
    assert [r[0] for r in df.select(syllables.divider(syllables.compile_rules(SYLLABLE_RULES))("w")).collect()] == [["ta", "ble"], None, [""]]
    with pytest.raises(ValueError):
        syllables.expand("<Q>x", {})


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(fn.graphemes(F.lit("éa👩‍👩‍👧"))) == ["é", "a", "👩‍👩‍👧"] and one(fn.graphemes(F.lit(""))) == []
    assert one(fn.titlecase(F.lit("o'neil-smith ÉCOLE x2b"))) == "O'neil-Smith École X2b" and one(fn.titlecase(F.lit("ǆ ßa 'tis МИР x’Y"))) == "ǅ Ssa 'Tis Мир X’y" and one(fn.titlecase(F.lit(None).cast("string"))) is None and one(fn.trimmed(F.lit("  a b\t"))) == "a b"
    assert one(fn.split_at(F.lit("a.b.c"), ".", 1)) == ["a", "b.c"] and one(fn.split_at(F.lit("a "), " ")) == ["a", ""]
    assert one(fn.without_pos(F.lit("x_y_NOUN"))) == "x_y" and one(fn.links(F.lit('<li><a href="u">x'))) == ["u"]
    assert one(fn.special_to_id(F.lit(SOS))) == -2 and one(fn.id_to_special(F.lit(-2))) == SOS and one(fn.opposite_case(F.lit("a"))) == "A"
    assert one(fn.padded_context(F.array(F.lit("a")), 2)) == [SOS, "a"] and one(fn.padded_context(F.array(*map(F.lit, "abc")), 2)) == ["b", "c"]
    assert one(fn.in_proximity(F.create_map(F.lit("a"), F.array(F.lit("s"))), F.lit("a"), F.lit("s"))) and not one(fn.in_proximity(F.create_map(F.lit("a"), F.array(F.lit("s"))), F.lit("s"), F.lit("a")))
    assert one(fn.starts_with(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) and one(fn.spelling_label(F.lit(2))) == "typo"
    assert one(fn.segment_sentences(F.lit("One two. Three."))) == [["One", "two"], ["Three"]]
    assert one(fn.find_or(F.create_map(F.lit("a"), F.lit(1)), F.lit("b"), F.lit(7))) == 7


def test_flags_and_session():
    assert Flags(8, 2).pack() == 520 and Flags.unpack(520) == Flags(8, 2)
    f = Flags(255, 15, 3, 2, True, False, True)
    assert Flags.unpack(f.pack()) == f
    s = Session.from_json('{"predictionWeights": {"lookup": {"maxCostSum": 2.0}, "training": {"usageBonus": 5}}, "keyProximityChecker": {"enabled": true, "mapping": {"a": ["q"]}}, "other": 1}')
    assert (s.lookup.max_cost, s.lookup.insert, s.training, s.near_keys) == (2.0, 0.5, Training(5, 1), {"a": ("q",)})
    assert Session.from_json(s.to_json()) == s and s.lookup.reach() == 4
    c = LexiconConfig.from_json('{"projectSpecificWords": ["P"], "filters": [{"name": "root", "excluded": {"words": [], "tags": ["t"], "categories": []}, "offensive": {"words": [], "tags": [], "categories": []}}]}')
    assert c.filter("missing").name == "root" and c.project_words == ("P",)


def test_stream_training(spark, tmp_path):
    from keyloom.streaming.trainer import compact, snapshot, train_stream

    rows = [["a", "b"], ["b"], ["a", "b", "c"]]
    for k, r in enumerate(rows):
        sentences(spark, [r]).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("words ARRAY<STRING>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    train_stream(stream, "words", str(tmp_path / "counts"), str(tmp_path / "cp")).awaitTermination()
    want = {tuple(r.tokens): r.score for r in ngrams.train(ngrams.count_ngrams(sentences(spark, rows), "words")).collect()}
    assert {tuple(r.tokens): r.score for r in snapshot(spark, str(tmp_path / "counts"))[0].collect()} == want
    compact(spark, str(tmp_path / "counts"), str(tmp_path / "one"))
    assert {tuple(r.tokens): r.score for r in snapshot(spark, str(tmp_path / "one"))[0].collect()} == want


def test_raw_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One two. Three\n\n  One\ttwo!  \r\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    rows = sorted(r.words for r in rawtext.read_raw_text(spark, str(tmp_path)).collect())
    assert rows == [["One", "two"], ["One", "two"], ["Three"]]
    entries_, penalty = rawtext.train_raw_text(spark, str(tmp_path))
    assert {tuple(r.tokens): r.score for r in entries_.collect()}[("One", "two")] == 258 and {r.entry_type: r.penalty for r in penalty.collect()} == {1: 5, 2: 5, 3: 5}


def test_archive(spark, tmp_path):
    fldic.write(entries(spark, [word("a", 5), word("b", 6, bad=True)]), str(tmp_path / "en"), "https://schemas.example/nlp/v0~draft1/fldic.txt")
    manifest = {"$": "dictionary", "dictionaries": [{"id": "en", "label": "Größe"}]}
    archive.write_archive(str(tmp_path / "x.flex"), manifest, {"en": str(tmp_path / "en")})
    held = archive.unpack_archive(str(tmp_path / "x.flex"), str(tmp_path / "out"))
    assert {(r.text, r.score, r.is_possibly_offensive) for r in fldic.read(spark, held["en"], strict=True).collect()} == {("a", 5, False), ("b", 6, True)}
    with pytest.raises(ValueError):
        archive.write_archive(str(tmp_path / "y.flex"), manifest, {"de": str(tmp_path / "en")})


def test_a_dictionary_file_in_many_splits(spark, tmp_path):
    rows = [word(f"w{k:04d}", k, bad=k % 7 == 0) for k in range(400)] + [(1, 2, [f"w{k:04d}", f"w{k + 1:04d}"], k, False, False, None) for k in range(300)]
    fldic.write(entries(spark, rows), str(tmp_path / "d"), "https://schemas.example/nlp/v0~draft1/fldic.txt")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(str(tmp_path / "d")).rdd.getNumPartitions() > 3
        got = {(tuple(r.tokens), r.score, r.is_possibly_offensive) for r in fldic.read(spark, str(tmp_path / "d"), strict=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert got == {(tuple(t), s, p) for _, _, t, s, p, _, _ in rows}


def test_lexicon_stats_files(spark, tmp_path):
    df = record(spark, ("a", "noun", [(["obsolete"],), (["t"],)]), ("b", "verb", [([],)]), ("c1", "verb", [(None, None, ["k"])]))
    rows = lexicon.stats(df, lexicon.classify(lexicon.word_totals(lexicon.senses(df))))
    lexicon.write_stats(rows, str(tmp_path / "s"), 2.9)
    found = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "s")).collect()]
    totals = next(x for x in found if "_total_raw_words" in x)
    assert totals == {"_parse_duration_in_seconds": 2, "_total_raw_words": 3, "_total_raw_senses": 4, "_total_words_excluded": 2, "_total_words_offensive": 0, "_total_words_normal": 1}
    assert {(x["stats"], x["name"]): x["n"] for x in found if "stats" in x} == {("pos_stats", "noun"): 1, ("pos_stats", "verb"): 2, ("tag_stats", "obsolete"): 1, ("tag_stats", "t"): 1, ("category_stats", "k"): 1}


def test_unigram_files_out_and_in(spark, tmp_path):
    df = spark.createDataFrame([("1-a.gz", "x\t1"), ("1-b.gz", ""), ("1-a.gz", "x\t1"), ("2-a.gz", "no")], "partition_file STRING, line STRING")
    unigrams.write_unigram_files(df, str(tmp_path / "u"))
    assert sorted(map(tuple, unigrams.read_unigram_files(spark, str(tmp_path / "u")).collect())) == [("1-a.gz", "x\t1"), ("1-a.gz", "x\t1"), ("1-b.gz", "")]
    with pytest.raises(Exception, match="can't be written"):
        unigrams.write_unigram_files(spark.createDataFrame([("1-a.gz", "x\ny")], df.schema), str(tmp_path / "v"))


def test_suggestion_json_and_labels(spark):
    row = spark.range(1).select(fn.suggestion_to_json(F.lit("a"), F.lit(""), F.lit(0.5), F.lit(False), F.lit(True)).alias("x"), fn.shift_label(F.lit(3)).alias("y"), fn.shift_label(F.lit(9)).alias("z")).first()
    assert json.loads(row.x) == {"text": "a", "secondaryText": "", "confidence": 0.5, "isEligibleForAutoCommit": False, "isEligibleForUserRemoval": True} and (row.y, row.z) == ("CL", "??")
    assert spark.range(1).select(fn.suggestion_from_json(F.lit(row.x)).alias("s")).first().s.confidence == 0.5


def test_settled_tables_are_removed(spark):
    import os

    from keyloom import session

    held = session.settled(spark.range(3))
    assert held.count() == 3 and session.drop_settled(spark) >= 1 and session.drop_settled(spark) == 0
    assert not any(n.startswith("table-") for n in os.listdir(session.shared_dir(spark).removeprefix("file:")))


def test_rest_stands_without_llm():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1]
    for p in (root / "keyloom").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "keyloom.llm" not in p.read_text(encoding="utf-8"), p


def test_limits_lose_nothing(spark):
    """With and without the limits on what may follow: the same best words, offensive ones filtered or not."""
    rng = random.Random(9)
    pool = ["".join(rng.choice("abAé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = [word(w, rng.randint(0, 9), d, rng.random() < 0.3, rng.random() < 0.2) for d in (0, 1) for w in sorted(set(rng.sample(pool, 40)))]
    rows += [(0, 2, [h, w], rng.randint(1, 5), rng.random() < 0.3, False, None) for h in ("go", "Go") for w in sorted(set(pool))] + [word("go", 1, 0), word("Go", 1, 0)]
    asked = lambda count: [(k, w, ["go"], Flags(count, 2, offensive=k % 2 == 0, hidden=k % 3 == 0).pack()) for k, w in enumerate(["", "a", "b", "é", "ab", "", "A", "aa"])]
    for more in ({}, {"filter_ngrams": True}):
        every, few = suggest(spark, rows, asked(0), **more), suggest(spark, rows, asked(4), **more)
        assert few == {k: v[:4] for k, v in every.items()} and len(few) == 8
