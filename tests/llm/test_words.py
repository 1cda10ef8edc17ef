import random

import pytest

from keyloom.llm import lookalike, mojibake
from keyloom.llm.lattice import Lattice

WORDS = ["chesdré", "vaca", "skiza shotradri", "o'mipe", "cufiet-thortri", "дяло", "сорех", "тычи", "σήχασο", "χαζος", "ビエロイ", "ガード", "다포산사", "Virsho", "rofiànd", "fluśglist", "thønthar", "ñahi", "glűtdề", "fiflin", "šhorvoudo", "Éclair"]


def lexicon(spark):
    return spark.createDataFrame([(k, w, "n") for k, w in enumerate([*WORDS, None, "vaca"])], "entry_id BIGINT, word STRING, kl_form STRING").drop("kl_form")


def rows(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "row_id BIGINT, word STRING, kl_rank STRING")


LOOK = {
    "vaса": "vaca", "ｖａｃａ": "vaca", " vaca": "vaca", "vaca\u3000": "vaca", "va\u200bca": "vaca", "va\u00adca\ufeff": "vaca", "chesdre\u0301": "chesdré", "сhеsdrе\u0301": "chesdré", "νаcа": "vaca",
    "skiza\u00a0shotradri": "skiza shotradri", "o’mipe": "o'mipe", "oʼmipe": "o'mipe", "cufiet‐thortri": "cufiet-thortri", "cufiet−thortri": "cufiet-thortri", "cоpex": "сорех", "copex": "сорех", "дялo": "дяло",
    "σήχασo": "σήχασο", "ﾋﾞｴﾛｲ": "ビエロイ", "ビエロイ": "ビエロイ", "ｶﾞｰﾄﾞ": "ガード", "다포산사": "다포산사", "ﬁﬂin": "fiflin", "Ѵirѕһо": "Virsho", "glu\u030btde\u0302\u0341".replace("\u0341", "\u0300"): "glűtdề", "Éclаir": "Éclair",
}
NOT_LOOK = ["vaca", None, "", "  ", "vacа b", "vacá", "Vaca", "vаcu", "zzz", "\u200b", "дяла", "chesdre", "x" * 5000]


def test_disguised_words(spark):
    found = {r.word: r.kl_form for r in lookalike.disguised_words(rows(spark, [*LOOK, *NOT_LOOK]), "word", lexicon(spark), "word").collect()}
    assert found == {k: v for k, v in LOOK.items() if k != v}


def test_consistent_forms_keep_what_they_cannot_read(spark):
    got = {r.kl_text: r.kl_forms for r in lookalike.consistent_forms(rows(spark, ["vаcа", "", "漢字漢"]), "word", lexicon(spark), "word").collect()}
    assert got["vаcа"][0] == "vaca" and got[""] == []
    empty = lexicon(spark).limit(0)
    assert lookalike.disguised_words(rows(spark, ["vаcа"]), "word", empty, "word").count() == 0 and lookalike.disguised_words(rows(spark, []), "word", lexicon(spark), "word").count() == 0


def test_many_paths_lose_no_reference_word(spark, monkeypatch):
    """Look-alikes within one script: the word asked for reads worst of 2 ** 6 spellings."""
    words = ["ニロカエタト"] * 5 + ["二口力工夕卜ハ", "ニ口力工夕卜"]
    listed = spark.createDataFrame([(w,) for w in [*words, *("二ロ" + "カエタト" + x for x in "アイウオ")]], "word STRING")
    for held in (4_000_000, 30):
        monkeypatch.setattr(lookalike, "REFERENCE_BYTES", held)
        got = {r.word: r.kl_form for r in lookalike.disguised_words(rows(spark, ["二ロ力工夕卜ハ", "二口カ工タ卜ハ", "ニロ力エ夕トア"]), "word", listed, "word").collect()}
        assert got == {"二ロ力工夕卜ハ": "二口力工夕卜ハ", "二口カ工タ卜ハ": "二口力工夕卜ハ", "ニロ力エ夕トア": "二ロカエタトア"}


def test_scores_count_every_ngram(spark, monkeypatch):
    """Models that are too large to be sent choose among look-alike words as whole ones do; held against plain counts."""
    rng = random.Random(5)
    kana = ["".join(rng.choice("ニ二ロ口カ力エ工") for _ in range(rng.randint(3, 5))) for _ in range(150)]
    listed = sorted({*kana, *WORDS, "1-2", "a-1", "21", "カ-1"})
    other = dict(zip("ニ二ロ口カ力エ工", "二ニ口ロ力カ工エ"))
    asked = sorted({"".join(rng.choice((c, other[c])) for c in w) for w in kana} - set(listed)) + ["vаса", "1‐2", "а-1"]
    grams, letters = {}, {}
    for w in listed:
        script = next((x for x in map(lookalike.script_of, w) if x), "")
        signs = ["^", "^", *lookalike._clusters(w), "$"]
        for k in range(len(signs) - 2):
            own = grams.setdefault(script, {})
            own[tuple(signs[k : k + 3])] = own.get(tuple(signs[k : k + 3]), 0) + 1
            letters.setdefault(script, {}).setdefault(signs[k + 2], []).append(1)
    one = {s: {c: len(letters[""].get(c, [])) + len(x.get(c, [])) for c in {*letters[""], *x}} for s, x in letters.items() if s}
    whole = {s: lookalike.Model({**grams[""], **grams[s]}, one[s]) for s in sorted(one)}
    best, forms, several = {}, {}, 0
    for t in asked:
        hits = [(-x, form) for x, form in lookalike.scored_readings(t, whole, 10_000) if form in listed]
        best |= {t: min(hits)[1]} if hits else {}
        several += len({form for _, form in hits}) > 1
        forms[t] = lookalike.readings(t, whole)
    assert len(best) == len(asked) and several > 20
    reference = spark.createDataFrame([(w,) for w in listed], "word STRING")
    for most, block, held in ((500_000, 500_000, 4_000_000), (3, 500_000, 4_000_000), (3, 40, 300)):
        monkeypatch.setattr(lookalike, "MODEL_ROWS", most)
        monkeypatch.setattr(lookalike, "BLOCK_BYTES", block, raising=False)
        monkeypatch.setattr(lookalike, "REFERENCE_BYTES", held)
        assert {r.word: r.kl_form for r in lookalike.disguised_words(rows(spark, [*asked, None, ""]), "word", reference, "word").collect()} == best
        assert {r.kl_text: r.kl_forms for r in lookalike.consistent_forms(rows(spark, asked), "word", reference, "word").collect()} == forms
    empty = rows(spark, [])
    assert lookalike.disguised_words(empty, "word", reference, "word").count() == 0 and lookalike.consistent_forms(empty, "word", reference, "word").count() == 0


def test_viterbi_stays_in_one_script():
    grams = {}
    for w in ("рос", "сор"):
        p = ["^", "^", *w, "$"]
        for k in range(len(p) - 2):
            grams[tuple(p[k : k + 3])] = grams.get(tuple(p[k : k + 3]), 0) + 1
    latin = {("^", "^", "p"): 1, ("^", "p", "o"): 1, ("p", "o", "c"): 1, ("o", "c", "$"): 1}
    models = {"CYRILLIC": lookalike.Model(grams), "LATIN": lookalike.Model(latin)}
    got = lookalike.readings("pоc", models)
    assert set(got) == {"poc", "рос"} and all(len({lookalike.script_of(c) for c in w}) == 1 for w in got)


def broken(word, *chain):
    for true, read in chain:
        word = word.encode(true).decode(read)
    return word


MOJIBAKE = {
    broken("chesdré", ("utf-8", "cp1252")): "chesdré", broken("chesdré", ("utf-8", "cp1252"), ("utf-8", "cp1252")): "chesdré", broken("дяло", ("utf-8", "cp1251")): "дяло", broken("дяло", ("cp1251", "cp1252")): "дяло",
    broken("дяло", ("cp866", "cp1251")): "дяло", broken("тычи", ("koi8-r", "cp1251")): "тычи", broken("χαζος", ("iso8859_7", "cp1252")): "χαζος", broken("ビエロイ", ("shift_jis", "latin-1")): "ビエロイ", broken("ガード", ("euc_jp", "latin-1")): "ガード",
    broken("다포산사", ("euc_kr", "cp1252")): "다포산사", broken("thønthar", ("utf-8", "mac_roman")): "thønthar", broken("rofiànd", ("utf-8", "cp850")): "rofiànd", broken("fluśglist", ("cp1250", "cp1252")): "fluśglist",
    broken("chesdré", ("utf-8", "cp1252")).lower(): "chesdré", broken("дяло", ("utf-8", "cp1251")).lower(): "дяло", "д" + broken("яло", ("utf-8", "cp1251")): "дяло", broken("σήχασο", ("utf-8", "latin-1")): "σήχασο",
    broken("glűtdề", ("utf-8", "latin-1")): "glűtdề", broken("rofià", ("utf-8", "latin-1")) + "nd": "rofiànd", broken("rofià", ("utf-8", "latin-1")).replace("\xa0", " ") + "nd": "rofiànd",
}
LOST = [broken("дяло", ("utf-8", "latin-1")).encode("latin-1").decode("cp1252", "replace"), broken("сорех", ("utf-8", "latin-1")).encode("latin-1").decode("cp1252", "replace"), "chesdr?", "chesdr�", "chesdr��", "?ahi", "th?nthar", "rofi�nd", "����", "????????"]
FINE = ["chesdré", None, "", "vaca?", "zzz?", "vacä", "Ã", "мышь", "x" * 3000 + "é", "?", "a" * 40]


def test_damaged_words(spark):
    found = {r.word: r.kl_form for r in mojibake.damaged_words(rows(spark, [*MOJIBAKE, *LOST, *FINE]), "word", lexicon(spark), "word").collect()}
    assert found == {**MOJIBAKE, **dict.fromkeys(LOST, "")}


def test_damage_edges(spark):
    assert mojibake.damaged_words(rows(spark, []), "word", lexicon(spark), "word").count() == 0
    assert mojibake.damaged_words(rows(spark, list(MOJIBAKE)), "word", lexicon(spark).limit(0), "word").count() == 0


def test_reference_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(mojibake, "DICTIONARY_BYTES", 100)
    few = [x for x in MOJIBAKE if MOJIBAKE[x] in ("дяло", "rofiànd", "ビエロイ")]
    found = {r.word: r.kl_form for r in mojibake.damaged_words(rows(spark, few), "word", lexicon(spark), "word").collect()}
    assert found == {k: MOJIBAKE[k] for k in few}


def test_languages_of_a_column(spark):
    listed = spark.createDataFrame([(w, "xyz"[k % 3]) for k, w in enumerate(WORDS)], "word STRING, own STRING")
    describer, _ = mojibake.train(listed, "word", "own")
    assert set(describer.words) == {"x", "y", "z"} and describer.length("chesdré") < 16
    found = {r.word: r.kl_form for r in mojibake.damaged_words(rows(spark, list(MOJIBAKE)), "word", listed, "word", "own").collect()}
    assert found == MOJIBAKE


def test_candidates_stay_few(spark):
    """Every accented letter has several readings; their combinations are never listed."""
    import time

    words = sorted(WORDS)
    letters = frozenset("".join(WORDS) + "".join(map(chr, range(0x410, 0x450))) + "éèàùçÉÈÀÙÇ")
    pairs = mojibake.pair_scores(words)
    for text in ("дЯло" * 50, "é" * 200, "Ã©" * 100, broken("дяло" * 50, ("cp1251", "cp1252")), "дяло" * 10, "�" * 200):
        began = time.time()
        assert len(mojibake.candidates(text, letters, words, pairs)) < 5000 and time.time() - began < 20
    assert "дяло" in mojibake.candidates(broken("дяло", ("cp1251", "cp1252")), letters, words, pairs)


def test_lattice_walk_finds_every_word():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 6)
        edges = [[(rng.choice("abc"), min(n, k + rng.randint(1, 2)), rng.choice([0, 1])) for _ in range(rng.randint(0, 3))] for k in range(n)] + [[]]
        lattice = Lattice(edges, frozenset([n]))
        every = set(lattice.all())
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(40)})
        assert set(lattice.along(words)) == {x for x in every if x[0] in words}
        pairs = {a + b: rng.random() for a in "abc\n" for b in "abc\n"}
        score = lambda t: sum(pairs[x] for x in map("".join, zip("\n" + t, t + "\n")))
        ranked = sorted((round(score(t), 9) for t, _ in every), reverse=True)
        assert [round(score(t), 9) for t, _ in lattice.best(pairs, 3)][: len(ranked)][:1] == ranked[:1]


@pytest.mark.parametrize("seed", [1])
def test_random_chains_come_back(seed):
    rng = random.Random(seed)
    letters = frozenset("".join(WORDS))
    describer = mojibake.Describer({s: [w for w in WORDS if mojibake._script(w) == s] for s in {mojibake._script(w) for w in WORDS}})
    words = sorted(WORDS)
    pairs = mojibake.pair_scores(words)
    tried = right = 0
    for _ in range(200):
        w = rng.choice([x for x in WORDS if not x.isascii()])
        codec = rng.choice(["cp1252", "latin_1", "cp1251", "cp850", "koi8_r", "mac_roman"])
        try:
            bad = w.encode().decode(codec)
        except UnicodeDecodeError:
            continue
        tried += 1
        right += w in [t for _, t in mojibake.restore(bad, describer, letters, words, pairs)]
    assert tried > 50 and right >= 0.98 * tried
