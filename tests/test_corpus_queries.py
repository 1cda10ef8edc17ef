"""The queries over the whole corpus against brute force, on a small table of messages."""

from collections import Counter

import pytest
import regex

import __spark_entry__
from keyloom.config import SOS
from keyloom.sources import fldic

TEXTS = [
    "To be or not to be, that's the question.", "to BE or not", "Θέλω να πάω. Θέλω νερό!", "слово за слово", None, "", " ", "one", "42 17",
    "je veux être là", "मैं घर जाता हूँ", " ".join(f"w{'abc'[k % 3]} x{'de'[k % 2]}" for k in range(3000)),
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = [(k, t, [None, "en", "EN", "de", "el", "ru"][k % 6]) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "another text")], "item_id BIGINT, text STRING").write.parquet(f"{d}/eval_items.parquet")
    return d


def run(spark, d, name):
    return Counter(tuple(r) for r in __spark_entry__.queries()[name](spark, d).collect())


def words(text):
    return regex.findall(r"[\p{L}']+", text or "")


def grams():
    found = Counter()
    for t in TEXTS:
        own = words(t)
        for n in (1, 2, 3):
            padded = [SOS] * (n - 1) + own
            found.update(tuple(padded[k : k + n]) for k in range(len(own)))
    return found


def test_ngrams_of_the_corpus(spark, corpus):
    g = grams()
    total = Counter()
    for t, n in g.items():
        total[len(t)] += n
    trained = Counter((" ".join(t), len(t), n * 129) for t, n in g.items())
    for name in ("ngram_train", "incremental_merge", "stream_train"):
        assert run(spark, corpus, name) == trained, name
    assert run(spark, corpus, "penalised_scores") == Counter((" ".join(t), len(t), n * 129 - total[len(t)]) for t, n in g.items())
    clamped = Counter((k, sum(max(n * 129 - total[k], 0) for t, n in g.items() if len(t) == k), sum(len(t) == k for t in g)) for k in (1, 2, 3))
    assert run(spark, corpus, "reload_clamp") == clamped
    assert run(spark, corpus, "ngram_presence") == Counter((" ".join(x),) for x in {t[:k] for t in g for k in range(1, len(t) + 1)})
    assert run(spark, corpus, "codec_roundtrip") == Counter((len(t), " ".join(t), n * 129, len(t) == 1 and len(t[0]) % 2 == 0, len(t) == 1 and len(t[0]) % 3 == 0, None) for t, n in g.items()) + Counter([(-1, "brb", 1, False, False, "be right back")])
    upper = {tuple(x.upper() for x in t) for t in g if len(t) == 2}
    alike = Counter((" ".join(t), " ".join(u)) for t in g if len(t) == 2 for u in upper if [x.lower() for x in t] == [x.lower() for x in u])
    assert run(spark, corpus, "context_ignoring_case") == alike


def test_next_words_of_the_corpus(spark, corpus):
    pairs = {t: n * 129 for t, n in grams().items() if len(t) == 2}
    bottom = sum(pairs.values()) + len(pairs)
    want = Counter()
    for k, t in enumerate(TEXTS):
        if len(own := words(t)) > 1:
            best: dict[str, float] = {}
            for (a, b), score in pairs.items():
                if a.lower() == own[-2].lower():
                    best[b] = max(best.get(b, 0), (1 + 0.1 * ((score + 1) / bottom)) / 1.1)
            ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
            want.update((k, rank, b, round(c, 9)) for rank, (b, c) in enumerate(ranked, 1))
    assert run(spark, corpus, "next_word") == want


def test_every_language_is_a_dictionary(spark, corpus):
    counts: dict[str | None, Counter] = {}
    for (t, lang) in ((t, [None, "en", "EN", "de", "el", "ru"][k % 6]) for k, t in enumerate(TEXTS)):
        if words(t):
            counts.setdefault(lang, Counter()).update(words(t))
    assert None in counts and len(counts) > 2
    want = Counter()
    for w in {w for c in counts.values() for w in c}:
        there = [(c[w], sum(c.values()) + len(c)) for c in counts.values() if w in c]
        want[w, sum(n for n, _ in there), round(sum((n + 1) / bottom for n, bottom in there) / len(there), 9)] += 1
    assert run(spark, corpus, "multi_dict_merge") == want


def test_sentences_of_the_corpus(spark, corpus):
    got = run(spark, corpus, "sentence_segment")
    assert {k for k, _, _ in got} == {k for k, t in enumerate(TEXTS) if t} and got[6, 0, ""] == 1  # a blank is a sentence without words
    assert got[2, 0, "Θέλω να πάω"] == 1 and got[2, 1, "Θέλω νερό"] == 1 and got[10, 0, TEXTS[10]] == 1
    assert got[11, 0, TEXTS[11]] == 1  # a long text comes out whole


def test_header_of_many_lines(spark):
    many = [(f"f{k}", 1, f"#~ note {k}: x") for k in range(3000)]
    frame = lambda *more: spark.createDataFrame([*many, *(("z", 2, x) for x in more)], "path STRING, line_no INT, line STRING")
    fldic.check_header(frame().unionByName(spark.createDataFrame([("z", 3, "[words]"), ("z", 4, "#~ schema: y")], "path STRING, line_no INT, line STRING")))  # a comment behind the header
    good = (f"#~ schema: https://x{fldic.SCHEMA_END}", f"#~ encoding: {fldic.ENCODING}")
    fldic.check_header(frame(*good), strict=True)
    for bad, strict in ((("#~ schema: y",), False), (("#~ encoding: latin1",), False), (good[:1], True)):
        with pytest.raises(ValueError):
            fldic.check_header(frame(*bad), strict=strict)
