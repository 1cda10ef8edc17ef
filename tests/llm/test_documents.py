import base64
import os
import quopri
import random

import pytest
from pyspark.sql import functions as F

from keyloom.llm import leak, mime, sentences, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", 7) for k, t in enumerate(texts)], "doc_id BIGINT, text STRING, kl_doc STRING, ids INT")


@needs_vocabulary
def test_ids_against_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    signs = "ab1 \t\n\r\x0b\x1c\x85\xa0\u2003\u3000'sé²Ⅷ٣ा\u0301\ufeff漢😀.,-<|endoftext|>"
    texts = ["", None, " ", "<|endoftext|>", "the " * 30_000, *("".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(300))]
    monkeypatch.setattr(tokens, "BLOCK_DOCS", 40)
    df = docs(spark, [*texts, texts[-1]]).repartition(3)
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}
    t = Tokenizer.from_file(os.path.join(os.path.dirname(tokens.VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert got == {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate([*texts, texts[-1]])}
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert back == {k: x or "" for k, x in enumerate([*texts, texts[-1]])}
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    lists = spark.createDataFrame([(1, None), (2, [])], "doc_id BIGINT, ids ARRAY<INT>")
    assert {r.text for r in tokens.decode_corpus(lists).collect()} == {""}


def mail(*parts, boundary="b1", end=True, line="\n"):
    out = [f'From: a@b.test{line}Content-Type: multipart/mixed;{line} boundary="{boundary}"{line}']
    out += [f"--{boundary}{line}{head.replace(chr(10), line)}{line}{line}{body.replace(chr(10), line)}" for head, body in parts]
    return line.join(out) + (f"{line}--{boundary}--{line}" if end else "")


PLAIN, HTML = "Content-Type: text/plain; charset=utf-8", "Content-Type: text/html; charset=utf-8"


@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_parts(line):
    b64 = lambda s, c="utf-8": base64.encodebytes(s.encode(c)).decode()
    inner = 'Content-Type: multipart/alternative; boundary="b2"\n\n--b2\n' + PLAIN + "\n\ninner\n--b2\n" + HTML + "\n\n<p>in<b>ner</b><br>two &amp; three</p>\n--b2--"
    text = mail(
        ("Content-Type: text/plain; charset=windows-1252\nContent-Transfer-Encoding: base64", b64("Größe", "cp1252")), (PLAIN + "\nContent-Transfer-Encoding: quoted-printable", quopri.encodestring("Grüße=x".encode()).decode()),
        (PLAIN + '; name="a.txt"\nContent-Disposition: attachment; filename="a.txt"', "attached"), ("Content-Type: image/png\nContent-Transfer-Encoding: base64", b64("no")), tuple(inner.split("\n\n", 1)), line=line,
    )
    got = mime.parts(text)
    assert [(p.kind, p.attached, p.text.strip()) for p in got[:4]] == [("text/plain", False, "Größe"), ("text/plain", False, "Grüße=x"), ("text/plain", True, "attached"), ("text/plain", False, "inner")]
    assert mime.readable(text)[-1].split() == ["inner", "two", "&", "three"] and mime.plain_body(text).strip() == "Größe"


def test_odd_messages():
    assert mime.parts("") == [] and mime.plain_body("Subject: x") is None and mime.plain_body("Subject: x\n\nbody") == "body"
    assert mime.plain_body(mail((HTML, "<p>x</p>"))) is None and mime.plain_body(mail((PLAIN, "cut off"), end=False)) == "cut off"
    deep = "Content-Type: text/plain\n\nbottom"
    for k in range(60):
        deep = f'Content-Type: multipart/mixed; boundary="b{k}"\n\n--b{k}\n{deep}\n--b{k}--' if k % 2 else f"Content-Type: message/rfc822\n\n{deep}"
    assert [p.text for p in mime.parts(deep)] == ["bottom"]
    forwarded = "Content-Type: message/rfc822\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(b"Subject: x\n\ninner").decode()
    assert mime.readable(forwarded) == ["inner"] and mime.parts("Content-Type: multipart/mixed; boundary=x\n\n") == []
    cut = "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode("abcé".encode()).decode()[:-2]
    assert mime.plain_body(cut).startswith("abc") and mime.html_text("<style>p{}</style><!-- c -->a<script>x</script>b").split() == ["a", "b"]


ITEM = "one silver glacier reflects another turbine and carries every narrow harbour beyond the old furnace today"


def test_leaks_against_shingles(spark, monkeypatch):
    monkeypatch.setattr(leak, "BLOCK_DOCS", 3)
    words = ITEM.split()
    near = " ".join(w if k % 6 else "other" for k, w in enumerate(words))
    quoted = "\n".join("> " + " ".join(words[k : k + 4]).upper() for k in range(0, len(words), 4))
    b64 = "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64"
    texts = [
        "S: x\n\n" + ITEM, "S: x\n\n" + " ".join(words[2:14]), "S: x\n\n" + " ".join(words[2:13]), "S: x\n\n" + near, "S: x\n\nsaid:\n" + quoted, mail((b64, base64.b64encode(ITEM.encode()).decode())),
        mail((HTML, "<p>" + ITEM.replace("glacier", "gla<b>cier</b>") + "</p>")), mail((PLAIN, " ".join(words[:8])), (PLAIN, " ".join(words[8:]))), f"Subject: {ITEM}\n\nno", None, "", mail(("Content-Type: application/pdf", ITEM)), "S: x\n\n" + ITEM,
    ]
    items = spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None), (4, ""), (5, ITEM.title()), (6, "a b c d e f g h i j k l m")], "item_id BIGINT, text STRING")
    got = {(r.doc_id, r.item_id) for r in leak.leaked_items(docs(spark, texts), "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(d, i) for d in (0, 1, 4, 5, 6, 12) for i in (1, 5)}
    terms = sorted({w for t in [ITEM, "a b c d e f g h i j k l m"] for w in leak.words_of(t)})
    index = leak.build_index(docs(spark, texts), "doc_id", "text", terms, 2)
    assert {(r.doc_id, r.item_id) for r in leak.leaked_items(docs(spark, texts), "doc_id", "text", items, "item_id", "text", index=index).collect()} == got
    monkeypatch.setattr(leak, "TERMS", 5)
    monkeypatch.setattr(leak, "ITEMS_AT_ONCE", 1)
    assert {(r.doc_id, r.item_id) for r in leak.leaked_items(docs(spark, texts), "doc_id", "text", items, "item_id", "text").collect()} == got
    assert leak.leaked_items(docs(spark, []), "doc_id", "text", items, "item_id", "text").count() == 0 and leak.leaked_items(docs(spark, texts), "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


@pytest.mark.parametrize("slack", [0, 1, 2])
def test_proximity_against_every_place(spark, slack, monkeypatch):
    """Near-misses: words moved, left out and put in, and passages that run over two parts or two messages."""
    monkeypatch.setattr(leak, "BLOCK_DOCS", 4)
    rng = random.Random(slack)
    length = 5
    items = [[rng.choice("abcdefgh") * 2 for _ in range(rng.randint(4, 9))] for _ in range(12)]
    bodies = []
    for _ in range(60):
        own = list(rng.choice(items))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(own))
            rng.choice([lambda: own.insert(k, "zz"), lambda: own.pop(k), lambda: own.insert(rng.randrange(len(own)), own.pop(k))])()
        cut = rng.randint(0, len(own))
        bodies.append([own] if rng.random() < 0.6 else [own[:cut], own[cut:]])
    bodies += [[items[0][:3]], [items[0][3:]]]  # one message goes on where the other ends
    texts = [mail(*((PLAIN, " ".join(p)) for p in b)) for b in bodies]

    def near(part, window):
        at = {}
        for k, w in enumerate(part):
            at.setdefault(w, []).append(k)
        return any(all(any(abs(x - b - k) <= slack for x in at.get(w, ())) for k, w in enumerate(window)) for b in range(-slack, len(part) + slack))

    want = {(d, i) for d, b in enumerate(bodies) for i, words in enumerate(items) if any(near(p, words[f : f + length]) for p in b for f in range(len(words) - length + 1))}
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id BIGINT, text STRING")
    got = leak.leaked_items(docs(spark, texts), "doc_id", "text", tests, "item_id", "text", length, slack).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and (slack == 0 or len(want) > 5)


FILLER = ["We moved the paint order.", "Was it late?", "Thanks for the rope!", "The ledger is heavy."]


def corpus():
    """Bodies that show how words are used; what is asked about comes once more in the tests."""
    rng = random.Random(2)
    kinds = [
        lambda: f"Dr. {rng.choice(['Lote', 'Elmi', 'Vara'])} looked at no. {rng.randint(10, 99)} again.", lambda: f"It weighs approx. {rng.randint(10, 99)} kg.", lambda: f"S. E. {rng.choice(['Taqua', 'Bo'])} of Mivo Ltd. signed it.",
        lambda: "Wait... the gate was open.", lambda: f"The sum is {rng.randint(100, 999)}.{rng.randint(10, 99)}.", *([lambda: rng.choice(FILLER)] * 3),
    ]
    blocks = ["\n\n".join(" ".join(rng.choice(kinds)() for _ in range(3)) for _ in range(4)) for _ in range(150)]
    german = ["\n\n".join(" ".join(rng.choice(["Das Treffen ist im 5. Stock.", "Das Treffen ist im 7. Stock.", "Die Nr. 76 fehlt, d. h. sie ist weg.", "Wir kommen nicht.", "Ist der Weg frei?"]) for _ in range(3)) for _ in range(4)) for _ in range(60)]
    return ["Subject: x\n\n" + b for b in (*blocks, *german)]


CASES = {
    "Dear Mr. X:\n\nDr. Vara asked about\nno. 93 today. We agreed\n\n> quoted. text.\n\nOk.": ["Dr. Vara asked about no. 93 today.", "We agreed", "Ok."],
    '"We never ordered rope!" wrote R. Bo in the note. He said, "Leave it." The end.': ['"We never ordered rope!" wrote R. Bo in the note.', 'He said, "Leave it."', "The end."],
    "(It can stay.) See http://a.test/b.html for v. 8.3.39. Wait... the door was shut?! Ok": ["(It can stay.)", "See http://a.test/b.html for v. 8.3.39.", "Wait... the door was shut?!", "Ok"],
    "The sum is 814.75. The rest is late": ["The sum is 814.75.", "The rest is late"],
    "Das Treffen ist im 5. Stock. »Wo ist der Weg?«, fragte Bo. „Er ist frei!“, rief Elmi.": ["Das Treffen ist im 5. Stock.", "»Wo ist der Weg?«, fragte Bo.", "„Er ist frei!“, rief Elmi."],
    "« Qui est là ? » demanda Bo. Quel registre ! On a vu le port.": ["« Qui est là ? » demanda Bo.", "Quel registre !", "On a vu le port."],
    "沃林问：“谁动了水表？”请看第2.55节。“很重！”沃林说。在吗？": ["沃林问：“谁动了水表？”", "请看第2.55节。", "“很重！”沃林说。", "在吗？"],
    "「どこですか。」と彼は聞いた。ベノルさんは「足りない！」と言った。了解です。": ["「どこですか。」と彼は聞いた。", "ベノルさんは「足りない！」と言った。", "了解です。"],
    "यह भारी है। “गीला है!” मीरादा ने कहा। क्या आप आएँगे?": ["यह भारी है।", "“गीला है!” मीरादा ने कहा।", "क्या आप आएँगे?"],
    "Πού είναι ο πάγκος; Ελάτε την Τρίτη.": ["Πού είναι ο πάγκος;", "Ελάτε την Τρίτη."],
    "هل الستار عندكم؟ «الدفتر رطب!» قالت ميرادا.": ["هل الستار عندكم؟", "«الدفتر رطب!» قالت ميرادا."],
    "ขอบคุณค่ะ มิราดาส่งไปแล้ว\nวันพุธเรา": ["ขอบคุณค่ะ", "มิราดาส่งไปแล้ว", "วันพุธเรา"],
    "ገጽ 23 ይታያል። ሰኞ እንገናኝ!": ["ገጽ 23 ይታያል።", "ሰኞ እንገናኝ!"],
    "«Это журнал!» — сказал Медо. Где склад?": ["«Это журнал!» — сказал Медо.", "Где склад?"],
    "Hello,\nwe wait.\n-- \nName. Street.": ["Hello, we wait."], "a.\n__________\nb.": ["a."], "a.\n-----Original Message-----\nb.": ["a."], "a. a. Same.  Same.": ["a. a. Same.", "Same."],
}


def test_sentences(spark, monkeypatch):
    learning = corpus()
    label = lambda t: "de" if "Das " in t or "Nr." in t or "Wir " in t else "fr" if "« Qui" in t else "en"
    df = docs(spark, [*learning, *("Subject: x\n\n" + c for c in CASES), None, "", "  ", "Content-Type: text/html\n\n<p>Hi.</p>"])
    got: dict[int, set[str]] = {}
    df = df.withColumn("own", F.udf(lambda t: label(t or ""), "string")("text"))
    for r in sentences.sentences(df, "doc_id", "text", "own").filter(F.col("doc_id") >= len(learning)).collect():
        assert r.sentence not in got.setdefault(r.doc_id, set())
        got[r.doc_id].add(r.sentence)
    assert {k - len(learning): v for k, v in got.items()} == {k: set(v) for k, v in enumerate(CASES.values())}
    assert sentences.sentences(df.limit(0), "doc_id", "text", "own").count() == 0
    few = {(r.doc_id, r.sentence) for r in sentences.sentences(df, "doc_id", "text", "own").collect()}
    monkeypatch.setattr(sentences, "MODEL_ROWS", 3)
    assert {(r.doc_id, r.sentence) for r in sentences.sentences(df, "doc_id", "text", "own").collect()} == few


def test_long_tokens_and_many_marks():
    """Words are taken whole, and marks are looked at in linear time."""
    import time

    word = "Donau" + "dampf" * 30
    m = next(sentences.marks(f"{word}. {word.upper()} x"))
    assert m.before == word.lower() and m.first == word.upper()
    began = time.time()
    for text in ("a?b" * 50_000, "x.. " * 50_000, "啊…" * 50_000, "-. " * 50_000, ". " * 50_000, '"a." ' * 20_000, "a" * 200_000 + "."):
        sum(1 for _ in sentences.marks(text))
    assert time.time() - began < 30


def test_languages_are_learned(spark):
    rng = random.Random(6)
    words = {"aa": ["mo", "ti", "re", "sa"], "bb": ["lu", "ti", "ke", "no"], "cc": ["zz"]}
    rows = [(" ".join(rng.choice(words[k]) for _ in range(12)), k) for k in ["aa"] * 60 + ["bb"] * 40 + ["cc"]]
    df = spark.createDataFrame([("S: x\n\n" + t, k) for t, k in rows] + [(None, "aa"), ("S: x\n\nслово", "ru"), ("S: x\n\nmo", None)], "text STRING, own STRING")
    tongues = sentences.learn_languages(df, "text", "own")
    assert tongues.most == "aa" and {k for w in tongues.words.values() for k, _ in w} == {"aa", "bb"} and "ti" not in tongues.words
    assert sentences.languages_of(["mo re.", "lu ke lu", "x", "слово"], tongues)[:2] == ["aa", "bb"] and sentences.languages_of(["слово"], tongues) == ["ru"]
    assert sentences.languages_of(["x y"], tongues) == ["aa"] and sentences.languages_of(["x y"], sentences.learn_languages(df, "text", None)) == ["latin"]
