"""One consistent form for text that looks the same but is spelled with other characters.

Every distinct word is brought to its compatibility form without ignorable characters, opened into a lattice of the
characters each visible sign may stand for, and read off by a Viterbi search under the character n-gram scores of one
script: a path stays within a script, and the n-grams are those of the reference words of that script. The best paths
are then held against the reference words by an equi-join; of a lattice with more paths than are kept, all that are
reference words come along.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.lattice import Lattice
from keyloom.llm.reference import reference_words, spread, unlisted, word_pieces
from keyloom.session import settled

# Signs that look alike in common typefaces, one class a line. Accents are left out: they are separate
# marks after decomposition, so that a class of base letters covers its accented forms as well.
ALIKE = """
a а ɑ α ⍺
b Ꮟ ᖯ
c с ϲ ᴄ ꮯ
d ԁ ⅾ ꓒ
e е ҽ ℮
f ꬵ ꞙ ẝ
g ɡ ց
h һ հ
i і ɩ ι ꙇ Ꭵ
j ј ϳ
k ĸ
l ӏ ⅼ ǀ
n ո
o о ο օ ᴏ ჿ ഠ
p р ρ ⍴
q ԛ գ
r ꭇ ꮁ
s ѕ ꜱ ꮪ
u ս υ ᴜ ꭎ
v ν ѵ ᴠ ꮩ
w ԝ ѡ ᴡ ꮃ
x х ᕽ
y у ү γ ʏ
z ᴢ ꮓ
A А Α Ꭺ ᗅ ꓮ
B В Β Ᏼ ᗷ ꓐ
C С Ϲ Ꮯ ꓚ
D Ꭰ ꓓ
E Е Ε Ꭼ ꓰ
F Ϝ ꓝ
G Ԍ Ꮐ ꓖ
H Н Η Ꮋ ꓧ
I І Ι Ӏ ꓲ
J Ј Ꭻ Ϳ ꓙ
K К Κ Ꮶ ꓗ
L Ꮮ ꓡ
M М Μ Ꮇ ꓟ
N Ν ꓠ
O О Ο Օ ꓳ
P Р Ρ Ꮲ ꓑ
Q Ԛ
R Ꭱ ꓣ
S Ѕ Տ Ꮪ ꓢ
T Т Τ Ꭲ ꓔ
U Ս ꓴ
V Ѵ Ꮩ ꓦ
W Ԝ Ꮃ ꓪ
X Х Χ ꓫ
Y Υ Ү Ꮍ ꓬ
Z Ζ Ꮓ ꓜ
к κ ĸ
в ʙ ᏼ
м ᴍ
н ʜ
т ᴛ τ
п ᴨ π
г ᴦ
л ᴫ
я ᴙ
з ɜ
э ɘ
φ ф ɸ
Γ Г
Π П
Λ Л
Φ Ф
ニ 二
ロ 口
カ 力
エ 工
タ 夕
ト 卜
ハ 八
ヘ へ
ベ べ
ペ ぺ
リ り
ミ 三
チ 千
オ 才
ー 一
- ‐ ‑ ‒ – — ― − ⁃ ˗
' ’ ‘ ʼ ʹ ′ ‛ ʻ ʽ ꞌ ` ´ ˈ
"""

_BLANKS = {c: " " for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
#: Best paths that a search keeps.
PATHS = 8
#: Most n-grams of the models that are sent to every executor; more are joined to what blocks of texts ask for.
MODEL_ROWS = 500_000
#: About the bytes of the texts that are scored together with their own part of larger models.
BLOCK_BYTES = 500_000
#: Most bytes of reference words that a task holds; with more, the pieces follow each other.
REFERENCE_BYTES = 4_000_000


@lru_cache(maxsize=1)
def _classes() -> dict[str, str]:
    """Sign to the signs of its class."""
    out: dict[str, str] = defaultdict(str)
    for line in ALIKE.split("\n"):
        signs = line.split()
        for s in signs:
            out[s] = "".join(dict.fromkeys(out[s] + "".join(signs)))
    return dict(out)


@lru_cache(maxsize=100_000)
def script_of(sign: str) -> str:
    """Script of a letter by the first word of its Unicode name; empty for signs that all scripts share."""
    if not (sign.isalpha() or unicodedata.category(sign) == "Lm") or sign in "ー":
        return ""
    name = unicodedata.name(sign, "?").split()[0]
    return "KANA" if name in ("KATAKANA", "HIRAGANA", "CJK", "KATAKANA-HIRAGANA") else name.split("-")[0]


def plain(text: str) -> str:
    """Compatibility form without ignorable characters; blanks become single-width ones and leave at the ends."""
    import regex

    kept = regex.sub(r"\p{Default_Ignorable_Code_Point}", "", text).translate(_BLANKS).strip(" ")
    if kept.isascii():
        return kept
    kept = unicodedata.normalize("NFC", "".join(map(_compatible, kept)))
    return regex.sub(r"\p{Default_Ignorable_Code_Point}", "", kept)


@lru_cache(maxsize=100_000)
def _compatible(sign: str) -> str:
    """Compatibility form of one sign; spacing accents stay, as their form would bring in a blank."""
    if sign in "\u309b\u309c":  # spacing voice marks look like the combining ones behind their letter
        return chr(ord(sign) - 2)
    form = unicodedata.normalize("NFKC", sign)
    return sign if form[:1] == " " else form


def _clusters(text: str) -> list[str]:
    """Base signs with their combining marks, composed."""
    out: list[str] = []
    for c in unicodedata.normalize("NFC", text):
        if out and unicodedata.combining(c):
            out[-1] += c
        else:
            out.append(c)
    return out


@lru_cache(maxsize=200_000)
def _readings(cluster: str) -> dict[str, tuple[str, ...]]:
    """Script to the clusters of that script that look like this one; shared signs are under the empty name."""
    parts = unicodedata.normalize("NFD", cluster)
    out: dict[str, list[str]] = defaultdict(list)
    composed = unicodedata.normalize("NFC", cluster)
    out[script_of(composed[0])].append(composed)
    for base in dict.fromkeys(_classes().get(parts[0], "") + ("".join(_classes().get(composed[0], "")) if len(composed) == 1 else "")):
        tail = parts[1:] if base in _classes().get(parts[0], "") else ""
        other = unicodedata.normalize("NFC", base + tail)
        if other not in out[script_of(base)]:
            out[script_of(base)].append(other)
    return {k: tuple(v) for k, v in out.items()}


class Model:
    """Trigram scores of clusters, by script, with back-off to bigrams and single clusters (``letters``: counts of all).

    ``pairs``: counts of the bigrams, where ``grams`` is only a part of the trigrams.
    """

    def __init__(self, grams: dict[tuple[str, str, str], int], letters: dict[str, int] | None = None, pairs: dict[tuple[str, str], int] | None = None):
        self.three = grams
        self.two: dict[tuple[str, str], int] = defaultdict(int, pairs or {})
        self.one: dict[str, int] = defaultdict(int, letters or {})
        for (a, b, c), n in grams.items():
            if pairs is None:
                self.two[a, b] += n
            if not letters:
                self.one[c] += n
        self.all = sum(self.one.values()) or 1
        self._options: dict[str, tuple[str, ...]] = {}

    def options(self, cluster: str, script: str) -> tuple[str, ...]:
        """Clusters of the script that this one may stand for: those the reference is written with, else itself."""
        if (known := self._options.get(cluster)) is None:
            alike = _readings(cluster)
            both = (*alike.get(script, ()), *alike.get("", ()))
            own = both[:1] if both and both[0] == cluster else ()
            known = self._options[cluster] = tuple(c for c in both if c in self.one) or own
        return known

    def score(self, a: str, b: str, c: str) -> float:
        n = self.three.get((a, b, c), 0)
        low = (self.one.get(c, 0) + 0.01) / (self.all + 1)
        return math.log((n + 2 * low) / (self.two.get((a, b), 0) + 2))


def _ways(word: str, models: dict[str, Model]) -> dict[str, list[tuple[str, ...]]]:
    """Script to the options of a word's places; scripts that can't spell it are left out."""
    clusters = _clusters(plain(word))
    ways = {}
    for script, model in models.items():
        options = []
        for c in clusters:
            if not (own := model.options(c, script)):
                break
            options.append(own)
        else:
            if options:
                ways[script] = options
    return ways


def _settles(ways: dict[str, list[tuple[str, ...]]]) -> bool:
    """Whether there is one spelling only, so that no score is asked for."""
    return len(ways) == 1 and all(len(x) == 1 for own in ways.values() for x in own)


def scored_readings(word: str, models: dict[str, Model], paths: int = PATHS, words: list[str] | None = None) -> list[tuple[float, str]]:
    """(score, spelling) of the best ``paths`` spellings of a word, each within one script, best first; scripts that
    can't spell it have none. Where there are more, those that are one of the sorted ``words`` come too, with their score.
    """
    ways = _ways(word, models)
    if _settles(ways):
        return [(0.0, "".join(x[0] for own in ways.values() for x in own))]
    found: list[tuple[float, str]] = []
    for script, way in ways.items():
        model = models[script]
        states: dict[tuple[str, str], list[tuple[float, str]]] = {("^", "^"): [(0.0, "")]}
        for own in way:
            following: dict[tuple[str, str], list[tuple[float, str]]] = defaultdict(list)
            for (a, b), held in states.items():
                for c in own:
                    s = model.score(a, b, c)
                    following[b, c].extend((x + s, t + c) for x, t in held)
            states = {k: heapq.nlargest(paths, v) for k, v in following.items()}
        found.extend((x + model.score(a, b, "$"), t) for (a, b), held in states.items() for x, t in held)
    best = heapq.nlargest(paths, found)
    if words and sum(math.prod(map(len, way)) for way in ways.values()) > paths:
        known = {t for _, t in best}
        for script, way in ways.items():
            lattice = Lattice([*([(c, k + 1, 0) for c in own] for k, own in enumerate(way)), []], frozenset([len(way)]))
            for t, _ in lattice.along(words):
                if t not in known:
                    known.add(t)
                    signs = ["^", "^", *_clusters(t), "$"]
                    best.append((sum(models[script].score(*signs[k : k + 3]) for k in range(len(signs) - 2)), t))
        best.sort(reverse=True)
    return best


def readings(word: str, models: dict[str, Model], paths: int = PATHS) -> list[str]:
    """The best ``paths`` spellings of a word, best first."""
    return [t for _, t in scored_readings(word, models, paths)]


def _grams(words: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in words:
        rows = []
        for w in batch["kl_word"]:
            signs = _clusters(w)
            script = next((s for s in map(script_of, w) if s), "")
            padded = ["^", "^", *signs, "$"]
            rows.extend((script, *padded[k : k + 3]) for k in range(len(padded) - 2))
        yield pd.DataFrame(rows, columns=["script", "a", "b", "c"])


def train(reference: DataFrame, word: str) -> tuple[dict[str, Model], DataFrame | None]:
    """n-gram models of all reference words, by script.

    Where there are more than ``MODEL_ROWS`` n-grams, the models know the letters only (at most one a character of Unicode
    with its marks), and the counts come as a table ``script, a, b, c, n`` (of the pair where ``c`` is empty); else it is None.
    """
    words = reference.select(reference[word].alias("kl_word")).filter("kl_word IS NOT NULL AND kl_word <> ''").distinct()
    counts = settled(words.mapInPandas(_grams, "script STRING, a STRING, b STRING, c STRING").groupBy("script", "a", "b", "c").agg(F.count("*").alias("n")))
    letters: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counts.groupBy("script", "c").agg(F.sum("n").alias("n")).orderBy("script", "c").collect():
        letters[r.script][r.c] = r.n
    signs = letters.pop("", {})
    both = lambda x: {c: signs.get(c, 0) + x.get(c, 0) for c in {*signs, *x}}
    known = {s: both(own) for s, own in letters.items()} or {"LATIN": signs}
    if counts.count() > MODEL_ROWS:
        return {s: Model({}, own) for s, own in known.items()}, _with_pairs(counts, list(known))
    grams: dict[str, dict[tuple[str, str, str], int]] = defaultdict(dict)
    for r in counts.collect():
        grams[r.script][r.a, r.b, r.c] = r.n
    shared = grams.pop("", {})
    return {s: Model({**shared, **grams[s]}, own) for s, own in known.items()}, None


def _with_pairs(counts: DataFrame, scripts: list[str]) -> DataFrame:
    """Counts as each script's model has them: its own n-grams, else the shared ones; and of their pairs (``c`` empty)."""
    own = F.col("script") != ""
    every = counts.select(own.alias("own"), F.explode(F.when(own, F.array("script")).otherwise(F.array(*map(F.lit, scripts)))).alias("script"), "a", "b", "c", "n")
    three = settled(every.groupBy("script", "a", "b", "c").agg(F.max_by("n", "own").alias("n")))
    return three.unionByName(three.groupBy("script", "a", "b").agg(F.sum("n").alias("n")).withColumn("c", F.lit("")))


def _in_blocks(texts: DataFrame, models: Broadcast, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The settled texts by ``kl_block``, and of each block the counts that its lattices ask for."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length("kl_text"))).first()[0] or 0
    blocks = texts.withColumn("kl_block", F.pmod(F.xxhash64("kl_text"), F.lit(max(tasks, -(-size // BLOCK_BYTES))))).repartition(tasks, "kl_block")

    def asked(block: pd.DataFrame) -> pd.DataFrame:
        keys: set[tuple[str, str, str, str]] = set()
        for t in block["kl_text"]:
            if _settles(ways := _ways(t, models.value)):
                continue
            for script, way in ways.items():
                places = [("^",), ("^",), *way, ("$",)]
                for k in range(len(places) - 2):
                    keys.update((script, *x) for x in product(places[k], places[k + 1], (*places[k + 2], "")))
        out = pd.DataFrame(list(keys), columns=["script", "a", "b", "c"])
        out.insert(0, "kl_block", block["kl_block"].iloc[0])
        return out

    keys = blocks.groupBy("kl_block").applyInPandas(asked, "kl_block BIGINT, script STRING, a STRING, b STRING, c STRING")
    return blocks, settled(keys.join(counts, ["script", "a", "b", "c"])).repartition(tasks, "kl_block")


def _spelled(texts: DataFrame, models: Broadcast, counts: DataFrame | None, rows: Callable[[pd.Series, dict[str, Model]], pd.DataFrame], schema: str) -> DataFrame:
    """What ``rows`` makes of the texts and the models; ``counts``: the part of larger models for each block of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield rows(b["kl_text"], models.value)

    def of_block(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        grams: dict[str, dict[tuple[str, str, str], int]] = defaultdict(dict)
        pairs: dict[str, dict[tuple[str, str], int]] = defaultdict(dict)
        for script, a, b, c, n in zip(*(own[x].tolist() for x in ("script", "a", "b", "c", "n"))):
            if c:
                grams[script][a, b, c] = n
            else:
                pairs[script][a, b] = n
        return rows(block["kl_text"], {s: Model(grams[s], m.one, pairs[s]) for s, m in models.value.items()})

    if counts is None:
        return texts.mapInPandas(run, schema)
    return texts.groupBy("kl_block").cogroup(counts.groupBy("kl_block")).applyInPandas(of_block, schema)


def consistent_forms(df: DataFrame, text: str, reference: DataFrame, word: str) -> DataFrame:
    """``kl_text, kl_forms``: for every distinct non-null text, its best spellings (best first, at most ``PATHS``).

    A text no script can spell, an empty or a blank one has an empty list.
    """
    held, counts = train(reference, word)
    models = df.sparkSession.sparkContext.broadcast(held)

    def rows(texts: pd.Series, own: dict[str, Model]) -> pd.DataFrame:
        return pd.DataFrame({"kl_text": texts, "kl_forms": [readings(t, own) for t in texts]})

    texts = spread(df.select(df[text].alias("kl_text")).filter("kl_text IS NOT NULL"))
    if counts is not None:
        texts, counts = _in_blocks(settled(texts), models, counts)
    return _spelled(texts, models, counts, rows, "kl_text STRING, kl_forms ARRAY<STRING>")


def disguised_words(df: DataFrame, text: str, reference: DataFrame, word: str) -> DataFrame:
    """Rows of ``df`` whose text looks like a reference word but has other characters, with that word as ``kl_form``.

    Nulls and texts stored exactly as a reference word never come out; ties between spellings are settled by the
    reference (no two of its words look the same), else by the better score, then by code points. No spelling that is a
    reference word is missed, however many paths its lattice has. Rows leave by the reference before any
    shuffle, so that a common correct word costs nothing; a common disguised one is split by the join's skew handling.
    """
    known = reference_words(reference, word)
    rows = unlisted(df, text, known)
    spark = df.sparkSession
    held, counts = train(reference, word)
    models = spark.sparkContext.broadcast(held)

    def found(piece: Broadcast) -> Callable[[pd.Series, dict[str, Model]], pd.DataFrame]:
        def of(texts: pd.Series, own: dict[str, Model]) -> pd.DataFrame:
            hits = [(t, score, form) for t in texts for score, form in scored_readings(t, own, PATHS, piece.value)]
            return pd.DataFrame(hits, columns=["kl_text", "kl_score", "kl_form"])

        return of

    pieces = word_pieces(reference.select(reference[word].alias("w")).filter("w IS NOT NULL AND w <> ''").distinct(), REFERENCE_BYTES)
    texts = spread(rows.select(rows[text].alias("kl_text")))
    texts = texts if len(pieces) == 1 and counts is None else settled(texts)
    if counts is not None:
        texts, counts = _in_blocks(texts, models, counts)
    forms = None
    for piece in pieces:
        words = sorted(r.w for r in piece.collect())  # at most REFERENCE_BYTES
        part = _spelled(texts, models, counts, found(spark.sparkContext.broadcast(words)), "kl_text STRING, kl_score DOUBLE, kl_form STRING")
        forms = part if forms is None else forms.unionByName(part)
    hit = forms.join(known, "kl_form").groupBy("kl_text").agg(F.min_by("kl_form", F.struct(-F.col("kl_score"), "kl_form")).alias("kl_form"))
    return rows.join(hit, rows[text] == hit["kl_text"]).drop("kl_text")
