"""Text whose bytes were read in a wrong encoding: found and restored by minimum description length.

For every distinct text the chains of wrong readings that could have made it are undone, also where only a part was
damaged or where the letters' case or the blanks were changed afterwards. What one reading can go back to is a lattice of
characters over the places of the text, never a list of all combinations: out of it come all paths that are reference
words, by a walk that follows their beginnings, and the paths that read best by character pairs. Every candidate is
compressed with zstandard dictionaries made of the reference words, one for each language (told by a column of the
reference, else by the script the words are written in); the chain with the least total of compressed bytes and chain
cost is chosen, and the text is left unchanged where that is cheapest. Texts with characters lost to a replacement sign
are described by the words whose remains they can be.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.lattice import CAPITAL, CHANGED, Lattice
from keyloom.llm.lookalike import script_of
from keyloom.llm.reference import reference_words, spread, unlisted, word_pieces
from keyloom.session import settled

# Encodings that UTF-8 bytes are commonly read in.
READ_UTF8_AS = ("cp1252", "latin_1", "cp1251", "cp1253", "cp1250", "cp850", "cp437", "cp866", "mac_roman", "koi8_r", "iso8859_15", "iso8859_2", "iso8859_5", "iso8859_7", "mac_cyrillic")
# Fixed values: (encoding read in, true encoding) of one-byte encodings that are commonly mixed up.
MIXED_UP = (
    ("cp1252", "cp1251"), ("cp1252", "iso8859_7"), ("cp1252", "cp1253"), ("iso8859_15", "cp1253"), ("iso8859_15", "iso8859_7"), ("cp1252", "koi8_r"),
    ("cp1252", "iso8859_5"), ("cp1252", "cp866"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp1250"),
    ("cp1252", "iso8859_2"), ("cp1252", "cp852"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp852", "cp1250"), ("cp852", "cp1252"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"),
    ("cp1251", "mac_cyrillic"), ("mac_cyrillic", "cp1251"), ("cp1251", "iso8859_5"), ("iso8859_5", "cp1251"), ("koi8_r", "cp866"), ("cp866", "koi8_r"),
    ("cp1251", "cp1252"), ("cp1253", "cp737"), ("cp437", "cp737"), ("cp737", "cp1253"), ("cp1253", "mac_greek"),
)
# Fixed values: (encoding read in, true encoding) of two-byte encodings.
TWO_BYTES = (
    ("cp1252", "shift_jis"), ("latin_1", "shift_jis"), ("mac_roman", "shift_jis"), ("latin_1", "euc_jp"), ("cp1252", "euc_jp"), ("cp1252", "euc_kr"), ("latin_1", "euc_kr"),
    ("cp1252", "cp949"), ("cp1251", "euc_kr"), ("cp1251", "euc_jp"),
)
#: Signs that stand for lost characters.
LOST = "?�"
#: Bytes of description that a step of the chain costs, and a change of case, blanks or only a part on top.
STEP_COST, CHANGE_COST = 1.0, 0.5
#: Of compression: one that looks at every place of a dictionary.
LEVEL = 12
#: Words of the dictionary that a message begins with.
BEFORE = 3
#: Most bytes of reference words in one dictionary (a bounded sample where a language has more), and in one piece of the
#: reference that candidates are walked along (with more, all pieces follow each other).
DICTIONARY_BYTES = 4_000_000
#: Paths of a lattice up to which all are taken; of a larger one, the best by character pairs besides all reference words.
PATHS = 24
#: Bytes by which a compressor's length of so short a text is uncertain.
SLACK = 4


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding; undefined bytes read as the control character of their number."""
    out: dict[str, int] = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def _chars_of(codec: str) -> dict[int, str]:
    return {b: c for c, b in sorted(_bytes_of(codec).items(), key=lambda x: x[0].isprintable())}


#: Sign that stands for a byte or a character that could not be read.
GONE = "\ufffd"


@lru_cache(maxsize=None)
def _undefined(codec: str) -> tuple[int, ...]:
    return tuple(b for b in range(256) if bytes([b]).decode(codec, "replace") == GONE)


#: What a character may have been before quotes, dashes and blanks were made plain.
_PLAINED = {" ": "\xa0", "'": "‘’", '"': "“”", "-": "–—\xad"}


@lru_cache(maxsize=None)
def _options(codec: str, char: str) -> tuple[int, ...]:
    """Bytes that a character may go back to, the character's own first; a replacement sign to any that the encoding
    leaves undefined."""
    known = _bytes_of(codec)
    if char == GONE:
        return _undefined(codec)
    forms = [char, *([char.upper()] if char.upper() != char else []), *_PLAINED.get(char, "")]
    return tuple(dict.fromkeys(known[f] for f in forms if f in known))


@lru_cache(maxsize=None)
def _leads(codec: str, char: str) -> tuple[tuple[int, bool], ...]:
    own = _bytes_of(codec).get(char)
    return tuple((b, b != own) for b in _options(codec, char) if 0xC2 <= b <= 0xF4)


@lru_cache(maxsize=None)
def _follows(codec: str, char: str) -> tuple[tuple[int, bool], ...]:
    own = _bytes_of(codec).get(char)
    return tuple((b, b != own) for b in _options(codec, char) if 0x80 <= b <= 0xBF)


def _sequences(codec: str, text: str, at: int) -> list[tuple[str, int, bool]]:
    """(character, end, changed) of the UTF-8 sequences that may begin at a place of the text."""
    out = []
    for lead, changed in _leads(codec, text[at]):
        more = 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3
        tails = [_follows(codec, c) for c in text[at + 1 : at + 1 + more]]
        if len(tails) == more and all(tails):
            for tail in product(*tails):
                try:
                    out.append((bytes([lead, *(b for b, _ in tail)]).decode(), at + 1 + more, changed or any(x for _, x in tail)))
                except UnicodeDecodeError:
                    pass
        if len(tails) >= more - 1 and all(tails[: more - 1]) and not (len(tails) == more and tails[-1]):
            for gone in (0xA0, 0xAD):  # a no-break blank or a soft hyphen that was taken out
                for tail in product(*tails[: more - 1]):
                    try:
                        out.append((bytes([lead, *(b for b, _ in tail), gone]).decode(), at + more, True))
                    except UnicodeDecodeError:
                        pass
    return out


def undo_utf8(codec: str, text: str, letters: frozenset[str]) -> Lattice:
    """UTF-8 read in ``codec``, undone wherever it can be; only ``letters`` come out."""
    edges: list[list[tuple[str, int, int]]] = []
    for at, c in enumerate(text):
        found = [f for f in _sequences(codec, text, at) if f[0] in letters] if _leads(codec, c) else []
        own = [(char, end, CHANGED * other) for char, end, other in found]
        if c in letters and all(f[2] for f in found):  # only a part of the text may be damaged
            own.append((c, at + 1, CHANGED * (not c.isascii())))
        edges.append(own)
    return Lattice([*edges, []], frozenset([len(text)]))


def undo_once(codec: str, text: str) -> tuple[str, bool] | None:
    """A step within a chain: (text, changed), whatever comes out; a change of case is taken back only where needed."""
    out, at, changed, steps = [], 0, False, 0
    while at < len(text):
        found = _sequences(codec, text, at) if _leads(codec, text[at]) else []
        if found:
            char, end, other = min(found, key=lambda f: (f[2], -f[1]))
            out.append(char)
            at, changed, steps = end, changed or other, steps + 1
        else:
            out.append(text[at])
            at += 1
    return ("".join(out), changed) if steps else None


@lru_cache(maxsize=4)
def _tables(letters: frozenset[str]) -> tuple[dict[str, int], list[dict[str, tuple[str, ...]]]]:
    """For one-byte mix-ups: the pairs (as bits) that a character fits, and each pair's readings of it."""
    bits: dict[str, int] = {}
    readings = []
    for k, (read, true) in enumerate(MIXED_UP):
        chars, own = _chars_of(true), {}
        for char in {*_bytes_of(read), *(c.lower() for c in _bytes_of(read) if len(c.lower()) == 1)}:
            if char.isascii():
                continue
            found = dict.fromkeys(c for b in _options(read, char) if (c := chars.get(b, "")) in letters and c and not c.isascii())
            if found:
                own[char] = tuple(found)
                bits[char] = bits.get(char, 0) | 1 << k
        readings.append(own)
    return bits, readings


def undo_one_byte(text: str, letters: frozenset[str]) -> Iterator[Lattice]:
    """One-byte encodings mixed up, in whole or in one run, within ``letters``: for each pair that fits, places before,
    in and behind the run. Where no sign is foreign, more than three signs are taken as a whole."""
    bits, readings = _tables(letters)
    places = [k for k, c in enumerate(text) if not c.isascii()]
    if not places or any(text[k] not in letters and text[k] not in bits for k in places):
        return
    odd = [k for k in places if text[k] not in letters]
    common = -1
    for k in odd:
        common &= bits[text[k]]
    for n, own in enumerate(readings):
        if not common >> n & 1:
            continue
        fit = sum(text[k] in own for k in places)
        if not fit:
            continue
        in_part = bool(odd) or fit <= 3
        edges: list[list[tuple[str, int, int]]] = []
        for at, c in enumerate(text):
            below, inside, behind = 3 * at + 3, 3 * at + 4, 3 * at + 5
            if c.isascii():
                edges += [[(c, below, 0)], [(c, inside, 0)], [(c, behind, 0)]]
                continue
            ways = [(w, inside, CHANGED * (k > 0)) for k, w in enumerate(own.get(c, ()))]
            kept = c in letters
            before = [(c, below, CHANGED)] if kept and (in_part or not ways) else []
            edges.append(before + ways)
            edges.append(ways + ([(c, behind, CHANGED)] if kept and in_part else []) + ([(c, inside, 0)] if kept and not ways else []))
            edges.append([(c, behind, CHANGED)] if kept else [])
        end = 3 * len(text)
        yield Lattice([*edges, [], [], []], frozenset([end + 1, end + 2]))


def undo_two_bytes(text: str, letters: frozenset[str]) -> Iterator[Lattice]:
    """Two-byte encodings read as one-byte ones, within ``letters``."""
    for read, true in TWO_BYTES:
        options = [_options(read, c) for c in text]
        if not all(options):
            continue
        edges: list[list[tuple[str, int, int]]] = []
        for at, own in enumerate(options):
            following = options[at + 1] if at + 1 < len(text) else ()
            edges.append([(char, at + 2, CHANGED * (a != own[0] or b != following[0])) for a, b in product(own, following) if (char := _two(true, a, b)) in letters and char])
        yield Lattice([*edges, []], frozenset([len(text)]))


@lru_cache(maxsize=200_000)
def _two(codec: str, a: int, b: int) -> str:
    try:
        return bytes([a, b]).decode(codec) if a >= 0x80 else ""
    except UnicodeDecodeError:
        return ""


@lru_cache(maxsize=64)
def _patterns(codec: str, letters: frozenset[str]) -> tuple:
    """(search, match): what a text with UTF-8 read in ``codec`` must hold, and what one consists of that may be undone
    again. The first is a lead with a follower, or one whose follower may have left; the second, letters besides."""
    import regex

    chars = {*_bytes_of(codec), *(c.lower() for c in _bytes_of(codec) if len(c.lower()) == 1), GONE}
    leads = {c for c in chars if _leads(codec, c) and not c.isascii()}
    follows = {c for c in chars if _follows(codec, c)} | set(_PLAINED)
    alone = {c for c in leads for b, _ in _leads(codec, c) if b < 0xE0 and any(bytes([b, x]).decode() in letters for x in (0xA0, 0xAD))}
    l, f, a, own = ("".join(map(regex.escape, sorted(x))) for x in (leads, follows, alone, letters))
    either = f"[{l}][{f}]" + (f"|[{a}]" if a else "")
    return regex.compile(either).search, regex.compile(rf"(?:[{l}][{f}]++|[\x20-\x7e{own}])*+").fullmatch


@lru_cache(maxsize=4)
def _undoable(letters: frozenset[str]) -> frozenset[str]:
    """Letters and all that any of the encodings can have read; a text with anything else has no original."""
    codecs = {*READ_UTF8_AS, *(r for r, _ in MIXED_UP), *(r for r, _ in TWO_BYTES)}
    chars = {c for k in codecs for c in _bytes_of(k)}
    return letters | chars | {c.lower() for c in chars if len(c.lower()) == 1} | {GONE}


def candidates(text: str, letters: frozenset[str], words: list[str], pairs: dict[str, float]) -> dict[str, float]:
    """Texts that a chain of wrong readings may have started from, with the least cost of a chain.

    Chains may be of any length: a step within one makes the text shorter. Each step's lattice gives all of its paths
    where these are few, else all that are one of the sorted ``words`` and the best by ``pairs``.
    """
    found: dict[str, float] = {}
    lower = text == text.lower()

    def take(lattice: Lattice, cost: float) -> None:
        if not lattice.count:
            return
        if lower:  # a capital may have gone with a change of case
            lattice.lower_start(letters)
        few = lattice.count <= PATHS and not lower or lattice.count * 2 <= PATHS
        for part in (lattice.all(),) if few else (lattice.along(words), lattice.best(pairs, PATHS)):
            for out, marks in part:
                if marks != CAPITAL:
                    c = cost + STEP_COST + CHANGE_COST * marks.bit_count()
                    found[out] = min(found.get(out, c), c)

    frontier = {text: 0.0}
    seen = {text}
    while frontier:
        inner: dict[str, float] = {}
        for t, cost in frontier.items():
            for codec in READ_UTF8_AS:
                if not _patterns(codec, letters)[0](t):
                    continue
                take(undo_utf8(codec, t, letters), cost)
                if (once := undo_once(codec, t)) and any(_patterns(k, letters)[1](once[0]) and _patterns(k, letters)[0](once[0]) for k in READ_UTF8_AS):
                    c = cost + STEP_COST + CHANGE_COST * once[1]
                    inner[once[0]] = min(inner.get(once[0], c), c)
            for lattice in (*undo_one_byte(t, letters), *undo_two_bytes(t, letters)):
                take(lattice, cost)
        frontier = {t: c for t, c in inner.items() if t not in seen}
        seen.update(frontier)
    found.pop(text, None)
    return found


def pair_scores(words: list[str]) -> dict[str, float]:
    """Logarithms of how often a character follows another in the words, line ends around them."""
    pairs: Counter[str] = Counter()
    for w in words:
        line = f"\n{w}\n"
        pairs.update(line[k : k + 2] for k in range(len(line) - 1))
    firsts: Counter[str] = Counter()
    for p, n in pairs.items():
        firsts[p[0]] += n
    return {p: math.log(n / firsts[p[0]]) for p, n in pairs.items()}


class Describer:
    """Length of a text's description: what it adds to a message compressed with the dictionary of a language.

    ``words`` has the words of each language. Only languages written in the text's script are tried, and the shortest
    description holds. The message begins with words of the dictionary, and all is written in two bytes a character, so
    that short words too are long enough to be matched.
    """

    def __init__(self, words: dict[str, list[str]]):
        self.words = {s: sorted(w) for s, w in words.items()}
        scripts: dict[str, list[str]] = defaultdict(list)
        for language, own in self.words.items():
            for script in sorted({s for w in own if (s := _script(w))}):
                scripts[script].append(language)
        self.languages = dict(scripts)
        self._ready: dict[str, tuple] = {}

    def _compressor(self, language: str) -> tuple:
        if language not in self._ready:
            import zstandard

            words = self.words[language]
            data = f"\n{'\n'.join(words)}\n".encode("utf-16-le")
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress
            before = f"\n{'\n'.join(words[:: max(1, len(words) // BEFORE)][:BEFORE])}\n".encode("utf-16-le")
            self._ready[language] = compress, before, len(compress(before))
        return self._ready[language]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": {}}

    def length(self, text: str) -> int:
        data = f"{text}\n".encode("utf-16-le", "surrogatepass")
        scripts = {s for c in text if (s := script_of(c))}
        if len(scripts) != 1:  # no language is written so: nothing to go by
            return len(data)
        least = len(data)
        for language in self.languages.get(scripts.pop(), ()):
            compress, before, known = self._compressor(language)
            least = min(least, len(compress(before + data)) - known)
        return least


def restore(text: str, describer: Describer, letters: frozenset[str], words: list[str], pairs: dict[str, float]) -> list[tuple[float, str]]:
    """Originals of a damaged text with the length of their descriptions, the shortest first.

    The text is left unchanged (nothing comes out) where its own description is shorter by more than ``SLACK`` bytes;
    within that the compressor's own grain decides, and the reference is asked.
    """
    if text.isascii() or not _undoable(letters).issuperset(text):
        return []
    found = candidates(text, letters, words, pairs)
    if not found:
        return []
    own = describer.length(text)
    ranked = sorted((cost + describer.length(t), t) for t, cost in found.items())
    return [(total, t) for total, t in ranked if total <= own + SLACK]


def _script(word: str) -> str:
    return next((s for c in word if (s := script_of(c))), "")


def train(reference: DataFrame, word: str, language: str | None = None) -> tuple[Describer, frozenset[str]]:
    """Dictionaries of the reference words by language, and the letters the words are written in.

    Without a column of languages a script stands for its languages. A dictionary takes at most ``DICTIONARY_BYTES`` (a
    sample by hash where a language has more words); the letters are those of all words.
    """
    told = reference[language].cast("string") if language else F.lit(None).cast("string")
    words = reference.select(reference[word].alias("w"), told.alias("l")).filter("w IS NOT NULL AND w <> ''").distinct()
    letters = frozenset(r.c for r in words.select(F.explode(F.split("w", "")).alias("c")).distinct().collect() if r.c)  # at most one row a code point
    grouped: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for r in words.orderBy(F.xxhash64("w")).limit(DICTIONARY_BYTES // 8).collect():
        s = r.l or _script(r.w)
        size[s] = size.get(s, 0) + len(r.w.encode()) + 1
        if size[s] <= DICTIONARY_BYTES:
            grouped.setdefault(s, []).append(r.w)
    return Describer(grouped), letters


def _remains(text: Column, pattern: str) -> Column:
    """A text with each run of lost (or, in reference words, losable) characters as one sign."""
    return F.regexp_replace(text, pattern, GONE)


def _fits(lost: str, whole: str) -> bool:
    """Whether a text with lost signs may be what is left of a word: runs without lost signs are alike, and a run of n
    signs stands for n characters, or for fewer that took several bytes."""
    import regex

    a = regex.findall(r"(?:[^\x00-\x7f]|\?)+", lost)
    b = regex.findall(r"[^\x00-\x7f]+", whole)
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        n = sum(c in LOST for c in x)
        if not n:
            if x != y:
                return False
        elif n == len(x):
            if not len(y) <= n <= len(y.encode()):
                return False
        elif not (2 * n >= len(x) and len(y) <= 2 * len(x) and len(x) <= len(y.encode())) and not regex.fullmatch("".join("(?:.)" if c in LOST else regex.escape(c) for c in x), y):
            return False
    return True


def damaged_words(df: DataFrame, text: str, reference: DataFrame, word: str, language: str | None = None) -> DataFrame:
    """Rows of ``df`` whose text is a reference word damaged by wrong decoding, with that word as ``kl_form``.

    ``kl_form`` is an empty string where characters were lost to a replacement sign. Nulls, empty texts and texts stored
    as a reference word never come out. Of several restorations that are reference words the one with the shortest
    description holds, ties by code points. ``language``: a column of the reference with the words' languages. Reference
    words are followed in pieces of ``DICTIONARY_BYTES``, so that no task holds more of them; every piece meets all texts.
    """
    known = reference_words(reference, word)
    rows = unlisted(df, text, known)
    describer, letters = train(reference, word, language)
    spark = df.sparkSession
    model = spark.sparkContext.broadcast((describer, letters))
    words = reference.select(reference[word].alias("w")).filter("w IS NOT NULL AND w <> ''").distinct()
    pieces = word_pieces(words, DICTIONARY_BYTES)

    def run(piece):
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, own = model.value
            listed = piece.value
            pairs = pair_scores(listed)
            for b in batches:
                found = [(t, total, form) for t in b["kl_text"] for total, form in restore(t, held, own, listed, pairs)]
                yield pd.DataFrame(found, columns=["kl_text", "kl_total", "kl_form"])

        return of

    texts = rows.select(rows[text].alias("kl_text"))
    damaged = spread(texts.filter(r"kl_text RLIKE '[^\\x00-\\x7f]'"))
    damaged = damaged if len(pieces) == 1 else settled(damaged)
    restored = None
    for piece in pieces:
        listed = sorted(r.w for r in piece.collect())  # at most DICTIONARY_BYTES
        part = damaged.mapInPandas(run(spark.sparkContext.broadcast(listed)), "kl_text STRING, kl_total DOUBLE, kl_form STRING")
        restored = part if restored is None else restored.unionByName(part)
    hit = settled(restored.join(known, "kl_form").groupBy("kl_text").agg(F.min_by("kl_form", F.struct("kl_total", "kl_form")).alias("kl_form")))
    hit = hit.withColumn("kl_form", F.when(F.contains("kl_text", F.lit(GONE)), "").otherwise(F.col("kl_form")))

    def described(lost: str, whole: str) -> bool:
        return _fits(lost, whole) and STEP_COST + model.value[0].length(whole) <= model.value[0].length(lost) + SLACK

    lossy = texts.filter(F.col("kl_text").rlike(f"[{LOST}]")).distinct().withColumn("kl_left", _remains(F.col("kl_text"), r"(?:[^\x00-\x7f]|\?)+"))
    whole = words.select(F.col("w").alias("kl_whole")).withColumn("kl_left", _remains(F.col("kl_whole"), r"[^\x00-\x7f]+"))
    fits = F.udf(described, "boolean", useArrow=True)
    lost = lossy.join(whole, "kl_left").filter(fits("kl_text", "kl_whole")).select("kl_text", F.lit("").alias("kl_form")).distinct()
    lost = lost.join(hit, "kl_text", "left_anti")
    found = hit.unionByName(lost)
    return rows.join(found, rows[text] == found["kl_text"]).drop("kl_text")
