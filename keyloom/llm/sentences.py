"""Sentences of message bodies in many languages and scripts.

Nothing about a language's abbreviations is given: for each language, counts over the whole corpus tell by log-likelihood
ratios which words are written with a period without ending a sentence, which words begin sentences, and which numbers
and words go together. Every mark is then classified by these statistics and by the quotes and brackets around it.
Languages that share the Latin script are told apart by words that are learned from labelled messages; other blocks go
by their script. Messages are parsed once: their blocks and the counts are written together to the shared folder.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.mime import plain_body
from keyloom.session import settled

_SCRIPTS = (
    ("th", re.compile("[฀-๿]")), ("am", re.compile("[ሀ-᎟]")), ("ja", re.compile("[ぁ-ヿ]")), ("zh", re.compile("[㐀-鿿]")),
    ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")), ("el", re.compile("[Ͱ-Ͽἀ-῿]")), ("ru", re.compile("[Ѐ-ӿ]")),
    ("ko", re.compile("[가-힣]")), ("he", re.compile("[֐-׿]")), ("hy", re.compile("[԰-֏]")), ("ka", re.compile("[Ⴀ-ჿ]")),
)
LATIN = "latin"
_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = re.compile(r"[^\W\d_]+")
_BEYOND_LATIN = re.compile("[Ͱ-ᷟἀ-῿ぁ-￿]")

_ANNOUNCED = re.compile(r"\s*-{2,}\s*[^-\s].*[^-\s]\s*-{2,}\s*")
_RULE = re.compile(r"_{10,}")
_SALUTATION = re.compile(r"[,:，：、،؛՝፣፥፦﹕﹐]\s*\Z")


class Tongues(NamedTuple):
    """How Latin-script languages are told apart: the words that tell, each with its scores by language, and the language
    of a block that says nothing."""

    words: dict[str, tuple[tuple[str, float], ...]]
    most: str = LATIN


#: By how much the best language of a block has to lead for the rest of the body not to be asked.
LEAD = 2.0


def _script_or_votes(block: str, tongues: Tongues) -> str | dict[str, float]:
    """The language that a block's script stands for; in the Latin script, the scores of its words."""
    if not block.isascii() and _BEYOND_LATIN.search(block):
        letters = len(_LETTER.findall(block))
        for name, pattern in _SCRIPTS:
            n = len(pattern.findall(block))
            if name == "zh" and n and len(_SCRIPTS[2][1].findall(block)):
                name = "ja"
            if n * 2 > letters or (name in ("ja", "zh") and n * 3 > letters):
                return name
    votes: dict[str, float] = {}
    if tongues.words:
        for w in _LETTERS.findall(block.lower()):
            for k, x in tongues.words.get(w, ()):
                votes[k] = votes.get(k, 0.0) + x
    return votes


def languages_of(parts: list[str], tongues: Tongues) -> list[str]:
    """Language of each block of a body: by its script or words; what these leave open, the whole body tells."""
    told = [_script_or_votes(p, tongues) for p in parts]
    whole: dict[str, float] = {}
    for votes in told:
        for k, n in votes.items() if isinstance(votes, dict) else ():
            whole[k] = whole.get(k, 0.0) + n
    out = []
    for votes in told:
        if isinstance(votes, dict):
            ranked = sorted(votes.values(), reverse=True)
            if len(ranked) < 2 or ranked[0] - ranked[1] < LEAD:
                votes = {k: votes.get(k, 0.0) + x for k, x in whole.items()}
            votes = max(votes, key=lambda k: (votes[k], k)) if votes else tongues.most
        out.append(votes)
    return out


def blocks(body: str) -> list[str]:
    """The author's blocks: without quoted lines, what follows a signature or announced message, and salutations."""
    out: list[list[str]] = [[]]
    for line in body.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        bare = line.rstrip()
        if line == "-- " or _RULE.fullmatch(bare) or (line[:1] in "- " and _ANNOUNCED.fullmatch(line)):
            break
        if line.startswith(">") or not line.strip():
            out.append([])
        else:
            out[-1].append(line)
    return ["\n".join(b) for b in out if b and not (len(b) == 1 and _SALUTATION.search(b[0]))]


OPENERS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "《": "》", "〈": "〉", "【": "】", "‚": "‘"}
CLOSERS = "”»›」』）)]》〉】"
_HARD = "!?！？。．｡؟।॥።፧፨۔‼⁇⁈⁉;;"
_SPAN = re.compile("[.…!?！？。．｡؟।॥።፧፨۔‼⁇⁈⁉;;]+")
#: Signs besides blanks that part words.
_PARTING = frozenset('“„”«»‹›"「」『』（）()[]—–/…。！？．｡、，：।።')
_QUOTE = re.compile("[" + re.escape("".join(OPENERS) + CLOSERS + '"“»«”') + "]")
_NEXT = re.compile(r"\S")
_FIRST = re.compile(r"[¿¡\"“„«»「『（(\[‹—–\-\s]*([^\W_]+)?")
_PIECES = re.compile(r"(?:[^\W\d_]{1,4}[.\-’']*)+\Z")
_ORDINAL = re.compile(r"\d{1,3}\Z")
_NUMBER = re.compile(r"[+\-]?\d[\d.,:/\-]*\Z")


class Mark(NamedTuple):
    """A run of marks that may end a sentence: where it and its closing signs end, and what is around."""

    start: int
    stop: int  # after the closing signs
    kind: str  # dot, dots or hard
    before: str  # the word before, in lower case
    after: str  # the sign that follows behind blanks, empty at the end
    first: str  # the word that follows behind blanks, quotes and dashes
    spaced: bool  # whether a blank or the block's end follows
    quoted: str  # closing signs that follow at once
    inside: bool  # whether an outer quote or bracket stays open
    opened: int  # where the closed quote or bracket was opened, -1 without


def _pairs(text: str) -> dict[int, int]:
    """Closing to opening place of quotes and brackets that are closed within the block."""
    held: list[tuple[str, int]] = []
    out: dict[int, int] = {}
    for m in _QUOTE.finditer(text):
        k, c = m.start(), m[0]
        if held and (c == '"' and held[-1][0] == '"' or c in OPENERS.get(held[-1][0], "") or held[-1][0] == "»" and c == "«" or held[-1][0] == "”" and c == "”"):
            out[k] = held.pop()[1]
            continue
        left, right = text[k - 1 : k], text[k + 1 : k + 2]
        begins = (not left or left.isspace() or left in "([—–-:：，,„“«") and right and not right.isspace()
        if c in OPENERS or (c == '"' or c == "»" or c == "”") and begins:
            held.append((c, k))
        else:  # a closing sign that closes an outer one
            for n in range(len(held) - 1, -1, -1):
                if c in OPENERS.get(held[n][0], "") or c == held[n][0] == '"':
                    out[k] = held[n][1]
                    del held[n:]
                    break
    return out


def marks(text: str) -> Iterator[Mark]:
    """The marks of a block in their order."""
    pairs = _pairs(text)
    spans = sorted((a, b) for b, a in pairs.items())
    size, next_span, reach, token = len(text), 0, -1, 0
    for m in _SPAN.finditer(text):
        run, start, stop = m.group(), m.start(), m.end()
        if run == "." and stop < size and text[stop].isalnum():
            continue
        opened, signs = -1, ""
        at = stop
        while at < size:  # closing signs right behind, in French after a blank
            if pairs.get(at, size) < start:
                opened, signs, at = pairs[at], signs + text[at], at + 1
                stop = at
            elif text[at] in " \u00a0\u202f\n" and text[at + 1 : at + 2] == "»" and pairs.get(at + 1, size) < start:
                at += 1
            else:
                break
        follows = _NEXT.search(text, stop)
        spaced = not follows or follows.start() > stop
        after = follows[0] if follows else ""
        first = (m1[1] or "") if follows and (m1 := _FIRST.match(text, follows.start())) else ""
        if any(c in _HARD for c in run):
            kind = "hard"
        else:
            dots = run.count(".") + 2 * run.count("…")
            kind = "dots" if dots > 1 else "dot"
        before = ""
        if spaced or signs or kind == "dots":
            end = start
            while end and text[end - 1].isspace():
                end -= 1
            at = end
            while at > token and (c := text[at - 1]) not in _PARTING and not c.isspace():  # the word's own begin, never before a known one
                at -= 1
            before, token = text[at:end].lower(), at
        while next_span < len(spans) and spans[next_span][0] < start:
            reach = max(reach, spans[next_span][1])
            next_span += 1
        yield Mark(start, stop, kind, before, after, first, spaced, signs, reach >= stop, opened)


def _outcome(mark: Mark) -> str:
    """What follows a period: the block's end, a continuation, a capital, or other."""
    if not mark.after:
        return "end"
    c = mark.after
    if c in ",;:)،，；：" or c.isdigit() or c.islower():
        return "on"
    return "up" if mark.first[:1].isupper() else "other"


#: Scripts written without blanks: the word before an ellipsis is no unit there, its last signs are.
_UNSPACED = re.compile("[฀-๿ぁ-ヿ㐀-鿿]")


def _ending(word: str) -> str:
    """What an ellipsis goes with: the word before it, or in scripts without blanks its last two signs."""
    return word[-2:] if word and _UNSPACED.match(word[-1]) else word


def count_events(block: str, language: str, held: Counter, words: dict[str, Counter]) -> None:
    """Adds the (language, kind, word, outcome) events of one block to a counter, and its words to those of a language."""
    words[language].update(_LETTERS.findall(block.lower()))
    if first := _FIRST.match(block)[1]:
        held[language, "s", first.lower(), ""] += 1
    for m in marks(block):
        if not m.spaced and m.kind == "dot" and not m.quoted:
            continue
        outcome = _outcome(m)
        if m.kind == "dot":
            if _NUMBER.fullmatch(m.before):
                if _ORDINAL.fullmatch(m.before):
                    held[language, "n", m.first.lower(), outcome] += 1
            else:
                held[language, "d", m.before, outcome] += 1
        elif m.kind == "dots":
            held[language, "e", _ending(m.before), outcome] += 1
        held[language, "m", "", outcome] += 1


def _llr(k1: float, n1: float, k2: float, n2: float) -> float:
    """Log-likelihood ratio of two rates."""

    def part(k: float, n: float, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    if not n1 or not n2 or k1 > n1 or k2 > n2:
        return 0.0
    p = (k1 + k2) / (n1 + n2)
    if p <= 0 or p >= 1:
        return 0.0
    return 2 * (part(k1, n1, k1 / n1) + part(k2, n2, k2 / n2) - part(k1, n1, p) - part(k2, n2, p))


class Model(NamedTuple):
    """What was learned: by language, abbreviations, sentence starters, words that go with a number, and dots that go on."""

    short: frozenset[tuple[str, str]]
    starters: frozenset[tuple[str, str]]
    numbered: frozenset[tuple[str, str]]
    going_on: frozenset[tuple[str, str]]
    ending: frozenset[tuple[str, str]]


#: Least log-likelihood ratio, and least count of a word, to be held as learned.
LEAST, SEEN = 10.0, 4


def judge(language: str, kind: str, word: str, n: dict[str, int], totals: dict[tuple[str, str], int], words: int) -> list[str]:
    """Names of the sets of the model that a counted word belongs to. n: its counts by outcome, ``""`` as a word."""
    marked, ended = totals.get((language, "m"), 0), totals.get((language, "end"), 0)
    all_words, all_first = totals.get((language, "w"), 0), totals.get((language, "s"), 0)
    seen = sum(n.values())
    found = []
    if kind == "d":
        end, on = n.get("end", 0), n.get("on", 0)
        rare_end = _llr(end, seen, ended - end, marked - seen) >= LEAST and end / seen < 0.25 * ended / max(1, marked)
        alone = words  # the word without a period
        tied = _llr(seen, seen + alone, marked, all_words + marked) * math.exp(-len(word) / 4) >= LEAST and alone < seen
        if word and (rare_end or (seen >= SEEN and on >= 0.8 * seen) or (tied and on >= 0.3 * seen)):
            found.append("short")
        if end:
            found.append("ending")
    elif kind == "s":
        total = words
        if seen >= SEEN and _llr(seen, all_first, total - seen, max(1, all_words - all_first)) >= LEAST and seen / max(1, all_first) > (total - seen) / max(1, all_words - all_first):
            found.append("starters")
    elif kind == "n":
        if seen >= SEEN and word and _llr(seen, totals.get((language, "n"), 0), words, all_words) >= LEAST and seen / max(1, totals.get((language, "n"), 0)) > 3 * words / max(1, all_words):
            found.append("numbered")
    elif kind == "e":
        end = n.get("end", 0)
        if word and (_llr(end, seen, ended - end, marked - seen) >= LEAST and end / seen < 0.25 * ended / max(1, marked) or (seen >= SEEN and not end and n.get("on", 0) >= 0.8 * seen)):
            found.append("going_on")
        if end:
            found.append("ending")
    return found


def _ends(m: Mark, language: str, model: Model, sentence_start: int, text: str) -> bool:
    """Whether a mark ends the sentence that began at ``sentence_start``."""
    if not m.after:
        return True
    if m.inside:
        return False
    c, first = m.after, m.first
    cased = first[:1].isupper() or first[:1].islower()
    wide = any(x in "。．｡！？।॥።" for x in text[m.start : m.stop])
    if not m.spaced and not wide and not (m.kind == "dots" and language in ("zh", "ja")) and not (m.kind == "hard" and m.quoted and language in ("zh", "ja")):
        return False
    if c in ",;:،，；：":
        return False
    if m.kind == "hard" and all(x in ";;" for x in text[m.start : m.start + 1]) and language != "el":
        return False
    if m.quoted:
        sign = m.quoted[-1]
        lead = text[sentence_start : m.opened].strip()
        if sign in ")）]】":
            return not lead
        if first[:1].islower() and c == first[0] or c in "—–-":
            return False
        if not lead:  # the sentence began with the quote: the carrier clause may follow
            return bool(first) and cased or not first[:1].isalpha()
        if lead[-1] in ":：,，、":
            return True
        return cased and first[:1].isupper()
    if m.kind == "hard":
        return True
    low = first.lower()
    if m.kind == "dots":
        word = _ending(m.before)
        if (language, word) in model.going_on:
            return False
        if c.islower():
            return (language, "…" + word) in model.ending
        return cased or not first or (language, "…" + word) in model.ending
    if _NUMBER.fullmatch(m.before):
        if not _ORDINAL.fullmatch(m.before):
            return True
        if c.islower():
            return (language, low) in model.starters
        return (language, low) not in model.numbered or (language, low) in model.starters
    word = m.before
    if len(word) == 1 and word.isalpha():
        return False
    if "." in word and _PIECES.fullmatch(word) and len(word.split(".")[0]) <= 3:
        return (language, word) in model.ending and first[:1].isupper() and (language, low) in model.starters
    if (language, word) in model.short:
        return (language, word) in model.ending and first[:1].isupper() and (language, low) in model.starters
    return True


_THAI = re.compile("[฀-๿]")


def split_block(block: str, language: str, model: Model) -> list[str]:
    """A block's sentences, blanks made single."""
    out, start = [], 0
    if language == "th":
        pieces = [""]
        for piece in re.split(r"(\s+)", block):
            if piece.isspace():
                pieces.append("")
            else:
                pieces[-1] += piece
        out = _rejoined(pieces)
    else:
        for m in marks(block):
            if m.start < start:
                continue
            if _ends(m, language, model, start, block):
                out.append(block[start : m.stop])
                start = m.stop
        out.append(block[start:])
    return [s for x in out if (s := " ".join(x.split()))]


def _rejoined(pieces: list[str]) -> list[str]:
    """Thai pieces: a blank between two pieces without any Thai letter doesn't part them."""
    out: list[str] = []
    thai = False
    for p in pieces:
        now = bool(_THAI.search(p))
        if out and not now and not thai:
            out[-1] += " " + p
        else:
            out.append(p)
        thai = now
    return out


#: Rows of labelled messages that the words of languages are learned from (a sample by hash), the share of them that a
#: language must have, and the telling words kept for each.
SAMPLE_ROWS, LEAST_SHARE, TELLING = 5_000, 0.02, 200


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each message's Latin blocks by label, counted; an empty word counts the messages."""
    held: Counter[tuple[str, str]] = Counter()
    for b in batches:
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            body = plain_body(text) if text else None
            latin = [p for p in blocks(body) if isinstance(_script_or_votes(p, Tongues({})), dict)] if body else []
            if words := {w for p in latin for w in _LETTERS.findall(p.lower())}:
                held.update((label, w) for w in (*words, ""))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.string()), pa.array([w for _, w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["label", "word", "n"])


def learn_languages(df: DataFrame, text: str, label: str | None) -> Tongues:
    """The words that tell Latin-script languages apart, by log-likelihood ratio over labelled messages.

    Labels may be wrong or rare: those with less than ``LEAST_SHARE`` of the messages are no language of their own. At
    most about ``SAMPLE_ROWS`` messages are read, chosen by hash. Without labels the Latin script is one language.
    """
    if label is None:
        return Tongues({})
    rows = df.select(df[label].cast("string").alias("label"), df[text].alias("text")).filter("label IS NOT NULL AND text IS NOT NULL")
    total = rows.count()
    if total > SAMPLE_ROWS:
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE_ROWS / total))
    counts = rows.mapInArrow(_labelled, "label STRING, word STRING, n BIGINT").groupBy("label", "word").agg(F.sum("n").alias("n")).filter(f"word = '' OR n >= {SEEN}")
    per: dict[str, dict[str, int]] = {}
    for r in counts.collect():  # words of a bounded sample
        per.setdefault(r.label, {})[r.word] = r.n
    messages = sum(own.get("", 0) for own in per.values())
    per = {k: own for k, own in per.items() if own.get("", 0) >= LEAST_SHARE * messages}
    if not per:
        return Tongues({})
    size = {k: own.pop("") for k, own in per.items()}
    whole = sum(size.values())
    summed: Counter[str] = Counter()
    for own in per.values():
        summed.update(own)
    telling: set[str] = set()
    for k, own in per.items():
        ranked = sorted(((_llr(n, size[k], summed[w] - n, whole - size[k]), w) for w, n in own.items() if n * whole > summed[w] * size[k]), reverse=True)
        telling.update(w for x, w in ranked[:TELLING] if x >= LEAST)
    words = {}
    for w in telling:
        rate = {k: math.log((own.get(w, 0) + 0.5) / (size[k] + 1)) for k, own in per.items()}
        least = min(rate.values())
        words[w] = tuple((k, x - least) for k, x in sorted(rate.items()))
    return Tongues(words, max(size, key=lambda k: (size[k], k)))


_COUNTS = "language STRING, kind STRING, word STRING, outcome STRING, n BIGINT"
_PARSED = f"kl_row BIGINT, kl_doc BIGINT, kl_blocks ARRAY<STRING>, kl_languages ARRAY<STRING>, {_COUNTS}"
#: Distinct events that a map task counts before it hands them on; bounds its memory.
COUNTED = 500_000
#: Most rows of the learned model that are sent to every executor; a larger one is joined to the documents' words.
MODEL_ROWS = 300_000


def _parse(model):
    """Messages to rows of two kinds: a message's blocks with their languages, and counts of events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, str, str, str]] = Counter()
        tongues, row = model.value, TaskContext.get().partitionId() << 40
        schema = pa.schema([("kl_row", pa.int64()), ("kl_doc", pa.int64()), ("kl_blocks", pa.list_(pa.string())), ("kl_languages", pa.list_(pa.string())), *((c, pa.string()) for c in ("language", "kind", "word", "outcome")), ("n", pa.int64())])

        def made(columns: dict[str, list], size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

        words: dict[str, Counter[str]] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            held.update({(language, "w", w, ""): n for language, own in words.items() for w, n in own.items()})
            words.clear()
            columns = dict(zip(("language", "kind", "word", "outcome"), map(list, zip(*held)))) | {"n": list(held.values())}
            out = made(columns, len(held))
            held.clear()
            return out

        for b in batches:
            rows, docs, parts, languages = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                body = plain_body(text) if text else None
                if not (own := blocks(body) if body else []):
                    continue
                told = languages_of(own, tongues)
                for block, language in zip(own, told):
                    count_events(block, language, held, words)
                rows.append(row)
                docs.append(doc)
                parts.append(own)
                languages.append(told)
                row += 1
            if rows:
                yield made({"kl_row": rows, "kl_doc": docs, "kl_blocks": parts, "kl_languages": languages}, len(rows))
            if len(held) + sum(map(len, words.values())) >= COUNTED:
                yield flush()
        if held or words:
            yield flush()

    return run


def parsed_messages(df: DataFrame, doc_id: str, text: str, label: str | None = None) -> DataFrame:
    """Blocks and counts of all messages, parsed once and written to the shared folder."""
    tongues = df.sparkSession.sparkContext.broadcast(learn_languages(df, text, label))
    return settled(df.select(df[doc_id].cast("bigint").alias("kl_doc"), df[text].alias("kl_text")).mapInArrow(_parse(tongues), _PARSED))


def learn(parsed: DataFrame) -> DataFrame:
    """The model as a table ``what, language, word``: counts over all bodies and what they tell. Words are judged where
    they are counted."""
    counts = settled(parsed.filter("kind IS NOT NULL").groupBy("language", "kind", "word", "outcome").agg(F.sum("n").alias("n")))
    totals: dict[tuple[str, str], int] = {}
    for r in counts.groupBy("language", "kind", "outcome").agg(F.sum("n").alias("n")).collect():  # languages x kinds x outcomes
        totals[r.language, r.kind] = totals.get((r.language, r.kind), 0) + r.n
        if r.kind == "m" and r.outcome == "end":
            totals[r.language, "end"] = r.n
    alone = counts.filter("kind = 'w'").select("language", "word", F.col("n").alias("alone"))
    per = (
        counts.filter("kind IN ('d', 's', 'n', 'e')")
        .groupBy("language", "kind", "word")
        .agg(F.map_from_entries(F.collect_list(F.struct("outcome", "n"))).alias("n"))
        .join(alone, ["language", "word"], "left")
    )
    judged = F.udf(lambda language, kind, word, n, a: judge(language, kind, word, n, totals, a or 0), "array<string>", useArrow=True)
    rows = settled(per.select("language", "kind", "word", F.explode(judged("language", "kind", "word", "n", "alone")).alias("what")))
    short = rows.filter("what = 'short'").select("language", "word").distinct()
    kept = rows.filter("what <> 'ending' OR kind = 'e'").unionByName(rows.filter("what = 'ending' AND kind = 'd'").join(short, ["language", "word"], "left_semi").select(*rows.columns))
    word = F.when((F.col("kind") == "e") & (F.col("what") == "ending"), F.concat(F.lit("…"), "word")).otherwise(F.col("word"))
    return kept.select("what", "language", word.alias("word")).distinct()


def _model(rows) -> Model:
    sets: dict[str, set[tuple[str, str]]] = {k: set() for k in Model._fields}
    for what, language, word in rows:
        sets[what].add((language, word))
    return Model(**{k: frozenset(v) for k, v in sets.items()})


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(message, language, word) of all that a message's marks may ask the model about."""
    for b in batches:
        found = []
        for row, parts, told in zip(*(b.column(k).to_pylist() for k in range(3))):
            own = set()
            for block, language in zip(parts, told):
                for m in marks(block):
                    own.update((language, w) for w in (m.before, _ending(m.before), "…" + _ending(m.before), m.first.lower()))
            found.extend((row, *x) for x in own)
        rows, languages, words = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(languages, pa.string()), pa.array(words, pa.string())], ["kl_row", "language", "word"])


def _split(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = model.value if model is not None else None
        for b in batches:
            docs, found = [], []
            told = [None] * b.num_rows if shared is not None else b.column(3).to_pylist()
            for doc, parts, languages, rows in zip(*(b.column(k).to_pylist() for k in range(3)), told):
                known = shared if shared is not None else _model((r["what"], r["language"], r["word"]) for r in rows or ())
                own: dict[str, None] = {}
                for block, language in zip(parts, languages):
                    own.update(dict.fromkeys(split_block(block, language, known)))
                docs.extend([doc] * len(own))
                found.extend(own)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.string())], ["kl_doc", "sentence"])

    return run


def sentences(df: DataFrame, doc_id: str, text: str, label: str | None = None) -> DataFrame:
    """``doc_id, sentence``: the distinct sentences of each message's body.

    Null, empty and blank texts, and messages without a plain body, give no rows. Documents under another id come out on
    their own; very long bodies are one task's work each. ``label``: a column of (possibly wrong) languages. The learned
    model is sent to all where it is small; beyond ``MODEL_ROWS`` each message gets the part of it that its own words ask
    for, by an equi-join.
    """
    parsed = parsed_messages(df, doc_id, text, label)
    model = settled(learn(parsed))
    docs = parsed.filter("kl_blocks IS NOT NULL")
    out = "kl_doc BIGINT, sentence STRING"
    if model.count() <= MODEL_ROWS:
        shared = df.sparkSession.sparkContext.broadcast(_model(model.collect()))
        return docs.select("kl_doc", "kl_blocks", "kl_languages").mapInArrow(_split(shared), out).withColumnRenamed("kl_doc", doc_id)
    asked = docs.select("kl_row", "kl_blocks", "kl_languages").mapInArrow(_asked, "kl_row BIGINT, language STRING, word STRING")
    own = asked.join(model, ["language", "word"]).groupBy("kl_row").agg(F.collect_list(F.struct("what", "language", "word")).alias("kl_model"))
    return docs.join(own, "kl_row", "left").select("kl_doc", "kl_blocks", "kl_languages", "kl_model").mapInArrow(_split(None), out).withColumnRenamed("kl_doc", doc_id)
