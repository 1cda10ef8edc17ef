"""Passages of evaluation texts in a corpus of messages: a distributed positional inverted index.

The corpus is cut into blocks of documents, and each block's index has, for every term of the test texts, the sorted
positions at which it stands. The index is written once to the shared folder. Every window of a test text is joined by
its term that is rarest in the whole corpus to the blocks that hold this term, so that a block sees only the test texts
that it may hold; there the windows' position lists are intersected, shifted by their places and beginning with the
rarest. A block is one task's work, so no list of a common term is ever shuffled apart or held whole, and nothing about the
test texts is kept on the driver.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.mime import readable
from keyloom.session import settled

#: Consecutive words that make a passage.
WORDS = 12
#: Characters and documents in a block of the index.
BLOCK_CHARS, BLOCK_DOCS = 4_000_000, 4_000
#: Test texts in one list of a block's candidates, and most terms that the index is limited to; with more it has every term.
ITEMS_AT_ONCE, TERMS = 2_000, 200_000
_INDEX = "kl_block BIGINT, kl_docs ARRAY<BIGINT>, kl_starts ARRAY<BIGINT>, kl_terms ARRAY<STRING>, kl_counts ARRAY<INT>, kl_positions ARRAY<BINARY>"


@lru_cache(maxsize=1)
def _word():
    import regex

    return regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str) -> list[str]:
    """Unbroken runs of letters and digits, composed and without case."""
    return _word().findall(unicodedata.normalize("NFC", text).casefold() if not text.isascii() else text.lower())


def _indexed(terms, gap: int):
    def rows(block: int, docs: list[int], starts: list[int], numbers: list[np.ndarray], places: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
        number = np.concatenate([np.zeros(0, np.int64), *numbers])
        place = np.concatenate([np.zeros(0, np.int64), *places])
        order = np.argsort(number, kind="stable")
        number, place = number[order], place[order].astype(np.uint32)
        firsts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, np.int64)
        ends = np.append(firsts[1:], len(number)).astype(np.int64) if len(number) else firsts
        lists = [place[a:b].tobytes() for a, b in zip(firsts, ends)]
        own = [names[number[a]] for a in firsts]
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), one(docs, pa.int64()), one(starts, pa.int64()), one(own, pa.string()), one((ends - firsts).tolist(), pa.int32()), one(lists, pa.binary())],
            ["kl_block", "kl_docs", "kl_starts", "kl_terms", "kl_counts", "kl_positions"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.value if terms is not None else None
        names: list[str] = list(wanted) if wanted is not None else []
        known = {t: k for k, t in enumerate(names)}
        block = TaskContext.get().partitionId() << 32
        docs, starts, numbers, places, at, chars = [], [], [], [], 0, 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if doc is None or not text:
                    continue
                docs.append(doc)
                starts.append(at)
                for part in readable(text):
                    words = words_of(part)
                    if wanted is None:
                        for w in words:
                            if w not in known:
                                known[w] = len(names)
                                names.append(w)
                    number = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
                    own = np.flatnonzero(number >= 0)
                    numbers.append(number[own])
                    places.append(own + at)
                    at += len(words) + gap  # no passage goes over the end of a part, not even with some slack
                chars += len(text)
                if chars >= BLOCK_CHARS or len(docs) >= BLOCK_DOCS:
                    yield rows(block, docs, starts, numbers, places, names)
                    block += 1
                    docs, starts, numbers, places, at, chars = [], [], [], [], 0, 0
        if docs:
            yield rows(block, docs, starts, numbers, places, names)

    return run


def build_index(corpus: DataFrame, doc_id: str, text: str, terms: list[str] | None = None, slack: int = 0) -> DataFrame:
    """The index of ``corpus``, one row a block of documents; with ``terms`` of these only. Null texts have no entry.

    ``slack``: the greatest one that the index will be asked with; parts and documents lie so far apart that no match can
    reach from one into the next.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(terms) if terms is not None else None
    rows = corpus.select(corpus[doc_id].cast("bigint").alias("kl_doc"), corpus[text].alias("kl_text"))
    return settled(rows.mapInArrow(_indexed(shared, 1 + 2 * slack), _INDEX))


def _anchors(length: int):
    """Column function (frequency of each word of a text) -> the windows by their rarest word: its place, and the first
    and the last window that has it as its rarest. Windows with a word the corpus lacks are left out."""

    def of(frequency: list[int | None]) -> list[tuple[int, int, int]]:
        n = np.array([x or 0 for x in frequency], np.int64)
        if len(n) < length:
            return []
        windows = np.lib.stride_tricks.sliding_window_view(n, length)
        first = np.flatnonzero(windows.min(axis=1) > 0)
        place = first + windows[first].argmin(axis=1)
        begins = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1))) if len(first) else first
        ends = np.append(begins[1:], len(first)) - 1 if len(first) else first
        return [(int(p), int(a), int(b)) for p, a, b in zip(place[begins], first[begins], first[ends])]

    return F.udf(of, "array<struct<place: int, first: int, last: int>>", useArrow=True)


def _near(held: np.ndarray, wanted: np.ndarray, slack: int) -> np.ndarray:
    """Which of ``wanted`` have a place in the sorted ``held``, or one at most ``slack`` away."""
    k = np.searchsorted(held, wanted - slack)
    return (k < len(held)) & (held[np.minimum(k, len(held) - 1)] <= wanted + slack)


def _look_up(length: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, starts, terms, lists, asked in zip(*(b.column(k) for k in range(5))):
                doc, start = np.array(docs.values.to_numpy()), np.array(starts.values.to_numpy())
                held = {t: x for t, x in zip(terms.values.to_pylist(), lists.values)}
                ready: dict[str, np.ndarray] = {}

                def places(w: str) -> np.ndarray:
                    if w not in ready:
                        ready[w] = np.frombuffer(held[w].as_buffer(), np.uint32).astype(np.int64)
                    return ready[w]

                found: set[tuple[int, int]] = set()
                for item in asked.as_py():
                    words, frequency = item["words"], item["frequency"]
                    done: set[int] = set()
                    for anchor in item["anchors"]:
                        at = places(words[anchor["place"]])
                        own = np.searchsorted(start, at, "right") - 1  # the document of each place
                        for first in range(anchor["first"], anchor["last"] + 1):
                            window = words[first : first + length]
                            if not all(w in held for w in window):
                                continue
                            kept = ~np.isin(own, list(done)) if done else np.ones(len(at), bool)
                            begin = np.concatenate([at[kept] - (anchor["place"] - first) - d for d in range(-slack, slack + 1)])
                            document = np.tile(own[kept], 2 * slack + 1)
                            for k in sorted(range(length), key=lambda k: (frequency[first + k], k)):
                                if not len(begin):
                                    break
                                hit = _near(places(window[k]), begin + k, slack)
                                begin, document = begin[hit], document[hit]
                            done.update(document.tolist())
                    found.update((int(doc[k]), item["item"]) for k in done)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], ["kl_doc", "kl_item"])

    return run


def leaked_items(
    corpus: DataFrame, doc_id: str, text: str, tests: DataFrame, item_id: str, passage: str, length: int = WORDS, slack: int = 0, index: DataFrame | None = None
) -> DataFrame:
    """``doc_id, item_id`` of each message that holds ``length`` consecutive words of a test text, each pair once.

    ``slack`` 0 gives exact phrases. With more, there is a place in a part from which on each word stands at most so many
    places beside its own (proximity): words may change order or have others between them, within these bounds.
    Null and empty texts on either side, and test texts shorter than ``length``, match nothing; test texts with the same
    words match alike; empty tables give no rows. ``index``: one kept from ``build_index``, with all terms of the test
    texts and at least this slack; then the corpus isn't read.
    """
    split = F.udf(words_of, "array<string>", useArrow=True)
    rows = tests.select(tests[item_id].cast("bigint").alias("kl_item"), tests[passage].alias("kl_text")).filter("kl_item IS NOT NULL AND kl_text IS NOT NULL")
    items = settled(rows.select("kl_item", split("kl_text").alias("kl_words")).filter(F.size("kl_words") >= length).withColumn("kl_no", F.monotonically_increasing_id()))
    count = items.count()
    vocabulary = items.select(F.explode("kl_words").alias("kl_term")).distinct()
    terms = [r.kl_term for r in vocabulary.limit(TERMS + 1).collect()]
    few = len(terms) <= TERMS
    if index is None:
        index = build_index(corpus, doc_id, text, sorted(terms) if few else None, slack)
    postings = index.select("kl_block", F.explode(F.arrays_zip("kl_terms", "kl_counts")).alias("x")).select("kl_block", F.col("x.kl_terms").alias("kl_term"), F.col("x.kl_counts").alias("n"))
    frequency = postings.groupBy("kl_term").agg(F.sum("n").alias("kl_n"))
    if few:  # at most TERMS rows
        frequency = F.broadcast(frequency.join(F.broadcast(vocabulary), "kl_term", "left_semi"))
    each = items.select("kl_no", F.posexplode("kl_words").alias("pos", "kl_term")).join(frequency, "kl_term", "left")
    told = each.groupBy("kl_no").agg(F.array_sort(F.collect_list(F.struct("pos", "kl_n"))).alias("x")).select("kl_no", F.col("x.kl_n").alias("kl_frequency"))
    known = settled(items.join(told, "kl_no").withColumn("kl_anchors", _anchors(length)("kl_frequency")).filter(F.size("kl_anchors") > 0))
    anchors = known.select("kl_no", F.explode("kl_anchors").alias("a"), "kl_words").select("kl_no", "a", F.get("kl_words", F.col("a.place")).alias("kl_term"))
    met = anchors.join(postings.select("kl_block", "kl_term"), "kl_term").groupBy("kl_block", "kl_no").agg(F.collect_list("a").alias("anchors"))
    asked = met.join(known, "kl_no").select("kl_block", F.pmod(F.hash("kl_no"), F.lit(-(-count // ITEMS_AT_ONCE) or 1)).alias("kl_list"), F.struct(F.col("kl_item").alias("item"), F.col("kl_words").alias("words"), F.col("kl_frequency").alias("frequency"), "anchors").alias("q"))
    lists = asked.groupBy("kl_block", "kl_list").agg(F.collect_list("q").alias("kl_asked"))
    found = index.join(lists, "kl_block").select("kl_docs", "kl_starts", "kl_terms", "kl_positions", "kl_asked").mapInArrow(_look_up(length, slack), "kl_doc BIGINT, kl_item BIGINT")
    return found.distinct().withColumnsRenamed({"kl_doc": doc_id, "kl_item": item_id})
