"""Encoding of a whole corpus with a byte-level BPE vocabulary through a global shuffle of distinct words.

Texts are cut into pre-tokens ("words"), and every word keeps its position. A map task replaces the words of a block of
documents by numbers and sends each of the block's distinct words, once, to the bucket of its hash: a word that makes
up a third of the corpus is one row a block. A bucket encodes every distinct word once, the ids go back to the words'
blocks, and a block puts them in their positions. It is one linear plan of two shuffles, all of it in columnar form,
so that no row is made for a single token.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.packing import narrow, pack, unpack

#: Place of the public vocabulary's ranks (one token a line: base64 bytes, id).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts texts before the merges, part of the vocabulary's definition.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters and documents in a block; bounds the memory of the first and the last step.
BLOCK_CHARS, BLOCK_DOCS = 4_000_000, 4_000
#: The row of a block that holds its documents and positions.
POSITIONS = -1
_ROWS = "kl_key INT, kl_block BIGINT, kl_bucket INT, kl_first INT, kl_data BINARY"


def vocabulary_bytes(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


@lru_cache(maxsize=2)
def _encoder(raw: bytes):
    import tiktoken

    return tiktoken.Encoding("keyloom", pat_str=PATTERN, mergeable_ranks=_ranks(raw), special_tokens={})._core_bpe.encode_single_piece


class _Numbers(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _cut(buckets: int):
    """Documents to rows: one row of positions a block, and one row of distinct words a block and bucket."""

    def rows(block: int, docs: list, counts: list, numbers: _Numbers, places: array) -> pa.RecordBatch:
        words = [w.encode() for w in numbers]
        bucket = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")  # a bucket's words get consecutive numbers
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        place = rank[np.frombuffer(places, np.uint32)] if len(places) else np.zeros(0, np.uint32)
        known = np.array([x is not None for x in docs])
        ids = np.array([x if x is not None else 0 for x in docs], np.int64)
        out = [(block, POSITIONS, len(words), pack(ids, known, np.array(counts, np.uint32), narrow(place)))]
        firsts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(firsts)):
            own = [words[k] for k in order[firsts[b] : firsts[b + 1]]]
            out.append((block, int(b), int(firsts[b]), pack(narrow(np.fromiter(map(len, own), np.uint32, len(own))), np.frombuffer(b"".join(own), np.uint8))))
        blocks, buckets_, firsts_, data = zip(*out)
        keys = [block % buckets if b == POSITIONS else b for b in buckets_]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), pa.array(blocks, pa.int64()), pa.array(buckets_, pa.int32()), pa.array(firsts_, pa.int32()), pa.array(data, pa.binary())],
            ["kl_key", "kl_block", "kl_bucket", "kl_first", "kl_data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(PATTERN).findall
        block = TaskContext.get().partitionId() << 32
        docs, counts, numbers, places, chars = [], [], _Numbers(), array("I"), 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = cut(text) if text else []
                places.extend(map(numbers.__getitem__, words))
                docs.append(doc)
                counts.append(len(words))
                chars += len(text or "")
                if chars >= BLOCK_CHARS or len(docs) >= BLOCK_DOCS:
                    yield rows(block, docs, counts, numbers, places)
                    block += 1
                    docs, counts, numbers, places, chars = [], [], _Numbers(), array("I"), 0
        if docs:
            yield rows(block, docs, counts, numbers, places)

    return run


def _encode(vocabulary):
    """Encodes each distinct word of a bucket once; rows of positions pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value)
        known: dict[bytes, list[int]] = {}
        at = None
        for b in batches:
            data = []
            for bucket, raw in zip(b.column(2).to_pylist(), b.column(4).to_pylist()):
                if bucket == POSITIONS:
                    data.append(raw)
                    continue
                if bucket != at:  # rows lie by bucket: only one bucket's words are held
                    known, at = {}, bucket
                sizes, flat = unpack(raw)
                text, ends = flat.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
                ids, lengths, start = array("I"), array("I"), 0
                for end in ends:
                    word = text[start:end]
                    start = end
                    if (got := known.get(word)) is None:
                        known[word] = got = encode(word)
                    ids.extend(got)
                    lengths.append(len(got))
                data.append(pack(narrow(np.frombuffer(lengths, np.uint32)), narrow(np.frombuffer(ids, np.uint32))))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(data, pa.binary())], b.schema.names)

    return run


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, bucket) to documents with their ids."""

    def done(docs: tuple, parts: list) -> pa.RecordBatch:
        ids, known, counts, place = docs
        lengths = np.concatenate([np.zeros(0, np.int64), *(p[0].astype(np.int64) for p in parts)])
        flat = np.concatenate([np.zeros(0, np.int32), *(p[1].astype(np.int32) for p in parts)])
        starts = np.cumsum(lengths) - lengths
        sizes = lengths[place]
        values = _gather(flat, starts[place], sizes)
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts.astype(np.int64)))]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=~known), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))], ["kl_doc", "ids"]
        )

    at, docs, parts = None, None, []
    for b in batches:
        for block, bucket, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist()):
            if block != at:
                if at is not None:
                    yield done(docs, parts)
                at, docs, parts = block, None, []
            if bucket == POSITIONS:
                docs = tuple(unpack(data))
            else:
                parts.append(unpack(data))
    if at is not None:
        yield done(docs, parts)


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, buckets: int | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of every text, without special tokens; one row a row of ``df``.

    Null and empty texts give an empty list, repeated documents come out each, null doc_ids stay null, an empty table
    gives no rows. Strings of special tokens in a text are ordinary text. ``buckets`` spreads the distinct words
    (default: the session's shuffle partitions, which grow with the data).
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary))  # a vocabulary's file: its size is fixed
    cut = df.select(df[doc_id].cast("bigint").alias("kl_doc"), df[text].alias("kl_text")).mapInArrow(_cut(n), _ROWS)
    coded = cut.repartitionById(n, F.col("kl_key")).sortWithinPartitions("kl_bucket").mapInArrow(_encode(shared), _ROWS)
    place = F.pmod(F.shiftright("kl_block", 32) + F.col("kl_block").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(n)).cast("int")
    whole = coded.repartitionById(n, place).sortWithinPartitions("kl_block", "kl_bucket").mapInArrow(_assemble, "kl_doc BIGINT, ids ARRAY<INT>")
    return whole.withColumnRenamed("kl_doc", doc_id)


def decode_corpus(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of id lists, by a join of ids with the table of the tokens' bytes.

    The table has one entry for each id of the vocabulary and is held by every executor as an array, so that the join is
    a gather and needs no shuffle. Null and empty lists give an empty text; an id outside the vocabulary is an error.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(shared.value)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            tokens[k] = token
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat, starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes
        for b in batches:
            lists = b.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            per = np.append(0, np.cumsum([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()])).astype(np.int64)
            ends = np.append(0, np.cumsum(sizes[values]))[per]
            data = _gather(flat, starts[values], sizes[values]).tobytes()
            texts = [data[s:e].decode("utf-8", "replace") for s, e in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["kl_doc", "text"])

    rows = df.select(df[doc_id].cast("bigint").alias("kl_doc"), df[ids].cast("array<int>").alias("kl_ids"))
    return rows.mapInArrow(run, "kl_doc BIGINT, text STRING").withColumnRenamed("kl_doc", doc_id)
