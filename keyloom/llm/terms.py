"""Frequency of every distinct term: a vertical layout of record-identifier bitmaps with parallel counters.

A term's records are kept in containers of 65,536 ids each (the id's upper bits are the chunk). A container is a sorted
array of 16-bit ids up to 4,096 members and a bitmap of 8,192 bytes beyond, and has one counter per member in the order
of the ids. Containers are built in the map tasks, so that a hot term is reduced there, and packed by the hundred into
one row for each bucket of (term, region of ids), so that the many terms seen once cost few bytes; a term with a third of
all records is spread over all its regions. They are merged by union, which makes a record delivered again count once.
Document frequency is read from the cardinalities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.packing import narrow, pack, unpack
from keyloom.session import settled

ARRAY_MOST = 4096
CHUNK = 1 << 16
#: Chunks in a region: what a bucket holds of one term at once is bounded by 2**22 records.
REGION = 6
#: Rows and bytes that a map task gathers before it builds containers; they bound its memory.
GATHER, GATHER_BYTES = 500_000, 64_000_000
#: Buckets a partition of the shuffle; a task merges one at a time.
BUCKETS = 4
_PACKED = "kl_part INT, kl_bucket INT, kl_data BINARY"
_MERGED = "kl_term STRING, kl_chunk BIGINT, kl_ids BINARY, kl_counts BINARY, kl_n INT, kl_occurrences BIGINT"


def _binary(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value a slice of ``flat``; the slices lie one behind the other."""
    offsets = np.append(starts, ends[-1:] if len(ends) else [0]) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _containers(terms: pa.Array, chunk: np.ndarray, low: np.ndarray, count: np.ndarray, starts: np.ndarray) -> Iterator[tuple]:
    """Containers of members that lie sorted; ``starts`` has where each begins. Long ones come out as bitmaps."""
    ends = np.append(starts[1:], len(low))
    sizes = ends - starts
    sums = np.add.reduceat(count, starts) if len(starts) else count[:0]
    if not (long := sizes > ARRAY_MOST).any():
        yield terms, chunk, _binary(low, starts, ends), _binary(count, starts, ends), sizes, sums
        return
    keep = np.repeat(~long, sizes)
    if (~long).any():
        s = np.cumsum(sizes[~long]) - sizes[~long]
        few = pa.array(~long)
        yield terms.filter(few), chunk[~long], _binary(low[keep], s, s + sizes[~long]), _binary(count[keep], s, s + sizes[~long]), sizes[~long], sums[~long]
    for k in np.flatnonzero(long):
        bits = np.zeros(CHUNK, np.uint8)
        bits[low[starts[k] : ends[k]]] = 1
        counts = np.ascontiguousarray(count[starts[k] : ends[k]]).tobytes()
        yield terms.slice(k, 1), chunk[k : k + 1], pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), pa.array([counts], pa.binary()), sizes[k : k + 1], sums[k : k + 1]


def _batch(part: tuple) -> pa.RecordBatch:
    terms, chunk, ids, counts, sizes, sums = part
    columns = [terms, pa.array(chunk, pa.int64()), ids, counts, pa.array(sizes, pa.int32()), pa.array(sums, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["kl_term", "kl_chunk", "kl_ids", "kl_counts", "kl_n", "kl_occurrences"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= GATHER or size >= GATHER_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _distinct(code: np.ndarray, ident: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members sorted by term and id, each once: a repeat adds nothing, the smallest count holds."""
    order = np.lexsort((count, ident, code))
    code, ident, count = code[order], ident[order], count[order]
    fresh = np.append(True, (code[1:] != code[:-1]) | (ident[1:] != ident[:-1])) if len(code) else np.zeros(0, bool)
    return code[fresh], ident[fresh], count[fresh]


def _build(partitions: int):
    """Rows (term, id, count) to packed containers, each as far as the rows gathered go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches):
            coded = _flat(t["kl_term"]).dictionary_encode(null_encoding="encode")
            names = [None if x is None else x.encode() for x in coded.dictionary.to_pylist()]
            code, ident, count = _distinct(coded.indices.to_numpy(zero_copy_only=False), t["kl_id"].to_numpy(), t["kl_count"].to_numpy())
            # A bucket by the hashes of the term and of the region its id lies in.
            hashed = np.fromiter((zlib.crc32(x) if x is not None else 7 for x in names), np.uint64, len(names))
            mixed = (hashed[code] ^ ((ident >> (16 + REGION)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            bucket = (mixed % np.uint64(partitions * BUCKETS)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # by term and id within a bucket
            bucket, code, ident, count = bucket[order], code[order], ident[order], count[order]
            firsts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            data = []
            for a, b in zip(firsts, np.append(firsts[1:], len(bucket))):
                own, chunk = code[a:b], ident[a:b] >> 16
                starts = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (chunk[1:] != chunk[:-1])))
                heads = np.flatnonzero(np.append(True, own[starts][1:] != own[starts][:-1]))  # containers where a term begins
                listed = [names[k] for k in own[starts][heads]]
                size = np.fromiter((0 if x is None else len(x) + 1 for x in listed), np.int64, len(listed))  # 0 is the null term
                least = int(chunk.min())
                lowest = int(count[a:b].min())
                data.append(pack(
                    np.array([least, lowest], np.int64), narrow(size), np.frombuffer(b"".join(x for x in listed if x), np.uint8), narrow(np.diff(np.append(heads, len(starts)))),
                    narrow(chunk[starts] - least), narrow(np.diff(np.append(starts, b - a))), (ident[a:b] & (CHUNK - 1)).astype(np.uint16), narrow(count[a:b] - lowest) if int(count[a:b].max()) - lowest < 1 << 32 else count[a:b] - lowest, planes=True,
                ))
            own = bucket[firsts]
            yield pa.RecordBatch.from_arrays([pa.array(own // BUCKETS, pa.int32()), pa.array(own, pa.int32()), pa.array(data, pa.binary())], ["kl_part", "kl_bucket", "kl_data"])

    return run


def _members(data: bytes) -> tuple[list[bytes | None], np.ndarray, np.ndarray, np.ndarray]:
    """(terms, number of the term, id, count) of the members of packed containers."""
    (least, lowest), size, text, each, chunk, sizes, low, count = unpack(data)
    ends = np.cumsum(np.maximum(size.astype(np.int64) - 1, 0))
    raw = text.tobytes()
    names = [None if n == 0 else raw[e - n + 1 : e] for n, e in zip(size.astype(np.int64).tolist(), ends.tolist())]
    term = np.repeat(np.repeat(np.arange(len(names)), each), sizes)
    return names, term, (np.repeat(chunk.astype(np.int64) + least, sizes) << 16) | low, count.astype(np.int64) + lowest


def _union(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The containers of one bucket, those of the same term and chunk merged."""
    known: dict[bytes | None, int] = {}
    codes, idents, counts = [], [], []
    for data in parts:
        names, term, ident, count = _members(data)
        codes.append(np.array([known.setdefault(x, len(known)) for x in names], np.int64)[term])
        idents.append(ident)
        counts.append(count)
    code, ident, count = _distinct(np.concatenate(codes), np.concatenate(idents), np.concatenate(counts))
    chunk = ident >> 16
    starts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])))
    terms = pa.array([None if x is None else x.decode() for x in known], pa.string()).take(pa.array(code[starts]))
    for part in _containers(terms, chunk[starts], (ident & (CHUNK - 1)).astype(np.uint16), count, starts):
        yield _batch(part)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the buckets of a partition one after the other; rows lie sorted by them."""
    at, parts = None, []
    for b in batches:
        for bucket, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if bucket != at:
                if parts:
                    yield from _union(parts)
                at, parts = bucket, []
            parts.append(data)
    if parts:
        yield from _union(parts)


def term_bitmaps(df: DataFrame, term: str, record_id: str, count: str) -> DataFrame:
    """The vertical layout: ``kl_term, kl_chunk, kl_ids, kl_counts, kl_n, kl_occurrences``, one row per container.

    ``kl_n`` is the container's cardinality, ``kl_occurrences`` the sum of its counters. A null term is a term like any
    other, a null count is 0, a record repeated with the same term counts once (if its counts differ, the smallest
    holds). Rows with a null record id have no place in a bitmap; ``term_frequencies`` adds them. No rows, no
    containers.
    """
    rows = df.filter(df[record_id].isNotNull()).select(
        df[term].cast("string").alias("kl_term"), df[record_id].cast("bigint").alias("kl_id"), F.coalesce(df[count].cast("bigint"), F.lit(0)).alias("kl_count")
    )
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInArrow(_build(partitions), _PACKED)
    return packed.repartitionById(partitions, F.col("kl_part")).sortWithinPartitions("kl_bucket").mapInArrow(_merge, _MERGED)


def term_frequencies(df: DataFrame, term: str, record_id: str, count: str) -> DataFrame:
    """``term, occurrences, records`` of every distinct term, null included.

    A row with a null record id can't be told from a repeat: it adds its count and no record.
    """
    merged = term_bitmaps(df, term, record_id, count).select("kl_term", F.col("kl_n").cast("bigint").alias("n"), "kl_occurrences")
    loose = df.filter(df[record_id].isNull()).select(
        df[term].cast("string").alias("kl_term"), F.lit(0).cast("bigint").alias("n"), F.coalesce(df[count].cast("bigint"), F.lit(0)).alias("kl_occurrences")
    )
    return merged.unionByName(loose).groupBy("kl_term").agg(F.sum("kl_occurrences").alias("occurrences"), F.sum("n").alias("records")).withColumnRenamed("kl_term", "term")


def term_verdicts(
    df: DataFrame, term: str, record_id: str, count: str, common_share: float = 0.004, rare_records: int = 3, rare_occurrences: int = 20
) -> DataFrame:
    """``term, occurrences, records, verdict`` of every non-null term; verdict is ``common``, ``rare`` or null.

    ``common``: in more than ``common_share`` of all records (those with a null term included). ``rare``: in fewer than
    ``rare_records`` records and with fewer than ``rare_occurrences`` occurrences. An empty table gives no rows.
    """
    found = settled(term_frequencies(df, term, record_id, count))
    total = found.agg(F.sum("records")).first()[0] or 0
    verdict = F.when(F.col("records") > common_share * total, "common").when(
        (F.col("records") < rare_records) & (F.col("occurrences") < rare_occurrences), "rare"
    )
    return found.filter("term IS NOT NULL").withColumn("verdict", verdict)
