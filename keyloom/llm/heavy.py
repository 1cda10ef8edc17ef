"""Most frequent items in bounded memory: combinatorial group testing.

Each of ``depth`` rows hashes an item's 32-bit fingerprint to one of ``width`` buckets; a bucket keeps the total weight
and, for every bit of the fingerprint, the weight of the items with that bit set. Where one item holds more than half
of a bucket, its fingerprint is read off the counters directly. Sketches are linear: those of all partitions are added,
level by level where they are many. What was decoded is verified by exact sums over the rows with a candidate's fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.packing import narrow, pack, unpack
from keyloom.llm.terms import term_bitmaps

BITS = 32
#: Buckets in a piece of the sketch; a piece is what is shuffled and added.
PIECE = 512
GATHER = 250_000
#: Sketches that are added by one task at most, and sketches a core that the rows are read into.
FAN, A_CORE = 64, 2
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_PIECES = "kl_row INT, kl_piece INT, kl_counters BINARY"


def shape(share: float) -> tuple[int, int]:
    """(depth, width) for items with at least ``share`` of the weight: eight buckets to each possible such item."""
    width = PIECE
    while width < 8 / share:
        width *= 2
    return 4, width


def _buckets(prints: np.ndarray, row: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((prints.astype(np.uint64) * _MULTIPLIERS[row]) >> np.uint64(65 - width.bit_length())).astype(np.int64)


def _add(sketch: np.ndarray, prints: np.ndarray, weights: np.ndarray) -> None:
    depth, width, _ = sketch.shape
    exact = float(np.abs(weights.astype(np.float64)).sum()) < 2**53  # sums in double precision have no error below
    for row in range(depth):
        at = _buckets(prints, row, width)
        for bit in range(BITS + 1):
            own = slice(None) if bit == BITS else np.flatnonzero((prints >> np.uint32(bit)) & 1)
            if exact:
                sketch[row, :, bit] += np.bincount(at[own], weights[own], width).astype(np.int64)
            else:
                np.add.at(sketch[row, :, bit], at[own], weights[own])


def _sketched(depth: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, any_rows = np.zeros((depth, width, BITS + 1), np.int64), False
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            prints, weights = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(prints, kind="stable")
            prints, weights = prints[order], weights[order]
            starts = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
            _add(sketch, prints[starts], np.add.reduceat(weights, starts))
            held.clear()

        for b in batches:
            if b.num_rows:
                any_rows = True
                held.append((b.column(0).to_numpy().astype(np.uint32), b.column(1).to_numpy()))
                if sum(len(x[0]) for x in held) >= GATHER:
                    flush()
        if held:
            flush()
        if any_rows:
            keys = [(r, p) for r in range(depth) for p in range(width // PIECE)]
            yield _pieces({k: sketch[k[0], k[1] * PIECE : (k[1] + 1) * PIECE] for k in keys})

    return run


def _pieces(parts: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    """Pieces as (non-empty buckets, their counters), packed."""
    data = []
    for x in parts.values():
        own = np.flatnonzero(x[:, BITS])
        data.append(pack(narrow(own), x[own].reshape(-1), planes=True))
    columns = [pa.array([r for r, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.int32()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kl_row", "kl_piece", "kl_counters"])


def _unpieced(data: bytes, into: np.ndarray) -> None:
    own, counters = unpack(data)
    into[own] += counters.reshape(-1, BITS + 1)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds pieces as they arrive; holds one array for each piece of the sketch at most."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for r, p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            _unpieced(x, sums.setdefault((r, p), np.zeros((PIECE, BITS + 1), np.int64)))
    if sums:
        yield _pieces(sums)


def sketch(rows: DataFrame, depth: int, width: int) -> np.ndarray:
    """The sum of all partitions' sketches of ``kl_print BIGINT, kl_weight BIGINT``; its size depends on the shape only.

    Partitions are read one after the other into ``A_CORE`` sketches a core, so that their number follows the cluster
    and not the data, and they are added in levels of ``FAN``, each salted, so that no task adds them all.
    """
    whole = np.zeros((depth, width, BITS + 1), np.int64)
    made = rows.sparkSession.sparkContext.defaultParallelism * A_CORE
    parts = rows.coalesce(made).mapInArrow(_sketched(depth, width), _PIECES)
    while made > FAN:
        made = -(-made // FAN)
        parts = parts.withColumn("kl_salt", F.pmod(F.spark_partition_id(), F.lit(made))).repartition("kl_row", "kl_piece", "kl_salt").drop("kl_salt").mapInArrow(_added, _PIECES)
    for r in parts.repartition("kl_row", "kl_piece").mapInArrow(_added, _PIECES).collect():  # depth * width / PIECE rows, whatever the input
        _unpieced(r.kl_counters, whole[r.kl_row, r.kl_piece * PIECE : (r.kl_piece + 1) * PIECE])
    return whole


def decode(counters: np.ndarray, least: float) -> dict[int, int]:
    """Fingerprint to estimated weight (an upper bound) of the items that dominate a bucket of at least ``least``."""
    depth, width, _ = counters.shape
    found: dict[int, int] = {}
    for row in range(depth):
        at = np.flatnonzero(counters[row, :, BITS] >= max(least, 1))
        set_bits = counters[row, at, :BITS] * 2 > counters[row, at, BITS][:, None]
        prints = (set_bits.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1).astype(np.uint32)
        for p in prints[_buckets(prints, row, width) == at]:
            one = np.array([p], np.uint32)
            most = min(int(counters[r, _buckets(one, r, width)[0], BITS]) for r in range(depth))
            if most >= least:
                found[int(p)] = most
    return found


def fingerprint(item: Column) -> Column:
    """32 bits of an item's hash, as a bigint."""
    return F.xxhash64(item).bitwiseAND(F.lit(0xFFFFFFFF))


def heavy_items(df: DataFrame, item: str, record_id: str, weight: str, share: float = 0.001) -> DataFrame:
    """``item, approx_weight, weight`` of every non-null item with at least ``share`` of the weight of all records.

    A null weight is 0, weights are taken as non-negative, null items count in the total only, a record delivered again
    counts once (with its smallest weight, should they differ); rows with a null record id count each. An empty table, or a total of 0, gives no rows.

    Memory: a sketch of ``depth * width * 33`` counters in each task and the driver, whatever the number of distinct
    items. Repeats may stay in the sketch: they only add to buckets, and candidates are taken from the weight of the
    distinct records on; the exact sums that follow take every record once. Ties at the limit all come out.
    """
    spark = df.sparkSession
    n = F.coalesce(df[weight].cast("bigint"), F.lit(0))
    rows = df.select(df[item].cast("string").alias("kl_item"), df[record_id].cast("bigint").alias("kl_id"), n.alias("kl_weight"))

    # The total takes each record once by the union of bitmaps of all ids, which are a few bytes a record.
    held = term_bitmaps(rows.withColumn("kl_all", F.shiftright("kl_id", 16).cast("string")), "kl_all", "kl_id", "kl_weight").agg(F.sum("kl_occurrences")).first()[0] or 0
    total = held + (rows.filter("kl_id IS NULL").agg(F.sum("kl_weight")).first()[0] or 0)
    schema = "item STRING, approx_weight BIGINT, weight BIGINT"
    if total <= 0:
        return spark.createDataFrame([], schema)
    depth, width = shape(share)
    prints = rows.filter("kl_item IS NOT NULL AND kl_weight > 0").select(fingerprint(F.col("kl_item")).alias("kl_print"), "kl_weight")
    found = decode(sketch(prints, depth, width), share * total)
    if not found:
        return spark.createDataFrame([], schema)
    # At most depth * width fingerprints, by the sketch's shape: safe to send to every executor.
    candidates = F.broadcast(spark.createDataFrame([(k, v) for k, v in found.items()], "kl_print BIGINT, approx_weight BIGINT"))
    own = rows.filter("kl_item IS NOT NULL").withColumn("kl_print", fingerprint(F.col("kl_item"))).join(candidates, "kl_print", "left_semi").drop("kl_print")
    each = own.filter("kl_id IS NOT NULL").groupBy("kl_id", "kl_item").agg(F.min("kl_weight").alias("kl_weight")).drop("kl_id").unionByName(own.filter("kl_id IS NULL").drop("kl_id"))
    exact = each.groupBy("kl_item").agg(F.sum("kl_weight").alias("weight")).filter(F.col("weight") >= share * total)
    return exact.withColumn("kl_print", fingerprint(F.col("kl_item"))).join(candidates, "kl_print").select(F.col("kl_item").alias("item"), "approx_weight", "weight")
