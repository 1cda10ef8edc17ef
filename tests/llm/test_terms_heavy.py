import random

import numpy as np
import pytest

from keyloom.llm import heavy, packing, terms


def table(spark, rows):
    return spark.createDataFrame(rows, "row_id BIGINT, word STRING, word_count BIGINT, term STRING, kl_n INT")


def rows_of(seed, n=6000):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        word = "hot" if rng.random() < 0.34 else None if rng.random() < 0.01 else f"w{int(rng.paretovariate(0.8))}"
        rows.append((k * 37 - 500, word, rng.choice([None, 0, 1, 5, 1000]), "x", 1))
    return rows + rng.sample(rows, n // 20)


@pytest.mark.parametrize("seed", [1, 2])
def test_frequencies_against_counting(spark, seed, monkeypatch):
    monkeypatch.setattr(terms, "GATHER", 500)
    rows = rows_of(seed)
    want = {}
    for _, word, n, *_ in set(rows):
        o, r = want.get(word, (0, 0))
        want[word] = (o + (n or 0), r + 1)
    got = {r.term: (r.occurrences, r.records) for r in terms.term_frequencies(table(spark, rows), "word", "row_id", "word_count").collect()}
    assert got == want


def test_bitmaps_beyond_arrays(spark):
    rows = [(k, "hot", 1, "", 0) for k in range(70_000)] + [(k, "hot", 1, "", 0) for k in range(0, 70_000, 7)] + [(5, "cold", 2, "", 0)]
    df = table(spark, rows).repartition(4)
    kept = terms.term_bitmaps(df, "word", "row_id", "word_count").collect()
    assert sorted((r.kl_term, r.kl_chunk, r.kl_n, len(r.kl_ids)) for r in kept) == [("cold", 0, 1, 2), ("hot", 0, 65_536, 8192), ("hot", 1, 4464, 8192)]
    assert {r.term: (r.occurrences, r.records) for r in terms.term_frequencies(df, "word", "row_id", "word_count").collect()} == {"hot": (70_000, 70_000), "cold": (2, 1)}


def test_nulls_and_empty(spark):
    rows = [(None, "a", 3, "", 0), (None, "a", 4, "", 0), (1, "a", None, "", 0), (2, None, 5, "", 0), (3, "", 1, "", 0)]
    got = {r.term: (r.occurrences, r.records, r.verdict) for r in terms.term_verdicts(table(spark, rows), "word", "row_id", "word_count").collect()}
    assert got == {"a": (7, 1, "common"), "": (1, 1, "common")}
    assert terms.term_verdicts(table(spark, rows).limit(0), "word", "row_id", "word_count").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_heavy_against_sums(spark, seed):
    rows = rows_of(seed)
    total, sums = 0, {}
    for _, word, n, *_ in set(rows):
        total += n or 0
        if word is not None:
            sums[word] = sums.get(word, 0) + (n or 0)
    want = {w: n for w, n in sums.items() if n >= 0.01 * total}
    got = heavy.heavy_items(table(spark, rows), "word", "row_id", "word_count", 0.01).collect()
    assert {r["item"]: r.weight for r in got} == want and all(r.approx_weight >= r.weight for r in got)


def test_heavy_sketch_is_linear_and_exact_beyond_doubles():
    a, b = (np.zeros((4, 1024, heavy.BITS + 1), np.int64) for _ in range(2))
    rng = np.random.default_rng(1)
    prints, weights = rng.integers(0, 2**32, 5000).astype(np.uint32), rng.integers(0, 50, 5000)
    heavy._add(a, prints, weights)
    heavy._add(b, prints[:2500], weights[:2500])
    heavy._add(b, prints[2500:], weights[2500:])
    assert (a == b).all()
    heavy._add(a, np.array([7], np.uint32), np.array([2**60]))
    assert heavy.decode(a, 2**59)[7] >= 2**60


def test_heavy_edges(spark):
    rows = [(1, None, 100, "", 0), (2, "a", 100, "", 0), (2, "a", 100, "", 0), (3, "b", 100, "", 0), (4, "c", None, "", 0), (None, "d", 50, "", 0)]
    got = {r["item"]: r.weight for r in heavy.heavy_items(table(spark, rows), "word", "row_id", "word_count", 0.25).collect()}
    assert got == {"a": 100, "b": 100}
    assert heavy.heavy_items(table(spark, rows).limit(0), "word", "row_id", "word_count").count() == 0


@pytest.mark.parametrize("planes", [False, True])
def test_packed_arrays_come_back(planes):
    own = [np.arange(5), np.zeros(0, np.uint8), np.arange(300, dtype=np.uint16), np.frombuffer(b"abc", np.uint8), np.zeros(0, np.int64), np.array([-(2**62), 2**62])]
    back = packing.unpack(packing.pack(*own, planes=planes))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(own, back)) and len(back) == len(own)
    assert packing.narrow(np.array([0, 255])).dtype == np.uint8 and packing.narrow(np.array([256])).dtype == np.uint16 and len(packing.narrow(np.zeros(0, np.int64))) == 0
