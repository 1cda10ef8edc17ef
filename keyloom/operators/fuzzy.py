"""Fuzzy search: every typed word against the dictionary words it may stand for.

The scorer is a weighted edit distance whose dead ends belong to its meaning: a dictionary word is found only if the
distance stays below the limit along the whole of it. A row of the distance matrix depends on the beginning of the
dictionary word only, so blocks of the dictionary become prefix trees that are walked level by level, all typed words of
a block at once: a dead end takes the whole branch with it, and everything below a typed prefix is one run of words.
Within a known context, where few words can follow, pairs are scored one by one instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from keyloom.config import SUGGEST, Lookup
from keyloom.functions.text import graphemes
from keyloom.session import BROADCAST_BYTES

SCORE = "cost DOUBLE, via_prefix BOOLEAN"
#: Rows of the distance matrix that all pairs are tried on before the whole of it.
EARLY = 3
#: Words in a block of the dictionary and of the requests, and rows of the distance matrix held at once in a walk.
TREE_WORDS, ASKED_WORDS, HELD_ROWS = 50_000, 1_000, 200_000


def signs_of(text: str) -> list[str]:
    if text.isascii():
        return list(text)
    import regex

    return regex.findall(r"\X", text)


def _opposite(sign: str) -> str:
    return sign.upper() if sign.upper() != sign else sign.lower()


def _coded(texts: list[str], code: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the signs from column 1 on, lengths); new signs are numbered in ``code``, -1 stands beyond the end."""
    signs = [signs_of(x) for x in texts]
    sizes = np.array([len(x) for x in signs], np.int64)
    table = np.full((len(signs), int(sizes.max(initial=0)) + 1), -1, np.int64)
    for k, x in enumerate(signs):
        table[k, 1 : len(x) + 1] = [code.setdefault(s, len(code)) for s in x]
    return table, sizes


def _relations(code: dict[str, int], near: dict[str, tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray | None]:
    """(number of each sign in its other case, matrix of neighbouring keys or None where there are none)."""
    for s in list(code):
        code.setdefault(_opposite(s), len(code))
    other = np.array([code.get(_opposite(s), -1) for s in code] + [-1], np.int64)
    if not near:
        return other, None
    beside = np.zeros((len(code) + 1, len(code) + 1), bool)
    for s, keys in near.items():
        for k in keys:
            if s in code and k in code:
                beside[code[s], code[k]] = True
    return other, beside


def _first_row(rows: int, columns: int, lookup: Lookup) -> np.ndarray:
    return np.tile(np.array([i * (lookup.insert_start if i == 1 else lookup.insert) for i in range(columns + 1)]), (rows, 1))


def _next_row(before: np.ndarray, typed: np.ndarray, sign: np.ndarray, back: np.ndarray, t: int, lookup: Lookup, other: np.ndarray, beside: np.ndarray | None) -> np.ndarray:
    """Row ``t`` of the distance matrices from the row before; ``sign`` and ``back`` are the word's signs t and t - 1."""
    insert, delete, substitute = (lookup.insert_start, lookup.delete_start, lookup.substitute_start) if t == 1 else (lookup.insert, lookup.delete, lookup.substitute)
    now = np.empty_like(before)
    now[:, 0] = t * insert
    for i in range(1, before.shape[1]):
        w = typed[:, i]
        step = np.full(len(w), substitute)
        if beside is not None:
            step[beside[sign, w]] = lookup.substitute_near
        if t > 1 and i > 1:
            step[(back == w) & (sign == typed[:, i - 1])] = lookup.transpose
        step[sign == other[w]] = lookup.equal_ignoring_case
        step[sign == w] = lookup.equal
        now[:, i] = np.minimum(np.minimum(before[:, i] + insert, now[:, i - 1] + delete), before[:, i - 1] + step)
    return now


def _next_band(before: np.ndarray, typed: np.ndarray, asked: np.ndarray, sign: np.ndarray, back: np.ndarray, t: int, lookup: Lookup, other: np.ndarray, beside: np.ndarray | None) -> np.ndarray:
    """As ``_next_row``, for the cells beside the diagonal only: column j stands for cell t - reach + j of row t.

    A cell further from the diagonal than the reach costs more than the limit, and no cell within the limit goes back to
    one beyond it, so these cells count as infinite.
    """
    insert, delete, substitute = (lookup.insert_start, lookup.delete_start, lookup.substitute_start) if t == 1 else (lookup.insert, lookup.delete, lookup.substitute)
    wide, reach = typed.shape[1] - 1, before.shape[1] // 2
    now = np.full_like(before, np.inf)
    last = None
    for j in range(max(0, reach - t), min(2 * reach, wide + reach - t) + 1):
        i = t - reach + j
        if i == 0:
            now[:, j] = t * insert
            continue
        w = typed[asked, i]
        step = np.full(len(w), substitute)
        if beside is not None:
            step[beside[sign, w]] = lookup.substitute_near
        if t > 1 and i > 1:
            step[(back == w) & (sign == (typed[asked, i - 1] if last is None else last))] = lookup.transpose
        step[sign == other[w]] = lookup.equal_ignoring_case
        step[sign == w] = lookup.equal
        step += before[:, j]
        if j < 2 * reach:
            np.minimum(step, before[:, j + 1] + insert, out=step)
        if j:
            np.minimum(step, now[:, j - 1] + delete, out=step)
        now[:, j], last = step, w
    return now


class Tree:
    """Distinct words as a prefix tree in arrays. The words lie sorted by their signs, so a node's words are one run."""

    def __init__(self, words: list[str]):
        self.code: dict[str, int] = {}
        table, size = _coded(words, self.code)
        order = np.lexsort(table.T[::-1]) if len(words) else np.zeros(0, np.int64)
        self.order, table, size = order, table[order], size[order]
        self.levels = []
        above, nodes = np.zeros(len(words), np.int64), 1
        for t in range(1, table.shape[1]):
            rows = np.flatnonzero(size >= t)
            node, sign = above[rows], table[rows, t]
            fresh = np.append(True, (node[1:] != node[:-1]) | (sign[1:] != sign[:-1]))
            heads = rows[fresh]
            number = np.cumsum(fresh) - 1
            ends = np.append(rows[np.flatnonzero(fresh)[1:] - 1], rows[-1]) + 1
            own = np.full(len(heads), -1, np.int64)
            whole = size[rows] == t
            own[number[whole]] = rows[whole]
            begin = np.searchsorted(above[heads], np.arange(nodes + 1))
            self.levels.append((begin, table[heads, t], table[heads, t - 1], own, heads, ends))
            above = np.full(len(words), -1, np.int64)
            above[rows], nodes = number, len(heads)
        self.filled = int((size == 0).sum())  # empty words are in front and never found

    def walk(self, typed: list[str], lookup: Lookup, near: dict[str, tuple[str, ...]], prefixes: bool, pick=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(typed, word, cost, via_prefix) of all matches, the first two as places in ``typed`` and the tree's words.

        ``pick(first, last, cost, signs)`` chooses among the sorted words ``first`` to ``last`` below a typed prefix;
        without it all of them come out.
        """
        code = dict(self.code)
        left, n = _coded(typed, code)
        other, beside = _relations(code, near)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        limit, count = lookup.max_cost, len(self.order)

        def runs(asked: np.ndarray, first: np.ndarray, last: np.ndarray, cost: np.ndarray) -> None:
            for q, a, b, c in zip(asked.tolist(), first.tolist(), last.tolist(), cost.tolist()):
                rows = pick(a, b, c, int(n[q])) if pick else np.arange(a, b)
                if len(rows):
                    found.append((np.full(len(rows), q), rows, np.full(len(rows), c), np.ones(len(rows), bool)))

        asked = np.arange(len(typed)) if limit > 0 and count else np.zeros(0, np.int64)
        if prefixes and len(empty := asked[n[asked] == 0]):
            runs(empty, np.full(len(empty), self.filled), np.full(len(empty), count), np.zeros(len(empty)))
            asked = asked[n[asked] > 0]
        reach = max(left.shape[1] - 1, len(self.levels))
        if lookup.reach() is not None:
            reach = min(reach, lookup.reach())
        start = np.full((len(asked), 2 * reach + 1), np.inf)
        start[:, reach:] = _first_row(len(asked), reach, lookup)
        stack = [(0, asked, np.zeros(len(asked), np.int64), start, np.zeros(len(asked), bool))]
        while stack:
            t, asked, node, row, first = stack.pop()
            if t == len(self.levels) or not len(asked):
                continue
            begin, signs, backs, own, heads, ends = self.levels[t]
            counts = begin[node + 1] - begin[node]
            if counts.sum() > HELD_ROWS and len(asked) > 1:
                half = len(asked) // 2
                stack += [(t, asked[x], node[x], row[x], first[x]) for x in (slice(half, None), slice(half))]
                continue
            at = np.repeat(np.arange(len(asked)), counts)
            child = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts - begin[node], counts)
            t, asked, first = t + 1, asked[at], first[at]
            size = n[asked]
            now = _next_band(row[at], left, asked, signs[child], backs[child], t, lookup, other, beside)
            if t == 1 and left.shape[1] > 1:
                w = left[asked, 1]
                first = ((signs[child] == w) | (signs[child] == other[w])) & (size > 0)
            place = size - t + reach  # of the cell at the typed word's end
            whole = np.where(abs(size - t) <= reach, now[np.arange(len(asked)), np.clip(place, 0, 2 * reach)], np.inf)
            hit = np.flatnonzero((own[child] >= 0) & (whole <= limit))
            found.append((asked[hit], own[child[hit]], whole[hit], np.zeros(len(hit), bool)))
            on = np.where(t < size, now[:, reach], whole) < limit
            if prefixes:
                below = np.flatnonzero(on & first & (size == t))
                runs(asked[below], heads[child[below]] + (own[child[below]] >= 0), ends[child[below]], whole[below])
                on[below] = False
            stack.append((t, asked[on], child[on], now[on], first[on]))
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)]
        return parts[0], self.order[parts[1]], parts[2], parts[3]


def score_pairs(typed: list[str], words: list[str], lookup: Lookup, near: dict[str, tuple[str, ...]], prefixes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(cost, via_prefix) of pairs; the cost is NaN where the word isn't found.

    Rows of the distance matrix walk the dictionary word. The costs at the start of a word hold for its first row, and
    for the first cell of the row before it. A pair leaves as soon as its row is a dead end.
    """
    count = len(typed)
    code: dict[str, int] = {}

    def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        which, distinct = pd.factorize(np.array(texts, object))  # each distinct text is read once
        table, sizes = _coded(list(distinct), code)
        return table[which], sizes[which]

    left, n = coded(typed)
    right, m = coded(words)
    wide, deep = left.shape[1] - 1, right.shape[1] - 1
    other, beside = _relations(code, near)
    alive = (m > 0) & (lookup.max_cost > 0)
    # Most pairs end within their first signs: a dead end there depends on as many columns as rows.
    few = min(wide, deep, EARLY)
    row = _first_row(count, few, lookup)
    for t in range(1, few + 1):
        live = np.flatnonzero(alive & (m >= t))
        row[live] = now = _next_row(row[live], left[live, : few + 1], right[live, t], right[live, t - 1], t, lookup, other, beside)
        alive[live[(n[live] > t) & (m[live] > t) & (now[:, t] >= lookup.max_cost)]] = False
    row = np.zeros((count, wide + 1))
    left_ones = np.flatnonzero(alive)
    row[left_ones] = _first_row(len(left_ones), wide, lookup)
    square = np.where(n == 0, 0.0, np.nan)  # the cell at (n, n)
    first = n == 0
    final, through = np.full(count, np.nan), np.zeros(count, bool)
    for t in range(1, deep + 1):
        live = np.flatnonzero(alive & (m >= t))
        if not len(live):
            break
        sign, own = right[live, t], n[live]
        now = _next_row(row[live], left[live], sign, right[live, t - 1], t, lookup, other, beside)
        row[live] = now
        if t == 1 and wide:
            w = left[live, 1]
            first[live] |= ((sign == w) | (sign == other[w])) & (own > 0)
        if t <= wide:
            at = np.flatnonzero(own == t)
            square[live[at]] = now[at, t]
        whole = now[np.arange(len(live)), own]
        by_prefix = (t > own) & first[live] & (square[live] <= lookup.max_cost) if prefixes else np.zeros(len(live), bool)
        found = (m[live] == t) & (by_prefix | (whole <= lookup.max_cost))
        final[live[found]] = np.where(by_prefix, square[live], whole)[found]
        through[live] = by_prefix
        dead = np.where(t < own, now[np.arange(len(live)), np.minimum(t, wide)], whole) >= lookup.max_cost
        alive[live] = by_prefix | ~dead
    return final, through & ~np.isnan(final)


def scorer(lookup: Lookup = Lookup(), near: dict[str, tuple[str, ...]] | None = None, mode: str = SUGGEST):
    """Column function (typed, word) -> struct(cost, via_prefix), null where the word isn't found or an input is null."""
    held = dict(near or {})
    prefixes = mode == SUGGEST

    @pandas_udf(SCORE)
    def score(typed: pd.Series, word: pd.Series) -> pd.DataFrame:
        known = (typed.notna() & word.notna()).to_numpy()
        cost, via = np.full(len(typed), np.nan), np.zeros(len(typed), bool)
        if known.any():
            cost[known], via[known] = score_pairs(typed[known].tolist(), word[known].tolist(), lookup, held, prefixes)
        return pd.DataFrame({"cost": pd.array(cost, dtype="Float64"), "via_prefix": via})

    return score.asNondeterministic()  # else a filter on its result is pushed below, and it runs twice


def similarity(cost: Column, via_prefix: Column, typed: Column, word: Column) -> Column:
    """1 less the cost for each sign of the longer word, or of the typed one where it is a prefix."""
    n, m = F.size(graphemes(typed)), F.size(graphemes(word))
    return 1.0 - cost / F.when(via_prefix, F.greatest(n, F.lit(1))).otherwise(F.greatest(n, m, F.lit(1)))


def confidence(alike: Column, frequency: Column) -> Column:
    return (alike + 0.1 * frequency) / 1.1


def _packed(size: int, columns: list[str]):
    """Rows of a task gathered into rows of lists, at most ``size`` each, with the number of the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, number = [], 0, TaskContext.get().partitionId() << 32

        def lists(t: pa.Table, number: int) -> pa.RecordBatch:
            ends = pa.array([0, t.num_rows], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.ListArray.from_arrays(ends, pa.concat_arrays(t[c].chunks)) for c in columns)], ["kl_block", *columns])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            while rows >= size:
                t = pa.Table.from_batches(held)
                yield lists(t.slice(0, size), number)
                held, rows, number = t.slice(size).to_batches(), rows - size, number + 1
        if rows:
            yield lists(pa.Table.from_batches(held), number)

    return run


@lru_cache(maxsize=2)
def _tree(words: bytes) -> Tree:
    return Tree(pa.ipc.open_stream(words).read_all()["w"].to_pylist())


def _stream(words: pa.Array) -> bytes:
    t = pa.table({"w": words})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _walked(lookup: Lookup, near: dict[str, tuple[str, ...]], prefixes: bool, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                asked, words, weight, kind = (b.column(c)[k].values for c in ("kl_asked", "kl_words", "kl_weight", "kl_kind"))
                tree = _tree(_stream(words))
                typed = asked.to_pylist()
                pick = None
                if top and prefixes:
                    weights, kinds = weight.to_numpy()[tree.order], kind.to_numpy()[tree.order]
                    texts = np.array(words.to_pylist(), object)[tree.order]

                    @lru_cache(maxsize=10_000)
                    def pick(first: int, last: int, cost: float, signs: int) -> np.ndarray:
                        rows = np.arange(first, last)
                        if len(rows) <= top:
                            return rows
                        merit = (1.0 - cost / max(signs, 1) + 0.1 * weights[first:last]) / 1.1
                        order = np.lexsort((texts[first:last].astype(str), -merit))
                        ranked = kinds[first:last][order]
                        return np.concatenate([rows[order[ranked == x][:top]] for x in np.unique(ranked)])

                q, w, cost, via = tree.walk(typed, lookup, near, prefixes, pick)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(q)), words.take(pa.array(w)), pa.array(cost, pa.float64()), pa.array(via, pa.bool_())], ["kl_typed", "kl_text", "cost", "via_prefix"])

    return run


def tree_matches(requests: DataFrame, words: DataFrame, lookup: Lookup = Lookup(), near: dict | None = None, mode: str = SUGGEST, top: int = 0) -> DataFrame:
    """``kl_typed, kl_text, cost, via_prefix`` of every distinct ``raw_word`` and the ``text`` it may stand for.

    The dictionary is cut into blocks of ``TREE_WORDS`` words and the requests into blocks of ``ASKED_WORDS``; each block
    of requests is walked down the tree of each block of words. The few blocks of a dictionary of proven size are sent
    to all; larger ones meet the requests by an equi-join on the block's number, salted to use all partitions.

    ``top``: of the words below one typed prefix, all of which have the same cost, no more than so many with the best
    confidence come out for each kind of flags (``frequency, is_possibly_offensive, is_hidden`` of ``words``, with a
    frequency above 0 only), as no more of them can be among the best ``top``. 0 keeps all.
    """
    spark = requests.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = words.filter("text IS NOT NULL AND text <> ''")
    if top:
        kind = F.col("is_possibly_offensive").cast("int") + 2 * F.col("is_hidden").cast("int")
        listed = listed.filter("frequency > 0").select(F.col("text").alias("kl_words"), F.col("frequency").alias("kl_weight"), kind.alias("kl_kind"))
    else:
        listed = listed.select(F.col("text").alias("kl_words"), F.lit(0.0).alias("kl_weight"), F.lit(0).alias("kl_kind")).distinct()
    told = listed.agg(F.count("*").alias("n"), F.sum(F.octet_length("kl_words")).alias("bytes")).first()
    pieces = max(1, -(-told.n // TREE_WORDS))
    few = (told.bytes or 0) + 16 * told.n <= BROADCAST_BYTES
    columns = ["kl_words", "kl_weight", "kl_kind"]
    arrays = "kl_words ARRAY<STRING>, kl_weight ARRAY<DOUBLE>, kl_kind ARRAY<INT>"
    # Ids of words are spread over the pieces by hash, so a block's number is its partition.
    blocks = listed.repartition(pieces, "kl_words").mapInArrow(_packed(1 << 31, columns), f"kl_block BIGINT, {arrays}").withColumn("kl_block", F.shiftright("kl_block", 32))
    asked = requests.select(F.col("raw_word").alias("kl_asked")).filter("kl_asked IS NOT NULL").distinct().repartition(spread, "kl_asked")
    lists = asked.mapInArrow(_packed(ASKED_WORDS, ["kl_asked"]), "kl_block BIGINT, kl_asked ARRAY<STRING>").withColumnRenamed("kl_block", "kl_list")
    lists = lists.withColumn("kl_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(pieces - 1).cast("bigint"))))
    if few:
        met = lists.join(F.broadcast(blocks), "kl_block")
    else:
        salts = max(1, -(-spread // pieces))
        salted = blocks.withColumn("kl_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        met = lists.withColumn("kl_salt", F.pmod(F.xxhash64("kl_list"), F.lit(salts))).join(salted, ["kl_block", "kl_salt"])
    return met.select("kl_asked", *columns).mapInArrow(_walked(lookup, dict(near or {}), mode == SUGGEST, top), "kl_typed STRING, kl_text STRING, cost DOUBLE, via_prefix BOOLEAN")


def fuzzy_matches(requests: DataFrame, words: DataFrame, lookup: Lookup = Lookup(), near: dict | None = None, mode: str = SUGGEST, on: tuple[str, ...] = (), top: int = 0) -> DataFrame:
    """Rows of ``requests`` (with ``raw_word``) and ``words`` (with ``text``) that match, with ``cost, via_prefix``.

    ``on``: columns that have to be equal besides; then the pairs of the equi-join are scored, and an empty word is a
    prefix of all without being scored. Otherwise ``tree_matches`` finds the pairs. Nulls on either side match nothing.
    """
    columns = [*requests.columns, *(c for c in words.columns if c not in on)]
    if not on:
        found = tree_matches(requests, words, lookup, near, mode, top)
        held = requests.join(found, requests["raw_word"] == found["kl_typed"]).drop("kl_typed")
        return held.join(words, held["kl_text"] == words["text"]).select(*columns, "cost", "via_prefix")
    pairs = requests.join(words, list(on)).filter("text <> ''")
    free = F.lit(mode == SUGGEST and lookup.max_cost > 0) & (F.col("raw_word") == "")
    scored = pairs.filter(~free).withColumn("kl_score", scorer(lookup, near, mode)("raw_word", "text")).filter("kl_score.cost IS NOT NULL")
    return scored.select(*columns, "kl_score.cost", "kl_score.via_prefix").unionByName(pairs.filter(free).select(*columns, F.lit(0.0).alias("cost"), F.lit(True).alias("via_prefix")))
