import random

import numpy as np
import pytest

from keyloom.config import SPELL, SUGGEST, Lookup
from keyloom.operators import fuzzy
from keyloom.operators.fuzzy import fuzzy_matches, score_pairs

# typed, word, cost and way without prefixes, with prefixes (None: not found)
GOLDEN = [
    ("helo", "hello", (0.5, False), (0.5, True)), ("hello", "helo", (0.5, False), (0.5, False)), ("teh", "the", (0.5, False), (0.5, False)), ("eth", "the", None, None),
    ("hte", "the", (1.0, False), (1.0, False)), ("jello", "hello", (1.0, False), (1.0, False)), ("Hello", "hello", (0.25, False), (0.25, False)), ("hel", "hello", (1.0, False), (0.0, True)),
    ("wrold", "world", (0.5, False), (0.5, False)), ("ab", "ba", (1.0, False), (1.0, False)), ("kitten", "sitting", None, None), ("abc", "babc", None, None), ("", "the", (1.5, False), (0.0, True)),
]


@pytest.mark.parametrize("mode", [0, 1])
def test_golden(mode):
    cost, via = score_pairs([g[0] for g in GOLDEN], [g[1] for g in GOLDEN], Lookup(), {}, bool(mode))
    assert [None if np.isnan(c) else (c, bool(v)) for c, v in zip(cost, via)] == [g[2 + mode] for g in GOLDEN]


def plain(w, c, x, near, prefixes):
    """One pair by the definition, row by row."""
    n, m = len(w), len(c)
    ins = lambda t: x.insert_start if t == 1 else x.insert
    dele = lambda t: x.delete_start if t == 1 else x.delete
    sub = lambda t: x.substitute_start if t == 1 else x.substitute
    opp = lambda s: s.upper() if s != s.upper() else s.lower()
    d = [[i * ins(i) for i in range(n + 1)]]
    for t in range(1, m + 1):
        row = [t * ins(t)]
        for i in range(1, n + 1):
            if c[t - 1] == w[i - 1]:
                s = x.equal
            elif c[t - 1] == opp(w[i - 1]):
                s = x.equal_ignoring_case
            elif t > 1 and i > 1 and c[t - 2] == w[i - 1] and c[t - 1] == w[i - 2]:
                s = x.transpose
            elif w[i - 1] in near.get(c[t - 1], ()):
                s = x.substitute_near
            else:
                s = sub(t)
            row.append(min(d[t - 1][i] + ins(t), row[i - 1] + dele(t), d[t - 1][i - 1] + s))
        d.append(row)
    same = n == 0 or (m > 0 and c[0] in (w[0], opp(w[0])))
    prefix = lambda t: prefixes and t > n and same and d[n][n] <= x.max_cost
    dead = lambda t: (d[t][t] if t < n else d[t][n]) >= x.max_cost
    if m == 0 or not all(prefix(t) or not dead(t) for t in range(m)):
        return None
    if prefix(m):
        return d[n][n], True
    return (d[m][n], False) if d[m][n] <= x.max_cost else None


@pytest.mark.parametrize("prefixes", [False, True])
@pytest.mark.parametrize("near", [{}, {"a": ("b", "c"), "d": ("a",)}])
def test_against_the_definition(prefixes, near):
    rng = random.Random(7)
    word = lambda least: "".join(rng.choice("abcdAB") for _ in range(rng.randint(least, 7)))
    pairs = [(word(0), word(1)) for _ in range(4000)]
    for x in (Lookup(), Lookup(max_cost=2.0, delete=0.75, transpose=0.25, insert_start=0.75)):
        cost, via = score_pairs([a for a, _ in pairs], [b for _, b in pairs], x, near, prefixes)
        got = [None if np.isnan(c) else (c, bool(v)) for c, v in zip(cost, via)]
        assert got == [plain(a, b, x, near, prefixes) for a, b in pairs]


@pytest.mark.parametrize("prefixes", [False, True])
@pytest.mark.parametrize("near", [{}, {"a": ("b", "c"), "d": ("a",)}])
def test_the_walk_finds_what_pairs_find(prefixes, near, monkeypatch):
    monkeypatch.setattr(fuzzy, "HELD_ROWS", 150)
    rng = random.Random(8)
    word = lambda least: "".join(rng.choice(["a", "b", "c", "d", "A", "é", "e\u0301"]) for _ in range(rng.randint(least, 7)))
    typed, words = sorted({word(0) for _ in range(50)} | {""}), sorted({word(0) for _ in range(120)} | {""})
    for x in (Lookup(), Lookup(max_cost=2.0, delete=0.75, transpose=0.25, insert_start=0.75), Lookup(max_cost=0.5), Lookup(max_cost=0), Lookup(insert=0, insert_start=0, delete=0)):
        got = list(zip(*fuzzy.Tree(words).walk(typed, x, near, prefixes)))
        assert len({(q, w) for q, w, *_ in got}) == len(got)
        every = {(q, w): plain(fuzzy.signs_of(t), fuzzy.signs_of(c), x, near, prefixes) for q, t in enumerate(typed) for w, c in enumerate(words)}
        assert {(q, w): (c, bool(v)) for q, w, c, v in got} == {k: v for k, v in every.items() if v}
    assert len(fuzzy.Tree([]).walk(["a", ""], Lookup(), near, prefixes)[0]) == 0 and len(fuzzy.Tree(["a"]).walk([], Lookup(), near, prefixes)[0]) == 0


@pytest.mark.parametrize("mode", [SPELL, SUGGEST])
@pytest.mark.parametrize("held", [16_000_000, 0])
def test_blocks_lose_nothing(spark, mode, held, monkeypatch):
    monkeypatch.setattr(fuzzy, "BROADCAST_BYTES", held)
    monkeypatch.setattr(fuzzy, "TREE_WORDS", 70)
    monkeypatch.setattr(fuzzy, "ASKED_WORDS", 7)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcAé") for _ in range(rng.randint(1, 9)))
    typed, words = sorted({word() for _ in range(60)}), sorted({word() for _ in range(200)})
    asked = [*enumerate(typed), *((k + 1000, typed[0]) for k in range(30))]
    left = spark.createDataFrame(asked, "query_id BIGINT, raw_word STRING")
    right = spark.createDataFrame([(w, 7) for w in words], "text STRING, kl_typed INT")
    found = fuzzy_matches(left, right.withColumnRenamed("kl_typed", "cost_centre"), mode=mode).collect()
    got = {(r.query_id, r.text): (r.cost, r.via_prefix) for r in found}
    every = {(k, w): plain(t, w, Lookup(), {}, mode == SUGGEST) for k, t in asked for w in words}
    assert got == {k: v for k, v in every.items() if v} and len(found) == len(got)


def test_the_best_below_a_prefix(spark):
    rng = random.Random(4)
    words = [(w, rng.choice([0.0, 0.1, 0.2, 0.3]), rng.random() < 0.2, rng.random() < 0.2) for w in sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(300)})]
    left = spark.createDataFrame([(1, "a"), (2, "ab"), (3, "b"), (4, "")], "query_id BIGINT, raw_word STRING")
    right = spark.createDataFrame(words, "text STRING, frequency DOUBLE, is_possibly_offensive BOOLEAN, is_hidden BOOLEAN")
    best = {}
    for top in (0, 3):
        for r in fuzzy_matches(left, right, top=top).collect():
            merit = -fuzzy_confidence(r.cost, r.via_prefix, left_word[r.query_id], r.text, r.frequency)
            if r.frequency > 0:
                best.setdefault((top, r.query_id, r.is_possibly_offensive, r.is_hidden), []).append((merit, r.text))
    for (top, *key), found in best.items():
        if top == 0:
            assert sorted(found)[:3] == sorted(best[(3, *key)])[:3]


left_word = {1: "a", 2: "ab", 3: "b", 4: ""}


def fuzzy_confidence(cost, via, typed, word, frequency):
    return (1.0 - cost / (max(1, len(typed)) if via else max(len(typed), len(word))) + 0.1 * frequency) / 1.1


def test_pairs_within_a_context(spark):
    left = spark.createDataFrame([(1, "x", "ab"), (2, "x", ""), (3, "y", "ab"), (4, None, "ab")], "query_id BIGINT, head STRING, raw_word STRING")
    right = spark.createDataFrame([("x", "abc"), ("x", "zz"), ("y", ""), ("y", None), (None, "ab")], "head STRING, text STRING")
    got = lambda mode: {(r.query_id, r.text, r.cost, r.via_prefix) for r in fuzzy_matches(left, right, mode=mode, on=("head",)).collect()}
    assert got(SUGGEST) == {(1, "abc", 0.0, True), (1, "zz", 1.5, False), (2, "abc", 0.0, True), (2, "zz", 0.0, True)}
    assert got(SPELL) == {(1, "abc", 0.5, False), (1, "zz", 1.5, False), (2, "abc", 1.5, False), (2, "zz", 1.0, False)}


def test_nulls_and_empty_tables(spark):
    left = spark.createDataFrame([(1, None), (2, "ab")], "query_id BIGINT, raw_word STRING")
    right = spark.createDataFrame([(None,), ("ab",)], "text STRING")
    assert [(r.query_id, r.text) for r in fuzzy_matches(left, right).collect()] == [(2, "ab")]
    assert fuzzy_matches(left, right.limit(0)).count() == 0 and fuzzy_matches(left.limit(0), right).count() == 0
