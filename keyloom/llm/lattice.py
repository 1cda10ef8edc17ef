"""Lattices: all texts that a text may stand for, as paths through its places, and ways to take some of them out."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

#: Marks of a path: something besides the reading was changed, a capital was put back.
CHANGED, CAPITAL = 1, 2


class Lattice:
    """Edges (character, next node, marks) by node; every edge leads to a later node, and texts end at the last ones."""

    def __init__(self, edges: list[list[tuple[str, int, int]]], ends: frozenset[int]):
        ways = [0] * len(edges)
        for k in range(len(edges) - 1, -1, -1):  # paths that reach an end; what reaches none leaves
            edges[k] = [e for e in edges[k] if ways[e[1]]]
            ways[k] = (k in ends) + sum(ways[e[1]] for e in edges[k])
        self.edges, self.ends, self.count = edges, ends, ways[0]

    def lower_start(self, letters: frozenset[str]) -> None:
        """Lets a text begin with the capital of its first letter."""
        more = [(up, end, marks | CAPITAL) for c, end, marks in self.edges[0] if c.islower() and len(up := c.upper()) == 1 and up in letters]
        self.edges[0] = self.edges[0] + more

    def all(self) -> Iterator[tuple[str, int]]:
        stack = [("", 0, 0)]
        while stack:
            out, at, marks = stack.pop()
            if at in self.ends:
                yield out, marks
            stack.extend((out + c, end, marks | m) for c, end, m in self.edges[at])

    def along(self, words: list[str]) -> Iterator[tuple[str, int]]:
        """All paths that are one of the sorted words: beginnings that no word has are left at once."""
        live: dict[int, dict[tuple[str, int], None]] = {0: {("", 0): None}}
        for at in range(len(self.edges)):
            held = live.pop(at, {})
            for out, marks in held:
                if at in self.ends and (k := bisect_left(words, out)) < len(words) and words[k] == out:
                    yield out, marks
                for c, end, m in self.edges[at]:
                    longer = out + c
                    if (k := bisect_left(words, longer)) < len(words) and words[k].startswith(longer):
                        live.setdefault(end, {})[longer, marks | m] = None

    def best(self, pairs: dict[str, float], most: int) -> Iterator[tuple[str, int]]:
        """The ``most`` best paths by the scores of character pairs (a Viterbi search that keeps as many a node and sign)."""
        live: dict[int, dict[str, list[tuple[float, str, int]]]] = {0: {"\n": [(0.0, "", 0)]}}
        done: list[tuple[float, str, int]] = []
        for at in range(len(self.edges)):
            for last, held in live.pop(at, {}).items():
                held = sorted(held, reverse=True)[:most]
                if at in self.ends:
                    done.extend((x + pairs.get(last + "\n", -12.0), out, marks) for x, out, marks in held)
                for c, end, m in self.edges[at]:
                    gain = pairs.get(last + c, -12.0)
                    live.setdefault(end, {}).setdefault(c, []).extend((x + gain, out + c, marks | m) for x, out, marks in held)
        for _, out, marks in sorted(done, reverse=True)[:most]:
            yield out, marks
