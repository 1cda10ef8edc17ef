"""Syllables by division rules: literals, generators of character sets, back-references and hyphens for cuts.

Rules are tried in their order; a literal that fits says of each of its inner places whether to cut there or never to,
and holds unless it contradicts what an earlier one said.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql.functions import pandas_udf

EDGE = "#"
_PART = re.compile(r"<(?P<back>\\\d{1,2})>|<(?P<set>[A-Za-z0-9]+)>|(?P<cut>-+)|(?P<text>[^<-]+)")
_PART_COMPAT = re.compile(r"<(?P<back>\\\d{1,2})>|<(?P<set>[A-Za-z0-9]+)>|(?P<cut>-+)|(?P<text>[^<\\]+)")


@dataclass(frozen=True)
class Pattern:
    text: str
    cuts: frozenset[int]


def expand(token: str, sets: dict[str, tuple[str, ...]], compat: bool = False) -> list[Pattern]:
    """All literals of a rule's token. With ``compat`` a hyphen behind a letter is a letter of the literal."""
    parts, at = [], 0
    for m in (_PART_COMPAT if compat else _PART).finditer(token):
        if m.start() != at:
            raise ValueError(f"rule {token!r} can't be read at {at}")
        parts.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if at != len(token):
        raise ValueError(f"rule {token!r} can't be read at {at}")
    names = [v for k, v in parts if k == "set"]
    if missing := [n for n in names if n not in sets]:
        raise ValueError(f"no character set {missing[0]!r}")
    out = []
    for chosen in product(*(sets[n] for n in names)):
        text, cuts, k = "", set(), 0
        for kind, value in parts:
            if kind == "cut":
                cuts.add(len(text))
            elif kind == "set":
                text, k = text + chosen[k], k + 1
            elif kind == "back":
                text += chosen[int(value[1:]) - 1]
            else:
                text += value
        out.append(Pattern(text, frozenset(cuts)))
    return out


def compile_rules(rules: str | dict, compat: bool = False) -> list[Pattern]:
    """The literals of a rule file (its JSON, or what that holds), in order. Both edges of a word are sets of one sign."""
    raw = json.loads(rules) if isinstance(rules, str) else rules
    sets = {"SOW": (EDGE,), "EOW": (EDGE,)} | {s["shorthand"]: tuple(s["values"]) for s in raw["characterSets"]}
    return [p for rule in raw["divisionRules"] for token in rule["tokens"] for p in expand(token, sets, compat)]


def divide(word: str, patterns: list[Pattern]) -> list[str]:
    """Syllables of a word; an empty word is one empty syllable."""
    whole = f"{EDGE}{word}{EDGE}"
    decided: dict[int, bool] = {}
    for p in patterns:
        at = whole.find(p.text) if p.text else -1
        while at >= 0:
            says = {at + k: True for k in p.cuts} | {at + k: False for k in range(1, len(p.text)) if k not in p.cuts}
            if all(decided.get(k, v) == v for k, v in says.items()):
                decided |= says
            at = whole.find(p.text, at + len(p.text))
    cuts = [0, *(k for k in range(1, len(word)) if decided.get(k + 1)), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])] if word else [""]


def divider(patterns: list[Pattern]):
    """Column function: a word's syllables; null for null."""

    @pandas_udf("array<string>")
    def syllables(words: pd.Series) -> pd.Series:
        known = {w: divide(w, patterns) for w in words.dropna().unique()}
        return words.map(known.get)

    return syllables
