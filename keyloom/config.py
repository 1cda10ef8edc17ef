"""Settings as plain data: weights, key proximity, sessions, lexicon filters and syllable rules, read from JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

#: Start-of-sentence token; its number in dictionary files is the negative of its byte.
SOS = "\u0002"
SOS_ID = -2
WORD, SHORTCUT = 1, -1
SPELL, SUGGEST = "proximity_without_self", "proximity_or_prefix"


@dataclass(frozen=True)
class Lookup:
    """Costs of the fuzzy search; the defaults are the published ones."""

    max_cost: float = 1.5
    equal: float = 0.0
    equal_ignoring_case: float = 0.25
    insert: float = 0.5
    insert_start: float = 1.0
    delete: float = 0.5
    delete_start: float = 1.0
    substitute: float = 0.5
    substitute_near: float = 0.25
    substitute_start: float = 1.0
    transpose: float = 0.0

    def reach(self) -> int | None:
        """Greatest difference in length of two words within ``max_cost``; None where insertions may be free."""
        least = min(self.insert, self.insert_start, self.delete, self.delete_start)
        return int(self.max_cost / least) if least > 0 else None


_LOOKUP_NAMES = {
    "maxCostSum": "max_cost", "costIsEqual": "equal", "costIsEqualIgnoringCase": "equal_ignoring_case", "costInsert": "insert", "costInsertStartOfStr": "insert_start",
    "costDelete": "delete", "costDeleteStartOfStr": "delete_start", "costSubstitute": "substitute", "costSubstituteInProximity": "substitute_near",
    "costSubstituteStartOfStr": "substitute_start", "costTranspose": "transpose",
}


@dataclass(frozen=True)
class Training:
    """What a use adds to a word's score, and what it takes from all others."""

    bonus: int = 128
    reduction: int = 1


@dataclass(frozen=True)
class Session:
    """One user's setting: locales, dictionaries, weights and the neighbours of keys."""

    primary_locale: str = "en-US"
    secondary_locales: tuple[str, ...] = ()
    base_dictionaries: tuple[str, ...] = ()
    user_dictionary: str = ""
    lookup: Lookup = Lookup()
    training: Training = Training()
    near_enabled: bool = False
    near: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)

    @classmethod
    def from_json(cls, text: str) -> Session:
        """Reads a session; absent parts keep their defaults, unknown ones are passed over."""
        raw = json.loads(text)
        weights, near = raw.get("predictionWeights", {}), raw.get("keyProximityChecker", {})
        training = weights.get("training", {})
        return cls(
            raw.get("primaryLocale", "en-US"),
            tuple(raw.get("secondaryLocales", ())),
            tuple(raw.get("baseDictionaries", ())),
            raw.get("userDictionary", ""),
            Lookup(**{_LOOKUP_NAMES[k]: float(v) for k, v in weights.get("lookup", {}).items() if k in _LOOKUP_NAMES}),
            Training(int(training.get("usageBonus", 128)), int(training.get("usageReductionOthers", 1))),
            bool(near.get("enabled", False)),
            {k: tuple(v) for k, v in near.get("mapping", {}).items()},
        )

    def to_json(self) -> str:
        back = {v: k for k, v in _LOOKUP_NAMES.items()}
        return json.dumps(
            {
                "primaryLocale": self.primary_locale,
                "secondaryLocales": list(self.secondary_locales),
                "baseDictionaries": list(self.base_dictionaries),
                "userDictionary": self.user_dictionary,
                "predictionWeights": {
                    "lookup": {back[k]: v for k, v in asdict(self.lookup).items()},
                    "training": {"usageBonus": self.training.bonus, "usageReductionOthers": self.training.reduction},
                },
                "keyProximityChecker": {"enabled": self.near_enabled, "mapping": {k: list(v) for k, v in self.near.items()}},
            },
            ensure_ascii=False,
        )

    @property
    def near_keys(self) -> dict[str, tuple[str, ...]]:
        """Neighbours by dictionary character; none where the check is off."""
        return dict(self.near) if self.near_enabled else {}


@dataclass(frozen=True)
class Rules:
    """What makes a lexicon word match: a pattern of the whole word, a tag, or a category."""

    words: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()


@dataclass(frozen=True)
class LexiconFilter:
    name: str = "root"
    excluded: Rules = Rules(tags=("obsolete", "misspelling", "morpheme"))
    offensive: Rules = Rules(tags=("offensive", "vulgar"))


@dataclass(frozen=True)
class LexiconConfig:
    project_words: tuple[str, ...] = ()
    filters: tuple[LexiconFilter, ...] = (LexiconFilter(),)

    @classmethod
    def from_json(cls, text: str) -> LexiconConfig:
        raw = json.loads(text)
        rules = lambda x: Rules(tuple(x["words"]), tuple(x["tags"]), tuple(x["categories"]))
        return cls(tuple(raw["projectSpecificWords"]), tuple(LexiconFilter(f["name"], rules(f["excluded"]), rules(f["offensive"])) for f in raw["filters"]))

    def filter(self, name: str) -> LexiconFilter:
        """The filter of a name, else ``root``, else one that matches nothing."""
        known = {f.name: f for f in self.filters}
        return known.get(name) or known.get("root") or LexiconFilter("", Rules(), Rules())


def read_text(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


@dataclass(frozen=True)
class Flags:
    """A request's flags, packed into one integer: count (8 bits), n-gram level (4), two shift states (2 each), and
    whether offensive and hidden words are allowed and the session is private."""

    count: int = 8
    level: int = 2
    start_shift: int = 0
    cursor_shift: int = 0
    offensive: bool = False
    hidden: bool = False
    private: bool = False

    def pack(self) -> int:
        parts = (self.count & 255, (self.level & 15) << 8, (self.start_shift & 3) << 12, (self.cursor_shift & 3) << 14)
        return sum(parts) | self.offensive << 16 | self.hidden << 17 | self.private << 18

    @classmethod
    def unpack(cls, n: int) -> Flags:
        return cls(n & 255, n >> 8 & 15, n >> 12 & 3, n >> 14 & 3, bool(n >> 16 & 1), bool(n >> 17 & 1), bool(n >> 18 & 1))
